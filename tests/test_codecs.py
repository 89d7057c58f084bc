import math
import struct

import pytest
from hypothesis import given, settings
from test_value import values

from recordloom import value as V
from recordloom.codecs import avro, cbor, csv_text, decoder, encoder, json_text, msgpack, protobuf, raw, toml_doc, yaml_doc
from recordloom.errors import AvroError, CborError, CsvError, FormatError, JsonError, MessagePackError, ProtobufError, RawError, TomlError, Unimplemented, YamlError


def s(x):
    return ("s", x)


RECORDS = [V.UNIT, ("b", True), ("m", [(s("a"), ("f64", 2.5))])]

# JSON


def test_json_identity():
    assert b"".join(encoder("json")(json_text.decode(b'null true {"a": 2.5}'))) == b'null\ntrue\n{"a":2.5}\n'


def test_json_framing():
    assert len(list(json_text.decode(b'[1][2] {"a":1}{"a":2}\n\n 3 "x""y"'))) == 7
    stream = json_text.decode(b"1 {")
    assert next(stream) == ("u64", 1)
    with pytest.raises(JsonError):
        next(stream)


@pytest.mark.parametrize("text", [b"NaN", b"Infinity", b"1e999", b"truefalse", b"1x", b'"\\ud800"', b"\xff", b"[1,]", b"{1:2}", b'"\n"', b"01"])
def test_json_rejects(text):
    with pytest.raises(JsonError):
        list(json_text.decode(text))


def test_json_numbers():
    assert list(json_text.decode(b"0 -1 18446744073709551615 18446744073709551616 -9223372036854775808 1.0 -0")) == [("u64", 0), ("i64", -1), ("u64", 2**64 - 1), ("f64", 2.0**64), ("i64", -(2**63)), ("f64", 1.0), ("f64", -0.0)]


def test_json_keeps_order_and_duplicates():
    assert b"".join(encoder("json")(json_text.decode(b'{"b":1,"a":1.0,"a":2}'))) == b'{"b":1,"a":1.0,"a":2}\n'


def test_json_escapes_bytes_and_keys():
    assert json_text.encode(("m", [(("u8", 1), s('"\\/\b\f\n\r\t\x01\x7fé')), (("c", "k"), ("y", b"\x01\xff")), (s("n"), ("f64", math.nan))])) == b'{"1":"\\"\\\\/\\b\\f\\n\\r\\t\\u0001\x7f\xc3\xa9","k":[1,255],"n":null}\n'
    for key in (V.UNIT, ("f64", 1.0), ("b", True), ("q", [])):
        with pytest.raises(JsonError):
            json_text.encode(("m", [(key, V.UNIT)]))


def test_json_indented():
    v = ("m", [(s("a"), ("q", [("u8", 1), ("q", []), ("m", [])])), (s("b"), V.UNIT)])
    assert json_text.encode(v, "indented") == b'{\n  "a": [\n    1,\n    [],\n    {}\n  ],\n  "b": null\n}\n'
    assert json_text.encode(("q", []), "indented") == b"[]\n"


def test_json_readable():
    out = json_text.encode(("m", [(s("k"), ("q", [V.UNIT, ("b", True), ("b", False), ("u8", 1), s("a\n")]))]), "readable").decode()
    assert out == (
        "\x1b[1m{\x1b[0m\n  \x1b[2;34m\"\x1b[0m\x1b[34mk\x1b[0m\x1b[2;34m\"\x1b[0m\x1b[1m: \x1b[0m\x1b[1m[\x1b[0m\n    \x1b[1;2;3;30mnull\x1b[0m\x1b[1m,\x1b[0m\n    \x1b[1;3;32mtrue\x1b[0m"
        "\x1b[1m,\x1b[0m\n    \x1b[1;3;31mfalse\x1b[0m\x1b[1m,\x1b[0m\n    \x1b[34m1\x1b[0m\x1b[1m,\x1b[0m\n    \x1b[2;32m\"\x1b[0m\x1b[32ma\x1b[0m\x1b[2;32m\\n\x1b[0m\x1b[2;32m\"\x1b[0m\n  \x1b[1m]\x1b[0m\n\x1b[1m}\x1b[0m\n"
    )


# CSV and raw


def test_csv_has_no_header_and_keeps_empty_cells():
    assert list(csv_text.decode(b'a,b\n\n"x\ny",""\n,"q""r"\r\n')) == [("q", [s("a"), s("b")]), ("q", [s("x\ny"), s("")]), ("q", [s(""), s('q"r')])]
    with pytest.raises(CsvError):
        list(csv_text.decode(b"a,b\n1\n"))


def test_csv_cells():
    row = ("q", [("b", True), ("i8", -1), ("u64", 2**64 - 1), ("f32", 0.5), ("f64", 2.0), ("c", "x"), s('a"b,\n')])
    assert csv_text.encode(row) == b'true,-1,18446744073709551615,0.5,2,x,"a""b,\n"\n'
    for bad in (V.UNIT, ("y", b""), ("q", []), ("m", [])):
        with pytest.raises(CsvError):
            csv_text.encode(("q", [bad]))
    for record in (V.UNIT, s("x"), ("m", [])):
        with pytest.raises(CsvError):
            csv_text.encode(record)


def test_raw_lines():
    assert [v[1] for v in raw.decode(b"a\nb\r\nc\rd\ne\r\r\n\nlast\r")] == ["a", "b", "c\rd", "e\r", "", "last\r"]
    assert list(raw.decode(b"")) == [] and list(raw.decode(b"\n")) == [s("")]
    with pytest.raises(RawError):
        list(raw.decode(b"\xff\n"))


def test_raw_sink():
    assert raw.encode(s("é")) + raw.encode(("y", b"\xff\x00")) + raw.encode(("c", "x")) == b"\xc3\xa9\n\xff\x00\nx\n"
    for bad in (V.UNIT, ("b", True), ("u8", 1), ("f64", 1.0), ("q", []), ("m", [])):
        with pytest.raises(RawError):
            raw.encode(bad)


# CBOR: vectors of RFC 8949, appendix A


@pytest.mark.parametrize(("hexed", "v"), [("00", ("u8", 0)), ("17", ("u8", 23)), ("1818", ("u8", 24)), ("1903e8", ("u16", 1000)), ("1bffffffffffffffff", ("u64", 2**64 - 1)), ("20", ("i8", -1)), ("3903e7", ("i16", -1000)), ("f4", ("b", False)), ("f6", V.UNIT), ("fb3ff199999999999a", ("f64", 1.1)), ("6161", s("a")), ("62c3bc", s("ü")), ("80", ("q", [])), ("83010203", ("q", [("u8", 1), ("u8", 2), ("u8", 3)])), ("a201020304", ("m", [(("u8", 1), ("u8", 2)), (("u8", 3), ("u8", 4))]))])
def test_cbor_vectors(hexed, v):
    assert list(cbor.decode(bytes.fromhex(hexed))) == [v] and cbor.encode(v).hex() == hexed


@pytest.mark.parametrize(("hexed", "v"), [("f93c00", ("f32", 1.0)), ("fa47c35000", ("f32", 100000.0)), ("4401020304", ("y", b"\x01\x02\x03\x04")), ("5f42010243030405ff", ("y", b"\x01\x02\x03\x04\x05")), ("7f657374726561646d696e67ff", s("streaming")), ("9f018202039f0405ffff", ("q", [("u8", 1), ("q", [("u8", 2), ("u8", 3)]), ("q", [("u8", 4), ("u8", 5)])])), ("bf6161019fff02ff", None), ("c11a514b67b0", ("u32", 1363896240)), ("f7", V.UNIT)])
def test_cbor_decodes(hexed, v):
    if v:
        assert list(cbor.decode(bytes.fromhex(hexed))) == [v]
    else:
        assert next(cbor.decode(bytes.fromhex(hexed)))[0] == "m"


def test_cbor_truncation_and_limits():
    assert [v[1] for v in cbor.decode(b"\x01\x02")] == [1, 2]
    with pytest.raises(CborError):
        list(cbor.decode(b"\x01\x62a"))
    assert list(cbor.decode(b"\x01\x62a", truncated="ignore")) == [("u8", 1)]
    for bad in (b"\x3b" + b"\xff" * 8, b"\xff", b"\x1c", b"\x61\xff", b"\xf8\x20"):
        with pytest.raises(CborError):
            list(cbor.decode(bad))


def test_cbor_bytes_are_integers_unless_asked():
    assert cbor.encode(("y", b"\x01\xff")).hex() == "820118ff" and cbor.encode(("y", b"\x01\xff"), True).hex() == "4201ff"


# MessagePack


@pytest.mark.parametrize(("hexed", "v"), [("05", ("u64", 5)), ("fb", ("i64", -5)), ("ccff", ("u64", 255)), ("d1ff7f", ("i64", -129)), ("cfffffffffffffffff", ("u64", 2**64 - 1)), ("c0", V.UNIT), ("c3", ("b", True)), ("ca3f000000", ("f32", 0.5)), ("cb3ff199999999999a", ("f64", 1.1)), ("a161", s("a")), ("d920" + "61" * 32, s("a" * 32)), ("c40201ff", ("y", b"\x01\xff")), ("9101", ("q", [("u64", 1)])), ("81c0c2", ("m", [(V.UNIT, ("b", False))]))])
def test_messagepack_vectors(hexed, v):
    assert list(msgpack.decode(bytes.fromhex(hexed))) == [v] and msgpack.encode(v).hex() == hexed


def test_messagepack_edges():
    assert list(msgpack.decode(bytes.fromhex("d20000000505d4070a"))) == [("u64", 5), ("u64", 5), ("y", b"\x0a")]
    for bad in (b"\xcc", b"\x92\x01", b"\xa1\xff", b"\xc1"):
        with pytest.raises(MessagePackError):
            list(msgpack.decode(bad))


@settings(max_examples=200, deadline=None)
@given(values)
def test_messagepack_is_total(v):
    (got,) = msgpack.decode(msgpack.encode(v))
    assert msgpack.encode(got) == msgpack.encode(v)


@settings(max_examples=200, deadline=None)
@given(values)
def test_cbor_round_trip(v):
    (got,) = cbor.decode(cbor.encode(v, True))
    assert cbor.encode(got, True) == cbor.encode(v, True)


# Avro

AVRO = """{"type":"record","name":"r","namespace":"n","fields":[{"name":"e","type":{"type":"enum","name":"E","symbols":["A","B"]}},
 {"name":"x","type":{"type":"fixed","name":"X","size":2}},{"name":"u","type":["null","long","string"]},{"name":"m","type":{"type":"map","values":"int"}},
 {"name":"l","type":{"type":"array","items":"n.X"}},{"name":"t","type":{"type":"long","logicalType":"timestamp-micros"}},{"name":"d","type":"double","default":1.5}]}"""


@pytest.mark.parametrize("codec", avro.CODECS)
def test_avro_round_trip(codec):
    v = ("m", [(s("x"), ("y", b"ab")), (s("e"), s("B")), (s("u"), s("z")), (s("m"), ("m", [(s("b"), ("i32", 1)), (s("a"), ("i32", 2))])), (s("l"), ("q", [("y", b"cd")])), (s("t"), ("u64", 5))])
    data = b"".join(avro.encode([v] * 5000, AVRO, codec))
    got = list(avro.decode(data))
    assert len(got) == 5000
    assert got[0] == ("m", [(s("e"), s("B")), (s("x"), ("y", b"ab")), (s("u"), s("z")), (s("m"), ("m", [(s("b"), ("i32", 1)), (s("a"), ("i32", 2))])), (s("l"), ("q", [("y", b"cd")])), (s("t"), ("i64", 5)), (s("d"), ("f64", 1.5))])


def test_avro_bytes_are_pinned():
    data = b"".join(avro.encode([("i64", -1), ("i64", 64)], '"long"'))
    assert data.startswith(b"Obj\x01\x04\x16avro.schema\x0c\"long\"\x14avro.codec\x08null\x00") and data[-21:-16] == b"\x04\x06\x01\x80\x01"


def test_avro_errors():
    for bad in (b"", b"Obj\x02", b"Obj\x01\x00" + b"0" * 16):
        with pytest.raises(AvroError):
            avro.decode(bad)  # at construction, before a value is asked for
    data = b"".join(avro.encode([("i32", 1)], '"int"'))
    with pytest.raises(AvroError):
        list(avro.decode(data[:-1]))
    for v, schema in ((("u64", 2**63), '"long"'), (("m", [(("u8", 1), V.UNIT)]), '{"type":"map","values":"null"}'), (s("C"), '{"type":"enum","name":"E","symbols":["A"]}'), (V.UNIT, '["int"]'), (("m", []), '{"type":"record","name":"r","fields":[{"name":"a","type":"int"}]}')):
        with pytest.raises(AvroError):
            list(avro.encode([v], schema))
    with pytest.raises(AvroError):
        avro.Schema('"nothing"')
    with pytest.raises(FormatError):
        encoder("avro", {"schema": '"int"', "codec": "zip"})


# TOML and YAML


def test_toml():
    (v,) = toml_doc.decode(b'b = 1\na = [1, 2.5]\n[t]\nx = 1979-05-27T07:32:00Z\n[t.u]\ny = "z"\n[[l]]\nk = true\n')
    assert [k[1] for k, _ in v[1]] == ["b", "a", "t", "l"]
    assert v[1][2][1][1][0][1] == ("m", [(s(toml_doc.DATETIME_KEY), s("1979-05-27T07:32:00Z"))])
    assert list(toml_doc.decode(toml_doc.encode(v))) == [v]
    for bad in (b"a = ", b"a = 99999999999999999999", b"\xff"):
        with pytest.raises(TomlError):
            list(toml_doc.decode(bad))


def test_toml_sink():
    assert toml_doc.encode(("m", [(s("a b"), s('x"\n')), (s("t"), ("m", [(s("k"), ("u8", 1))])), (s("n"), ("f64", math.inf)), (s("z"), ("m", [(s("y"), ("y", b"\x01"))]))])) == b'"a b" = "x\\"\\n"\nt = { k = 1 }\nn = inf\n\n[z]\ny = [1]\n\n'
    for bad in (V.UNIT, ("q", []), s("x"), ("m", [(s("a"), V.UNIT)]), ("m", [(s("a"), ("u64", 2**63))]), ("m", [(("u8", 1), s("x"))]), ("m", [(s("a"), s("1")), (s("a"), s("2"))])):
        with pytest.raises(TomlError):
            toml_doc.encode(bad)


def test_yaml_core_schema():
    (v,) = yaml_doc.decode(b"[yes, 012, 2001-01-01, 1e3, 0o14, 0x1F, ~, .inf, True, '1', !!str 1, -3, 18446744073709551615]")
    assert v[1] == [s("yes"), ("u64", 12), s("2001-01-01"), ("f64", 1000.0), ("u64", 12), ("u64", 31), V.UNIT, ("f64", math.inf), ("b", True), s("1"), s("1"), ("i64", -3), ("u64", 2**64 - 1)]
    assert list(yaml_doc.decode(b"? [1]\n: a\nb: &x {c: 1}\nb: *x\n")) == [("m", [(("q", [("u64", 1)]), s("a")), (s("b"), ("m", [(s("c"), ("u64", 1))])), (s("b"), ("m", [(s("c"), ("u64", 1))]))])]
    for bad in (b"!custom x", b"a: b: c", b"*x", b"\xff"):
        with pytest.raises(YamlError):
            list(yaml_doc.decode(bad))


def test_yaml_is_a_series():
    assert len(list(yaml_doc.decode(b"a: 1\n---\nb: 2\n"))) == 2
    assert [v for v in yaml_doc.decode(b"".join(map(yaml_doc.encode, RECORDS)))] == RECORDS


@pytest.mark.parametrize("word", ["yes", "no", "null", "1", "1.5", "012", "2001-01-01", "", " a", "a: b", "# c", "- d", "x\ny", "~", "é", "\x07", "<<", "0x1", "'q'", "a\u2028b", "é" * 300])
def test_yaml_words_stay_words(word):
    assert list(yaml_doc.decode(yaml_doc.encode(("q", [s(word), s("end")])))) == [("q", [s(word), s("end")])]


# Protocol Buffers

PROTO = """syntax = "proto3"; package example; // a comment
import "other.proto";
message Person { string name = 1; int32 age = 2; Kind kind = 3; enum Kind { NONE = 0; ADULT = 1; } repeated sint64 n = 4 [packed = true];
 map<string, Other> by = 5; oneof o { bytes raw = 6; double d = 7; } optional uint64 big = 8; reserved 9; Person friend = 10; }"""
OTHER = 'syntax = "proto3"; package example; message Other { float f = 1; }'


def descriptors():
    files = [protobuf.ProtoParser(PROTO, "person.proto").parse(), protobuf.ProtoParser(OTHER, "other.proto").parse()]
    return protobuf.link(files).SerializeToString()


def test_protobuf_person():
    data = b"\x0a\x04John\x10\x22"
    (v,) = decoder("protobuf", {"descriptors": descriptors(), "message": ".example.Person"})(data)
    assert v[1][:3] == [(s("name"), s("John")), (s("age"), ("i32", 34)), (s("kind"), s("NONE"))]
    more = data + b"\x18\x01\x22\x02\x01\x04\x2a\x0a\x0a\x01k\x12\x05\x0d" + struct.pack("<f", 0.5) + b"\x32\x01\xff\x40\x05\x52\x03\x0a\x01x"
    (v,) = decoder("protobuf", {"descriptors": descriptors(), "message": ".example.Person"})(more)
    assert dict((k[1], x) for k, x in v[1])["n"] == ("q", [("i64", -1), ("i64", 2)])
    assert dict((k[1], x) for k, x in v[1])["by"] == ("m", [(s("k"), ("m", [(s("f"), ("f32", 0.5))]))])
    assert [k[1] for k, _ in v[1]] == ["name", "age", "kind", "n", "by", "raw", "big", "friend"]


def test_protobuf_errors():
    for name in (".example.Nobody", "example.Person"):
        with pytest.raises(ProtobufError):
            decoder("protobuf", {"descriptors": descriptors(), "message": name})
    with pytest.raises(ProtobufError):
        list(decoder("protobuf", {"descriptors": descriptors(), "message": ".example.Person"})(b"\x0a\x09x"))
    with pytest.raises(Unimplemented):
        encoder("protobuf")
    with pytest.raises(FormatError):
        decoder("hjson")


@pytest.mark.parametrize("fmt", ["json", "cbor", "messagepack", "yaml"])
def test_documented_records_through_each_format(fmt):
    back = list(decoder(fmt)(b"".join(encoder(fmt)(RECORDS))))
    assert b"".join(encoder("json")(back)) == b'null\ntrue\n{"a":2.5}\n'
