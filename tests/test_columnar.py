"""The short way of whole columns against the general way of single values."""

import datetime
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from recordloom import value as V
from recordloom.codecs import avro, decoder, encoder, protobuf
from recordloom.errors import EngineError
from recordloom.operators import columnar


def fields(**kinds):
    return T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": k, "nullable": True, "metadata": {}} for n, k in kinds.items()]})


SCHEMA = fields(b="boolean", i8="byte", i16="short", i32="integer", i64="long", f="double", g="float", s="string", **{'k"\\é': "string"})


def table(n=400, nulls=True):
    r = random.Random(3)
    edge = [0, 1, -1, 23, 24, 31, 32, -24, -25, -32, -33, 127, 128, -128, -129, 255, 256, 2**15 - 1, -(2**15), 2**16, 2**31 - 1, -(2**31), 2**32, 2**63 - 1, -(2**63)]
    floats = [0.0, -0.0, 0.1, 1e16, 1e-7, 1e300, 123456.789, 5e-4, math.inf, -math.inf, 1.5, 100.0, 1e9, 999999999.9]
    texts = ["", "a", "x" * 23, "x" * 24, "x" * 31, "x" * 32, "é" * 200, 'q"\\\n\x01', "𐍈", "y" * 70_000]

    def cell(kind):
        if nulls and r.random() < 0.2:
            return None
        if isinstance(kind, T.BooleanType):
            return r.random() < 0.5
        if type(kind) in columnar.INTEGERS:
            lo, hi = V.INTEGERS[columnar.INTEGERS[type(kind)]]
            return r.choice([x for x in edge if lo <= x <= hi])
        if isinstance(kind, T.DoubleType):
            return r.choice(floats)
        if isinstance(kind, T.FloatType):
            return V.single(r.choice(floats[:5] + [1.5]))
        return r.choice(texts[: 9 if r.random() < 0.99 else 10])

    return [tuple(cell(f.dataType) for f in SCHEMA) for _ in range(n)]


def batch_of(rows):
    kinds = [pa.bool_(), pa.int8(), pa.int16(), pa.int32(), pa.int64(), pa.float64(), pa.float32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=SCHEMA.names)


@pytest.mark.parametrize("nulls", [False, True])
@pytest.mark.parametrize("fmt", columnar.FORMATS)
def test_bytes_and_rows_are_those_of_the_general_way(fmt, nulls):
    if fmt == "avro":
        schema = T.StructType([T.StructField("k" if f.name.startswith("k") else f.name, f.dataType) for f in SCHEMA])
    else:
        schema = SCHEMA
    rows = table(nulls=nulls)
    options = {"schema": avro.schema_of(schema)} if fmt == "avro" else {}
    read = [V.reader(f.dataType) for f in schema]
    values = [("m", [(("s", f.name), g(x)) for f, g, x in zip(schema, read, row)]) for row in rows]
    blocks = list(columnar.encoder(fmt, schema, options)(batch_of(rows).slice(0), 150))
    assert len(blocks) == 3
    for k, block in enumerate(blocks):
        own = values[150 * k : 150 * (k + 1)]
        general = b"".join(encoder(fmt, options)(own))
        if fmt == "avro":  # sync markers differ, and where blocks end
            assert list(map(V.to_envelope, avro.decode(block))) == list(map(V.to_envelope, avro.decode(general)))
        else:
            assert block == general
        want = [tuple(r.values()) for b in columnar.typed(decoder(fmt)(general), schema) for r in b.to_pylist()]
        got = [tuple(r.values()) for b in columnar.decode(fmt, block, schema) for r in b.to_pylist()]
        assert repr(got) == repr(want)


@pytest.mark.parametrize("fmt", ["json", "cbor", "messagepack"])
def test_rows_of_other_shapes_take_the_general_way(fmt):
    schema = fields(a="long", b="double", c="string", t="timestamp_ntz")
    s = lambda k: ("s", k)
    rows = [
        ("m", [(s("a"), ("i64", 1)), (s("b"), ("f64", 2.5)), (s("c"), s("x")), (s("t"), s("2020-01-02T03:04:05.000006"))]),
        ("m", [(s("c"), s("order")), (s("a"), ("i64", 2))]),
        ("m", [(s("a"), ("f64", 3.0)), (s("a"), ("i64", 9)), (s("b"), ("i64", 4)), (s("c"), ("b", True)), (s("t"), V.UNIT)]),
        ("q", [("i64", 5), ("f64", 0.5), V.UNIT, V.UNIT]),
        ("m", [(s("a"), ("i64", 6)), (s("b"), V.UNIT), (s("c"), ("q", [("i64", 1)])), (s("t"), V.UNIT)]),
    ]
    data = b"".join(encoder(fmt)(rows))
    got = [tuple(r.values()) for b in columnar.decode(fmt, data, schema) for r in b.to_pylist()]
    assert got == [(1, 2.5, "x", datetime.datetime(2020, 1, 2, 3, 4, 5, 6)), (2, None, "order", None), (3, 4.0, "true", None), (5, 0.5, None, None), (6, None, "[1]", None)]


@pytest.mark.parametrize("fmt,data", [("json", b'{"a":1.5}'), ("json", b'{"a":1}{'), ("json", b'{"a":99999999999999999999}'), ("json", b'{"a":true}'), ("cbor", b"\xa1\x61a\x19\x01"), ("messagepack", b"\x81\xa1a\xcf" + b"\xff" * 8), ("avro", b"Obj\x02"), ("cbor", b"\xa1\x61a\x1b" + b"\xff" * 8)])
def test_bad_input_raises(fmt, data):
    with pytest.raises(EngineError):
        list(columnar.decode(fmt, data, fields(a="long")))


def test_small_blocks_share_a_batch_and_keep_their_rows():
    schema = fields(a="long", c="string")
    row = lambda k: ("m", [(("s", "a"), ("i64", k)), (("s", "c"), ("s", str(k)))])
    odd = ("m", [(("s", "c"), ("s", "odd")), (("s", "a"), V.UNIT)])
    for fmt in columnar.FORMATS:
        options = {"schema": avro.schema_of(schema)} if fmt == "avro" else {}
        blocks = [b"".join(encoder(fmt, options)([odd if k == 50 else row(k)])) for k in range(100)]
        got = list(columnar.decode_all(fmt, blocks, schema))
        assert len(got) <= 3
        assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(None, "odd") if k == 50 else (k, str(k)) for k in range(100)]
    with pytest.raises(EngineError):  # a value may not go on in the next block
        list(columnar.decode_all("json", [b'{"a":1,"c":', b'"x"}'], schema))
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * 300_000] * 9, pa.binary())], names=["block"])
    assert [len(g) for g in columnar.grouped([batch])] == [3, 3, 3]


def test_protobuf_by_columns_gives_the_rows_of_the_general_way(spark):
    proto = """syntax = "proto3"; package t; enum E { A = 0; B = 1; }
message M { message P { int64 k = 1; optional string n = 2; P p = 3; } int64 i = 1; sint32 j = 2; P p = 3; repeated P ps = 4; repeated double ds = 5; map<string, int64> m = 6; E e = 7; oneof o { string s = 8; bytes y = 9; } bool b = 10; float f = 11; uint64 u = 12; map<int32, P> mp = 13; }"""
    data = protobuf.link([protobuf.ProtoParser(proto, "t.proto").parse()]).SerializeToString()
    descriptors = protobuf.Descriptors(data)
    kind, decode = descriptors.message(".t.M"), decoder("protobuf", {"descriptors": data, "message": ".t.M"})
    full = kind(i=-5, j=-6, p={"k": 1, "n": "é", "p": {"k": 2}}, ps=[{"k": 3}, {"n": ""}], ds=[0.5, -1.0], m={"x": 1, "y": 2}, e=1, s="t", b=True, f=0.1, u=7, mp={1: {"k": 9}})
    blocks = [full.SerializeToString(), b"", kind(e=7, y=b"\xff", p={}).SerializeToString(), full.SerializeToString()]
    ddl = "i long, j int, p struct<k: long, n: string, p: struct<k: long>>, ps array<struct<k: long, n: string>>, ds array<double>, m map<string, long>, e string, s string, y binary, b boolean, f double, u long, mp map<int, struct<k: long>>, none string"
    rows = lambda batches: [[(c, sorted(v) if c in ("m", "mp") else v) for c, v in r.items()] for b in batches for r in b.to_pylist()]
    general = lambda schema, blocks: columnar.typed((v for b in blocks for v in decode(b)), schema)
    for text in (ddl, "i string, p string", "i double, u int"):  # the last two have other kinds than the message
        schema = T.StructType.fromDDL(text)
        assert rows(columnar.protobuf_rows(blocks, kind, schema, decode)) == rows(general(schema, blocks))
    schema = T.StructType.fromDDL(ddl)
    assert [b.num_rows for b in columnar.protobuf_rows(blocks, kind, schema, decode)] == [4]
    assert len(protobuf.columns(blocks, kind, schema)) == len(schema)
    for bad, text in ((b"\x08", ddl), (kind(u=2**63).SerializeToString(), ddl), (kind(i=2**40).SerializeToString(), "i int")):
        with pytest.raises(EngineError):
            list(columnar.protobuf_rows([*blocks, bad], kind, T.StructType.fromDDL(text), decode))


@pytest.mark.parametrize("nulls", [False, True])
def test_envelopes_by_columns_are_those_of_the_general_way(nulls):
    rows = [tuple(math.nan if k == 7 and isinstance(x, float) else x for x in row) for k, row in enumerate(table(nulls=nulls))]
    read = [V.reader(f.dataType) for f in SCHEMA]
    want = [V.to_envelope(("m", [(("s", f.name), g(x)) for f, g, x in zip(SCHEMA, read, row)])) for row in rows]
    got = columnar.envelopes(SCHEMA)(batch_of(rows)).to_pylist()
    assert got == want
    back = list(columnar.typed_envelopes(got, SCHEMA))
    assert len(back) < 40  # whole runs, not single rows: only values beyond the pattern's ranges go the general way
    general = [tuple(r.values()) for b in columnar.typed(map(V.from_envelope, got), SCHEMA) for r in b.to_pylist()]
    assert repr([tuple(r.values()) for b in back for r in b.to_pylist()]) == repr(general)


def test_odd_envelopes_take_the_general_way():
    schema = fields(a="integer", c="string", t="timestamp_ntz", x="double")
    e = lambda a, c='["s","x"]', t='["n"]', x='["n"]': f'["m",[[["s","a"],{a}],[["s","c"],{c}],[["s","t"],{t}],[["s","x"],{x}]]]'
    odd = [
        e('["i64","1"]'), e('["u8","255"]', '["c","é"]'), e('["u16","65535"]', '["i8","1"]'), e('["f64","3.0"]', r'["s","a\"\\é\n"]', '["s","2020-01-02T03:04:05.000006"]', '["u8","4"]'),
        e('["n"]', '["s",""]', '["s","2020-01-02"]', '["f64","-inf"]'), '["m",[[["s","c"],["s","z"]],[["s","a"],["i8","-3"]]]]', '["q",[["i8","1"],["n"],["n"],["f32","0.1"]]]', e('["i32","-2147483648"]', x='["f64","1e-07"]'), e('["i64" , "5"]'),
    ]
    want = [tuple(r.values()) for b in columnar.typed(map(V.from_envelope, odd), schema) for r in b.to_pylist()]
    assert [tuple(r.values()) for b in columnar.typed_envelopes(odd, schema) for r in b.to_pylist()] == want
    for bad in (e('["i64","2147483648"]'), e('["u8","256"]'), e('["u8","-1"]'), e('["i8","200"]'), e('["i64","1"]', t='["s","2020-13-02T03:04:05.000006"]')):
        with pytest.raises(EngineError):
            list(columnar.typed_envelopes([odd[0], bad], schema))
