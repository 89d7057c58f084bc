"""Input read as it is needed, files entered in their middle, and errors that stay the engine's own."""

import io
import logging
import os
import subprocess
import sys
import tracemalloc

import pytest

from recordloom import cli
from recordloom import value as V
from recordloom.codecs import avro, decoder, encoder, raw
from recordloom.errors import AvroError, CborError, EngineError, FormatError, MessagePackError
from recordloom.value import to_column

RECORDS = [("m", [(("s", "a"), ("i64", k)), (("s", "b"), ("s", f"é{k}" * (k % 50)))]) for k in range(500)]
SCHEMA = '{"type":"record","name":"r","fields":[{"name":"a","type":"long"},{"name":"b","type":"string"}]}'


class Trickle(io.RawIOBase):
    """A file that gives a few bytes at a time, and says how many it gave."""

    def __init__(self, data, size=7):
        self.data, self.size, self.given = data, size, 0

    def readable(self):
        return True

    def readinto(self, b):
        part = self.data[self.given : self.given + min(self.size, len(b))]
        b[: len(part)] = part
        self.given += len(part)
        return len(part)


@pytest.mark.parametrize("fmt", ["json", "cbor", "messagepack", "avro", "yaml", "csv", "raw"])
def test_a_trickling_file_gives_the_same_records(fmt):
    records = {"csv": [("q", [("s", str(k)), ("s", "x\ny" * (k % 3))]) for k in range(200)], "raw": [("s", f"é{k}") for k in range(200)]}.get(fmt, RECORDS)
    data = b"".join(encoder(fmt, {"schema": SCHEMA, "codec": "snappy"} if fmt == "avro" else {})(records))
    assert list(decoder(fmt)(Trickle(data))) == list(decoder(fmt)(data)) and len(list(decoder(fmt)(data))) == len(records)


@pytest.mark.parametrize("fmt", ["json", "cbor", "messagepack", "raw"])
def test_the_first_record_comes_before_the_rest_is_read(fmt):
    data = b"".join(encoder(fmt)([("s", "x" * 100)] * 10_000))
    file = Trickle(data)
    next(iter(decoder(fmt)(file)))
    assert file.given < 200_000 < len(data)


def test_json_that_breaks_at_any_place():
    text = '12 -3.5e2 true "a\\u00e9\\n" [1,{"k":null}] {"x":"é"} 7'.encode()
    want = list(decoder("json")(text))
    for size in range(1, 9):
        assert list(decoder("json")(Trickle(text, size))) == want


def test_the_command_line_writes_before_the_input_ends():
    p = subprocess.Popen([sys.executable, "-m", "recordloom", "-jC", "-q"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, cwd=os.path.dirname(os.path.dirname(__file__)))
    p.stdin.write(b'"x" ')
    p.stdin.flush()
    assert os.read(p.stdout.fileno(), 10) == b"\x61x"  # stdin is still open
    p.stdin.close()
    assert p.wait(30) == 0


@pytest.mark.parametrize("fmt", ["json", "cbor", "raw", "avro"])
def test_a_large_file_takes_little_memory(tmp_path, fmt):
    path = tmp_path / "large"
    with open(path, "wb") as f:
        for piece in encoder(fmt, {"schema": '"string"'} if fmt == "avro" else {})(("s", "x" * 1000) for _ in range(20_000)):
            f.write(piece)
    tracemalloc.start()
    with open(path, "rb") as f:
        assert sum(1 for _ in decoder(fmt)(f)) == 20_000
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert path.stat().st_size > 20_000_000 and peak < 2_000_000


@pytest.mark.parametrize("part", [1, 100, 999, 5000])
def test_parts_of_a_file_hold_each_record_once(part):
    lines = b"".join(b"%d\r\n" % k + b"\n" * (k % 3) for k in range(300)) + b"end"
    got = [x for lo in range(0, len(lines), part) for x in raw.decode_split(io.BytesIO(lines), lo, lo + part)]
    assert [v for _, v in got] == list(raw.decode(lines)) and [p for p, _ in got] == sorted({p for p, _ in got})
    data = b"".join(avro.encode(RECORDS * 20, SCHEMA))
    got = [x for lo in range(0, len(data), part * 20) for x in avro.decode_split(io.BytesIO(data), lo, lo + part * 20)]
    assert [v for _, v in got] == list(avro.decode(data)) and [p for p, _ in got] == sorted({p for p, _ in got})


def test_corrupt_avro_raises_its_own_error():
    for schema, good, bad in (('{"type":"enum","name":"e","symbols":["A","B"]}', ("s", "B"), b"\x01"), ('["null","long"]', ("i64", 3), b"\x01")):
        data = b"".join(avro.encode([good], schema))
        sync = data[-16:]
        for body in (bad, b"\x7e"):  # index -1, and 63
            broken = data[: data.index(sync) + 16] + avro.container_block(1, body + b"\x06", "null", sync)
            with pytest.raises(AvroError):
                list(avro.decode(broken))
    data = b"".join(avro.encode(RECORDS, SCHEMA, "snappy"))
    head = data.index(data[-16:]) + 16
    with pytest.raises(AvroError):
        list(avro.decode(data[: head + 5] + b"\xff" * 40 + data[head + 45 :]))


def test_deep_nesting_raises_its_own_error():
    with pytest.raises(CborError):
        list(decoder("cbor")(b"\x81" * 100_000))
    with pytest.raises(MessagePackError):
        list(decoder("messagepack")(b"\x91" * 100_000))
    for flag, data in (("-cJ", b"\x81" * 100_000), ("-jC", b"[" * 100_000)):
        assert cli.main([flag, "-q"], io.BytesIO(data), io.BytesIO()) == 1


def test_what_does_not_fit_raises():
    from pyspark.sql import types as T

    assert to_column(("f64", 2.0), T.IntegerType()) == 2 and to_column(("s", "true"), T.BooleanType()) is True
    for v, kind in ((("f64", 2.7), T.IntegerType()), (("f64", -0.9), T.LongType()), (("f64", float("nan")), T.LongType()), (("s", "x"), T.BooleanType()), (("s", "x"), T.DoubleType()), (("s", "x"), T.DateType()), (("i64", 300), T.ByteType())):
        with pytest.raises(FormatError):
            to_column(v, kind)


def test_log_levels():
    assert cli.levels("warn,recordloom.codecs=debug") == {"": logging.WARNING, "recordloom.codecs": logging.DEBUG}
    with pytest.raises(EngineError):
        cli.levels("recordloom=loud")
    assert cli.main(["-l", "recordloom=loud"], io.BytesIO(b"1"), io.BytesIO()) == 1
    cli.set_up_log(cli.parser().parse_args([]), {cli.LOG_VARIABLE: "error"})
    assert logging.getLogger().level == logging.ERROR
    logging.getLogger().setLevel(logging.WARNING)
    assert V.UNIT == ("n",)
