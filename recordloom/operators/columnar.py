"""Whole columns to bytes and back, for rows of flat schemas: the short way of encode_rows and decode_blocks.

Encoding makes each column's bytes in numpy and lays them beside each other, row by row. Decoding runs a function that is
written once a schema, with the keys and kinds that it expects. A row of any other shape takes the general way.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import value as V
from ..codecs import avro, cbor, json_text, msgpack, protobuf
from ..errors import ProtobufError

FORMATS = ("avro", "cbor", "json", "messagepack")
INTEGERS = {T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64"}
NUMBERS = (T.FloatType, T.DoubleType)
#: Rows of a decoded batch, and bytes of the blocks that are decoded together.
ROWS, GROUP = 8_192, 1 << 20


class Ragged(NamedTuple):
    """Bytes of one cell after the other, and the number of bytes of each."""

    data: np.ndarray
    size: np.ndarray


def places(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of count, one run after the other."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - count), count)


def beside(parts: list, n: int) -> Ragged:
    """The parts, cells or the same bytes for all rows, beside each other in each of n rows."""
    sizes = [len(p) if isinstance(p, bytes) else p.size for p in parts]
    row = np.broadcast_to(np.asarray(sum(sizes), np.int64), n)
    at = np.cumsum(row) - row
    out = np.empty(int(row.sum()), np.uint8)
    for p, size in zip(parts, sizes):
        if isinstance(p, bytes):
            out[at[:, None] + np.arange(size)] = np.frombuffer(p, np.uint8)
        else:
            out[places(at, size)] = p.data
        at = at + size
    return Ragged(out, row)


def cut(rows: np.ndarray, size: np.ndarray) -> Ragged:
    """Of each row of bytes the first so many."""
    return Ragged(rows[np.arange(rows.shape[1]) < size[:, None]], size)


def fixed(x: np.ndarray, kind: str) -> Ragged:
    return Ragged(x.astype(kind).view(np.uint8), np.full(len(x), np.dtype(kind).itemsize))


def text_cells(column: pa.Array) -> Ragged:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return Ragged(np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8), np.diff(off))


def nulls_between(cells: Ragged, valid: np.ndarray, null: bytes) -> Ragged:
    size = np.full(len(valid), len(null))
    size[valid] = cells.size
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    out[places(start[valid], cells.size)] = cells.data
    out[start[~valid][:, None] + np.arange(len(null))] = np.frombuffer(null, np.uint8)
    return Ragged(out, size)


def big_endian(x: np.ndarray, width: int) -> np.ndarray:
    """The last so many bytes of each number, as columns."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]


def marked(first: np.ndarray, x: np.ndarray, width: np.ndarray) -> Ragged:
    """A marker byte and then the number in so many bytes."""
    rows = np.zeros((len(x), 9), np.uint8)
    rows[:, 0] = first
    for w in (1, 2, 4, 8):
        if (own := width == w).any():
            rows[own, 1 : 1 + w] = big_endian(x[own], w)
    return cut(rows, width + 1)


# Avro


def varint(z: np.ndarray) -> Ragged:
    size = np.ones(len(z), np.int64)
    for k in range(1, 10):
        size += z >= np.uint64(1 << (7 * k))
    most = int(size.max(initial=1))
    rows = (z[:, None] >> np.arange(0, 7 * most, 7, dtype=np.uint64)).astype(np.uint8) & 127
    rows[np.arange(most) < size[:, None] - 1] |= 128
    return cut(rows, size)


def zigzag(x: np.ndarray) -> Ragged:
    return varint(((x << 1) ^ (x >> 63)).view(np.uint64))


def avro_cells(column: pa.Array, kind: T.DataType) -> list:
    if isinstance(kind, T.BooleanType):
        return [b"\x02", fixed(column.to_numpy(zero_copy_only=False), "u1")]
    if type(kind) in INTEGERS:
        return [b"\x02", zigzag(column.to_numpy().astype(np.int64))]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [b"\x02", fixed(column.to_numpy(), "<f4" if isinstance(kind, T.FloatType) else "<f8")]
    cells = text_cells(column)
    return [b"\x02", zigzag(cells.size), cells]


# CBOR and MessagePack


def cbor_head(major: np.ndarray, x: np.ndarray) -> Ragged:
    k = sum((x >= np.uint64(1 << b)).astype(np.int64) for b in (8, 16, 32))
    small = x < np.uint64(24)
    return marked(np.where(small, x.astype(np.uint8), (24 + k).astype(np.uint8)) | (major << 5).astype(np.uint8), x, np.where(small, 0, 1 << k))


def cbor_cells(column: pa.Array, kind: T.DataType) -> list:
    if isinstance(kind, T.BooleanType):
        return [fixed(column.to_numpy(zero_copy_only=False) + 0xF4, "u1")]
    if type(kind) in INTEGERS:
        x = column.to_numpy().astype(np.int64)
        return [cbor_head((x < 0).astype(np.uint8), np.where(x < 0, -1 - x, x).view(np.uint64))]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = column.to_numpy().astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            narrow = x.astype(np.float32)
        short = ~np.isfinite(x) | (narrow == x) | isinstance(kind, T.FloatType)
        rows = np.zeros((len(x), 9), np.uint8)
        rows[:, 0] = np.where(short, 0xFA, 0xFB)
        rows[:, 1:] = x.astype(">f8").view(np.uint8).reshape(-1, 8)
        rows[short, 1:5] = narrow[short].astype(">f4").view(np.uint8).reshape(-1, 4)
        return [cut(rows, np.where(short, 5, 9))]
    cells = text_cells(column)
    return [cbor_head(np.full(len(column), 3, np.uint8), cells.size.astype(np.uint64)), cells]


def sized(size: np.ndarray, fix: int, most: int, marker: int, widths: tuple) -> Ragged:
    """A length in the marker up to most, else behind it in the fewest of the given widths, whose markers follow each other."""
    k = np.searchsorted([256**w for w in widths], size, "right")
    small = size <= most
    return marked(np.where(small, fix | size, marker + k), size.astype(np.uint64), np.where(small, 0, np.array(widths)[k]))


def messagepack_cells(column: pa.Array, kind: T.DataType) -> list:
    if isinstance(kind, T.BooleanType):
        return [fixed(column.to_numpy(zero_copy_only=False) + 0xC2, "u1")]
    if type(kind) in INTEGERS:
        x = column.to_numpy().astype(np.int64)
        small = (x >= -32) & (x < 128)
        up = np.searchsorted([2**8, 2**16, 2**32], x, "right")
        down = np.searchsorted([2**7, 2**15, 2**31], -1 - x, "right")
        k = np.where(x >= 0, up, down)
        return [marked(np.where(small, x & 255, np.where(x >= 0, 0xCC, 0xD0) + k), x.view(np.uint64), np.where(small, 0, 1 << k))]
    if isinstance(kind, T.FloatType):
        return [b"\xca", fixed(column.to_numpy(), ">f4")]
    if isinstance(kind, T.DoubleType):
        return [b"\xcb", fixed(column.to_numpy(), ">f8")]
    cells = text_cells(column)
    if isinstance(kind, T.BinaryType):
        return [sized(cells.size, 0, -1, 0xC4, (1, 2, 4)), cells]
    return [sized(cells.size, 0xA0, 31, 0xD9, (1, 2, 4)), cells]


# JSON

ESCAPED = np.zeros(256, bool)
ESCAPED[[*range(32), ord('"'), ord("\\")]] = True


def json_cells(column: pa.Array, kind: T.DataType) -> list:
    if isinstance(kind, T.BooleanType) or type(kind) in INTEGERS:
        return [text_cells(pc.cast(column, pa.string()))]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        tag = "f32" if isinstance(kind, T.FloatType) else "f64"
        x = column.to_numpy()
        alike = (np.abs(x) >= 1e-3) & (np.abs(x) < 1e9) | (x == 0) if tag == "f64" else np.zeros(len(x), bool)  # where Arrow writes the same digits
        texts = pc.cast(column, pa.string())
        if (round_ := alike & (x == np.floor(x))).any():
            texts = pc.if_else(pa.array(round_), pc.binary_join_element_wise(texts, ".0", ""), texts)
        if alike.all():
            return [text_cells(texts)]
        texts = texts.to_pylist()
        for k in np.flatnonzero(~alike).tolist():
            texts[k] = json_text.compact((tag, float(x[k])))
        return [text_cells(pa.array(texts, pa.string()))]
    cells = text_cells(column)
    if ESCAPED[cells.data].any():
        return [text_cells(pa.array([json_text.quoted(x) for x in column.to_pylist()], pa.string()))]
    return [b'"', cells, b'"']


CELLS = {"avro": (avro_cells, b"\0"), "cbor": (cbor_cells, b"\xf6"), "messagepack": (messagepack_cells, b"\xc0"), "json": (json_cells, b"null")}


def flat(fmt: str, schema: T.StructType) -> bool:
    """Whether columns of these kinds can take the short way in a format, and no key comes twice."""
    kinds = (T.BooleanType, *INTEGERS, T.FloatType, T.DoubleType, T.StringType, *([T.BinaryType] if fmt in ("avro", "messagepack") else []))
    return fmt in FORMATS and len(schema) > 0 and len(set(schema.names)) == len(schema) and all(isinstance(f.dataType, kinds) for f in schema)


def encoder(fmt: str, schema: T.StructType, options: dict) -> Callable[[pa.RecordBatch, int], Iterator[bytes]] | None:
    """(batch, rows to a block) -> blocks; None where rows of this schema and these options take the general way."""
    if not flat(fmt, schema) or options.get("style", "compact") != "compact" or (fmt == "avro" and options.get("schema") != avro.schema_of(schema)):
        return None
    cells, null = CELLS[fmt]
    names = [f.name for f in schema]
    if fmt == "json":
        keys, end = [(("," if k else "{") + json_text.quoted(n) + ":").encode() for k, n in enumerate(names)], b"}\n"
    elif fmt == "avro":
        keys, end = [b""] * len(names), b""
    else:
        one = cbor.encode if fmt == "cbor" else msgpack.encode
        keys, end = [one(("s", n)) for n in names], b""
        keys[0] = one(("m", [(("n",), ("n",))] * len(names)))[: -2 * len(names)] + keys[0]

    def whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for key, column, f in zip(keys, batch.columns, schema):
            if column.null_count:
                valid, some = column.is_valid().to_numpy(zero_copy_only=False), column.drop_null()
                own = [nulls_between(beside(cells(some, f.dataType), len(some)), valid, null)]
            else:
                own = cells(column, f.dataType)
            for p in [key, *own]:
                if isinstance(p, bytes) and parts and isinstance(parts[-1], bytes):
                    parts[-1] += p
                elif p != b"" if isinstance(p, bytes) else True:
                    parts.append(p)
        rows = beside([*parts, end] if end else parts, batch.num_rows)
        return rows.data, np.append(0, np.cumsum(rows.size))

    def blocks(batch: pa.RecordBatch, per: int) -> Iterator[bytes]:
        data, edge = whole(batch)
        for lo in range(0, batch.num_rows, per):
            own = edge[lo : lo + per + 1]
            if fmt == "avro":
                yield b"".join(container(data, own, options))
            else:
                yield data[own[0] : own[-1]].tobytes()

    return blocks


def container(data: np.ndarray, edge: np.ndarray, options: dict) -> Iterator[bytes]:
    """An Avro container file of rows that end at the given edges."""
    codec, sync = options.get("codec", "null"), os.urandom(16)
    yield avro.container_header(options["schema"], codec, sync)
    at = 0
    while at < len(edge) - 1:
        to = max(at + 1, min(len(edge) - 1, int(np.searchsorted(edge, edge[at] + avro.BLOCK))))
        yield avro.container_block(to - at, data[edge[at] : edge[to]].tobytes(), codec, sync)
        at = to


# envelopes

TAG = {T.BooleanType: "b", **INTEGERS, T.FloatType: "f32", T.DoubleType: "f64", T.StringType: "s"}
NEEDS_ESCAPE = r'["\\\x00-\x1f]'


def envelope_cells(column: pa.Array, kind: T.DataType) -> pa.Array:
    """The payloads of the nodes of a column, without quotes around numbers; null stays null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        tag = TAG[type(kind)]
        x = column.fill_null(0).to_numpy(zero_copy_only=False)
        alike = (np.abs(x) >= 1e-3) & (np.abs(x) < 1e9) | (x == 0) if tag == "f64" else np.zeros(len(x), bool)  # where Arrow writes the same digits
        texts = pc.cast(column, pa.string())
        if (round_ := alike & (x == np.floor(x))).any():
            texts = pc.if_else(pa.array(round_), pc.binary_join_element_wise(texts, ".0", ""), texts)
        if alike.all():
            return texts
        texts, valid = texts.to_pylist(), column.is_valid().to_pylist()
        for k in np.flatnonzero(~alike).tolist():
            texts[k] = V.float_name(tag, V.single(x[k]) if tag == "f32" else float(x[k])) if valid[k] else None
        return pa.array(texts, pa.string())
    if isinstance(kind, T.StringType):
        column = column.cast(pa.string())
        odd = pc.match_substring_regex(column, NEEDS_ESCAPE).fill_null(False)
        if pc.any(odd).as_py():
            own = pa.array([json_text.quoted(x)[1:-1] for x in column.filter(odd).to_pylist()], pa.string())
            column = pc.replace_with_mask(column, odd, own)
        return column
    return pc.cast(column, pa.string())


def envelopes(schema: T.StructType) -> Callable[[pa.RecordBatch], pa.Array] | None:
    """batch -> the envelope of each row, as value.to_envelope writes it; None where rows of this schema take the general way."""
    if not len(schema) or not all(type(f.dataType) in TAG for f in schema):
        return None

    def run(batch: pa.RecordBatch) -> pa.Array:
        parts = ['["m",[']
        for k, (column, f) in enumerate(zip(batch.columns, schema)):
            tag, cells = TAG[type(f.dataType)], envelope_cells(column, f.dataType)
            quote = "" if tag == "b" else '"'
            before, after = f'["{tag}",{quote}', f"{quote}]"
            parts[-1] += ("," if k else "") + f'[["s",{json_text.quoted(f.name)}],'
            if cells.null_count:
                parts += [pc.fill_null(pc.binary_join_element_wise(before, cells, after, ""), '["n"]'), "]"]
            else:
                parts[-1] += before
                parts += [cells, after + "]"]
        parts[-1] += "]]"
        return pc.binary_join_element_wise(*parts, "").cast(pa.string())

    return run


#: Numbers as they stand in a kind's node, all of them in its range, and floats as they are written.
WITHIN = {
    "i64": "-?[0-9]{1,19}", "u64": "[0-9]{1,19}", "u32": "[0-9]{1,9}|[1-3][0-9]{9}", "u16": "[0-9]{1,4}|[1-5][0-9]{4}", "u8": "[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]",
    "i32": "-?(?:[0-9]{1,9}|1[0-9]{9}|20[0-9]{8})", "i16": "-?(?:[0-9]{1,4}|[12][0-9]{4})", "i8": "-?(?:[0-9]{1,2}|1[01][0-9]|12[0-7])",
}
FLOAT = r"-?[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?|-?inf|NaN"
TEXT = r'[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*'
TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{6})?"


def node_pattern(kind: T.DataType) -> str | None:
    """A node of the expected kind with its payload as a group, or null."""
    if type(kind) in INTEGERS:
        own = INTEGERS[type(kind)]  # its range is checked by the cast
        tags = "|".join([own, *(f'{t}(?=","(?:{digits})")' for t, digits in WITHIN.items() if t != own)])
        some = rf'\["(?:{tags})","(-?[0-9]+)"\]'
    elif isinstance(kind, NUMBERS):
        some = rf'\["f(?:64|32)","({FLOAT})"\]'
    elif isinstance(kind, T.BooleanType):
        some = r'\["b",(true|false)\]'
    elif isinstance(kind, (T.StringType, T.TimestampNTZType)):
        some = rf'\["s","({TEXT if isinstance(kind, T.StringType) else TIME})"\]'
    else:
        return None
    return rf'(?:{some}|\["n"\])'


def unescaped(text: str | None) -> str | None:
    return text if text is None or "\\" not in text else json.loads(f'"{text}"')


def payload_cells(cells: tuple, kind: T.DataType, t: pa.DataType) -> pa.Array:
    if isinstance(kind, T.StringType):
        return pa.array(map(unescaped, cells) if any(c is not None and "\\" in c for c in cells) else cells, t)
    texts = pa.array(cells, pa.string())
    if isinstance(kind, T.FloatType):
        return texts.cast(pa.float64()).cast(t)
    return texts.cast(t)


def typed_envelopes(texts: list[str], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Envelopes as rows of the schema: runs of flat records with the schema's keys in their order by one pattern, others by the general way."""
    nodes = [node_pattern(f.dataType) for f in schema]
    if not nodes or None in nodes or len(set(schema.names)) < len(nodes):
        yield from typed(map(V.from_envelope, texts), schema)
        return
    pattern = r'\["m",\[' + ",".join(rf'\[\["s",{re.escape(json_text.quoted(f.name))}\],{node}\]' for f, node in zip(schema, nodes)) + r"\]\]"
    matches, at, arrow = list(map(re.compile(pattern).fullmatch, texts)), 0, to_arrow_schema(schema)
    for fits, run in groupby(matches, bool):
        run = list(run)
        own, at, out = texts[at : at + len(run)], at + len(run), None
        if fits:
            try:
                cells = zip(*[m.groups() for m in run])
                out = [pa.RecordBatch.from_arrays([payload_cells(c, f.dataType, a.type) for c, f, a in zip(cells, schema, arrow)], schema=arrow)]
            except (ValueError, pa.ArrowException):
                pass
        yield from typed(map(V.from_envelope, own), schema) if out is None else out


# decoding


class Other(Exception):
    """A row of another shape than expected."""


READ = {
    "cbor": {
        "int": """
if b < 24: v = b
elif b < 28: w = 1 << (b - 24); v = number(data[at:at + w]); at += w
elif 31 < b < 56: v = 31 - b
elif 55 < b < 60: w = 1 << (b - 56); v = -1 - number(data[at:at + w]); at += w
elif b == 0xF6: v = None
else: raise Other
if v is not None and not {lo} <= v <= {hi}: raise Other""",
        "real": """
if b == 0xFB: v, = double(data, at); at += 8
elif b == 0xFA: v, = single(data, at); at += 4
elif b == 0xF6: v = None
else: raise Other""",
        "bool": """
if b == 0xF5: v = True
elif b == 0xF4: v = False
elif b == 0xF6: v = None
else: raise Other""",
        "text": """
if 0x5F < b < 0x78: w = b - 0x60
elif b == 0x78: w = data[at]; at += 1
elif b == 0x79: w = number(data[at:at + 2]); at += 2
elif b == 0x7A: w = number(data[at:at + 4]); at += 4
elif b == 0xF6: w = -1
else: raise Other
if w < 0: v = None
else: v = data[at:at + w].decode(); at += w""",
    },
    "messagepack": {
        "int": """
if b < 128: v = b
elif b > 223: v = b - 256
elif 0xCB < b < 0xD0: w = 1 << (b - 0xCC); v = number(data[at:at + w]); at += w
elif 0xCF < b < 0xD4: w = 1 << (b - 0xD0); v = number(data[at:at + w], "big", signed=True); at += w
elif b == 0xC0: v = None
else: raise Other
if v is not None and not {lo} <= v <= {hi}: raise Other""",
        "real": """
if b == 0xCB: v, = double(data, at); at += 8
elif b == 0xCA: v, = single(data, at); at += 4
elif b == 0xC0: v = None
else: raise Other""",
        "bool": """
if b == 0xC3: v = True
elif b == 0xC2: v = False
elif b == 0xC0: v = None
else: raise Other""",
        "text": """
if 0x9F < b < 0xC0: w = b - 0xA0
elif b == 0xD9: w = data[at]; at += 1
elif b == 0xDA: w = number(data[at:at + 2]); at += 2
elif b == 0xDB: w = number(data[at:at + 4]); at += 4
elif b == 0xC0: w = -1
else: raise Other
if w < 0: v = None
else: v = data[at:at + w].decode(); at += w""",
        "bytes": """
if b == 0xC4: w = data[at]; at += 1
elif b == 0xC5: w = number(data[at:at + 2]); at += 2
elif b == 0xC6: w = number(data[at:at + 4]); at += 4
elif b == 0xC0: w = -1
else: raise Other
if w < 0: v = None
else: v = data[at:at + w]; at += w""",
    },
}
LONG = """
b = data[at]; at += 1
if b > 127:
    v = b & 127; w = 7
    while True:
        b = data[at]; at += 1
        v |= (b & 127) << w
        if b < 128: break
        w += 7
    b = v
v = (b >> 1) ^ -(b & 1)"""
READ["avro"] = {
    "int": LONG + "\nif not {lo} <= v <= {hi}: raise Other",
    "float": "v, = single(data, at); at += 4",
    "double": "v, = double(data, at); at += 8",
    "bool": "v = data[at] != 0; at += 1",
    "text": LONG + "\nif v < 0: raise Other\nw = v; v = data[at:at + w].decode(); at += w",
    "bytes": LONG + "\nif v < 0: raise Other\nw = v; v = data[at:at + w]; at += w",
}


def kind_of(t: T.DataType) -> str:
    if type(t) in INTEGERS:
        return "int"
    return next(k for of, k in ((T.BooleanType, "bool"), (NUMBERS, "real"), (T.BinaryType, "bytes"), (object, "text")) if isinstance(t, of))


def written(fields: list[tuple[str, str]], order: str) -> Callable:
    """The function rows(data, at, n, most, general, held) -> (at, rows): reads rows from data[at:n] into the lists held until there
    are most, each field by its (code, check before it). general(at) reads a row of another shape and gives where it ends."""
    body = []
    for k, (before, code) in enumerate(fields):
        body += [line for part in (before, code, f"v{k} = v") for line in part.split("\n") if line]
    inside = "\n".join("            " + line for line in body)
    cells = "; ".join(f"a{k}(v{k})" for k in range(len(fields)))
    appends = "\n".join(f"    a{k} = held[{k}].append" for k in range(len(fields)))
    source = f"""
def rows(data, at, n, most, general, held):
{appends}
    count = 0
    while at < n and count < most:
        start = at
        count += 1
        try:
{inside}
            if at > n: raise Other
        except (Other, IndexError, UnicodeDecodeError, Error):
            at = general(start)
            continue
        {cells}
    return at, count
"""
    scope = {"Other": Other, "Error": struct.error, "number": int.from_bytes, "single": struct.Struct(order + "f").unpack_from, "double": struct.Struct(order + "d").unpack_from}
    exec(source, scope)  # noqa: S102 - made of the fixed pieces above, numbers and the bytes of keys as literals
    return scope["rows"]


def ranges(t: T.DataType) -> tuple[int, int]:
    return V.INTEGERS[INTEGERS[type(t)]] if type(t) in INTEGERS else (0, 0)


@lru_cache(64)
def map_rows(fmt: str, schema_json: str) -> Callable:
    schema = T.StructType.fromJson(json.loads(schema_json))
    one = cbor.encode if fmt == "cbor" else msgpack.encode
    fields = []
    for k, f in enumerate(schema):
        key = one(("s", f.name))
        if not k:
            key = one(("m", [(("n",), ("n",))] * len(schema)))[: -2 * len(schema)] + key
        lo, hi = ranges(f.dataType)
        code = READ[fmt][kind_of(f.dataType)].replace("{lo}", str(lo)).replace("{hi}", str(hi))
        fields.append((f"if data[at:at + {len(key)}] != {key!r}: raise Other\nat += {len(key)}\nb = data[at]; at += 1", code))
    return written(fields, ">")


AVRO_KINDS = {"boolean": "bool", "int": "int", "long": "int", "float": "float", "double": "double", "string": "text", "bytes": "bytes"}


@lru_cache(64)
def avro_rows(file_schema: str, schema_json: str) -> Callable | None:
    schema, own = T.StructType.fromJson(json.loads(schema_json)), avro.Schema(file_schema)
    kind, record = own.of(own.root)
    if kind != "record" or [f["name"] for f in record["fields"]] != schema.names:
        return None
    fields = []
    for f, s in zip(schema, record["fields"]):
        kind, d = own.of(s["type"])
        null, plain = None, kind
        if kind == "union":
            kinds = [own.of(x)[0] for x in d]
            if len(d) != 2 or kinds.count("null") != 1:
                return None
            null, plain = kinds.index("null"), kinds[1 - kinds.index("null")]
        want = {"int": ("int",), "real": ("float", "double"), "bool": ("bool",), "text": ("text",), "bytes": ("bytes",)}[kind_of(f.dataType)]
        if AVRO_KINDS.get(plain) not in want:
            return None
        lo, hi = ranges(f.dataType)
        code = READ["avro"][AVRO_KINDS[plain]].strip().replace("{lo}", str(lo)).replace("{hi}", str(hi))
        if null is not None:
            code = f"b = data[at]; at += 1\nif b == {2 * (1 - null)}:\n" + "\n".join("    " + line for line in code.split("\n")) + f"\nelif b == {2 * null}: v = None\nelse: raise Other"
        fields.append(("", code))
    return written(fields, "<")


def decodable(fmt: str, schema: T.StructType, options: dict) -> bool:
    plain = T.StructType([T.StructField(f.name, T.StringType()) if isinstance(f.dataType, T.TimestampNTZType) else f for f in schema])
    return flat(fmt, plain) and not options


def typed(values, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Values of any shape as rows of the schema: the general way."""
    arrow, held, cells = to_arrow_schema(schema), [], V.writer(schema)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    for v in values:
        held.append(cells(v))
        if len(held) == ROWS:
            yield rows()
            held.clear()
    if held:
        yield rows()


def column_of(cells: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(kind):
        if all(x is None or isinstance(x, str) for x in cells):
            return pa.array(cells, pa.string()).cast(kind)
    return pa.array(cells, kind)


def grouped(batches) -> Iterator[list[bytes]]:
    """The blocks of Arrow batches in groups that are decoded together: ROWS blocks or GROUP bytes at most, or one larger block."""
    held, size = [], 0
    for batch in batches:
        for block in batch.column(0):
            block = block.as_py()
            if held and (len(held) == ROWS or size + len(block) > GROUP):
                yield held
                held, size = [], 0
            held.append(block)
            size += len(block)
    if held:
        yield held


def protobuf_rows(blocks: list[bytes], kind, schema: T.StructType, decode: Callable) -> Iterator[pa.RecordBatch]:
    """One message a block as rows of the schema, by whole columns where its fields are the schema's."""
    try:
        yield pa.RecordBatch.from_arrays(protobuf.columns(blocks, kind, schema), schema=to_arrow_schema(schema))
    except (protobuf.Other, ProtobufError):  # the general way raises the error of the first bad message
        yield from typed((v for block in blocks for v in decode(block)), schema)


def decode(fmt: str, data: bytes, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The records of a block as rows of the schema, which decodable() allows."""
    return decode_all(fmt, [data], schema)


def decode_all(fmt: str, blocks: list[bytes], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The records of blocks, one after the other: small blocks share a batch of rows."""
    if fmt == "json":
        yield from _json(blocks, schema)
        return
    arrow, cells, names = to_arrow_schema(schema), V.writer(schema), schema.json()
    held = [[] for _ in schema]

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([column_of(c, f.type) for c, f in zip(held, arrow)], schema=arrow)
        for c in held:
            c.clear()
        return out

    def parts_of(data: bytes):
        if fmt != "avro":
            yield None, map_rows(fmt, names), None, data
            return
        whole = avro._Reader(data)
        own, codec, sync = avro.header(whole)
        rows = avro_rows(own.text, names)
        for count, part in avro.container_parts(whole, codec, sync):
            yield own, rows, count, part

    for own, rows, count, part in (p for data in blocks for p in parts_of(data)):
        reader = {"avro": avro, "cbor": cbor, "messagepack": msgpack}[fmt]._Reader(part)

        def general(at: int) -> int:
            reader.at = at
            v = reader.value(own.root, own) if own else reader.inner() if fmt == "cbor" else reader.value()
            for c, x in zip(held, cells(v)):
                c.append(x)
            return reader.at

        at, done = 0, 0
        while at < len(part) if count is None else done < count:
            most = ROWS - len(held[0])
            if rows:
                at, n = rows(part, at, len(part), most if count is None else min(most, count - done), general, held)
                if not n:
                    raise avro.AvroError("a block ends early")
                done += n
            else:
                at, done = general(at), done + 1
            if len(held[0]) >= ROWS:
                yield batch()
    if held[0]:
        yield batch()


def _constant(text: str):
    raise json_text.JsonError(f"{text} is not JSON")


_scan = json.JSONDecoder(object_pairs_hook=list, parse_constant=_constant).scan_once


def _json(blocks: list[bytes], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    arrow, names, rows, held = to_arrow_schema(schema), tuple(schema.names), [], []
    unfit = (Other, ValueError, TypeError, OverflowError, RecursionError, StopIteration, pa.ArrowException)

    def batch() -> Iterator[pa.RecordBatch]:
        """The rows since the last batch, whose text is held: if a column does not take them they go the general way."""
        try:
            columns = []
            for c, f in zip(zip(*rows), arrow):
                kinds = set(map(type, c)) - {type(None)}
                if pa.types.is_integer(f.type) and not kinds <= {int} or pa.types.is_floating(f.type) and not kinds <= {int, float}:
                    raise Other
                columns.append(column_of(list(c), f.type))
                if pa.types.is_floating(f.type) and pc.any(pc.is_inf(columns[-1])).as_py():
                    raise Other
            out = [pa.RecordBatch.from_arrays(columns, schema=arrow)] if rows else []
        except unfit:
            out = typed((v for text, lo, hi in held for v in json_text.decode(text[lo:hi].encode())), schema)
        yield from out
        rows.clear()
        held.clear()

    for data in blocks:
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError as e:
            yield from batch()
            raise json_text.JsonError("not UTF-8") from e
        at, n = 0, len(text)
        while at < n:
            start, odd = at, False
            try:
                while at < n and len(rows) < ROWS:
                    if text[at] == "{":
                        got, end = _scan(text, at)
                        keys, row = zip(*got)
                        if keys != names:
                            raise Other
                        rows.append(row)
                        at = end
                    elif text[at] in json_text.BLANK:
                        at += 1
                    else:
                        raise Other
            except unfit:
                odd = True
            held.append((text, start, at))
            if odd or len(rows) == ROWS:
                yield from batch()
            if odd:
                yield from typed(json_text.decode(text[at:].encode()), schema)
                break
    yield from batch()
