"""Avro object container files: null, deflate and snappy blocks."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

from .. import value as V
from ..errors import AvroError
from .stream import Reader

MAGIC = b"Obj\x01"
CODECS = ("null", "deflate", "snappy")
PRIMITIVE = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
#: Bytes of a block before compression.
BLOCK = 1 << 16


class Schema:
    """A parsed schema with its named types."""

    def __init__(self, text: str):
        try:
            self.root = json.loads(text)
        except ValueError as e:
            raise AvroError(f"the schema is not JSON: {e}") from e
        self.text, self.named = text, {}
        self.resolved: dict = {}
        self.register(self.root, "")

    def register(self, s, space: str) -> None:
        if isinstance(s, list):
            for x in s:
                self.register(x, space)
        elif isinstance(s, dict):
            kind = s.get("type")
            if kind in ("record", "enum", "fixed", "error"):
                name = s.get("name")
                if not name:
                    raise AvroError("a named type without a name")
                space = name.rpartition(".")[0] if "." in name else s.get("namespace", space)
                full = name if "." in name or not space else f"{space}.{name}"
                self.named[full] = self.named[full.rpartition(".")[2]] = s
                for f in s.get("fields", ()):
                    self.register(f["type"], space)
            elif kind == "array":
                self.register(s["items"], space)
            elif kind == "map":
                self.register(s["values"], space)
            else:
                self.register(kind, space)
        elif s not in PRIMITIVE and s not in self.named and f"{space}.{s}" not in self.named:
            raise AvroError(f"unknown type {s!r}")

    def of(self, s):
        """(kind, definition) behind names and wrapped primitives; logical types are their plain ones."""
        key = s if isinstance(s, str) else id(s)  # definitions live as long as the schema
        found = self.resolved.get(key)
        if found is None:
            found = self.resolved[key] = self.resolve(s)
        return found

    def resolve(self, s):
        if isinstance(s, list):
            return "union", s
        if isinstance(s, str):
            if s in PRIMITIVE:
                return s, s
            s = self.named.get(s) or self.named[s.rpartition(".")[2]]
        kind = s["type"]
        if isinstance(kind, (dict, list)) or kind in PRIMITIVE or kind in self.named:
            return self.of(kind)
        return ("record" if kind == "error" else kind), s


class _Reader(Reader):
    def ended(self, n: int) -> Exception:
        return AvroError("the file ends early")

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 127) << shift
            if b < 128:
                break
            shift += 7
        return (n >> 1) ^ -(n & 1)

    def sized(self) -> bytes:
        return self.take(self.long())

    def blocks(self) -> Iterator[None]:
        while n := self.long():
            if n < 0:
                self.long()
            for _ in range(abs(n)):
                yield

    def value(self, s, schema: Schema):
        kind, s = schema.of(s)
        if kind == "null":
            return V.UNIT
        if kind == "boolean":
            return ("b", self.take(1) != b"\0")
        if kind in ("int", "long"):
            return ("i32" if kind == "int" else "i64", self.long())
        if kind == "float":
            return ("f32", struct.unpack("<f", self.take(4))[0])
        if kind == "double":
            return ("f64", struct.unpack("<d", self.take(8))[0])
        if kind == "bytes":
            return ("y", self.sized())
        if kind == "string":
            return ("s", self.text())
        if kind == "fixed":
            return ("y", self.take(s["size"]))
        if kind == "enum":
            return ("s", self.chosen(s["symbols"], "symbol"))
        if kind == "union":
            return self.value(self.chosen(s, "branch"), schema)
        if kind == "array":
            return ("q", [self.value(s["items"], schema) for _ in self.blocks()])
        if kind == "map":
            return ("m", [(("s", self.text()), self.value(s["values"], schema)) for _ in self.blocks()])
        return ("m", [(("s", f["name"]), self.value(f["type"], schema)) for f in s["fields"]])

    def chosen(self, among: list, what: str):
        k = self.long()
        if not 0 <= k < len(among):
            raise AvroError(f"no {what} {k} of {len(among)}")
        return among[k]

    def text(self) -> str:
        try:
            return self.sized().decode("utf-8")
        except UnicodeDecodeError as e:
            raise AvroError("text that is not UTF-8") from e


def _snappy():
    import pyarrow as pa

    return pa.Codec("snappy")


def _unpack(codec: str, data: bytes) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        try:
            return zlib.decompress(data, -15)
        except zlib.error as e:
            raise AvroError(str(e)) from e
    n = shift = 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            break
    if len(data) < 5 or n > 1 << 31:
        raise AvroError("a snappy block without its size or checksum")
    try:
        out = _snappy().decompress(data[:-4], decompressed_size=n, asbytes=True)
    except OSError as e:
        raise AvroError(str(e)) from e
    if zlib.crc32(out) != int.from_bytes(data[-4:], "big"):
        raise AvroError("a block's checksum is wrong")
    return out


def _pack(codec: str, data: bytes) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        c = zlib.compressobj(wbits=-15)
        return c.compress(data) + c.flush()
    return _snappy().compress(data, asbytes=True) + zlib.crc32(data).to_bytes(4, "big")


def header(r: _Reader) -> tuple[Schema, str, bytes]:
    """Schema, codec and sync marker of a file; the blocks come next. A bad header raises before any value is read."""
    if r.take(4) != MAGIC:
        raise AvroError("no Avro container file")
    meta = {}
    for _ in r.blocks():
        key = r.text()
        meta[key] = r.sized()
    codec = meta.get("avro.codec", b"null").decode()
    if codec not in CODECS:
        raise AvroError(f"unknown codec {codec}")
    if "avro.schema" not in meta:
        raise AvroError("a header without a schema")
    return Schema(meta["avro.schema"].decode()), codec, r.take(16)


def decode(data) -> Iterator[tuple]:
    r = _Reader(data)
    schema, codec, sync = header(r)
    return (v for count, part in container_parts(r, codec, sync) for v in part_values(count, part, schema))


def decode_split(file, lo: int, hi: int) -> Iterator[tuple[int, tuple]]:
    """(place, value) of the blocks of a seekable file that begin in [lo, hi): a block begins behind a sync marker, and belongs to
    the part in which its marker begins. A place is the block's, times 2**20, and the value's number in it."""
    r = _Reader(file)
    schema, codec, sync = header(r)
    if (start := r.at) - 16 < lo:
        start = next_marker(file, sync, lo)
        if start is None:
            return
    file.seek(start)
    r = _Reader(file)
    r.at = start
    while r.at - 16 < hi and r.more():
        place = r.at
        count, part = next(container_parts(r, codec, sync))
        if count >= 1 << 20:
            raise AvroError("a block of 2**20 values or more has no places: read the file whole")
        for k, v in enumerate(part_values(count, part, schema)):
            yield place << 20 | k, v


def next_marker(file, sync: bytes, at: int) -> int | None:
    """Where the first sync marker that begins at a place or behind it ends."""
    file.seek(at)
    held = b""
    while part := file.read(1 << 20):
        held += part
        if (k := held.find(sync)) >= 0:
            return at + k + 16
        at, held = at + max(0, len(held) - 15), held[-15:]
    return None


def part_values(count: int, part: bytes, schema: Schema) -> Iterator[tuple]:
    block = _Reader(part)
    for _ in range(count):
        try:
            yield block.value(schema.root, schema)
        except RecursionError as e:
            raise AvroError("values nested too deeply") from e


def container_parts(r: _Reader, codec: str, sync: bytes) -> Iterator[tuple[int, bytes]]:
    """The number of values and the bytes of each block from here on."""
    while r.more():
        count = r.long()
        part = _unpack(codec, r.sized())
        if r.take(16) != sync:
            yield count, part  # its values come before the error
            raise AvroError("a block does not end with the sync marker")
        yield count, part


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    if n < 128:
        return ONE_BYTE[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


ONE_BYTE = [bytes([n]) for n in range(128)]


def _bytes(data: bytes) -> bytes:
    return _long(len(data)) + data


def key_text(k) -> str:
    if k[0] in ("s", "c"):
        return k[1]
    raise AvroError(f"a key must be a string, not {k[0]}")


def fits(v, s, schema: Schema) -> bool:
    kind, s = schema.of(s)
    tag = v[0]
    if kind == "union":
        return any(fits(v, x, schema) for x in s)
    if kind in ("int", "long"):
        lo, hi = V.INTEGERS["i32" if kind == "int" else "i64"]
        return tag in V.INTEGERS and lo <= v[1] <= hi
    if kind == "float":
        return tag == "f32"
    if kind == "double":
        return tag in V.FLOATS
    if kind == "record":
        names = {f["name"] for f in s["fields"]}
        return tag == "m" and all(k[0] in ("s", "c") and k[1] in names for k, _ in v[1])
    if kind == "enum":
        return tag in ("s", "c") and v[1] in s["symbols"]
    if kind == "fixed":
        return tag == "y" and len(v[1]) == s["size"]
    return tag in {"null": "n", "boolean": "b", "bytes": "y", "string": ("s", "c"), "array": "q", "map": "m"}[kind]


def _default(x, s, schema: Schema):
    """A field's default, written in JSON, as a value."""
    kind, s = schema.of(s)
    if kind == "union":
        return _default(x, s[0], schema)
    if kind in ("int", "long"):
        return ("i64", x)
    if kind in ("float", "double"):
        return ("f32" if kind == "float" else "f64", float(x))
    if kind in ("bytes", "fixed"):
        return ("y", x.encode("latin-1"))
    if kind == "array":
        return ("q", [_default(y, s["items"], schema) for y in x])
    if kind == "map":
        return ("m", [(("s", k), _default(y, s["values"], schema)) for k, y in x.items()])
    if kind == "record":
        types = {f["name"]: f["type"] for f in s["fields"]}
        return ("m", [(("s", k), _default(y, types[k], schema)) for k, y in x.items()])
    return {"null": V.UNIT, "boolean": ("b", x)}.get(kind, ("s", x))


def write_value(v, s, schema: Schema) -> bytes:
    kind, s = schema.of(s)
    tag = v[0]
    if tag == "u64" and v[1] > 2**63 - 1:
        raise AvroError(f"{v[1]} is beyond a long")
    if kind == "union":
        for k, x in enumerate(s):
            if fits(v, x, schema):
                return _long(k) + write_value(v, x, schema)
        raise AvroError(f"no branch of the union holds {tag}")
    if tag == "m" and kind in ("record", "map"):
        for k, _ in v[1]:
            key_text(k)
    if kind == "record" and tag == "m":
        cells = {}
        for k, x in v[1]:
            cells.setdefault(key_text(k), x)
        out = []
        for f in s["fields"]:
            if f["name"] not in cells and "default" not in f:
                raise AvroError(f"the field {f['name']} is missing")
            out.append(write_value(cells.pop(f["name"]) if f["name"] in cells else _default(f["default"], f["type"], schema), f["type"], schema))
        if cells:
            raise AvroError(f"the schema lacks the fields {', '.join(cells)}")
        return b"".join(out)
    if not fits(v, s, schema):
        raise AvroError(f"{tag} is no {kind}")
    if kind == "null":
        return b""
    if kind == "boolean":
        return b"\x01" if v[1] else b"\0"
    if kind in ("int", "long"):
        return _long(v[1])
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", v[1])
    if kind == "bytes":
        return _bytes(v[1])
    if kind == "string":
        return _bytes(v[1].encode())
    if kind == "fixed":
        return v[1]
    if kind == "enum":
        return _long(s["symbols"].index(v[1]))
    parts = [write_value(x, s["items"], schema) for x in v[1]] if kind == "array" else [_bytes(key_text(k).encode()) + write_value(x, s["values"], schema) for k, x in v[1]]
    return (_long(len(parts)) + b"".join(parts) if parts else b"") + b"\0"


#: Kinds whose values are told by their tag alone, and how they are written.
TAGS = {"null": ("n",), "boolean": ("b",), "int": tuple(V.INTEGERS), "long": tuple(V.INTEGERS), "double": V.FLOATS, "float": ("f32",), "string": ("s", "c"), "bytes": ("y",)}
PLAIN = {"null": lambda x: b"", "boolean": lambda x: b"\x01" if x else b"\0", "double": struct.Struct("<d").pack, "float": struct.Struct("<f").pack, "string": lambda x: _bytes(x.encode()), "bytes": lambda x: _bytes(x)}


def writer(s, schema: Schema, made: dict | None = None):
    """write_value for one type as a function: what has the expected shape takes a short way, all else write_value itself."""
    made = {} if made is None else made
    kind, d = schema.of(s)
    general = lambda v: write_value(v, s, schema)
    if kind in PLAIN:
        tags, plain = TAGS[kind], PLAIN[kind]
        return lambda v: (plain(v[1]) if len(v) > 1 else b"") if v[0] in tags else general(v)
    if kind in ("int", "long"):
        lo, hi = V.INTEGERS["i32" if kind == "int" else "i64"]
        return lambda v: _long(v[1]) if v[0] in V.INTEGERS and lo <= v[1] <= hi else general(v)
    if kind == "union":
        kinds = [schema.of(x)[0] for x in d]
        if len(d) == 2 and kinds.count("null") == 1 and set(kinds) <= {"null", *TAGS}:
            at = 1 - kinds.index("null")
            null, some, inner, tags = _long(1 - at), _long(at), writer(d[at], schema, made), TAGS[kinds[at]]
            return lambda v: null if v[0] == "n" else some + inner(v) if v[0] in tags else general(v)
        return general
    if kind == "record":
        if id(d) not in made:
            made[id(d)] = general  # inside itself
            names, fields = [f["name"] for f in d["fields"]], [writer(f["type"], schema, made) for f in d["fields"]]
            made[id(d)] = lambda v: b"".join([w(x) for w, (_, x) in zip(fields, v[1])]) if v[0] == "m" and [k[1] for k, _ in v[1]] == names else general(v)
        return made[id(d)]
    return general


def container_header(schema: str, codec: str, sync: bytes) -> bytes:
    meta = {"avro.schema": schema.encode(), "avro.codec": codec.encode()}
    return MAGIC + _long(len(meta)) + b"".join(_bytes(k.encode()) + _bytes(x) for k, x in meta.items()) + b"\0" + sync


def container_block(count: int, data: bytes, codec: str, sync: bytes) -> bytes:
    return _long(count) + _bytes(_pack(codec, data)) + sync


def encode(values: Iterable[tuple], schema: str | Schema, codec: str = "null") -> Iterator[bytes]:
    """The pieces of a container file: its header, then blocks."""
    schema = Schema(schema) if isinstance(schema, str) else schema
    if codec not in CODECS:
        raise AvroError(f"unknown codec {codec}")
    sync = os.urandom(16)
    yield container_header(schema.text, codec, sync)
    held, size, n, write = [], 0, 0, writer(schema.root, schema)

    for v in values:
        held.append(write(v))
        size, n = size + len(held[-1]), n + 1
        if size >= BLOCK:
            yield container_block(n, b"".join(held), codec, sync)
            held, size, n = [], 0, 0
    if n:
        yield container_block(n, b"".join(held), codec, sync)


def schema_of(kind) -> str:
    """An Avro schema for rows of a Spark schema; every field may be null."""
    from pyspark.sql import types as T

    count = iter(range(1 << 30))

    def plain(t):
        if isinstance(t, T.StructType):
            return {"type": "record", "name": f"record{next(count)}", "fields": [{"name": f.name, "type": ["null", plain(f.dataType)]} for f in t]}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": ["null", plain(t.elementType)]}
        if isinstance(t, T.MapType):
            return {"type": "map", "values": ["null", plain(t.valueType)]}
        for of, name in ((T.BooleanType, "boolean"), (T.ByteType, "int"), (T.ShortType, "int"), (T.IntegerType, "int"), (T.LongType, "long"), (T.FloatType, "float"), (T.DoubleType, "double"), (T.BinaryType, "bytes")):
            if isinstance(t, of):
                return name
        return "string"

    return json.dumps(plain(kind))
