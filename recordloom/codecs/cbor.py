"""CBOR (RFC 8949): items back to back."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

from .. import value as V
from ..errors import CborError
from .stream import Reader

BREAK = object()


class Truncated(CborError):
    pass


class _Reader(Reader):
    def ended(self, n: int) -> Exception:
        return Truncated("the input ends inside an item")

    def size(self, info: int) -> int | None:
        if info < 24:
            return info
        if info <= 27:
            return int.from_bytes(self.take(1 << (info - 24)), "big")
        if info == 31:
            return None
        raise CborError(f"reserved length {info}")

    def item(self):
        head = self.take(1)[0]
        major, info = head >> 5, head & 31
        if major == 7:
            return self.simple(info)
        n = self.size(info)
        if n is None and major in (0, 1, 6):
            raise CborError("an integer or tag of unknown length")
        if major == 0:
            return (_width(n), n)
        if major == 1:
            if n >= 2**63:
                raise CborError("a negative integer below 64 bits")
            return (_signed(-1 - n), -1 - n)
        if major in (2, 3):
            data = self.take(n) if n is not None else self.chunks(major)
            if major == 2:
                return ("y", data)
            try:
                return ("s", data.decode("utf-8"))
            except UnicodeDecodeError as e:
                raise CborError("text that is not UTF-8") from e
        if major == 4:
            return ("q", list(self.items(n)))
        if major == 5:
            return ("m", [(k, self.inner()) for k in self.items(n)])
        return self.inner()  # a tag goes, its item stays

    def inner(self):
        v = self.item()
        if v is BREAK:
            raise CborError("a break where an item is due")
        return v

    def items(self, n: int | None):
        if n is None:
            while (v := self.item()) is not BREAK:
                yield v
        else:
            for _ in range(n):
                yield self.inner()

    def chunks(self, major: int) -> bytes:
        out = []
        while (head := self.take(1)[0]) != 0xFF:
            if head >> 5 != major or head & 31 == 31:
                raise CborError("a chunk of another kind")
            out.append(self.take(self.size(head & 31)))
        return b"".join(out)

    def simple(self, info: int):
        if info in (20, 21):
            return ("b", info == 21)
        if info in (22, 23):
            return V.UNIT
        if info == 25:
            return ("f32", struct.unpack(">e", self.take(2))[0])
        if info == 26:
            return ("f32", struct.unpack(">f", self.take(4))[0])
        if info == 27:
            return ("f64", struct.unpack(">d", self.take(8))[0])
        if info == 31:
            return BREAK
        raise CborError(f"unassigned simple value {info}")


def _width(n: int) -> str:
    return next(t for t in ("u8", "u16", "u32", "u64") if n <= V.INTEGERS[t][1])


def _signed(n: int) -> str:
    return next(t for t in ("i8", "i16", "i32", "i64") if n >= V.INTEGERS[t][0])


def decode(data, truncated: str = "error") -> Iterator[tuple]:
    """Items to the end of the input. A last item that is cut off raises, or is left out with truncated="ignore".
    Integers and floats take the narrowest kind that holds them."""
    r = _Reader(data)
    while r.more():
        try:
            v = r.item()
        except Truncated:
            if truncated == "ignore":
                return
            raise
        except RecursionError as e:
            raise CborError("items nested too deeply") from e
        if v is BREAK:
            raise CborError("a break where an item is due")
        yield v


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    k = next(k for k in range(4) if n < 1 << (8 << k))
    return bytes([major << 5 | 24 + k]) + n.to_bytes(1 << k, "big")


def encode(v, byte_strings: bool = False) -> bytes:
    """Bytes are arrays of integers, or byte strings if asked for."""
    tag = v[0]
    if tag == "n":
        return b"\xf6"
    if tag == "b":
        return b"\xf5" if v[1] else b"\xf4"
    if tag in V.INTEGERS:
        V.check(v)
        return _head(0, v[1]) if v[1] >= 0 else _head(1, -1 - v[1])
    if tag == "f32" or tag == "f64" and (not math.isfinite(v[1]) or V.single(v[1]) == v[1]):
        return b"\xfa" + struct.pack(">f", v[1])
    if tag == "f64":
        return b"\xfb" + struct.pack(">d", v[1])
    if tag in ("s", "c"):
        data = v[1].encode()
        return _head(3, len(data)) + data
    if tag == "y":
        return _head(2, len(v[1])) + v[1] if byte_strings else _head(4, len(v[1])) + b"".join(_head(0, x) for x in v[1])
    if tag == "q":
        return _head(4, len(v[1])) + b"".join(encode(x, byte_strings) for x in v[1])
    return _head(5, len(v[1])) + b"".join(encode(k, byte_strings) + encode(x, byte_strings) for k, x in v[1])
