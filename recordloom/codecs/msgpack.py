"""MessagePack: values back to back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .. import value as V
from ..errors import MessagePackError
from .stream import Reader

#: Marker of each fixed-size number: struct format.
NUMBERS = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}


class _Reader(Reader):
    def ended(self, n: int) -> Exception:
        return MessagePackError("the input ends inside a value")

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")

    def text(self, n: int):
        try:
            return ("s", self.take(n).decode("utf-8"))
        except UnicodeDecodeError as e:
            raise MessagePackError("text that is not UTF-8") from e

    def value(self):
        m = self.take(1)[0]
        if m < 0x80:
            return ("u64", m)
        if m < 0x90:
            return self.map(m & 15)
        if m < 0xA0:
            return self.array(m & 15)
        if m < 0xC0:
            return self.text(m & 31)
        if m >= 0xE0:
            return ("i64", m - 256)
        if m == 0xC0:
            return V.UNIT
        if m in (0xC2, 0xC3):
            return ("b", m == 0xC3)
        if m in (0xC4, 0xC5, 0xC6):
            return ("y", self.take(self.number(1 << (m - 0xC4))))
        if m in (0xC7, 0xC8, 0xC9):  # an extension loses its type
            n = self.number(1 << (m - 0xC7))
            self.take(1)
            return ("y", self.take(n))
        if m == 0xCA:
            return ("f32", struct.unpack(">f", self.take(4))[0])
        if m == 0xCB:
            return ("f64", struct.unpack(">d", self.take(8))[0])
        if m in NUMBERS:
            n = struct.unpack(NUMBERS[m], self.take(struct.calcsize(NUMBERS[m])))[0]
            return ("u64", n) if n >= 0 else ("i64", n)
        if 0xD4 <= m <= 0xD8:
            self.take(1)
            return ("y", self.take(1 << (m - 0xD4)))
        if m in (0xD9, 0xDA, 0xDB):
            return self.text(self.number(1 << (m - 0xD9)))
        if m in (0xDC, 0xDD):
            return self.array(self.number(2 << (m - 0xDC)))
        if m in (0xDE, 0xDF):
            return self.map(self.number(2 << (m - 0xDE)))
        raise MessagePackError(f"unassigned marker {m:#x}")

    def array(self, n: int):
        return ("q", [self.value() for _ in range(n)])

    def map(self, n: int):
        return ("m", [(self.value(), self.value()) for _ in range(n)])


def decode(data) -> Iterator[tuple]:
    """Values to the end of the input, which may only come before a marker. Integers from 0 on are u64, others i64."""
    r = _Reader(data)
    while r.more():
        try:
            yield r.value()
        except RecursionError as e:
            raise MessagePackError("values nested too deeply") from e


def _integer(n: int) -> bytes:
    if 0 <= n < 128 or -32 <= n < 0:
        return struct.pack(">B" if n >= 0 else ">b", n)
    for m, kind, lo, hi in ((0xCC, ">B", 0, 2**8), (0xCD, ">H", 0, 2**16), (0xCE, ">I", 0, 2**32), (0xCF, ">Q", 0, 2**64)) if n >= 0 else ((0xD0, ">b", -(2**7), 0), (0xD1, ">h", -(2**15), 0), (0xD2, ">i", -(2**31), 0), (0xD3, ">q", -(2**63), 0)):
        if lo <= n < hi:
            return bytes([m]) + struct.pack(kind, n)
    raise MessagePackError(f"{n} has more than 64 bits")


def _sized(n: int, fix: int, most: int, markers: dict[int, int]) -> bytes:
    """A length in the marker itself up to most, else after the marker in the fewest bytes."""
    if n <= most:
        return bytes([fix | n])
    size = next(s for s in sorted(markers) if n < 1 << (8 * s))
    return bytes([markers[size]]) + n.to_bytes(size, "big")


def encode(v) -> bytes:
    tag = v[0]
    if tag == "n":
        return b"\xc0"
    if tag == "b":
        return b"\xc3" if v[1] else b"\xc2"
    if tag in V.INTEGERS:
        return _integer(v[1])
    if tag == "f32":
        return b"\xca" + struct.pack(">f", v[1])
    if tag == "f64":
        return b"\xcb" + struct.pack(">d", v[1])
    if tag in ("s", "c"):
        data = v[1].encode()
        return _sized(len(data), 0xA0, 31, {1: 0xD9, 2: 0xDA, 4: 0xDB}) + data
    if tag == "y":
        return _sized(len(v[1]), 0, -1, {1: 0xC4, 2: 0xC5, 4: 0xC6}) + v[1]
    if tag == "q":
        return _sized(len(v[1]), 0x90, 15, {2: 0xDC, 4: 0xDD}) + b"".join(map(encode, v[1]))
    return _sized(len(v[1]), 0x80, 15, {2: 0xDE, 4: 0xDF}) + b"".join(encode(k) + encode(x) for k, x in v[1])
