"""Input that is read as it is needed: decoders take bytes, or a binary file of which they hold about one record."""

from __future__ import annotations

import io

#: Bytes asked for at once.
CHUNK = 1 << 16


def as_file(data):
    """A binary file of bytes, or the file itself, buffered."""
    if isinstance(data, (bytes, bytearray, memoryview)):
        return io.BytesIO(data)
    return data if hasattr(data, "read1") else io.BufferedReader(data, CHUNK)


def whole(data) -> bytes:
    """All bytes, for formats of one document."""
    return bytes(data) if isinstance(data, (bytes, bytearray, memoryview)) else data.read()


class Reader:
    """take() and more() of bytes; at is the place of the next byte."""

    def __init__(self, data):
        self.file = None if isinstance(data, (bytes, bytearray, memoryview)) else as_file(data)
        self.data, self.at, self.held = (data if self.file is None else b""), 0, b""

    def ended(self, n: int) -> Exception:
        raise NotImplementedError

    def take(self, n: int) -> bytes:
        if self.file is None:
            if n < 0 or self.at + n > len(self.data):
                raise self.ended(n)
            self.at += n
            return self.data[self.at - n : self.at]
        if n < 0:
            raise self.ended(n)
        got = self.held[:n]
        self.held = self.held[n:]
        if len(got) < n:
            parts, size = [got], len(got)
            while size < n and (part := self.file.read(min(n - size, 1 << 24))):  # a wrong length is not believed at once
                parts.append(part)
                size += len(part)
            got = b"".join(parts)
            if size < n:
                raise self.ended(n)
        self.at += n
        return got

    def more(self) -> bool:
        if self.file is None:
            return self.at < len(self.data)
        self.held = self.held or self.file.read(1)
        return bool(self.held)
