"""Raw text: a string for each line."""

from __future__ import annotations

from collections.abc import Iterator

from ..errors import RawError
from .stream import as_file


def text(line: bytes) -> tuple:
    r"""A line without its \n or \r\n."""
    if line.endswith(b"\n"):
        line = line[:-2] if line.endswith(b"\r\n") else line[:-1]
    try:
        return ("s", line.decode("utf-8"))
    except UnicodeDecodeError as e:
        raise RawError("not UTF-8") from e


def decode(data) -> Iterator[tuple]:
    r"""Lines end with \n or \r\n, one of which goes; a last line needs no end."""
    return map(text, as_file(data))


def decode_split(file, lo: int, hi: int) -> Iterator[tuple[int, tuple]]:
    """(place, line) of the lines of a seekable file that begin in [lo, hi); a place is that of the first byte."""
    file.seek(max(lo - 1, 0))
    at = lo and lo - 1 + len(file.readline())  # the line before ends here, or goes on into this part
    while at < hi and (line := file.readline()):
        yield at, text(line)
        at += len(line)


def encode(v) -> bytes:
    if v[0] in ("s", "c"):
        return v[1].encode() + b"\n"
    if v[0] == "y":
        return v[1] + b"\n"
    raise RawError(f"a line can't hold {v[0]}")
