"""JSON: a stream of values of any kind, and three output styles."""

from __future__ import annotations

import codecs
import json
import math
import re
from collections.abc import Iterator

from .. import value as V
from ..errors import JsonError
from .stream import CHUNK, as_file

BLANK = " \t\n\r"
#: ANSI styles of readable output. Attributes: 1 bold, 2 dim, 3 italic; colours: 30 black, 31 red, 32 green, 34 blue.
STYLES = {"null": "1;2;3;30", "true": "1;3;32", "false": "1;3;31", "number": "34", "quote": "2;32", "char": "32", "escape": "2;32", "punctuation": "1", "key_quote": "2;34", "key_char": "34", "key_escape": "2;34"}
ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"} | {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in "\b\f\n\r\t"}
SURROGATE = re.compile("[\ud800-\udfff]").search
#: Text in quotes with the same escapes, by the standard library.
quoted = json.encoder.encode_basestring


def _integer(text: str):
    n = int(text)
    if text.startswith("-"):
        return ("i64", n) if -(2**63) <= n < 0 else _real(text)
    return ("u64", n) if n < 2**64 else _real(text)


def _real(text: str):
    x = float(text)
    if not math.isfinite(x):
        raise JsonError(f"number out of range: {text[:40]}")
    return ("f64", x)


def _constant(text: str):
    raise JsonError(f"{text} is not JSON")


_decoder = json.JSONDecoder(object_pairs_hook=lambda pairs: ("m", pairs), parse_int=_integer, parse_float=_real, parse_constant=_constant)


def _value(x):
    """The decoder gives tuples for numbers and maps, and Python's own for the rest."""
    if isinstance(x, str):
        if not x.isascii() and SURROGATE(x):
            raise JsonError("a lone surrogate is no text")
        return ("s", x)
    if x is None:
        return V.UNIT
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, list):
        return ("q", [_value(y) for y in x])
    if x[0] == "m":
        return ("m", [(_value(k), _value(y)) for k, y in x[1]])
    return x


def cut_off(e: ValueError, n: int) -> bool:
    """Whether an error may come from text that goes on behind n: it stands at the end, or in a string without one."""
    return isinstance(e, json.JSONDecodeError) and (e.pos > n - 16 or e.msg.startswith("Unterminated string"))


def decode(data) -> Iterator[tuple]:
    """Values one after the other, in white space or not; the first error ends the stream. Of a file, what holds the next value is read."""
    file, utf8, text, at, ended, size = as_file(data), codecs.getincrementaldecoder("utf-8")(), "", 0, False, CHUNK

    def read() -> None:
        """More text, twice as much as the time before while one value is not whole."""
        nonlocal text, at, ended
        part = file.read1(size)
        ended = not part
        try:
            text, at = text[at:] + utf8.decode(part, ended), 0
        except UnicodeDecodeError as e:
            raise JsonError("not UTF-8") from e

    while True:
        n = len(text)
        while at < n and text[at] in BLANK:
            at += 1
        if at == n:
            if ended:
                return
            read()
            continue
        try:
            got, end = _decoder.raw_decode(text, at)
            if not ended and text[at] not in '[{"' and end > n - 4 and not text[end:].strip(".eE+-"):
                read()  # a number or name may go on
                continue
        except (ValueError, RecursionError) as e:
            if not ended and isinstance(e, ValueError) and cut_off(e, n):
                size = min(2 * size, 1 << 28)
                read()
                continue
            raise e if isinstance(e, JsonError) else JsonError(str(e)) from e
        if text[at] not in '[{"' and end < n and text[end] not in BLANK + '[]{}",:':
            raise JsonError(f"trailing characters at {end}")
        at, size = end, CHUNK
        yield _value(got)


def _key(k) -> str:
    if k[0] in ("s", "c"):
        return k[1]
    if k[0] in V.INTEGERS:
        return str(k[1])
    raise JsonError(f"a key must be a string, not {k[0]}")


def _scalar(v) -> tuple[str, str]:
    """Style and text of what is neither text nor container."""
    tag = v[0]
    if tag == "n" or tag in V.FLOATS and not math.isfinite(v[1]):
        return "null", "null"
    if tag == "b":
        return ("true", "true") if v[1] else ("false", "false")
    if tag in V.FLOATS:
        return "number", V.number_text(tag, v[1])
    return "number", str(v[1])


def compact(v) -> str:
    tag = v[0]
    if tag in ("s", "c"):
        return quoted(v[1])
    if tag == "y":
        return f"[{','.join(map(str, v[1]))}]"
    if tag == "q":
        return f"[{','.join(map(compact, v[1]))}]"
    if tag == "m":
        return "{" + ",".join([f"{quoted(_key(k))}:{compact(x)}" for k, x in v[1]]) + "}"
    return _scalar(v)[1]


def _spread(v, paint, depth: int = 0) -> str:
    """Each element on its own line, two spaces a level; empty containers stay on one line."""
    tag = v[0]
    if tag in ("s", "c"):
        return _text(v[1], paint, "")
    if tag in ("y", "q", "m"):
        opening, closing = "{}" if tag == "m" else "[]"
        inner = "\n" + "  " * (depth + 1)
        if tag == "m":
            parts = [_text(_key(k), paint, "key_") + paint("punctuation", ": ") + _spread(x, paint, depth + 1) for k, x in v[1]]
        else:
            parts = [_spread(("u8", x) if tag == "y" else x, paint, depth + 1) for x in v[1]]
        body = paint("punctuation", ",").join(inner + p for p in parts)
        return paint("punctuation", opening) + body + ("\n" + "  " * depth) * bool(parts) + paint("punctuation", closing)
    return paint(*_scalar(v))


def _text(text: str, paint, kind: str) -> str:
    out, plain = [paint(f"{kind}quote", '"')], 0
    for k, c in enumerate(text):
        if c in ESCAPES:
            if plain < k:
                out.append(paint(f"{kind}char", text[plain:k]))
            out.append(paint(f"{kind}escape", ESCAPES[c]))
            plain = k + 1
    if plain < len(text):
        out.append(paint(f"{kind}char", text[plain:]))
    return "".join(out) + paint(f"{kind}quote", '"')


def indented(v) -> str:
    return _spread(v, lambda _, text: text)


def readable(v) -> str:
    return _spread(v, lambda style, text: f"\x1b[{STYLES[style]}m{text}\x1b[0m")


STYLE = {"compact": compact, "indented": indented, "readable": readable}


def encode(v, style: str = "compact") -> bytes:
    """One value and a line end. Bytes are arrays of integers; NaN and infinities are null."""
    return (STYLE[style](v) + "\n").encode()
