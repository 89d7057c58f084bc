"""TOML: one document, one record."""

from __future__ import annotations

import datetime
import math
import re
import tomllib
from collections.abc import Iterator

from .. import value as V
from ..errors import TomlError
from .stream import whole

#: Fixed value: the key of the one-entry map that stands for a date or time.
DATETIME_KEY = "$__toml_private_datetime"
BARE = re.compile(r"[A-Za-z0-9_-]+")
ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"} | {chr(c): f"\\u{c:04X}" for c in [*range(32), 127] if chr(c) not in "\b\f\n\r\t"}
TABLE = str.maketrans(ESCAPES)


def _value(x):
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, int):
        if not -(2**63) <= x < 2**63:
            raise TomlError(f"{x} has more than 64 bits")
        return ("i64", x)
    if isinstance(x, float):
        return ("f64", x)
    if isinstance(x, str):
        return ("s", x)
    if isinstance(x, list):
        return ("q", [_value(y) for y in x])
    if isinstance(x, dict):
        return ("m", [(("s", k), _value(y)) for k, y in x.items()])
    assert isinstance(x, (datetime.datetime, datetime.date, datetime.time))
    return ("m", [(("s", DATETIME_KEY), ("s", x.isoformat().replace("+00:00", "Z")))])


def decode(data) -> Iterator[tuple]:
    try:
        yield _value(tomllib.loads(whole(data).decode("utf-8")))
    except (UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise TomlError(str(e)) from e


def _key(k) -> str:
    if k[0] not in ("s", "c"):
        raise TomlError(f"a key must be a string, not {k[0]}")
    return k[1] if BARE.fullmatch(k[1]) else f'"{k[1].translate(TABLE)}"'


def _inline(v) -> str:
    tag = v[0]
    if tag == "n":
        raise TomlError("null has no form")
    if tag == "b":
        return "true" if v[1] else "false"
    if tag in V.INTEGERS:
        if v[1] > 2**63 - 1:
            raise TomlError(f"{v[1]} is beyond 64 bits with sign")
        return str(v[1])
    if tag in V.FLOATS:
        return V.number_text(tag, v[1]) if math.isfinite(v[1]) else "nan" if math.isnan(v[1]) else "inf" if v[1] > 0 else "-inf"
    if tag in ("s", "c"):
        return f'"{v[1].translate(TABLE)}"'
    if tag == "y":
        return f"[{', '.join(map(str, v[1]))}]"
    if tag == "q":
        return f"[{', '.join(map(_inline, v[1]))}]"
    return f"{{ {', '.join(f'{_key(k)} = {_inline(x)}' for k, x in v[1])} }}" if v[1] else "{}"


def _table(v, path: str) -> str:
    """Keys in order. A table gets a header only where no plain key follows, which would belong to it."""
    keys = [_key(k) for k, _ in v[1]]
    if len(set(keys)) < len(keys):
        raise TomlError("a table holds a key once")
    last_plain = max((k for k, (_, x) in enumerate(v[1]) if x[0] != "m"), default=-1)
    out = []
    for k, (name, (_, x)) in enumerate(zip(keys, v[1])):
        if x[0] == "m" and k > last_plain:
            full = f"{path}.{name}" if path else name
            out.append(f"\n[{full}]\n{_table(x, full)}")
        else:
            out.append(f"{name} = {_inline(x)}\n")
    return "".join(out)


def encode(v) -> bytes:
    """The document and a line end. It is built whole before any of it is written."""
    if v[0] != "m":
        raise TomlError(f"a document is a table, not {v[0]}")
    return (_table(v, "").lstrip("\n") + "\n").encode()
