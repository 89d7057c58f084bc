"""YAML: a series of documents, read by the core schema of YAML 1.2."""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator

import yaml

from .. import value as V
from ..errors import YamlError
from .stream import as_file

PREFIX = "tag:yaml.org,2002:"
INTEGER = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?")
#: The plain words of the core schema.
NULLS, TRUES, FALSES = {"", "~", "null", "Null", "NULL"}, {"true", "True", "TRUE"}, {"false", "False", "FALSE"}
SPECIAL = {s + w: f for w in (".inf", ".Inf", ".INF") for s, f in (("", math.inf), ("+", math.inf), ("-", -math.inf))} | dict.fromkeys((".nan", ".NaN", ".NAN"), math.nan)
#: Words that YAML 1.1 readers take for something else; they are quoted.
OLD_WORDS = re.compile(r"(?i)(y|yes|n|no|on|off)|[-+]?[0-9][0-9_,.:eExXoObB-]*|[-0-9: tTzZ+.]+|=|<<")


def plain(text: str):
    if text in NULLS:
        return V.UNIT
    if text in TRUES or text in FALSES:
        return ("b", text in TRUES)
    if INTEGER.fullmatch(text):
        n = int(text, 0) if text[:2] in ("0o", "0x") else int(text)
        if -(2**63) <= n < 2**64:
            return ("u64", n) if n >= 0 else ("i64", n)
        return ("f64", float(n))
    if text in SPECIAL:
        return ("f64", SPECIAL[text])
    if FLOAT.fullmatch(text):
        return ("f64", float(text))
    return ("s", text)


def _scalar(e):
    if e.tag is None or e.tag == "!":
        return plain(e.value) if e.implicit[0] and e.tag is None else ("s", e.value)
    kind = e.tag.removeprefix(PREFIX)
    if kind == "str":
        return ("s", e.value)
    v = plain(e.value)
    if kind == "float" and v[0] in V.INTEGERS:
        return ("f64", float(v[1]))
    if {"null": v[0] == "n", "bool": v[0] == "b", "int": v[0] in V.INTEGERS, "float": v[0] == "f64"}.get(kind):
        return v
    raise YamlError(f"the tag {e.tag} does not fit {e.value!r}")


def _node(e, events, anchors):
    if isinstance(e, yaml.AliasEvent):
        if e.anchor not in anchors:
            raise YamlError(f"no anchor {e.anchor}, or inside itself")
        return anchors[e.anchor]
    if isinstance(e, yaml.ScalarEvent):
        v = _scalar(e)
    else:
        sequence = isinstance(e, yaml.SequenceStartEvent)
        if e.tag not in (None, "!", PREFIX + ("seq" if sequence else "map")):
            raise YamlError(f"unknown tag {e.tag}")
        parts = []
        while not isinstance(x := next(events), (yaml.SequenceEndEvent, yaml.MappingEndEvent)):
            parts.append(_node(x, events, anchors))
        v = ("q", parts) if sequence else ("m", list(zip(parts[::2], parts[1::2])))
    if e.anchor:
        anchors[e.anchor] = v
    return v


def decode(data) -> Iterator[tuple]:
    """A record for each document, read as the parser asks for more; input without a document has none."""
    try:
        events = iter(yaml.parse(io.TextIOWrapper(as_file(data), "utf-8", newline=""), Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)))
        anchors: dict = {}
        for e in events:
            if isinstance(e, yaml.DocumentStartEvent):
                anchors = {}
            elif isinstance(e, (yaml.ScalarEvent, yaml.AliasEvent, yaml.SequenceStartEvent, yaml.MappingStartEvent)):
                yield _node(e, events, anchors)
    except (yaml.YAMLError, UnicodeDecodeError, RecursionError) as e:
        raise YamlError(str(e)) from e


def _events(v):
    tag = v[0]
    if tag in ("q", "y"):
        parts = v[1] if tag == "q" else [("u8", x) for x in v[1]]
        yield yaml.SequenceStartEvent(None, None, True, flow_style=not parts)
        for x in parts:
            yield from _events(x)
        yield yaml.SequenceEndEvent()
    elif tag == "m":
        yield yaml.MappingStartEvent(None, None, True, flow_style=not v[1])
        for k, x in v[1]:
            yield from _events(k)
            yield from _events(x)
        yield yaml.MappingEndEvent()
    elif tag in ("s", "c"):
        safe = plain(v[1])[0] == "s" and not OLD_WORDS.fullmatch(v[1]) and v[1].isprintable() and v[1].strip() == v[1]
        yield yaml.ScalarEvent(None, None, (safe, True), v[1], style=None if safe else '"')
    else:
        if tag == "n":
            text = "null"
        elif tag == "b":
            text = "true" if v[1] else "false"
        elif tag in V.INTEGERS:
            text = str(v[1])
        else:
            text = V.number_text(tag, v[1]) if math.isfinite(v[1]) else ".nan" if math.isnan(v[1]) else ".inf" if v[1] > 0 else "-.inf"
        yield yaml.ScalarEvent(None, None, (True, False), text)


def encode(v) -> bytes:
    """A document that begins with a separator, so that several in a row are a series."""
    events = [yaml.StreamStartEvent(), yaml.DocumentStartEvent(explicit=True), *_events(v), yaml.DocumentEndEvent(explicit=False), yaml.StreamEndEvent()]
    text = yaml.emit(events, allow_unicode=True, width=1 << 30)
    return (text.removesuffix("...\n").rstrip("\n") + "\n").encode()
