"""Codecs: pure functions between bytes and values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from ..errors import FormatError, Unimplemented

#: Input formats in the order in which the first one asked for wins, and output formats alike.
FORMATS = ("protobuf", "avro", "cbor", "messagepack", "toml", "yaml", "raw", "csv", "json")


def decoder(fmt: str, options: dict | None = None) -> Callable[..., Iterator[tuple]]:
    """bytes, or a binary file that is read as it is needed -> values. Options: truncated (cbor), descriptors and message (protobuf)."""
    o = options or {}
    if fmt == "protobuf":
        from . import protobuf

        descriptors = protobuf.Descriptors(o["descriptors"])
        descriptors.message(o["message"])  # an unknown name fails here
        return lambda data: protobuf.decode(data, descriptors, o["message"])
    if fmt == "cbor":
        from . import cbor

        return lambda data: cbor.decode(data, o.get("truncated", "error"))
    return _module(fmt).decode


def encoder(fmt: str, options: dict | None = None) -> Callable[[Iterable[tuple]], Iterator[bytes]]:
    """values -> the pieces of one file. Options: style (json), byte_strings (cbor), schema and codec (avro)."""
    o = options or {}
    if fmt == "protobuf":
        raise Unimplemented("protobuf serialization")
    if fmt == "avro":
        from . import avro

        if "schema" not in o:
            raise FormatError("avro output needs a schema")
        schema, codec = avro.Schema(o["schema"]), o.get("codec", "null")
        if codec not in avro.CODECS:
            raise FormatError(f"unknown codec {codec}")
        return lambda values: avro.encode(values, schema, codec)
    if fmt == "json":
        from . import json_text

        style = json_text.STYLE.get(o.get("style", "compact"))
        if not style:
            raise FormatError(f"unknown style {o['style']}")
        return lambda values: ((style(v) + "\n").encode() for v in values)
    if fmt == "cbor":
        from . import cbor

        return lambda values: (cbor.encode(v, bool(o.get("byte_strings"))) for v in values)
    one = _module(fmt).encode
    return lambda values: map(one, values)


def _module(fmt: str):
    from . import avro, cbor, csv_text, json_text, msgpack, raw, toml_doc, yaml_doc

    found = {"avro": avro, "cbor": cbor, "csv": csv_text, "json": json_text, "messagepack": msgpack, "raw": raw, "toml": toml_doc, "yaml": yaml_doc}.get(fmt)
    if not found:
        raise FormatError(f"unknown format {fmt}; known are {', '.join(FORMATS)}")
    return found
