"""Command line: records from standard input to standard output, or from files to files by Spark.

    python -m recordloom [-a|-c|-j|-v|-m|-p MESSAGE|-r|-t|-y] [-A SCHEMA|-C|-J|-V|-M|-P MESSAGE|-R|-T|-Y] [--format STYLE] [--codec CODEC]
    python -m recordloom --input PATH --output PATH ...
    python -m recordloom protobuf add FILE [--base DIR]
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from . import registry
from .codecs import decoder, encoder
from .errors import EngineError

INPUTS = {"avro": "a", "cbor": "c", "json": "j", "csv": "v", "messagepack": "m", "protobuf": "p", "raw": "r", "toml": "t", "yaml": "y"}
OUTPUTS = {"avro": "A", "cbor": "C", "json": "J", "raw": "R", "csv": "V", "messagepack": "M", "protobuf": "P", "toml": "T", "yaml": "Y"}
LONG = {"messagepack": "message-pack"}
#: Of several formats the first in this order wins.
PRECEDENCE = ("protobuf", "avro", "cbor", "messagepack", "toml", "yaml", "raw", "csv", "json")
STYLES = ("compact", "readable", "indented")
LOG_VARIABLE = "RECORDLOOM_LOG"
log = logging.getLogger("recordloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recordloom", description="Reads records of one format and writes them in another.")
    for side, letters, takes in (("input", INPUTS, {"protobuf": "MESSAGE"}), ("output", OUTPUTS, {"avro": "SCHEMA_FILE", "protobuf": "MESSAGE"})):
        for fmt, letter in letters.items():
            kind = {"metavar": takes[fmt]} if fmt in takes else {"action": "store_true"}
            p.add_argument(f"-{letter}", f"--{side}-{LONG.get(fmt, fmt)}", dest=f"{side}_{fmt}", help=f"{side} is {fmt}", **kind)
    p.add_argument("--format", choices=STYLES, help="style of JSON output; readable on a terminal, else compact")
    p.add_argument("--codec", default="null", help="codec of Avro output: null, deflate or snappy")
    p.add_argument("--input", help="a path that Spark reads, instead of standard input")
    p.add_argument("--output", help="a folder that Spark writes, instead of standard output")
    p.add_argument("-b", "--base", default=".", help="of protobuf add: the folder that paths are relative to")
    p.add_argument("-l", "--log", help=f"log level, or levels by logger as in warn,recordloom=debug; else ${LOG_VARIABLE}, else info")
    p.add_argument("-q", "--quiet", action="store_true", help="no log")
    p.add_argument("--trace", action="store_true", help="log errors with their trace")
    p.add_argument("words", nargs="*", help="protobuf add FILE")
    return p


def chosen(args: argparse.Namespace, side: str) -> str:
    return next((f for f in PRECEDENCE if getattr(args, f"{side}_{f}", None)), "json")


def style(args: argparse.Namespace, terminal: bool) -> str:
    return args.format or ("readable" if terminal else "compact")


def main(argv: list[str] | None = None, stdin=None, stdout=None) -> int:
    """0 where all records were written; errors are logged with their causes, and the exit code is 1."""
    args = parser().parse_args(argv)
    try:
        set_up_log(args, os.environ)
        return run(args, stdin or sys.stdin.buffer, stdout or sys.stdout.buffer)
    except (EngineError, OSError, RecursionError) as e:
        log.error("%s", e, exc_info=args.trace)
        cause = e.__cause__
        while cause:
            log.error("caused by: %s", cause)
            cause = cause.__cause__
        return 1


#: What a name of a level may be, in order; off logs nothing.
LEVELS = {"off": logging.CRITICAL + 1, "error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": logging.DEBUG}


def levels(text: str) -> dict[str, int]:
    """Level by logger ("" for all others) of a specification such as warn,recordloom.codecs=debug; a name alone logs all."""
    out = {}
    for part in filter(None, (x.strip() for x in text.split(","))):
        name, equals, level = part.partition("=")
        if equals and level.lower() not in LEVELS:
            raise EngineError(f"no such log level: {level}")
        if equals:
            out[name] = LEVELS[level.lower()]
        elif name.lower() in LEVELS:
            out[""] = LEVELS[name.lower()]
        else:
            out[name] = logging.DEBUG
    return out


def set_up_log(args: argparse.Namespace, env) -> None:
    logging.basicConfig(format="%(levelname)s %(message)s", stream=sys.stderr)
    wanted = {"": LEVELS["off"]} if args.quiet else {"": logging.INFO} | levels(args.log or env.get(LOG_VARIABLE, ""))
    for name, level in wanted.items():
        logging.getLogger(name or None).setLevel(level)


def run(args: argparse.Namespace, stdin, stdout) -> int:
    if args.words[:2] == ["protobuf", "add"] and len(args.words) == 3:
        registry.add_file(registry.Paths(), args.words[2], args.base)
        return 0
    if args.words:
        raise EngineError(f"there is no query language; decode to a DataFrame and query that: {' '.join(args.words)!r}")
    source, sink = chosen(args, "input"), chosen(args, "output")
    reading = {"descriptors": registry.compile_descriptor_set(registry.Paths()).data, "message": args.input_protobuf} if source == "protobuf" else {}
    writing = {}
    if sink == "avro":
        with open(args.output_avro) as f:
            writing = {"schema": f.read(), "codec": args.codec}
    if sink == "json":
        writing = {"style": style(args, not args.output and getattr(stdout, "isatty", lambda: False)())}
    if args.input or args.output:
        if not (args.input and args.output):
            raise EngineError("--input and --output go together")
        from pyspark.sql import SparkSession

        from .operators.transcode import transcode

        transcode(SparkSession.builder.appName("recordloom").getOrCreate(), source, args.input, sink, args.output, read_options=reading, **writing)
        return 0
    encode = encoder(sink, writing)
    for piece in encode(decoder(source, reading)(stdin)):  # one record at a time: what is read is written before more is asked for
        stdout.write(piece)
        stdout.flush()
    return 0
