"""Sources: files of any format as envelope rows, and Spark's own readers where their semantics fit."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import value as V
from ..codecs import avro, decoder, raw
from ..codecs.stream import CHUNK
from ..errors import FormatError

ENVELOPE = "src string, pos long, value string"
#: Formats whose files are dealt out in parts.
SPLIT = {"avro": avro.decode_split, "raw": raw.decode_split}
#: Records of an Arrow batch, and bytes of the parts of files that one task reads.
BATCH, TASK = 2_000, 32 << 20


def read_records(spark: SparkSession, fmt: str, path, *, split_bytes: int | None = None, **options) -> DataFrame:
    """src, pos, value: each record of the files as an envelope, with its place in its file.

    Spark lists the files. Where pyarrow's file systems reach them too they are opened in the tasks and read as records are
    needed, so a file may be of any size; from other stores Spark hands over whole files, of up to 2 GB. Of most formats a stream can't be
    entered in its middle: a file is one task's work. With split_bytes, Avro files are dealt out by their sync markers and plain
    text by its line ends, in parts of about so many bytes, and pos is a place in bytes and not a number. Where there are many more parts than
    cores a task takes several, up to TASK bytes, and those that follow each other in one go. Bad input fails the job.
    """
    decoder(fmt, options)  # bad options fail here
    listed = spark.read.format("binaryFile").load(path)
    if split_bytes is None:
        return records_of(listed, fmt, options)
    if fmt not in SPLIT:
        raise FormatError(f"{fmt} files can't be entered in their middle")
    if not opens(listed):
        raise FormatError("only files that pyarrow opens are split")
    ends = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest("length", F.lit(1)) - 1, F.lit(split_bytes).cast("long")), lambda lo: F.struct(lo.alias("lo"), (lo + split_bytes).alias("hi")))
    parts = listed.select("path", F.explode(ends).alias("part")).select("path", "part.*")
    n, size = parts.agg(F.count(F.lit(1)), F.sum(F.lit(split_bytes))).head()
    tasks = min(n, max(2 * spark.sparkContext.defaultParallelism, (size or 0) // TASK))
    dealt = parts.repartitionByRange(max(1, tasks), "path", "lo").sortWithinPartitions("path", "lo")

    def run(batches):
        for src, lo, hi in joined(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches):
            with opened(src) as file:
                yield from placed(src, SPLIT[fmt](file, lo, hi))

    return dealt.mapInArrow(run, ENVELOPE)


def joined(batches) -> Iterator[tuple[str, int, int]]:
    """Parts in their order, those of a file that follow each other as one."""
    held = None
    for src, lo, hi in chain.from_iterable(batches):
        if held and held[0] == src and held[2] == lo:
            held = (src, held[1], hi)
        else:
            if held:
                yield held
            held = (src, lo, hi)
    if held:
        yield held


def file_system(path: str):
    """pyarrow's file system of a path as Spark names it, and the path as it takes it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", re.sub("^s3[an]:", "s3:", quote(path, safe="/:=,+@!$&()*;~"))))


def file_system_known(path: str) -> bool:
    """Whether pyarrow has a file system for a folder that may hold no file yet."""
    try:
        fs, plain = file_system(path if ":/" in path else "file://" + os.path.abspath(path))
        return fs.get_file_info(plain).type.name == "Directory"
    except (OSError, ValueError, ImportError):
        return False


def opened(path: str):
    fs, plain = file_system(path)
    return io.BufferedReader(fs.open_input_file(plain), CHUNK)


def opens(listed: DataFrame) -> bool:
    """Whether pyarrow sees the first of the files too."""
    first = listed.select("path").head()
    if not first:
        return True
    try:
        fs, plain = file_system(first.path)
        return fs.get_file_info(plain).is_file
    except (OSError, ValueError, ImportError):
        return False


def records_of(listed: DataFrame, fmt: str, options: dict, by_path: bool | None = None) -> DataFrame:
    by_path = opens(listed) if by_path is None else by_path

    def run(batches):
        decode = decoder(fmt, options)
        for batch in batches:
            for src, content in zip(batch.column(0).to_pylist(), batch.column(0) if by_path else batch.column(1)):
                if by_path:
                    with opened(src) as file:
                        yield from placed(src, enumerate(decode(file)))
                else:
                    yield from placed(src, enumerate(decode(content.as_py())))

    return listed.select("path", *([] if by_path else ["content"])).mapInArrow(run, ENVELOPE)


def placed(src: str, values) -> Iterator[pa.RecordBatch]:
    """Batches of envelope rows from (pos, value) pairs."""
    held = []
    for pos, v in values:
        held.append((pos, V.to_envelope(v)))
        if len(held) == BATCH:
            yield _rows(src, held)
            held = []
    if held:
        yield _rows(src, held)


def _rows(src: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
    pos, value = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array([src] * len(held)), pa.array(pos, pa.int64()), pa.array(value, pa.string())], names=["src", "pos", "value"])


def read_json_lines(spark: SparkSession, path, schema: T.StructType | str) -> DataFrame:
    """Typed rows of files with one object a line, by Spark's own splittable reader; anything else fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def read_raw_lines(spark: SparkSession, path) -> DataFrame:
    r"""value: the lines of files, by Spark's own splittable reader. One \r before the \n goes; bytes that are not UTF-8 fail the job.

    Unlike read_records, a last line without \n loses a \r that ends it too: a split file has no last line to tell.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.when(F.expr("is_valid_utf8(value)"), F.regexp_replace("value", r"\r\z", "")).otherwise(F.raise_error(F.lit("a line is not UTF-8"))).alias("value"))


def read_csv_rows(spark: SparkSession, path, width: int) -> DataFrame:
    """_c0, _c1, ...: rows of the given number of strings, by Spark's own reader. Empty cells are empty strings; a row of
    another width fails the job: Spark marks it as corrupt."""
    names = [f"_c{k}" for k in range(width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    options = {"header": False, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "emptyValue": "", "nullValue": "\0"}
    rows = spark.read.schema(schema).options(**options).csv(path)
    wrong = F.col("_corrupt").isNotNull()
    cells = [F.when(wrong, F.raise_error(F.lit(f"a row is not {width} cells wide"))).otherwise(F.coalesce(n, F.lit(""))).alias(n) for n in names]
    return rows.select(cells)
