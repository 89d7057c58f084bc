"""Operators on records: typed columns from envelopes and back, blocks of encoded rows, and transcoding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import value as V
from ..codecs import avro, decoder, encoder, protobuf
from ..shared import bound_batches
from ..sinks.records import write_records
from ..sources.records import read_records
from . import columnar

#: Rows of an encoded block, and bytes of the rows that are encoded together.
BLOCK, PIECE = 4_000, 2 << 20


def _schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text with microseconds: the value model has none."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name)
        out.append(c)
    return df.select(out)


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch cut into so many rows, and into halves while they hold more than PIECE bytes."""
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        if part.num_rows > 1 and part.nbytes > PIECE:
            yield from pieces(part, (part.num_rows + 1) // 2)
        else:
            yield part


def encode_rows(df: DataFrame, fmt: str, *, rows_as: str = "map", **options) -> DataFrame:
    """block (binary): the rows of df, each as a map by column name or, with rows_as="sequence", without names, BLOCK to a block, or
    fewer where they are long: PIECE bytes, or one longer row.

    A block is a file's content. Formats of one document to a file (toml, yaml by choice) take rows_per_block=1.
    """
    per, df = int(options.pop("rows_per_block", BLOCK)), _dates_as_text(df)
    schema = df.schema
    if fmt == "avro":
        options.setdefault("schema", avro.schema_of(schema))
    encoder(fmt, options)
    bound_batches(df.sparkSession)
    columns = columnar.encoder(fmt, schema, options) if rows_as == "map" else None

    def by_columns(batches):
        for batch in batches:
            for part in pieces(batch, max(1, batch.num_rows)):
                yield pa.RecordBatch.from_arrays([pa.array(columns(part, per), pa.binary())], names=["block"])

    def run(batches):
        encode = encoder(fmt, options)
        names, read = [("s", f.name) for f in schema], [V.reader(f.dataType) for f in schema]
        for batch in batches:
            for part in pieces(batch, per):
                cells = [list(map(f, c.to_pylist())) for c, f in zip(part.columns, read)]
                if rows_as == "sequence":
                    values = [("q", list(row)) for row in zip(*cells)]
                else:
                    values = [("m", list(zip(names, row))) for row in zip(*cells)]
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(encode(values))], pa.binary())], names=["block"])

    return df.mapInArrow(by_columns if columns else run, "block binary")


def decode_blocks(blocks: DataFrame, fmt: str, schema, **options) -> DataFrame:
    """Typed rows of the records in a binary column named block."""
    schema = _schema(schema)
    decoder(fmt, options)
    bound_batches(blocks.sparkSession)
    by_columns = columnar.decodable(fmt, schema, options)

    def run(batches):
        decode = decoder(fmt, options)
        kind = protobuf.Descriptors(options["descriptors"]).message(options["message"]) if fmt == "protobuf" else None
        for blocks in columnar.grouped(batches):
            if kind:
                yield from columnar.protobuf_rows(blocks, kind, schema, decode)
            elif by_columns:
                yield from columnar.decode_all(fmt, blocks, schema)
            else:
                yield from columnar.typed((v for block in blocks for v in decode(block)), schema)

    return blocks.select("block").mapInArrow(run, schema)


def decode(records: DataFrame, schema) -> DataFrame:
    """Typed columns of envelope rows: the columns are the record's keys, or its elements in order."""
    schema = _schema(schema)
    bound_batches(records.sparkSession)

    def run(batches):
        for batch in batches:
            yield from columnar.typed_envelopes(batch.column(0).to_pylist(), schema)

    return records.select("value").mapInArrow(run, schema)


def encode(df: DataFrame) -> DataFrame:
    """src, pos, value: the rows of df as envelopes, in no order that lasts; src tells the task."""
    df = _dates_as_text(df)
    bound_batches(df.sparkSession)
    schema = df.schema
    columns = columnar.envelopes(schema)

    def run(batches):
        from pyspark import TaskContext

        src, pos, read = f"task-{TaskContext.get().partitionId():08d}", 0, [V.reader(f.dataType) for f in schema]
        for batch in batches:
            if columns:
                out = columns(batch)
            else:
                cells = [list(map(f, c.to_pylist())) for c, f in zip(batch.columns, read)]
                out = pa.array([V.to_envelope(("m", [(("s", f.name), x) for f, x in zip(schema, row)])) for row in zip(*cells)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(src, len(out)), pa.array(range(pos, pos + len(out)), pa.int64()), out], names=["src", "pos", "value"])
            pos += len(out)

    return df.mapInArrow(run, "src string, pos long, value string")


def transcode(spark: SparkSession, from_fmt: str, from_path, to_fmt: str, to_path: str, *, read_options: dict | None = None, mode: str = "append", **write_options) -> None:
    """Reads records of one format and writes them in another, in their order."""
    write_records(read_records(spark, from_fmt, from_path, **(read_options or {})), to_fmt, to_path, mode=mode, **write_options)
