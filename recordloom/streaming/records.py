"""Structured Streaming over record files: new files become envelope rows, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..codecs import decoder
from ..operators.transcode import decode
from ..sinks.records import write_records
from ..sources import records as R


def stream_records(spark: SparkSession, fmt: str, path: str, *, files_per_trigger: int = 100, **options) -> DataFrame:
    """src, pos, value of each record of files that appear in a folder; a file is one task's work."""
    decoder(fmt, options)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)

    by_path = R.file_system_known(path)
    return R.records_of(files, fmt, options, by_path)


def stream_decoded(records: DataFrame, schema) -> DataFrame:
    """Typed columns of streamed records; watermarks and windows go on from here."""
    return decode(records, schema)


def stream_transcode(records: DataFrame, fmt: str, path: str, checkpoint: str, **options):
    """Writes each micro-batch as files of another format; an error stops the stream. A batch that is tried again after a
    failure replaces nothing: its folder is named by its number, and a folder that is there is written over."""

    def one(batch: DataFrame, number: int) -> None:
        write_records(batch, fmt, f"{path}/batch-{number:08d}", mode="overwrite", **options)

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
