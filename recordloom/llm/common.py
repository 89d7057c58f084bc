"""What the operators of this subpackage share: tables, the shared folder, Arrow text as numpy bytes."""

from __future__ import annotations

from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


@contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Queries that run inside drop their shuffle files when they end, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Bytes of an Arrow batch on its way to a Python worker. Spark's own bound is 10,000 rows: tens of MB of texts, which the
#: executor and the worker each hold several times, for every task.
BATCH = 2 << 20


def small_batches(step):
    """A stage (spark, docs, sf_dir) whose batches to Python workers hold at most BATCH bytes, or one longer row. The bound stays in
    the session, as a stage's rows are made after it returns; one that the session has already is left as it is."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(BATCH))
        return step(spark, docs, sf_dir)

    return run


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written as Parquet to the shared folder and read again: lineage ends here and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    with cleaned_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def numbered(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ... in their order: names that clash, differ in case only or hold dots can't do harm."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def pick(df: DataFrame, **columns) -> DataFrame:
    """Only the named columns, each a name or (name, type to cast to), under fixed names. Names are matched exactly."""
    names, plain = df.columns, numbered(df)
    wanted = {k: (c, None) if isinstance(c, str) else c for k, c in columns.items()}
    return plain.select(*[(F.col(f"c{names.index(c)}").cast(t) if t else F.col(f"c{names.index(c)}")).alias(k) for k, (c, t) in wanted.items()])


def map_rows(df: DataFrame, run) -> DataFrame:
    """mapInArrow of all columns, numbered, to the same columns."""
    plain = numbered(df)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is among ids (one column); a null id is if null is."""
    at, plain = df.columns.index(id_col), numbered(df)
    return plain.join(ids.toDF("kept_id"), F.col(f"c{at}").eqNullSafe(F.col("kept_id")), "left_semi").toDF(*df.columns)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column as one uint8 array, and the n + 1 offsets of its rows; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(off: np.ndarray, most: int):
    """Ranges (first row, last row + 1) of consecutive rows that hold at most so many bytes; a longer row stands alone."""
    n, at = len(off) - 1, 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to
