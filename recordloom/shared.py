"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from .errors import IllegalState


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if driver and executors are one process, else an error:
    executors don't see each other's disks."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise IllegalState("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='recordloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch on its way to a Python worker; Spark's own bound is 10,000 rows of any size.
BATCH = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python workers hold at most BATCH bytes, or one longer row. The bound stays in the session; one that it has already is left as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH))
