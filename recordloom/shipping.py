"""The package on the executors: where they can't see this folder, it goes to them as a zip file."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def visible(spark: SparkSession) -> bool:
    """Whether Python workers find the package by themselves: on PYTHONPATH, or in the working folder of a local session."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if spark.sparkContext.master.startswith("local["):
        paths.append(os.getcwd())
    return any(Path(p).resolve() == ROOT for p in paths)


def ship(spark: SparkSession) -> None:
    """Sends the package once to each application that needs it."""
    key = spark.sparkContext.applicationId
    if key in _done or visible(spark):
        return
    target = Path(tempfile.mkdtemp()) / "recordloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "recordloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _done.add(key)
