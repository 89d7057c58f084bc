"""Size-tiered compaction: arrivals are appended as small immutable shards, runs of shards of similar size are merged into
files of up to the target size, and each state is a versioned manifest, committed by one atomic rename.

The main path is DataFrame operations only.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cleaned_shuffles, hadoop_fs, numbered, pick, scratch, table

#: Rows of an arriving shard at most; bytes of a merged file; sizes within a factor of FANOUT are one tier.
ARRIVAL_ROWS, TARGET, FANOUT = 2_000, 32 << 20, 4
#: Appends that the query's table arrives in.
ARRIVALS = 4
#: Shards of which sizes are added up in one task.
PLANNED = 10_000
#: Shards up to this many: their plan (under 200 bytes each) is broadcast; more are joined by a shuffle.
BROADCAST_SHARDS = 50_000
#: Seconds that a folder without a live shard is kept at least: an append or a merge may be about to commit it, and a reader may hold it.
KEPT_SECONDS = 86_400
#: Times that an append takes a newer version where another writer was faster.
TRIES = 20
#: The partition column of merged files, in their paths only.
RUN = "recordloom_run"
RELATIVE = rf"((?:arrivals|merged)-[0-9a-f]+/(?:{RUN}=[^/]*/)?[^/]+)$"
MANIFEST = "file string, run string, rows long, bytes long, schema string"


class Conflict(Exception):
    """Another writer committed the version first."""


class ShardStore:
    """Shards under base/data and manifests under base/manifest/vNNNNNN. A manifest row is a live shard: its file (below
    data), run, rows and bytes; one more row has the schema. Readers see one version whole; files of older versions stay until
    expire(). Shards hold columns by their place, so names may clash, differ in case only, or be the store's own."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def versions(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.base}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))

    def _whole(self, version: int | None) -> DataFrame:
        version = self.versions()[-1] if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest/v{version:06d}")

    def manifest(self, version: int | None = None) -> DataFrame:
        """file, run, rows, bytes of the live shards."""
        return self._whole(version).where("file IS NOT NULL").drop("schema")

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._whole(version).where("file IS NULL").first().schema))

    def commit(self, rows: DataFrame, schema: T.StructType, version: int) -> None:
        """Writes the manifest aside, beside its place, and renames it; where the version is taken, the rename fails."""
        aside, to = f"{self.base}/manifest/_aside-{uuid.uuid4().hex}", f"{self.base}/manifest/v{version:06d}"
        head = self.spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("run", "string"), ("rows", "long"), ("bytes", "long"))), F.lit(schema.json()).alias("schema"))
        rows.select("file", "run", "rows", "bytes", F.lit(None).cast("string").alias("schema")).unionByName(head).write.parquet(aside)
        _, p = hadoop_fs(self.spark, aside)
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        files = hadoop.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(hadoop.Path(aside), hadoop.Path(to), gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self._delete(aside)
            if version in self.versions():
                raise Conflict(f"version {version} of {self.base} is taken") from e
            raise

    def _delete(self, path: str) -> None:
        fs, p = hadoop_fs(self.spark, path)
        fs.delete(p, True)

    def _read(self, folders: list[str], schema: T.StructType) -> DataFrame:
        """The rows of whole folders, columns by place; without folders none."""
        stored = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema)])
        if not folders:
            return self.spark.createDataFrame([], stored).withColumn("file", F.lit(""))
        rows = self.spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(*(f"{self.base}/data/{f}" for f in folders))
        return rows.select("*", F.regexp_extract("_metadata.file_path", RELATIVE, 1).alias("file"))

    def _shards(self, folder: str) -> DataFrame:
        """What Spark's own file metadata says of the shards in a folder."""
        files = self.spark.read.schema("c0 string").option("recursiveFileLookup", "true").parquet(f"{self.base}/data/{folder}")
        files = files.select(F.regexp_extract("_metadata.file_path", RELATIVE, 1).alias("file"), F.col("_metadata.file_size").alias("bytes"))
        rows = files.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"))
        return rows.withColumn("run", F.coalesce(F.nullif(F.regexp_extract("file", f"{RUN}=([^/]*)", 1), F.lit("")), "file"))

    def append(self, rows: DataFrame) -> int:
        """Each task's rows become shards of at most ARRIVAL_ROWS rows, without a shuffle; the next version has them beside the
        old ones. Where another writer commits first, the shards join its version. What a lost driver leaves is never named."""
        folder = f"arrivals-{uuid.uuid4().hex}"
        numbered(rows).write.option("maxRecordsPerFile", ARRIVAL_ROWS).option("compression", "zstd").parquet(f"{self.base}/data/{folder}")
        new = self._shards(folder)
        for left in reversed(range(TRIES)):
            seen = self.versions()
            version = seen[-1] + 1 if seen else 1
            if seen and (own := [f.dataType for f in self.schema(seen[-1])]) != [f.dataType for f in rows.schema]:
                raise ValueError(f"the store holds {own}")
            try:
                self.commit(self.manifest(seen[-1]).unionByName(new) if seen else new, self.schema(seen[-1]) if seen else rows.schema, version)
                return version
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def plan(self, live: DataFrame) -> DataFrame:
        """file, run, place of the shards to merge: those of one tier, in the order of their names, cut where their sizes add up to
        the target; a run has two shards or more, and a number of its own, its place. A tier's sizes differ by less than FANOUT, so a byte is
        rewritten once for each factor of FANOUT that its file grows by. Tiers of many shards are cut into parts first."""
        parts = max(1, live.count() // PLANNED)
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)).cast("double")) / F.log(F.lit(float(FANOUT)))).cast("long")
        before = F.sum("bytes").over(Window.partitionBy("tier", "part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        tiered = live.where(F.col("bytes") < TARGET).withColumn("tier", tier).withColumn("part", F.pmod(F.xxhash64("file"), F.lit(parts))).withColumn("before", F.coalesce(before, F.lit(0)))
        cut = tiered.select("file", "tier", "part", F.expr(f"before div {TARGET}L").alias("number"))
        several = cut.groupBy("tier", "part", "number").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        own = Window.partitionBy("tier", "part").orderBy("number")
        runs = several.withColumn("nth", F.row_number().over(own) - 1)
        size = runs.groupBy("tier", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each PLANNED shards
        first = size.withColumn("first", F.sum("n").over(Window.orderBy("tier", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
        named = runs.join(F.broadcast(first) if parts <= PLANNED else first, ["tier", "part"])
        named = named.select("tier", "part", "number", F.format_string("t%02d-%05d-%06d", "tier", "part", "number").alias("run"), (F.col("first") + F.col("nth")).alias("place"))
        return cut.join(named, ["tier", "part", "number"]).select("file", "run", "place")

    def compact(self) -> int:
        """Merges every run into one file each and commits the next version, which may have runs of the next tier to merge."""
        seen = self.versions()[-1]
        live, schema, version = self.manifest(seen), self.schema(seen), seen + 1
        plan = self.plan(live)
        runs, members = plan.agg(F.count_distinct("run"), F.count(F.lit(1))).first()
        if not runs:
            return seen
        folder = f"merged-{uuid.uuid4().hex}"
        folders = [r[0] for r in live.join(plan, "file", "left_semi").select(F.substring_index("file", "/", 1)).distinct().collect()]  # one for each append and compaction
        side = plan.select("file", F.col("run").alias(RUN), "place")
        side = F.broadcast(side) if members <= BROADCAST_SHARDS else side
        dealt = self._read(folders, schema).join(side, "file").drop("file").repartitionById(runs, F.col("place").cast("int")).drop("place")  # a run is a task: no two meet in one
        with cleaned_shuffles(self.spark):
            dealt.write.option("compression", "zstd").partitionBy(RUN).parquet(f"{self.base}/data/{folder}")
        self.commit(live.join(plan.select("file"), "file", "left_anti").unionByName(self._shards(folder)), schema, version)
        return version

    def settle(self, kept_seconds: float = KEPT_SECONDS) -> int:
        """Compacts until no tier has a run; what a merge replaces goes before the next one."""
        while (seen := self.versions()[-1]) != self.compact():
            self.expire(kept_seconds)
        return seen

    def _folders(self) -> list[str]:
        """The folders that hold the newest version's shards."""
        return [r[0] for r in self.manifest().select(F.substring_index("file", "/", 1)).distinct().collect()]

    def expire(self, kept_seconds: float = KEPT_SECONDS) -> None:
        """Deletes the folders of which the newest version names no file, and manifests that were never committed, that have not
        changed for so many seconds. What is younger may belong to a writer that has not committed yet."""
        live = set(self._folders())
        for below, left in (("data", lambda n: n not in live), ("manifest", lambda n: n.startswith("_aside"))):
            fs, p = hadoop_fs(self.spark, f"{self.base}/{below}")
            for s in fs.listStatus(p) if fs.exists(p) else ():
                if left(s.getPath().getName()) and s.getModificationTime() / 1000 <= time.time() - kept_seconds:
                    fs.delete(s.getPath(), True)

    def rows(self) -> DataFrame:
        """Every row of the newest version, with the columns that were appended."""
        seen = self.versions()
        if not seen:
            raise FileNotFoundError(f"no shards in {self.base}")
        live, schema = self.manifest(seen[-1]).select("file"), self.schema(seen[-1])
        side = F.broadcast(live) if live.count() <= BROADCAST_SHARDS else live
        return self._read(self._folders(), schema).join(side, "file", "left_semi").drop("file").toDF(*schema.names)


def shard(docs: DataFrame, base: str, *, arrivals: int = ARRIVALS, id_col: str = "doc_id") -> ShardStore:
    """A store at base, of this call alone, whose newest version holds the rows of docs, appended in so many arrivals (by a hash of
    the id) and compacted after each, with all columns as they are.

    Nulls, long texts and repeated rows are kept as they come; rows of a null id arrive together. A row that is larger than the target
    is a file of its own. An empty table gives a version without shards that keeps the schema. Columns may have any names, also clashing ones.
    A lost task writes its files again, and a lost driver leaves folders that no manifest names: only committed manifests make files live.
    """
    store, at = ShardStore(docs.sparkSession, base), docs.columns.index(id_col)
    arrival = F.pmod(F.xxhash64(F.col(f"c{at}")), F.lit(arrivals))
    for k in range(arrivals):
        store.append(numbered(docs).where(arrival == k).toDF(*docs.columns))
        store.settle(0)
        store.expire(0)
    return store


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes and text_md5 of every document, read back from the compacted shards."""
    store = shard(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return pick(store.rows(), doc_id="doc_id", text="text").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


ORACLE = "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS text_md5 FROM documents"
