"""Quality classifier by importance resampling: the ratio of two hashed n-gram models, of target and of raw text, as a
document's log weight; a Gumbel top-k draws the documents."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import blocks, keep_ids, pick, stored, table, text_bytes

#: Hash buckets, one half for unigrams and one for bigrams.
BUCKETS = 1 << 19
#: Bound on the labelled rows that the target model and the cut are fitted on, by a hash of their ids.
MOST_LABELS = 50_000
#: Occurrences that the raw model adds to a bucket's count and to what is expected of it.
PRIOR = 2.0
#: Odds, before counting, that a bucket's share differs in target text: one bucket of all. A bucket counts by the odds after
#: counting, with the likelihood ratio of its target count and what the raw model expects.
ODDS = 1 / BUCKETS
#: A lost target row counts as so many kept others where the cut is chosen: clean documents stay.
KEEP_WEIGHT = 4
#: Log weights are divided by it before the Gumbel noise is added.
TEMPERATURE = 1.0
SEED = 7
BLOCK = 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Log weights and keys are compared as integers of this step, so that every engine and run agrees.
STEP = 1 << 20


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row and number of occurrences of the unigrams and bigrams of words, A-Z in lower case."""
    raw = LOWER[raw]
    start, end, row = H.words_of(raw, off)
    word = H.Spans(raw).of(start, end)
    pair = H.ngram(word, 2)
    same = row[1:] == row[:-1]
    half = np.uint64(BUCKETS // 2)
    bucket = np.concatenate([word % half, pair[same] % half + half]).astype(np.int64)
    key, times = np.unique(np.concatenate([row, row[1:][same]]) * BUCKETS + bucket, return_counts=True)
    return key % BUCKETS, key // BUCKETS, times


#: The bucket that counts rows.
ROWS = -1


def ngram_counts(docs: DataFrame) -> DataFrame:
    """bucket, raw, target: how often each bucket occurs in the rows of docs (text, is_target), and in its target rows."""

    def run(batches):
        total, rows = np.zeros((2, BUCKETS), np.int64), 0
        for batch in batches:
            raw, off = text_bytes(batch.column(0))
            chosen = flags(batch.column(1))
            rows += batch.num_rows
            for a, b in blocks(off, BLOCK):
                bucket, row, times = features(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                total[0] += np.bincount(bucket, times, BUCKETS).astype(np.int64)
                own = chosen[a:b][row]
                total[1] += np.bincount(bucket[own], times[own], BUCKETS).astype(np.int64)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([ROWS], [rows], [0])], names=["bucket", "raw", "target"])
        at = np.flatnonzero(total[0])
        for lo in range(0, len(at), 1 << 14):
            k = at[lo : lo + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[0][k]), pa.array(total[1][k])], names=["bucket", "raw", "target"])

    return docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


class Model(NamedTuple):
    """The target's share of all occurrences, a row's mean number of them, and raw and target counts of all buckets."""

    share: float
    mean: float
    raw: np.ndarray
    target: np.ndarray


def fit(counts: DataFrame) -> Model:
    """At most BUCKETS rows of three numbers come to the driver."""
    got = stored(counts, "counts")[0].toArrow()
    bucket, counted = got["bucket"].to_numpy(), np.array([got["raw"].to_numpy(), got["target"].to_numpy()], np.float64)
    model = np.zeros((2, BUCKETS))
    model[:, bucket[bucket != ROWS]] = counted[:, bucket != ROWS]
    rows, all_, target = counted[0, bucket == ROWS].sum(), model[0].sum(), model[1].sum()
    return Model(target / max(all_, 1), all_ / max(rows, 1), model[0], model[1])


def weigh(bucket: np.ndarray, row: np.ndarray, times: np.ndarray, rows: int, own: np.ndarray, model: Model) -> np.ndarray:
    """log p_target / p_raw of the occurrences of each row, brought to the mean length: the noise of a sum grows with the root
    of its terms. A target row's own occurrences are taken out of the target model first: it does not judge itself."""
    expected = model.raw[bucket] * model.share
    target = model.target[bucket] - times * own[row]
    ratio = target * np.log(np.maximum(target, 1) / np.maximum(expected, 1e-9)) - (target - expected)  # log likelihood ratio of two Poisson counts
    sure = 1 / (1 + np.exp(-ratio) / ODDS)
    total = np.bincount(row, times * sure * np.log((target + PRIOR) / (expected + PRIOR)), rows)
    return total * np.sqrt(model.mean / np.maximum(np.bincount(row, times, rows), 1))


def log_weights(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, is_target, weight (long): the log weight of each row of docs (doc_id, text, is_target) in steps of 1 / STEP."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers a bucket

    def run(batches):
        model = shared.value
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            own, out = flags(batch.column(2)), np.zeros(batch.num_rows)
            for a, b in blocks(off, BLOCK):
                bucket, row, times = features(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                out[a:b] = weigh(bucket, row, times, b - a, own[a:b], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.floor(out * STEP).astype(np.int64))], names=["doc_id", "is_target", "weight"])

    return docs.select("doc_id", "text", "is_target").mapInArrow(run, "doc_id long, is_target boolean, weight long")


def cut(scored: list[tuple[int, bool]]) -> int:
    """The weight above which labelled rows are target rows with the fewest errors, as shares of their class."""
    good, bad = sum(x for _, x in scored), sum(not x for _, x in scored)
    if not good or not bad:
        return -(2**62)
    best, found, lost_good, kept_bad = math.inf, -(2**62), 0, bad
    rows = sorted(scored)
    for k in range(len(rows) + 1):
        error = KEEP_WEIGHT * lost_good / good + kept_bad / bad
        if error < best and (k in (0, len(rows)) or rows[k][0] != rows[k - 1][0]):
            best = error
            found = rows[0][0] - 1 if k == 0 else rows[-1][0] if k == len(rows) else (rows[k - 1][0] + rows[k][0]) // 2
        if k < len(rows):
            lost_good, kept_bad = lost_good + rows[k][1], kept_bad - (not rows[k][1])
    return found


def largest(df: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th largest long of a column, and how many rows are larger: histograms of 4,096 bins, narrowed to one value."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while lo < hi:
        width = (hi - lo) // 4096 + 1
        rows = df.where(F.col(column).between(lo, hi)).groupBy(F.expr(f"({column} - {lo}L) div {width}L").alias("bin")).count().collect()
        for b, n in sorted(rows, reverse=True):
            if above + n >= k:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            above += n
    return lo, above


def gumbel():
    """Standard Gumbel noise of a row, from a hash of its id alone, in steps of 1 / STEP."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(SEED)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.floor(-F.log(-F.log(u)) * STEP).cast("long")


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, is_target of at most MOST_LABELS labelled rows: of good quality and not toxic, or else.

    A doc_id labelled more than once counts once, as target only if each of its rows says so. Null labels don't count.
    """
    rows = pick(labels, doc_id=("doc_id", "long"), quality="quality", toxic="toxic").select("doc_id", F.expr("quality = 1 AND toxic = 0").alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min("good").alias("is_target")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, gumbel_key (double), selected (boolean) for each row of docs.

    The raw model counts hashed unigrams and bigrams of all rows, the target model those of labelled target rows; every
    occurrence of every n-gram counts, by its evidence. k, the number of rows drawn, is the number of rows whose weight passes the cut
    that separates the labelled rows best; the cut chooses nothing else. The k largest of log weight / TEMPERATURE + Gumbel noise are
    selected, ties to the smaller doc_id. Null and empty texts weigh 0; a very long text is a block of its own, taken whole. Without
    labels of both kinds every row is selected. Repeated rows are weighed and counted each; those under one id draw the same noise.
    A null doc_id has the noise of the hash of null. Only the two named columns are read, matched exactly, so others may clash. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = F.broadcast(stored(labelled(labels), "labels")[0])  # at most MOST_LABELS rows
    rows = pick(docs, doc_id=(id_col, "long"), text=text_col).join(known, "doc_id", "left").select("doc_id", "text", "is_target")
    model = fit(ngram_counts(rows.select("text", "is_target")))
    scored, _ = stored(log_weights(rows, model).withColumn("key", F.floor(F.col("weight") / TEMPERATURE).cast("long") + gumbel()), "weights")
    seen = [(x.weight, x.is_target) for x in scored.where("is_target IS NOT NULL").dropDuplicates(["doc_id"]).select("weight", "is_target").collect()]
    k = scored.where(F.col("weight") > cut(seen)).count()
    chosen = F.lit(False)
    if k:
        bound, above = largest(scored, "key", k)
        ties = scored.where(F.col("key") == bound).select(F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)).alias("low"))
        last, _ = largest(ties, "low", k - above)
        chosen = (F.col("key") > bound) | ((F.col("key") == bound) & (F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)) >= last))
    return scored.select("doc_id", (F.col("weight") / STEP).alias("log_weight"), (F.col("key") / STEP).alias("gumbel_key"), chosen.alias("selected"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the resampling draws."""
    return keep_ids(docs, resample(docs, table(spark, sf_dir, "labels")).where("selected").select("doc_id").distinct())
