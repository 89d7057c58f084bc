"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, and the characters inside what repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import blocks, map_rows, pick, table, text_bytes

#: Share of a text's word characters that may lie in repeated n-grams of n words, by n, in percent.
COVERAGE = {5: 30, 7: 28, 10: 25}
#: Share of word characters that may lie in lines that an earlier line of the text equals, in percent.
DUP_LINE_CHARS = 30
#: Symbols [#*$%&|<>] for each hundred words.
SYMBOLS = 10
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BLOCK = 1 << 19


def covered(start: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the words in the n-word windows that begin at the given words."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each of the concatenated rows."""
    rows = len(off) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[off[1:]] - sums[off[:-1]]

    point = (raw & 0xC0) != 0x80
    start, end, row = H.words_of(raw, off)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(point & ~H.IS_SEP[raw], out=chars[1:])
    out = {"n_words": np.bincount(row, minlength=rows), "word_chars": chars[off[1:]] - chars[off[:-1]], "n_symbols": per_row(IS_SYMBOL[raw])}
    word, width = H.named(raw, start, end), chars[end] - chars[start]

    # lines end at \n and at the end of their row
    cut = np.union1d(np.flatnonzero(raw == 10) + 1, off)
    lo, hi = cut[:-1], cut[1:].copy()
    if len(lo):
        hi -= raw[hi - 1] == 10
        line_row = np.searchsorted(off, lo, "right") - 1
        holds = np.searchsorted(start, hi) > np.searchsorted(start, lo)
        lo, hi, line_row = lo[holds], hi[holds], line_row[holds]
        _, later = H.repeated(H.named(raw, lo, hi) * rows + line_row)
        out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
        out["dup_line_chars"] = np.bincount(line_row[later], (chars[hi] - chars[lo])[later], rows).astype(np.int64)
    else:
        out["n_dup_lines"] = out["dup_line_chars"] = np.zeros(rows, np.int64)

    for n in sorted({8, *COVERAGE}):
        at = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])
        twice, _ = H.repeated(H.named_windows(word, row, at, n))
        inside = covered(at[twice], n, len(word))
        if n == 8:
            out["n_repeat_words"] = np.bincount(row[inside], minlength=rows)
        if n in COVERAGE:
            out[f"dup_{n}gram_chars"] = np.bincount(row[inside], width[inside], rows).astype(np.int64)
    return out


def repetition_measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures for each row of docs, in Arrow batches and numpy, without a shuffle.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. Null and empty texts have no words and zero everywhere; repeated rows
    and equal ids each give their row; other columns are not read, whatever their names. Repeats are found by 64-bit hashes, and what
    they call equal is compared by its bytes. An empty table gives no rows. Memory: blocks of 0.5 MB of text, or one text that is longer.
    """
    names = [*BASE, "dup_line_chars", *(f"dup_{n}gram_chars" for n in COVERAGE)]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names)])

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            for a, b in blocks(off, BLOCK):
                found = measure(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(found[n], pa.int64()) for n in names)], schema=schema)

    kept = pick(docs, doc_id=(id_col, "long"), text=text_col)
    return kept.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict():
    """Kept: the base holds, few characters lie in repeated n-grams or lines, few symbols stand among the words."""
    ok = ~base_failed() & (100 * F.col("dup_line_chars") <= DUP_LINE_CHARS * F.col("word_chars")) & (100 * F.col("n_symbols") <= SYMBOLS * F.col("n_words"))
    for n, most in COVERAGE.items():
        ok &= 100 * F.col(f"dup_{n}gram_chars") <= most * F.col("word_chars")
    return ok


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_measures(table(spark, sf_dir, "documents")).withColumn("base_failed", base_failed()).withColumn("kept", verdict())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, in one pass: a text goes through the worker beside its measures, not through a join."""
    return filter_documents(docs)


def kept_mask(m: dict[str, np.ndarray]) -> np.ndarray:
    """verdict() in numpy."""
    ok = (m["n_words"] >= 20) & (100 * m["n_repeat_words"] <= 30 * m["n_words"])
    ok &= (100 * m["dup_line_chars"] <= DUP_LINE_CHARS * m["word_chars"]) & (100 * m["n_symbols"] <= SYMBOLS * m["n_words"])
    for n, most in COVERAGE.items():
        ok &= 100 * m[f"dup_{n}gram_chars"] <= most * m["word_chars"]
    return ok


def filter_documents(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text the rules keep; null texts have no words and go."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(at))
            keep = [kept_mask(measure(raw[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in blocks(off, BLOCK)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return map_rows(docs, run)


def _coverage_sql(n: int) -> str:
    """Rows (doc, i): the words of the n-word windows that occur twice or more in their text."""
    return f"""
g{n} AS (SELECT doc, i, list_aggregate(list_slice(ws, i, i + {n - 1}), 'string_agg', ' ') AS g FROM (SELECT doc, ws, unnest(generate_series(1, len(ws) - {n - 1})) AS i FROM w)),
c{n} AS (SELECT DISTINCT doc, i + k AS i FROM (SELECT doc, i, unnest(generate_series(0, {n - 1})) AS k FROM (SELECT doc, i, count(*) OVER (PARTITION BY doc, g) AS c FROM g{n}) WHERE c > 1)),
r{n} AS (SELECT doc, count(*) AS words, sum(length(ws[i])) AS chars FROM c{n} JOIN w USING (doc) GROUP BY doc)"""


_LENGTHS = sorted({8, *COVERAGE})
ORACLE = (
    r"WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),"
    + ",".join(_coverage_sql(n) for n in _LENGTHS)
    + r""",
l AS (SELECT doc, k, line, list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x))) AS chars FROM (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc, count(*) AS n, sum(chars) AS chars FROM (SELECT doc, chars, row_number() OVER (PARTITION BY doc, line ORDER BY k) AS r FROM l) WHERE r > 1 GROUP BY doc),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(r8.words, 0)::BIGINT AS n_repeat_words, coalesce(dl.chars, 0)::BIGINT AS dup_line_chars, """
    + ", ".join(f"coalesce(r{n}.chars, 0)::BIGINT AS dup_{n}gram_chars" for n in COVERAGE)
    + " FROM w LEFT JOIN dl USING (doc) "
    + " ".join(f"LEFT JOIN r{n} USING (doc)" for n in _LENGTHS)
    + f""")
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * dup_line_chars <= {DUP_LINE_CHARS} * word_chars AND 100 * n_symbols <= {SYMBOLS} * n_words"""
    + "".join(f" AND 100 * dup_{n}gram_chars <= {most} * word_chars" for n, most in COVERAGE.items())
    + ") AS kept FROM m"
)
