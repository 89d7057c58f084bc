"""Suffix-array dedup: every byte that a repeated 100-byte string covers is removed, but for the first place of the string.

1. Anchors. A window of LENGTH bytes is owned by the smallest hash among its GRAM-byte strings, so equal windows have equal
   anchors at the same place within them. The windows that one anchor owns follow each other: a span. One row a span,
   about one for each 35 bytes, is dealt out by the anchor's hash.
2. Spans that equal an earlier one are removed whole. Where an anchor has different spans, their bytes are fetched.
3. Deep-shallow sorting of the suffixes that start in these spans: a three-way multikey quicksort over eight-byte digits down to
   SHALLOW bytes, and blind tries for the groups that share a longer prefix. Equal suffixes (to LENGTH bytes) meet
   in a leaf, of which the earliest stays.
4. Each document's removed windows are joined to its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import blocks, numbered, pick, stored, table, text_bytes

LENGTH, GRAM = 100, 32
WINDOWS = LENGTH - GRAM + 1
#: Bytes that the multikey quicksort compares before blind tries take over.
SHALLOW = 24
#: Different spans of one anchor that are sorted together; the windows of more are grouped by hashes of their bytes.
MOST_SPANS = 20_000
#: Bytes of text worked on, and suffixes sorted, at once.
BLOCK, SUFFIXES = 1 << 20, 1 << 18
PLACE = np.uint64((1 << 23) - 1)


def owned(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor hash, span hash, row, first window and number of windows of each span of the concatenated rows."""
    n = len(raw) - LENGTH + 1
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n <= 0:
        return empty
    spans = H.Spans(raw)
    at = np.arange(len(raw) - GRAM + 1)
    gram = spans.of(at, at + GRAM)
    low = (gram & ~PLACE) | at.astype(np.uint64)  # the leftmost of equal ones
    width = 1
    while 2 * width <= WINDOWS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (WINDOWS - width)], low[WINDOWS - width :])[:n]
    start = np.arange(n)
    row = np.searchsorted(off, start, "right") - 1
    good = np.flatnonzero(start + LENGTH <= off[row + 1])
    if not len(good):
        return empty
    anchor, row = (low[good] & PLACE).astype(np.int64), row[good]
    new = np.ones(len(good), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(good)))
    p = good[first]
    return gram[anchor[first]], spans.of(p, p + count + LENGTH - 1), row[first], p - off[row[first]], count


def pieces(raw: np.ndarray, off: np.ndarray):
    """(first row, last row + 1, bytes, offsets, start in the first row) of blocks; a row longer than a block comes in pieces
    that overlap, so that each window lies in one."""
    for a, b in blocks(off, BLOCK):
        if off[b] - off[a] <= BLOCK:
            yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a], 0
        else:
            for lo in range(0, int(off[b] - off[a]), BLOCK):
                part = raw[off[a] + lo : min(off[b], off[a] + lo + BLOCK + LENGTH - 1)]
                yield a, b, part, np.array([0, len(part)]), lo


def span_rows(docs: DataFrame) -> DataFrame:
    """ah, sh, did, th, place (first window * 256 + windows * 2 + done) of each span of docs (did, th, text).

    done: the same span stands earlier in the same block, so it goes; only one of a block's equal spans has to meet others.
    """

    def run(batches):
        for batch in batches:
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, off = text_bytes(batch.column(2))
            for a, b, part, cuts, lo in pieces(raw, off):
                ah, sh, row, p, n = owned(part, cuts)
                if not len(ah):
                    continue
                d, t, p = did[a:b][row], th[a:b][row], p + lo
                order = np.lexsort((p, t, d, sh, ah))
                ah, sh, d, t, p, n = (x[order] for x in (ah, sh, d, t, p, n))
                done = np.zeros(len(ah), bool)
                done[1:] = (ah[1:] == ah[:-1]) & (sh[1:] == sh[:-1])
                again = np.zeros(len(ah), bool)  # the same place of a repeated row
                again[1:] = done[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (p[1:] == p[:-1])
                k = ~again
                if again.any():  # a repeat of a group's first must not count the next as its copy
                    first = np.flatnonzero(~done)
                    lead = first[np.cumsum(~done) - 1]
                    done &= (d != d[lead]) | (t != t[lead]) | (p != p[lead])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ah[k].view(np.int64), sh[k].view(np.int64), d[k], t[k], (p * 256 + n * 2 + done)[k])], names=["ah", "sh", "did", "th", "place"])

    return docs.select("did", "th", "text").mapInArrow(run, "ah long, sh long, did long, th int, place long")


#: What becomes of a span: it goes, its windows are sorted with its anchor's others, or its windows are grouped.
GOES, SORTED, GROUPED = 0, 1, 2


def judged_spans(spans: DataFrame, most_spans: int = MOST_SPANS) -> DataFrame:
    """kind, ah, did, th, place: of equal spans all but the first go; anchors with one kind of span need nothing more."""
    key = F.when(F.col("place") % 2 == 1, F.xxhash64("did", "place")).otherwise(F.col("ah"))
    dealt = spans.repartition(key).sortWithinPartitions("ah", "sh", "did", "th", "place")
    names = ["kind", "ah", "did", "th", "place"]

    def run(batches):
        last, hot = None, None  # the first row of the last run of equal spans; an anchor found to have many
        held = [np.zeros(0, np.int64)] * 4

        def out(kind, cols):
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int32(kind), len(cols[0])) if np.isscalar(kind) else kind, pa.int32()), *(pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(cols))], names=names)

        for batch in batches:
            ah, sh, did, th, place = (c.to_numpy() for c in batch.columns)
            through = place % 2 == 1
            if through.any():
                yield out(GOES, [x[through] for x in (ah, did, th, place)])
                ah, sh, did, th, place = (x[~through] for x in (ah, sh, did, th, place))
            if not len(ah):
                continue
            if last is not None:
                ah, sh, did, th, place = (np.concatenate([[v], x]) for v, x in zip(last, (ah, sh, did, th, place)))
            new = np.ones(len(ah), bool)
            new[1:] = (ah[1:] != ah[:-1]) | (sh[1:] != sh[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            copy = ~new & ((did != did[lead]) | (th != th[lead]) | (place != place[lead]))
            if copy.any():
                yield out(GOES, [x[copy] for x in (ah, did, th, place)])
            begun = last is not None
            last = [x[lead[-1]] for x in (ah, sh, did, th, place)]
            if begun:
                new[0] = False  # it was held before
            held = [np.concatenate([h, x[new]]) for h, x in zip(held, (ah, did, th, place))]
            # anchors are complete but for the last
            if len(held[0]):
                edge = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if held[0][0] != held[0][-1] else 0
                full, held = [h[:edge] for h in held], [h[edge:] for h in held]
                if len(full[0]):
                    yield from settle(full, hot, out)
                if len(held[0]) > most_spans or (hot is not None and held[0][0] == hot):
                    hot = held[0][0]
                    yield out(GROUPED, held)
                    held = [h[:0] for h in held]
        if len(held[0]):
            yield from settle(held, hot, out)

    def settle(cols, hot, out):
        _, inverse, count = np.unique(cols[0], return_inverse=True, return_counts=True)
        is_hot = cols[0] == hot if hot is not None else np.zeros(len(cols[0]), bool)
        several = (count[inverse] > 1) & ~is_hot
        for kind, mask in ((SORTED, several), (GROUPED, is_hot)):
            if mask.any():
                yield out(kind, [c[mask] for c in cols])

    return dealt.mapInArrow(run, "kind int, ah long, did long, th int, place long")


def fetched(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """kind, ah, did, th, p, bytes: the bytes under the spans, or a 128-bit hash of each window of those that are grouped."""
    from xxhash import xxh128_digest

    wanted = spans.groupBy("did", "th").agg(F.collect_list(F.struct("ah", F.col("place") * 4 + F.col("kind"))).alias("spans"))  # at most one for each window of a text
    joined = docs.join(wanted, ["did", "th"]).select("did", "th", "text", "spans")
    names = ["kind", "ah", "did", "th", "p", "bytes"]

    def run(batches):
        for batch in batches:
            for did, th, text, own in zip(*(batch.column(k) for k in range(3)), batch.column(3)):
                raw, got = text.as_py().encode(), own.values
                ah, code = got.field(0).to_numpy(), got.field(1).to_numpy()
                kind, p, n = code % 4, code // 1024, code // 8 % 128
                rows = [(k, h, x, raw[x : x + m + LENGTH - 1]) for k, h, x, m in zip(kind.tolist(), ah.tolist(), p.tolist(), n.tolist()) if k == SORTED]
                rows += [(k, h, x + j, xxh128_digest(raw[x + j : x + j + LENGTH])) for k, h, x, m in zip(kind.tolist(), ah.tolist(), p.tolist(), n.tolist()) if k == GROUPED for j in range(m)]
                for lo in range(0, len(rows), 1 << 14):
                    k, h, x, y = zip(*rows[lo : lo + (1 << 14)])
                    m = len(k)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(h, pa.int64()), pa.array([did.as_py()] * m, pa.int64()), pa.array([th.as_py()] * m, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.binary())], names=names)

    return joined.mapInArrow(run, "kind int, ah long, did long, th int, p long, bytes binary")


class BlindTrie:
    """A trie that keeps, at each branch, only the depth and the bytes that tell its children apart. A suffix descends
    blindly to some leaf; one comparison with it gives the true common prefix, and so the leaf or the place of a new branch."""

    def __init__(self, text: bytes, depth: int, first: int, rank: int):
        self.text, self.depth = text, depth
        self.root: list = [LENGTH, first, [(rank, first)]]  # leaf: LENGTH, its suffix, members; branch: depth, a suffix, children

    def add(self, start: int, rank: int) -> None:
        text, node = self.text, self.root
        while node[0] < LENGTH:
            child = node[2].get(text[start + node[0]])
            if child is None:
                break
            node = child
        other = node[1]
        if text[start + self.depth : start + LENGTH] == text[other + self.depth : other + LENGTH]:
            if node[0] == LENGTH:
                node[2].append((rank, start))
                return
        lo, hi = self.depth, LENGTH  # the common prefix, by halves
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if text[start + self.depth : start + mid] == text[other + self.depth : other + mid]:
                lo = mid
            else:
                hi = mid - 1
        leaf = [LENGTH, start, [(rank, start)]]
        parent, node = None, self.root
        while node[0] < lo:
            parent, node = node, node[2][text[start + node[0]]]
        if node[0] == lo and node[0] < LENGTH:
            node[2][text[start + lo]] = leaf
            return
        branch = [lo, node[1], {text[node[1] + lo]: node, text[start + lo]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[2][text[start + parent[0]]] = branch

    def leaves(self):
        """Members of each leaf, leaves in the order of their suffixes."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] == LENGTH:
                yield node[2]
            else:
                stack += [node[2][b] for b in sorted(node[2], reverse=True)]


def multikey_quicksort(raw: np.ndarray, start: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, part): the suffixes that share SHALLOW bytes with another of their part, in order, and the parts that they make.

    Three-way partitioning of all parts at once: each takes the eight-byte digit of its middle suffix as pivot; what is
    smaller or larger stays at its depth, and what equals the pivot goes on to the next digit. A suffix that is alone is in place and drops
    out, and parts that are equal to SHALLOW bytes are done.
    """
    digits = [np.ndarray((len(raw) - 7,), ">u8", raw.data, 0, (1,))[start + d].astype(np.uint64) for d in range(0, SHALLOW, 8)]
    live = np.argsort(part, kind="stable")
    part, depth = part[live], np.zeros(len(start), np.int64)
    done: list[np.ndarray] = []
    while len(live):
        new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        size = np.diff(np.append(new, len(live)))
        at = np.repeat(np.arange(len(new)), size)
        level = depth[new]
        digit = np.choose(np.repeat(level, size), [d[live] for d in digits])
        pivot = digit[new + size // 2][at]
        side = 1 + (digit > pivot).astype(np.int64) - (digit < pivot)
        key = at * 3 + side
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        many = np.bincount(key, minlength=3 * len(new))[key] > 1
        live, key = live[many], key[many]
        depth = level[key // 3] + (key % 3 == 1)
        full = depth == len(digits)
        done.append(np.stack([live[full], key[full] + (len(done) << 40)]))
        live, part, depth = live[~full], key[~full], depth[~full]
    found = np.concatenate(done, axis=1) if done else np.zeros((2, 0), np.int64)
    return found[0], found[1]


def deep_shallow(text: bytes, group: np.ndarray, start: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, rank of the suffixes that equal, to LENGTH bytes, one of smaller rank in their group: a multikey quicksort to
    SHALLOW bytes, and blind tries for the parts that share these."""
    live, part = multikey_quicksort(np.frombuffer(text, np.uint8), start, group.astype(np.int64))
    if not len(live):
        return start[:0], rank[:0]
    out_start, out_rank = [], []
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [len(live)]
    starts, ranks = start[live].tolist(), rank[live].tolist()
    for a, b in zip(edges, edges[1:]):
        trie = BlindTrie(text, SHALLOW, starts[a], ranks[a])
        for k in range(a + 1, b):
            trie.add(starts[k], ranks[k])
        for members in trie.leaves():
            if len(members) > 1:
                low = min(members)[0]
                for r, s in members:
                    if r != low:
                        out_rank.append(r)
                        out_start.append(s)
    return np.array(out_start, np.int64), np.array(out_rank, np.int64)


def sorted_windows(spans: DataFrame) -> DataFrame:
    """did, th, p, n: runs of windows that go, by sorting the suffixes of each anchor's spans."""
    dealt = spans.repartition("ah").sortWithinPartitions("ah").select("ah", "did", "th", "p", "bytes")

    def work(rows):
        ah, did, th, p, data = (np.concatenate(x) if k < 4 else [v for part in x for v in part] for k, x in enumerate(zip(*rows)))
        size = np.fromiter(map(len, data), np.int64, len(data))
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        count = size - LENGTH + 1
        order = np.lexsort((p, th, did))  # repeated rows share their place
        new = np.append(True, (did[order][1:] != did[order][:-1]) | (th[order][1:] != th[order][:-1]) | (p[order][1:] != p[order][:-1]))
        place, back = np.empty(len(ah), np.int64), order[new]
        place[order] = np.cumsum(new) - 1
        own = np.repeat(np.arange(len(ah)), count)
        j = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        _, group = np.unique(ah, return_inverse=True)
        _, rank = deep_shallow(b"".join(data), group[own], base[own] + j, place[own] * 128 + j)
        if not len(rank):
            return None
        rank = np.unique(rank)
        span, j = back[rank // 128], rank % 128
        new = np.append(True, np.diff(rank) != 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(rank)))
        return pa.RecordBatch.from_arrays([pa.array(did[span[first]]), pa.array(th[span[first]], pa.int32()), pa.array(p[span[first]] + j[first]), pa.array(n)], names=["did", "th", "p", "n"])

    def run(batches):
        held, suffixes = [], 0
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(4)] + [batch.column(4).to_pylist()]
            edges = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            at = 0
            for e in [*edges[1:].tolist(), len(cols[0])]:  # an anchor's spans stay together
                if suffixes > SUFFIXES and held and held[-1][0][-1] != cols[0][at]:
                    if (got := work(held)) is not None:
                        yield got
                    held, suffixes = [], 0
                held.append(tuple(c[at:e] for c in cols))
                suffixes += sum(len(x) - LENGTH + 1 for x in cols[4][at:e])
                at = e
        if held and (got := work(held)) is not None:
            yield got

    return dealt.mapInArrow(run, "did long, th int, p long, n long")


def grouped_windows(windows: DataFrame) -> DataFrame:
    """did, th, p, n of windows that go, of anchors with more spans than are sorted at once: minima are taken before and
    after the shuffle and joined back, so no anchor's windows ever meet in one task."""
    place = F.struct("did", "th", "p")
    least = windows.groupBy("ah", "bytes").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1")
    found = windows.join(least, ["ah", "bytes"]).where(place != F.col("least"))
    return found.select("did", "th", "p", F.lit(1).cast("long").alias("n"))


def removals(docs: DataFrame, most_spans: int = MOST_SPANS) -> DataFrame:
    """did, th, runs (first window, number of windows) of the windows of docs (did, th, text) that go."""
    judged, _ = stored(judged_spans(span_rows(docs), most_spans), "spans")
    seen = judged.where(F.col("kind") == GOES).select("did", "th", F.expr("place div 256").alias("p"), F.expr("(place div 2) % 128").alias("n"))
    spans, _ = stored(fetched(docs, judged.where(F.col("kind") != GOES)), "span-bytes")
    by_sort = sorted_windows(spans.where(F.col("kind") == SORTED).drop("kind"))
    by_group = grouped_windows(spans.where(F.col("kind") == GROUPED).drop("kind"))
    runs = seen.unionByName(by_sort).unionByName(by_group)
    return runs.groupBy("did", "th").agg(F.collect_list(F.struct("p", "n")).alias("runs"))  # at most one for each window of a text


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of docs, numbered, with did, th and body of each document: a null id comes before all others."""
    body = F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit(""))
    did = F.coalesce(F.col(f"c{docs.columns.index(id_col)}").cast("long"), F.lit(-(2**63)))
    return numbered(docs).withColumn("did", did).withColumn("th", F.hash(body)).withColumn("body", body)


def with_runs(docs: DataFrame, id_col: str, text_col: str, most_spans: int = MOST_SPANS) -> DataFrame:
    """The columns of docs, numbered, with runs, for each row the windows of its text that go."""
    rows = keyed(docs, id_col, text_col)
    found = removals(rows.select("did", "th", F.col("body").alias("text")), most_spans)
    return rows.join(found, ["did", "th"], "left").drop("did", "th", "body")


def kept_parts(size: int, runs) -> tuple[int, int, list[tuple[int, int]]]:
    """Bytes removed, maximal removed runs, and the ranges that stay of a text of so many bytes."""
    if runs is None or not len(runs):
        return 0, 0, [(0, size)] if size else []
    p, n = runs.field(0).to_numpy(), runs.field(1).to_numpy()
    order = np.argsort(p)
    lo, hi = p[order], np.maximum.accumulate((p + n + LENGTH - 1)[order])
    new = np.append(True, lo[1:] > hi[:-1])
    first = np.flatnonzero(new)
    lo, hi = lo[first], hi[np.append(first[1:] - 1, len(hi) - 1)]
    stay = [(int(a), int(b)) for a, b in zip(np.append(0, hi), np.append(lo, size)) if a < b]
    return int((hi - lo).sum()), len(lo), stay


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_spans: int = MOST_SPANS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) for each row of docs.

    Texts are taken whole, as UTF-8 bytes; null is empty. A byte goes if a 100-byte string of the input covers it that also
    starts earlier: in a smaller doc_id, or before it in the same text. A null id is the smallest. Rows of the same id
    and text are one document, each with its result; of one id with several texts, the text of the smaller hash is
    earlier. Texts of under 100 bytes stay whole; very long ones are worked on in overlapping pieces. Other columns are not read; no rows give no rows. Equal spans are told by
    64-bit hashes of span and anchor together, equal windows by their bytes, or, of anchors with over most_spans
    different spans, by 64-bit hashes of their anchors and 128-bit hashes of their bytes.
    """
    rows = with_runs(pick(docs, doc_id=(id_col, "long"), text=text_col), "doc_id", "text", most_spans)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            out = []
            for k, runs in enumerate(batch.column(2)):
                own = raw[off[k] : off[k + 1]]
                gone, n, stay = kept_parts(len(own), runs.values)
                kept = b"".join(own[a:b].tobytes() for a, b in stay)
                out.append((len(own), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the text that stays, and n_chars as its code points; a character that lost a byte goes too. A null text
    is the empty text from here on. Repeated rows and ids as in dedup(); other columns are kept, also where names clash."""
    rows = with_runs(docs, "doc_id", "text")
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    plain = numbered(docs).schema

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(at))
            texts = []
            for k, runs in enumerate(batch.column(batch.num_columns - 1)):
                own = raw[off[k] : off[k + 1]]
                _, _, stay = kept_parts(len(own), runs.values)
                texts.append(b"".join(own[a:b].tobytes() for a, b in stay).decode("utf-8", "ignore"))
            cols = list(batch.columns[:-1])
            if count >= 0:
                cols[count] = pa.array(map(len, texts), pa.int64()).cast(cols[count].type)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=plain.names)

    return rows.mapInArrow(run, plain).toDF(*docs.columns)
