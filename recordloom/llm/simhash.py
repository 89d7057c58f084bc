"""SimHash near-duplicates by a segment-popcount embedding: a fingerprint's per-segment bit counts form a grid point, points
within the Manhattan radius meet at shared grid points, and the full fingerprints are compared exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import keep_ids, pick, remove, stored, table

#: Production contract: shingles of so many words, links at so many differing bits.
SHINGLE, BITS = 3, 2
SEED = 42
CHUNK = 1 << 15


def ones_of(h: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is 1."""
    return np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """64 majority bits over XXH64 of every word shingle, repeats included; fewer words: the whole sequence; none: zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: lower() changes A-Z, split() takes \x20 and \x09-\x0D
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    ones, left = np.zeros(64, np.int64), n
    while left:  # a long text in chunks: memory stays bounded
        size = min(left, CHUNK)
        ones += ones_of(np.fromiter((xxh64_intdigest(next(grams), SEED) for _ in range(size)), np.uint64, size))
        left -= size
    return majority(ones, n)


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for each row; null texts have no words: zero."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(v, shingle) if (v := x.as_buffer()) is not None and (v := v.to_pybytes()) else 0 for x in batch.column(1).cast(pa.large_binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, doc_id=(id_col, "long"), text=text_col).mapInArrow(run, "doc_id long, fp long")


#: Grid points of one long: 16 segments of four bits, one bit count (0 to 4) to a nibble.
WHOLE = [("0L", "(({0} & {m}) + (shiftrightunsigned({0}, 1) & {m}) + (shiftrightunsigned({0}, 2) & {m}) + (shiftrightunsigned({0}, 3) & {m}))".format("f0", m="1229782938247303441L"), 16, 4)]


def cells(bands) -> str:
    """SQL: the grid points within one step of a point, in each band (tag, point, segments, bits to a count)."""
    near = []
    for tag, p, segments, width in bands:
        steps = f"sequence(0, {segments - 1})"
        ups = f"transform({steps}, i -> {p} + shiftleft(1L, {width} * i))"
        downs = f"transform(filter({steps}, i -> (shiftrightunsigned({p}, {width} * i) & {2**width - 1}L) > 0), i -> {p} - shiftleft(1L, {width} * i))"
        near.append(f"transform(concat({ups}, {downs}, array({p})), c -> c + {tag})")
    return f"concat({', '.join(near)})"


def links(points: DataFrame, bands, own: list[str], verified, confirmed=None) -> DataFrame:
    """Links (u, v), u > v, that join the ids of all points whose fingerprints are linked, directly or over others.

    points: id (distinct, not null), the longs that bands read, and the columns own, which verified(left, right) compares;
    without bands a row for each cell of a point, in the column cell, and own may differ from cell to cell.
    confirmed, if given, keeps of distinct verified pairs (u, v) those that are links.
    The Manhattan distance of two grid points never exceeds the Hamming distance of their fingerprints. Points within
    two of each other share a cell, a grid point within one step of both, so cells hold all candidates.

    A cell may hold any number of points. It is sorted, not collected: each member is compared with the cell's first and,
    where links have to be confirmed, with the member before it in an order of the cell's own if these are in different
    components; so a member meets another one in each of its cells. Only members that this leaves in another component than the first's are then compared with the whole cell, so a cell in which
    all are alike costs its size and not its square, and no pair across components is left out.
    """
    dealt = points.select("id", *own, F.explode(F.expr(cells(bands))).alias("cell") if bands else "cell")
    w = Window.partitionBy("cell").orderBy("id")
    first = F.first(F.struct("id", *own)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    member = F.struct("id", *own)
    mixed = Window.partitionBy("cell").orderBy(F.xxhash64("id", "cell"), "id") if confirmed else w
    shared = dealt.select("cell", "id", *own, first.alias("first"), F.lag(member).over(mixed).alias("before"), F.lead("id").over(w).isNotNull().alias("more")).where("more OR id != first.id").drop("more")
    shared, _ = stored(shared, "cells")

    def pairs(other: str) -> DataFrame:
        sides = shared.where(f"{other} IS NOT NULL AND id != {other}.id").select("id", F.col(f"{other}.id").alias("other"), *[F.col(c).alias(f"l_{c}") for c in own], *[F.col(f"{other}.{c}").alias(f"r_{c}") for c in own])
        return sides.where(verified("l_", "r_")).select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).distinct()

    def settle(found: DataFrame) -> DataFrame:
        return stored(components(confirmed(stored(found, "pairs")[0]) if confirmed else found), "roots")[0]

    def rooted(rows: DataFrame, id_col: str, root_col: str, roots: DataFrame) -> DataFrame:
        side = roots.select(F.col("u").alias("rooted_u"), F.col("root").alias("rooted_root"))
        return rows.join(side, F.col(id_col) == F.col("rooted_u"), "left").withColumn(root_col, F.coalesce("rooted_root", id_col)).drop("rooted_u", "rooted_root")

    def edges(roots: DataFrame) -> DataFrame:
        return roots.select("u", F.col("root").alias("v")).where("u > v")

    roots = settle(pairs("first"))
    if confirmed:
        apart = rooted(rooted(pairs("before"), "u", "u_root", roots), "v", "v_root", roots).where("u_root != v_root").select("u", "v")
        roots, _ = stored(components(edges(roots).unionByName(confirmed(stored(apart, "pairs")[0]))), "roots")
    named = rooted(rooted(shared.withColumn("head", F.col("first.id")).drop("first", "before"), "id", "root", roots), "head", "head_root", roots).drop("head")
    named, _ = stored(named, "named")
    odd = named.where("root != head_root").select(F.col("cell").alias("odd_cell"), F.col("id").alias("a"), F.col("root").alias("a_root"), *[F.col(c).alias(f"l_{c}") for c in own])
    rest = named.select("cell", F.col("id").alias("b"), F.col("root").alias("b_root"), *[F.col(c).alias(f"r_{c}") for c in own])
    cross = odd.join(rest, (F.col("odd_cell") == F.col("cell")) & (F.col("a_root") != F.col("b_root")) & verified("l_", "r_")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    if confirmed:
        cross = confirmed(stored(cross, "pairs")[0])
    return edges(roots).unionByName(cross).distinct()


#: A key is hot if it holds more than one row in so many; at most so many keys are, so they may be broadcast. A hot key's rows are dealt
#: out in SALTS parts, the rows of any other key meet in one task.
HOT, SALTS = 4096, 256


def with_least(rows: DataFrame, total: int, key: str, member: str, value: str) -> DataFrame:
    """rows, total in number, with the least value of their key, in the column least. Rows of a hot key are dealt out by a hash of
    member, and its least value comes by broadcast; so a key that holds a large part of all rows is no task's load."""
    held = rows.groupBy(key).agg(F.min(value).alias("hot_least"), F.count(F.lit(1)).alias("held"))
    hot = held.where(F.col("held") * HOT > total).select(F.col(key).alias("hot_key"), "hot_least")
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    salted = dealt.withColumn("salt", F.when(F.col("hot_key").isNotNull(), F.pmod(F.xxhash64(member), F.lit(SALTS))).otherwise(-1))
    least = F.coalesce("hot_least", F.min(value).over(Window.partitionBy(key, "salt")))
    return salted.withColumn("least", least).drop("salt", "hot_key", "hot_least")


def lowest(nodes: DataFrame, id_col: str, roots: DataFrame) -> DataFrame:
    """id_col, component_id of nodes (id_col, low): the least low of the nodes that have the same root (u, root). A node that is no u is its own."""
    named, _ = stored(nodes.join(roots, F.col(id_col) == F.col("u"), "left").select(id_col, "low", F.coalesce("root", id_col).alias("root")), "named")
    return with_least(named, named.count(), "root", id_col, "low").select(id_col, F.col("least").alias("component_id"))


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of edges (u > v): root is the smallest node that u reaches. Large-star and small-star steps
    until nothing changes; only minima are grouped, no neighbour list is ever collected, and each round is written to the
    shared folder. The number of rounds grows with the logarithm of the longest chain."""
    edges, path = stored(edges, "edges")
    seen = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return edges.select("u", F.col("v").alias("root"))
        seen = state
        both = with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * state[0], "u", "v", "v")
        # A row for each edge. Rows of equal ends that come from different nodes are told apart by these, else they would share a salt.
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"), F.col("u").alias("via"))
        small = with_least(large, state[0], "u", "via", "v").select(F.when(F.col("v") != F.col("least"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("least").alias("v")).where("u > v").distinct()
        old = path
        edges, path = stored(small, "edges")
        remove(edges.sparkSession, old)


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id reachable over links of at most
    two differing bits, for each row of docs.

    Documents of equal fingerprints are one node, so copies are never paired: groups of any size cost one row. Null and
    empty texts, and those of separators only, have fingerprint zero and link like any other. Rows with a null doc_id have
    a fingerprint; their component is that of their fingerprint, null where no row of it has an id. Repeated rows each
    give their row; rows that share an id but not a text each belong to the component of their own text. An empty table gives an
    empty result.
    """
    fps, _ = stored(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    nodes, _ = stored(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    near = links(nodes.select(F.col("fp").alias("id"), F.col("fp").alias("f0")), WHOLE, ["f0"], lambda a, b: F.expr(f"bit_count({a}f0 ^ {b}f0) <= {BITS}"))
    out = fps.join(lowest(nodes, "fp", components(near)), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The pipeline's stage. Links: exact Jaccard similarity of the sets of five-word shingles of at least SIMILAR fifths.
#: A text's cells are the grid points of its SimHash fingerprint, as in op6, where fingerprints within BITS bits meet, and its prefix, for
#: similar texts whose fingerprints are farther apart: in one order of all shingles, two such sets share one of the first
#: n - ceil(0.8 n) + 1 of each, n its size. So no pair is left out. They share even more of these, by their sizes, and the parities of
#: two sets' counts in 256 classes of shingles differ in no more classes than the sets have shingles that the other lacks. All
#: bounds are exact and pass over most pairs that meet by chance; every other pair is compared by all its shingles.
STAGE_SHINGLE, SIMILAR = 5, 4
PARITIES = ["p0", "p1", "p2", "p3"]
#: Pairs of neighbours in a cell are compared before all others if their fingerprints differ in at most so many bits. This only saves
#: comparisons: whoever is not joined by it is compared with the whole cell. Texts of a similarity of 0.8 differ in 10 bits on average.
SOON = 12
#: The order: shingles that fewer texts have come first, so that cells are small. Counts of at least two in about so many texts, and of
#: at most so many shingles, tell frequent ones from rare ones. Any order finds every pair; this one only saves comparisons.
ORDER_TEXTS, ORDER_SHINGLES = 20_000, 1 << 18


def node_of(words: list[bytes]) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join(words), SEED) - 2**63


def hashed(words: list[bytes]) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; fewer words: of the whole sequence."""
    from xxhash import xxh64_intdigest

    n = max(1, len(words) - STAGE_SHINGLE + 1)
    grams = map(b" ".join, zip(*(words[k:] for k in range(STAGE_SHINGLE)))) if len(words) >= STAGE_SHINGLE else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)


def hashes(words: list[bytes]) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes."""
    return np.unique(hashed(words)).view(np.int64)


def words_of(x: pa.Scalar) -> list[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"").lower().split()


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that come first among those of about ORDER_TEXTS documents."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = [hashes(words_of(x)) for x in batch.column(0).slice(lo, 256).cast(pa.large_binary())]
                gram, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["gram", "n"])

    texts = pick(docs, doc_id=("doc_id", "long"), text="text").where("doc_id IS NOT NULL")
    n = texts.count()
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < ORDER_TEXTS).select("text")
    counts = some.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "gram").limit(ORDER_SHINGLES).toPandas().sort_values("gram")
    return got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def prefix(grams: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of a text's sorted shingles that come first, one of which it shares with every text of SIMILAR fifths or more."""
    n = len(grams)
    often = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        often = np.where(known[at] == grams, counts[at], 0)
    return grams[np.argsort(often, kind="stable")[: n - -(-SIMILAR * n // 5) + 1]]


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, node (a hash of the words in order), size (shingles of the text), f0 (the fingerprint), cells (its prefix, in order) and PARITIES."""
    order = docs.sparkSession.sparkContext.broadcast(frequent(docs))  # at most ORDER_SHINGLES pairs

    def run(batches):
        known, counts = order.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, nodes, sizes, fps, first, odd = batch.slice(lo, 256), [], [], [], [], []
                for x in part.column(1).cast(pa.large_binary()):
                    words = words_of(x)
                    h = hashed(words)
                    grams = np.unique(h).view(np.int64)
                    nodes.append(node_of(words))
                    sizes.append(len(grams))
                    fps.append(majority(sum(ones_of(h[k : k + CHUNK]) for k in range(0, len(h), CHUNK)), len(h)) if words else 0)
                    first.append(prefix(grams, known, counts))
                    odd.append(np.packbits(np.bincount(grams & 255, minlength=256) & 1).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(first, pa.list_(pa.int64())), *map(pa.array, np.array(odd).T)], names=["doc_id", "node", "size", "f0", "cells", *PARITIES])

    return pick(docs, doc_id=("doc_id", "long"), text="text").mapInArrow(run, "doc_id long, node long, size int, f0 long, cells array<long>, " + ", ".join(f"{c} long" for c in PARITIES))


def alike(a: str, b: str) -> str:
    """Whether two texts can be similar enough by their sizes and parities."""
    apart = " + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in PARITIES)
    return f"5 * least({a}size, {b}size) >= {SIMILAR} * greatest({a}size, {b}size) AND {5 + SIMILAR} * ({apart}) <= {5 - SIMILAR} * ({a}size + {b}size)"


def met(a: str, b: str) -> str:
    """Whether a cell that two texts share makes them candidates: a grid point (at is -1) if their fingerprints are linked; a shingle if
    what they can share before and from its places in their orders is enough."""
    both = f"least({a}at, {b}at) + least({a}size - {a}at, {b}size - {b}at)"
    return f"CASE WHEN {a}at < 0 OR {b}at < 0 THEN {a}at = {b}at AND bit_count({a}f0 ^ {b}f0) <= {BITS} ELSE {5 + SIMILAR} * ({both}) >= {SIMILAR} * ({a}size + {b}size) END"


def enough() -> str:
    """Whether two texts that share n shingles of their prefixes, the last at these places (at_u, at_v), can be similar enough. The
    prefix that ends first in the order holds all that it shares with the other text, so they share at most n, what lies behind this
    prefix, and what lies behind the last place in the other text."""
    behind = [f"least(floor(({SIMILAR} * size_{x} - 1) / 5), size_{y} - 1 - at_{y})" for x, y in ("uv", "vu")]
    return f"{5 + SIMILAR} * (n + greatest({', '.join(behind)})) >= {SIMILAR} * (size_u + size_v)"


def similar(docs: DataFrame, nodes: DataFrame):
    """Keeps pairs (u, v) of nodes whose texts' shingles have a Jaccard similarity of SIMILAR fifths or more, by comparing them all."""

    def own(batches):
        for batch in batches:
            same = [node_of(words_of(x)) == node for node, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()))]
            yield batch.filter(pa.array(same, pa.bool_()))  # not another text under the same id

    def compared(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())):
                a, b = hashes(words_of(x)), hashes(words_of(y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(5 * both >= SIMILAR * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs, _ = stored(pairs, "pairs")
        asked = pairs.select(F.col("u").alias("asked")).union(pairs.select("v")).distinct()
        named = nodes.join(asked, nodes.id == F.col("asked"), "left_semi").select(F.col("id").alias("node"), "low")
        texts = pick(docs, low=("doc_id", "long"), text="text")
        texts, path = stored(texts.join(named, "low").select("node", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(own, "node long, text string").groupBy("node").agg(F.first("text").alias("text")), "texts")
        left = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
        both = left.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")
        found, _ = stored(both.mapInArrow(compared, "u long, v long"), "confirmed")
        remove(docs.sparkSession, path)
        return found

    return confirmed


def rooted(rows: DataFrame, id_col: str, root_col: str, roots: DataFrame) -> DataFrame:
    side = roots.select(F.col("u").alias("rooted_u"), F.col("root").alias("rooted_root"))
    return rows.join(side, F.col(id_col) == F.col("rooted_u"), "left").withColumn(root_col, F.coalesce("rooted_root", id_col)).drop("rooted_u", "rooted_root")


def edges_of(roots: DataFrame) -> DataFrame:
    return roots.select("u", F.col("root").alias("v")).where("u > v")


def similar_links(dealt: DataFrame, nodes: DataFrame, confirmed) -> DataFrame:
    """Links (u, v), u > v, that join the ids of all nodes whose texts are similar, directly or over others.

    dealt: cell, id, at, a row for each cell of a node; nodes: id (distinct), size, f0, PARITIES. confirmed keeps of distinct pairs
    (u, v) those that are links. Only ids are sorted into cells, and those that are alone in theirs go no further.

    A cell may hold any number of nodes. Each is compared with the cell's first, then, if it is in another component, with the one before it in
    an order of the cell's own, if their fingerprints are near. Members that this leaves in another component than the first's are then compared with the
    whole cell, so a cell in which all are alike costs its size and not its square, and no pair across components is left out:
    two nodes in different components meet in every cell that they share, so the shared ones can be counted.
    """
    spark = dealt.sparkSession
    w = Window.partitionBy("cell").orderBy("id", "at")
    first = F.first("id").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shared = dealt.select("cell", "id", "at", first.alias("first"), F.lead("id").over(w).alias("next")).where("next != first OR id != first").drop("next")
    before = F.lag("id").over(Window.partitionBy("cell").orderBy(F.xxhash64("id", "cell"), "id"))
    shared, shared_path = stored(shared.withColumn("before", before), "cells")
    facts = nodes.select("id", "size", "f0", *PARITIES)

    def side(of: str, p: str) -> DataFrame:
        return facts.select(F.col("id").alias(of), *[F.col(c).alias(f"{p}{c}") for c in ["size", "f0", *PARITIES]])

    def soon(other: str) -> DataFrame:
        pairs = shared.where(f"id != {other}").select(F.greatest("id", other).alias("u"), F.least("id", other).alias("v")).distinct()
        return pairs.join(side("u", "l_"), "u").join(side("v", "r_"), "v").where(f"bit_count(l_f0 ^ r_f0) <= {SOON} AND {alike('l_', 'r_')}").select("u", "v")

    roots, _ = stored(components(confirmed(soon("first"))), "roots")
    apart = rooted(rooted(soon("before"), "u", "u_root", roots), "v", "v_root", roots).where("u_root != v_root").select("u", "v")
    roots, _ = stored(components(edges_of(roots).unionByName(confirmed(apart))), "roots")
    named = rooted(shared.select("cell", "id", "at", "first").join(rooted(facts, "id", "root", roots), "id"), "first", "head_root", roots).drop("first").withColumn("odd", F.expr("root != head_root")).drop("head_root")
    named, named_path = stored(named, "named")
    remove(spark, shared_path)
    odd = named.where("odd").select(F.col("cell").alias("odd_cell"), F.col("id").alias("a"), *[F.col(c).alias(f"l_{c}") for c in ["root", "at", "size", "f0", *PARITIES]])
    rest = named.select("cell", F.col("id").alias("b"), F.col("odd").alias("r_odd"), *[F.col(c).alias(f"r_{c}") for c in ["root", "at", "size", "f0", *PARITIES]])
    once = "l_root != r_root AND (NOT r_odd OR a > b)"  # of two odd ones, the pair comes once
    cross = odd.join(rest, (F.col("odd_cell") == F.col("cell")) & F.expr(f"{once} AND {alike('l_', 'r_')} AND {met('l_', 'r_')}"))
    ends = [F.expr(f"IF(a {sign} b, l_{c}, r_{c})").alias(f"{c}_{x}") for x, sign in (("u", ">"), ("v", "<")) for c in ("size", "at")]
    counted = cross.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), *ends).groupBy("u", "v", "size_u", "size_v")
    counted = counted.agg(F.min("at_u").alias("grid"), F.max("at_u").alias("at_u"), F.max("at_v").alias("at_v"), F.count_if(F.col("at_u") >= 0).alias("n"))
    found = counted.where(f"grid < 0 OR {enough()}").select("u", "v")
    links = edges_of(roots).unionByName(confirmed(found)).distinct()
    remove(spark, named_path)
    return links


def grid(nodes: DataFrame) -> DataFrame:
    """cell, id, at (-1) of the grid points within one step of that of each node's fingerprint."""
    return nodes.select(F.explode(F.expr(cells(WHOLE))).alias("cell"), "id", F.lit(-1).alias("at"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of documents with an id: texts of equal words, and texts whose five-word shingles are at
    least 0.8 similar, are in one component, named by its smallest doc_id.

    Null and empty texts, and those of separators only, have the empty sequence of words and are copies of each other. Texts of fewer
    than five words are one shingle, all their words. Very long texts are taken whole. Repeated rows each give their row; rows that share
    an id but not a text each belong to the component of their own text. Ties: the smallest id names a component. Other columns are not read,
    whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    found, found_path = stored(prefixes(docs).where("doc_id IS NOT NULL"), "prefixes")
    full, full_path = stored(found.groupBy(F.col("node").alias("id")).agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ["size", "f0", "cells", *PARITIES]]), "full")
    named, _ = stored(found.select("doc_id", "node"), "documents")
    remove(spark, found_path)
    nodes, _ = stored(full.drop("cells"), "nodes")
    dealt = grid(nodes).unionByName(full.select("id", F.posexplode("cells").alias("at", "cell")))
    near = similar_links(dealt, nodes, similar(docs, nodes.select("id", "low")))
    roots = components(near)
    remove(spark, full_path)
    return named.join(lowest(nodes.select("id", "low"), "id", roots).withColumnRenamed("id", "node"), "node").select("doc_id", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id, with each of its rows and all columns, also where names clash. Rows
    without an id, which no group can name, stay. An empty table stays empty."""
    keep = near_copies(docs).where("doc_id = component_id").select("doc_id").distinct()
    return keep_ids(docs, keep.unionByName(spark.createDataFrame([(None,)], "doc_id long")))
