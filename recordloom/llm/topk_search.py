"""Exact top-k search by inner product: a ball tree for each shard, nodes in the order of their upper bound, and the current
kth score shared between shards. Shards are parts of space, so a block of queries is sent only where its bounds reach."""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from .common import pick, stored, table

K = 5
SCALE = 256
QUERY_EVERY = 50
#: Vectors of a shard, vectors of a leaf, queries of a block, blocks that a task takes with one tree.
SHARD, LEAF, BLOCK, CHUNK = 8192, 64, 256, 32
#: Vectors that the parts of space are fitted on at most, by a hash of their rows, and of these in a part at least. All vectors are dealt to the parts.
SAMPLE, LEAST = 20_000, 16
#: Beyond this bound doubles can't add integers exactly: Python's integers take over.
EXACT = float(2**53)
LOW = -(2**63)


def integers(vectors: list) -> np.ndarray:
    """floor(256 * x) of each component, x as double; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = np.floor(SCALE * np.asarray(v, np.float64))
    return out


def halves(own: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The direction between two far points, and the points' order along it."""
    one = own[away.argmax()]
    other = own[((own - one) ** 2).sum(axis=1).argmax()]
    return other - one, np.argsort(own @ (other - one), kind="stable")


class Space:
    """Parts (cells) of space, by halving a sample; cell() tells each vector's, whatever its length. shares are the sample's."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple] = []  # direction, where it is cut, children; or a cell
        self.shares: list[float] = []
        self.width = sample.shape[1]

        def split(own: np.ndarray, cells: int) -> int:
            at = len(self.nodes)
            self.nodes.append(())
            away = ((own - own.mean(axis=0)) ** 2).sum(axis=1) if len(own) else np.zeros(1)
            if cells > 1 and len(own) >= 2 * LEAST and away.max() > 0:
                direction, rank = halves(own, away)
                along = (own @ direction)[rank]
                low = own @ direction < along[len(own) // 2]
                if low.any():  # else half of the sample or more lies at one place
                    self.nodes[at] = (direction, along[len(own) // 2], split(own[low], cells // 2), split(own[~low], cells - cells // 2))
                    return at
            self.nodes[at] = (len(self.shares),)
            self.shares.append(len(own) / max(len(sample), 1))
            return at

        split(sample, cells)

    def cell(self, points: np.ndarray) -> np.ndarray:
        points = np.pad(points[:, : self.width], ((0, 0), (0, max(0, self.width - points.shape[1]))))
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if len(self.nodes[at]) == 1:
                out[rows] = self.nodes[at][0]
            elif len(rows):
                direction, cut, left, right = self.nodes[at]
                low = points[rows] @ direction < cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def ball_tree(ids: np.ndarray, points: np.ndarray, rows: np.ndarray | None = None) -> dict:
    """Nodes (center, radius, range of rows, children), root first; rows are reordered so that a node is a range."""
    rows = ids if rows is None else rows
    order = np.arange(len(ids))
    nodes: list[list] = []

    def split(lo: int, hi: int) -> int:
        own = points[order[lo:hi]]
        center = own.mean(axis=0)
        away = ((own - center) ** 2).sum(axis=1)
        nodes.append([center, float(np.sqrt(away.max())), lo, hi, -1, -1])
        at = len(nodes) - 1
        if hi - lo > LEAF and away.max() > 0:
            order[lo:hi] = order[lo:hi][halves(own, away)[1]]
            mid = (lo + hi) // 2
            nodes[at][4], nodes[at][5] = split(lo, mid), split(mid, hi)
        return at

    split(0, len(ids))
    return {"ids": ids[order], "rows": rows[order], "points": points[order], "center": np.array([n[0] for n in nodes]), "radius": np.array([n[1] for n in nodes]), "node": np.array([n[2:] for n in nodes])}


def scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in Python's integers, held to the range of a long."""
    width = min(queries.shape[1], points.shape[1])
    q, p = queries[:, :width], points[:, :width]
    if width * (np.abs(q).max(initial=0) + 1) * (np.abs(p).max(initial=0) + 1) < EXACT:
        return np.rint(q @ p.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(q) @ whole(p).T, LOW, 2**63 - 1).astype(np.int64)


def bounds(queries: np.ndarray, norm: np.ndarray, center: np.ndarray, radius: float, far: float) -> np.ndarray:
    """No point of the ball has a higher inner product with the queries; rounding is allowed for."""
    b = queries @ center + norm * radius
    return b + 1e-9 * (np.abs(b) + norm * (far + radius)) + 1


def search(tree: dict, block: dict, k: int) -> None:
    """Improves the block's best rows (score, vec_id) of each query by those of the tree.

    A node is visited with the queries whose kth score its bound reaches, best bound first. An equal bound is visited
    too: a tie may have the smaller id.
    """
    queries, norm = block["queries"], np.sqrt((block["queries"] ** 2).sum(axis=1))
    width = min(queries.shape[1], tree["points"].shape[1])
    best, kth, own = block["best"], block["kth"], block.get("rows", block["ids"])

    def bound(at: int, rows: np.ndarray) -> np.ndarray:
        return bounds(queries[rows, :width], norm[rows], tree["center"][at][:width], tree["radius"][at], np.linalg.norm(tree["center"][at]))

    rows = np.arange(len(queries))
    top = bound(0, rows)
    heap = [(-float(top.max()), 0, rows, top)]
    while heap:
        _, at, rows, upper = heapq.heappop(heap)
        alive = upper >= kth[rows]
        rows = rows[alive]
        if not len(rows):
            continue
        lo, hi, left, right = tree["node"][at]
        if left >= 0:
            for child in (left, right):
                b = bound(child, rows)
                near = b >= kth[rows]
                if near.any():
                    heapq.heappush(heap, (-float(b[near].max()), int(child), rows[near], b[near]))
            continue
        found, ids = scores(queries[rows], tree["points"][lo:hi]), tree["ids"][lo:hi]
        hit = (found >= kth[rows][:, None]) & (tree["rows"][lo:hi][None, :] != own[rows][:, None])
        for i in np.flatnonzero(hit.any(axis=1)):
            row = rows[i]
            got = best[row] + [(-int(s), int(v)) for s, v in zip(found[i][hit[i]], ids[hit[i]])]
            best[row] = sorted(got)[:k]
            if len(best[row]) == k:
                kth[row] = max(kth[row], -best[row][-1][0])


def top_k(vectors: DataFrame, *, k: int = K, every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other rows, ties to the
    smaller vec_id; fewer rows where there are fewer candidates.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Each row is a
    candidate of its own, and a query of its own if its id is asked for, also where ids or whole rows repeat. Shorter vectors are as if they
    ended in zeros; a vector may be of any length that a row may have. Scores beyond a long are held to its range. Each block of queries is first
    searched in a shard of its own part of space, whose kth scores then tell the parts that its bounds reach. Other columns are not read,
    whatever their names. No candidates give no rows.
    """
    spark = vectors.sparkSession
    good = F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = pick(vectors, vec_id=(id_col, "long"), v=vector_col).where("vec_id IS NOT NULL AND v IS NOT NULL").where(good)
    rows, _ = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    hashed = F.xxhash64("row")
    n, asked = rows.count(), rows.where(F.col("vec_id") % every == 0).count()
    sample = rows.where(F.pmod(hashed, F.lit(-(-n // SAMPLE) or 1)) == 0).limit(2 * SAMPLE).select("v").toPandas()["v"]
    space = Space(integers(list(sample)), max(1, -(-n // SHARD)))
    shared = spark.sparkContext.broadcast(space)  # at most SAMPLE / LEAST directions
    shards = [max(1, math.ceil(n * share / SHARD)) for share in space.shares]
    parts = [max(1, math.ceil(asked * share / BLOCK)) for share in space.shares]

    def route(batches):
        for pdf in batches:
            pdf["cell"] = shared.value.cell(integers(list(pdf["v"])))
            yield pdf

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = ball_tree(pdf["vec_id"].to_numpy(), integers(list(pdf["v"])), pdf["row"].to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "cell": [int(pdf["cell"].iloc[0])], "tree": [pickle.dumps(tree)], "center": [tree["center"][0].tolist()], "radius": [tree["radius"][0]]})

    def ball(pdf: pd.DataFrame) -> pd.DataFrame:
        """Around the balls of a cell's shards."""
        centers = np.zeros((len(pdf), max(map(len, pdf["center"]))))
        for i, c in enumerate(pdf["center"]):
            centers[i, : len(c)] = c
        center = centers.mean(axis=0)
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "shards": [sorted(map(int, pdf["shard"]))], "center": [center.tolist()], "radius": [float((np.sqrt(((centers - center) ** 2).sum(axis=1)) + pdf["radius"].to_numpy()).max() * (1 + 1e-9))]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        part, cell, ids = int(pdf["part"].iloc[0]), int(pdf["cell"].iloc[0]), pdf["vec_id"].to_numpy()
        home = cell << 32 | (part & 0xFFFFFFFF) % shards[cell]
        block = {"ids": ids, "rows": pdf["row"].to_numpy(), "queries": integers(list(pdf["v"])), "best": [[] for _ in ids], "kth": np.full(len(ids), LOW, np.int64), "home": home}
        return pd.DataFrame({"part": [part], "shard": [home], "block": [pickle.dumps(block)]})

    def number(counts: list[int], column):
        """cell * 2**32 + a part of it by a hash; a cell has as many parts as its share of the sample tells."""
        of = F.array(*(F.lit(c) for c in counts))
        return F.shiftleft("cell", 32) + F.pmod(column, F.element_at(of, F.col("cell").cast("int") + 1))

    routed, _ = stored(rows.mapInPandas(route, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())])), "routed")
    trees, _ = stored(routed.withColumn("shard", number(shards, F.xxhash64(hashed))).groupBy("shard").applyInPandas(build, "shard long, cell long, tree binary, center array<double>, radius double"), "trees")
    balls = spark.sparkContext.broadcast(trees.select("cell", "shard", "center", "radius").groupBy("cell").applyInPandas(ball, "cell long, shards array<long>, center array<double>, radius double").toPandas())  # at most SAMPLE / LEAST balls
    ask = routed.where(F.col("vec_id") % every == 0).withColumn("part", number(parts, hashed))
    homes = ask.groupBy("part").applyInPandas(gather, "part long, shard long, block binary")
    homes, _ = stored(homes, "queries")

    def first(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        done = []
        tree = pickle.loads(left["tree"].iloc[0]) if len(left) and len(right) else None
        for data in right["block"]:
            block = pickle.loads(data)
            if tree:
                search(tree, block, k)
            done.append(pickle.dumps(block))
        return pd.DataFrame({"part": right["part"], "block": done})

    def reached(batches):
        """A block beside each shard that may hold a row of one of its queries, and its home, which has what it found there."""
        for pdf in batches:
            for part, data in zip(pdf["part"], pdf["block"]):
                block, wanted = pickle.loads(data), set()
                queries, norm = block["queries"], np.sqrt((block["queries"] ** 2).sum(axis=1))
                for _, own in balls.value.iterrows():
                    center = np.asarray(own["center"])
                    width = min(len(center), queries.shape[1])
                    if (bounds(queries[:, :width], norm, center[:width], own["radius"], np.linalg.norm(center)) >= block["kth"]).any():
                        wanted.update(map(int, own["shards"]))
                wanted.add(block["home"])
                yield pd.DataFrame({"part": part, "shard": sorted(wanted), "block": [data] * len(wanted)})

    def others(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = pickle.loads(left["tree"].iloc[0]) if len(left) and len(right) else None
        out = []
        for data in right["block"]:
            block = pickle.loads(data)
            if block["home"] != key[0]:
                block["best"] = [[] for _ in block["ids"]]
                if tree:
                    search(tree, block, k)
            out += [(int(row), int(q), v, -s) for row, q, best in zip(block["rows"], block["ids"], block["best"]) for s, v in best]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"])

    def dealt(blocks: DataFrame):
        """Trees beside chunks of blocks: a tree is sent once for each chunk that needs it."""
        blocks = blocks.withColumn("chunk", F.pmod(F.xxhash64("part"), F.lit(max(1, sum(parts) // CHUNK))))
        wanted = blocks.select(F.col("shard").alias("to_shard"), F.col("chunk").alias("to_chunk")).distinct()
        sides = trees.join(wanted, F.col("shard") == F.col("to_shard")).select(F.col("to_shard").alias("shard"), F.col("to_chunk").alias("chunk"), "tree")
        return sides.groupBy("shard", "chunk").cogroup(blocks.groupBy("shard", "chunk"))

    seen, _ = stored(dealt(homes).applyInPandas(first, "part long, block binary"), "blocks")
    found = dealt(seen.mapInPandas(reached, "part long, shard long, block binary")).applyInPandas(others, "query long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
