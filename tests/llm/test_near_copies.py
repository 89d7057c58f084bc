"""The pipeline's near-duplicate stage against all pairs' Jaccard similarity, on near copies of each kind."""

import pathlib
import random

import pytest

from recordloom.llm import simhash


def brute(rows):
    """Smallest id of the component of each row, by comparing the five-word shingles of all pairs; and the similarities."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    root, alike = {i: i for i in sets}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (both := len(sets[a] & sets[b])):
                alike[a, b] = both / len(sets[a] | sets[b])
                if 5 * both >= 4 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in sets}, alike


def near_copy(r, w, kind, share):
    """w with so large a share of its words changed in one way."""
    n = int(len(w) * share)
    fresh = [f"n{r.randrange(10**9)}" for _ in range(n)]
    if kind == "appended":
        return w + fresh
    if kind == "cut":
        return w[: len(w) - n]
    if kind == "replaced":
        at = r.randrange(len(w) - n)
        return w[:at] + fresh + w[at + n :]
    v = list(w)
    for k in r.sample(range(len(w)), max(1, n // 5)):  # each substituted word changes five shingles
        v[k] = f"s{r.randrange(10**9)}"
    return v


@pytest.mark.parametrize("kind", ["appended", "cut", "replaced", "substituted"])
def test_pairs_about_the_threshold(spark, kind):
    r = random.Random(kind)
    vocabulary = [f"w{k}" for k in range(3000)]
    common = [f"c{k}" for k in range(12)]  # a line that every text has
    shares = {"appended": (0.11, 0.33), "cut": (0.1, 0.25), "replaced": (0.05, 0.14), "substituted": (0.05, 0.16)}[kind]
    rows = []
    for k in range(60):
        w = common + [r.choice(vocabulary) for _ in range(r.choice([40, 150, 300]))]
        rows.append((2 * k, " ".join(w)))
        rows.append((2 * k + 1, " ".join(near_copy(r, w, kind, r.uniform(*shares)))))
    want, alike = brute(rows)
    near = [alike[2 * k, 2 * k + 1] for k in range(60)]
    assert sum(0.75 <= x < 0.8 for x in near) > 3 and sum(0.8 <= x <= 0.9 for x in near) > 15
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {x.doc_id: x.component_id for x in got.collect()} == want


def test_texts_that_only_share_a_passage_are_not_compared_in_full(spark, monkeypatch):
    """Pairs that meet by chance grow with the square of the table; and no intermediate table is left behind."""
    from recordloom.llm.common import shared_dir

    r = random.Random(3)
    passage = [f"p{k}" for k in range(30)]
    rows = [(k, " ".join(passage + [f"o{r.randrange(10**9)}" for _ in range(170 + k)])) for k in range(40)]
    compared, similar = [], simhash.similar

    def counting(docs, nodes):
        confirmed = similar(docs, nodes)

        def run(pairs):
            compared.append(pairs.count())
            return confirmed(pairs)

        return run

    monkeypatch.setattr(simhash, "similar", counting)
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {x.doc_id: x.component_id for x in got.collect()} == {k: k for k, _ in rows}
    assert sum(compared) <= len(rows)
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert not left & {"prefixes", "full", "cells", "texts", "grams"}


def test_linked_fingerprints_are_candidates(spark):
    """By their SimHash fingerprints alone, without a shared shingle, all similar texts within two bits are found, and no other texts."""
    from pyspark.sql import functions as F

    r = random.Random(11)
    rows = []
    for k in range(20):
        w = [f"w{r.randrange(10**6)}" for _ in range(400)]
        for _ in range(3):
            rows.append((len(rows), " ".join(w)))
            w = [*w[:-1], f"n{len(rows)}"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.prefixes(docs).toPandas()
    fps = {x.doc_id: simhash.fingerprint(rows[x.doc_id][1].encode(), 5) for x in found.itertuples()}
    assert {x.doc_id: x.f0 % 2**64 for x in found.itertuples()} == fps
    root = {k: k for k in fps}
    for a in sorted(fps):
        for b in sorted(fps):
            if a < b and a // 3 == b // 3 and (fps[a] ^ fps[b]).bit_count() <= simhash.BITS:
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert sum(k != v for k, v in root.items()) > 10
    nodes = simhash.prefixes(docs).selectExpr("node id", "doc_id low", "size", "f0", *simhash.PARITIES)
    links = simhash.similar_links(simhash.grid(nodes), nodes, simhash.similar(docs, nodes.select("id", "low")))
    ids = {x.node: x.doc_id for x in found.itertuples()}
    got = simhash.components(links).toPandas()
    place = {ids[x.u]: ids[x.root] for x in got.itertuples()}
    place = {k: place.get(k, k) for k in root}
    assert all(place[k] == place[v] for k, v in root.items())
    assert all(k // 3 == v // 3 for k, v in place.items())
    assert simhash.grid(nodes).where(F.col("at") != -1).count() == 0
