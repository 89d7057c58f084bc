"""The quality classifier on wording that is rare in the table."""

import math
import random
from collections import Counter

import numpy as np

from recordloom.llm import resampling


def rare_toxic(n=336, toxic=28):
    """Documents of which one in twelve has words that clean text never holds, too few for four standard deviations; three in five are labelled."""
    r = random.Random(4)
    good = ["".join(r.choice("etaoins") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(good) for _ in range(60)]
        if i % (n // toxic) == 0:
            for bad in ("moron", "idiot", "clown"):
                w[r.randrange(60)] = bad
        rows.append((i, " ".join(w)))
        if i % 5 < 3:
            labels.append((i, 1, int(i % (n // toxic) == 0)))
    return rows, labels


def test_rare_wording_counts(spark):
    rows, labels = rare_toxic()
    seen = {i for i, _, _ in labels}
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.selected for x in resampling.resample(df, lab).collect() if x.doc_id not in seen}
    assert np.mean([v for k, v in got.items() if k % 12 == 0]) < 0.3
    assert np.mean([v for k, v in got.items() if k % 12]) > 0.9


def test_weights_against_a_plain_recomputation(spark):
    """The two models of the n-grams themselves, without hash buckets: few weights may differ, by a collision."""
    rows, labels = rare_toxic()
    target = {i for i, _, toxic in labels if not toxic}
    grams = {}
    for i, t in rows:
        w = t.split()
        grams[i] = Counter(w) + Counter(zip(w, w[1:]))
    raw, good = Counter(), Counter()
    for i, own in grams.items():
        raw.update(own)
        if i in target:
            good.update(own)
    share, mean = sum(good.values()) / sum(raw.values()), sum(raw.values()) / len(rows)
    want = {}
    for i, own in grams.items():
        want[i] = 0.0
        for g, n in own.items():
            e, t = raw[g] * share, good[g] - n * (i in target)
            odds = resampling.ODDS * math.exp((t * math.log(t / e) if t else 0) - (t - e))
            want[i] += n * odds / (1 + odds) * math.log((t + resampling.PRIOR) / (e + resampling.PRIOR))
        want[i] *= math.sqrt(mean / sum(own.values()))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.log_weight for x in resampling.resample(df, lab).collect()}
    assert min(want.values()) < -1 and np.mean([abs(got[i] - want[i]) < 0.01 for i in want]) > 0.95
