"""Texts and hashes that collide."""

import random

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import hashing, quality_rules, suffix_dedup
from recordloom.llm.common import text_bytes


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


def measured(*texts):
    raw, off = text_bytes(pa.array(texts))
    return {k: v.tolist() for k, v in quality_rules.measure(raw, off).items()}


def plain(text):
    words = text.split()
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.split()]
    return len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("n", [1024, 2048, 4096, 65536])
def test_lines_that_collide_modulo_two_to_the_64(n):
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    got = measured(f"{one}\n{other}", f"{one}\n{one}")
    assert got["n_dup_lines"] == [0, 1] and got["dup_line_chars"] == [0, n]
    words = [f"w{k}" for k in range(7)]
    got = measured(" ".join([one, *words, other, *words]), " ".join([one, *words, one, *words]))
    assert got["n_repeat_words"] == [0, 16]


@pytest.mark.parametrize("kept", [0, 3])
def test_hashes_that_are_forced_to_collide(monkeypatch, kept):
    monkeypatch.setattr(hashing, "mix", lambda x: x & np.uint64(kept))
    r = random.Random(1)
    texts = ["".join(r.choice(["ab ", "c ", "d\n", "é "]) for _ in range(120)) for _ in range(8)] + ["", "a b c d e f g h a b c d e f g h"]
    got = measured(*texts)
    assert list(zip(got["n_dup_lines"], got["n_repeat_words"])) == [plain(t) for t in texts]


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh\xff"])
def test_multikey_quicksort(letters):
    r = random.Random(letters)
    text = "".join(r.choice(letters) for _ in range(900)).encode("latin-1") + b"x" * 100
    start = np.array(r.sample(range(900), 600))
    group = np.array([r.randrange(3) for _ in start])
    order, part = suffix_dedup.multikey_quicksort(np.frombuffer(text, np.uint8), start, group)
    want = {}
    for k, (s, g) in enumerate(zip(start.tolist(), group.tolist())):
        want.setdefault((g, text[s : s + suffix_dedup.SHALLOW]), set()).add(k)
    found = {}
    for k, p in zip(order.tolist(), part.tolist()):
        found.setdefault(p, set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    inner = [p for p, _ in zip(part.tolist(), order)]
    assert all(a == b or a not in inner[k + 1 :] for k, (a, b) in enumerate(zip(inner, inner[1:])))  # parts lie together
