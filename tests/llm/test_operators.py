"""Each operator against brute force or its SQL, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import chat_format, packing, quality_rules, registry, resampling, sentencepiece_nbest, sharding, simhash, suffix_dedup, topk_search, url_filter
from recordloom.llm.common import numbered, pick, scratch

SF = "/root/testdata/sf0.001"


def words(r, n, letters="abcdé"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n))


def odd_documents(seed=5, n=120):
    """Texts that are null, empty, blank, very long, repeated, near copies, or share passages; repeated rows and ids."""
    r = random.Random(seed)
    base = [words(r, r.randint(5, 150)) for _ in range(15)]
    rows = [(None, base[0]), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a" * 700), (5, "ab " * 400), (6, words(r, 30_000)), (7, "\u00a0\u2028 x\u0085y " * 9)]
    for k in range(10, n):
        p = r.random()
        t = r.choice(base)
        if p < 0.3:
            t = t[r.randint(0, 200) :] + " " + words(r, 3) + r.choice(base)[: r.randint(0, 300)]
        elif p < 0.6:
            w = t.split()
            w[r.randrange(len(w))] = "XX"
            t = " ".join(w)
        rows.append((k, t))
    rows += [rows[20], rows[20], (30, words(r, 40)), (30, base[1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With other columns of clashing names."""
    rows = [(i, t, "x", 1, 2, 3.0, "T") for i, t in odd_documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, id long, key long, `n.chars` double, Text string").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_operator_is_registered():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11)) and set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    order = [want.columns.index(c) for c in names]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, (tuple(r[k] for k in order) for r in want.fetchall())))


# 1


def small_pieces():
    rows = [(k, p, -float(k % 7 + 1)) for k, p in enumerate(["▁", "▁▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "▁b", "cab"])]
    return sentencepiece_nbest.Pieces.of(rows, {1000 + b: b for b in range(256)})


def test_n_best_is_exact():
    r, p = random.Random(3), small_pieces()

    def every(s):
        if not s:
            return [(0.0, ())]
        out = [(e[0] + x, e[1] + y) for j in range(1, len(s) + 1) if (e := p.entry.get(s[:j], 0)) for x, y in every(s[j:])]
        if not p.entry.get(s[0], 0):
            out += [(p.unknown + x, tuple(p.byte_id[b] for b in s[0].encode()) + y) for x, y in every(s[1:])]
        return out

    for _ in range(400):
        t = "".join(r.choice("abc é\n") for _ in range(r.randint(1, 9)))
        found = every("▁" + t.replace(" ", "▁"))
        ids, _, (best,) = p.segmentations([t], 4)
        full = [tuple(sentencepiece_nbest.edited(ids.tolist(), e)) for _, e in best]
        assert [s for s, _ in best] == sorted((s for s, _ in found), reverse=True)[:4]
        assert len(set(full)) == len(full) and all(dict((y, x) for x, y in found)[f] == s for f, (s, _) in zip(full, best))
        assert p.decode(ids.tolist()) == t


def test_words_together_are_as_alone():
    p = sentencepiece_nbest.loaded(sentencepiece_nbest.model_path())
    r = random.Random(1)
    some = {"▁" + words(r, 1, "etaoinshrdluéßñ.,-0129Ab") for _ in range(2000)} | {"▁", "▁▁▁", "▁" + "x" * 60, "▁漢字", "▁🙂", "\n"}
    p.forget()
    some = list(some)
    number = p.numbers(some[:900] + some)[900:]  # in two goes
    assert all((p.flat[p.start[k] : p.start[k] + p.count[k]].tolist(), p.score[k], p.loss[k]) == p.word(w) for k, w in zip(number, some))
    assert p.numbers(some).tolist() == number.tolist()


def test_encoding_and_decoding(spark, docs, none):
    got = sentencepiece_nbest.encode(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    for r in rows:
        assert r.n_pieces == len(r.ids) and all(a.score >= b.score for a, b in zip(r.nbest, r.nbest[1:]))
        assert (r.nbest[0].score == r.score and not r.nbest[0].edits) if r.ids else (r.score is None and not r.nbest)
    back = sorted((r.doc_id or -1, r.text) for r in sentencepiece_nbest.decode(got).collect())
    assert back == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert sentencepiece_nbest.encode(none).count() == 0
    query = sentencepiece_nbest.op1_sentencepiece(spark, SF)
    assert query.where("round_trip AND size(nbest) = 4").count() == query.count() == 200


# 2


def brute_dedup(rows, length=100):
    seen, out = set(), {}
    for i, h, t in sorted({(-(2**63) if i is None else i, h, t or "") for i, h, t in rows}):
        b = t.encode()
        edges = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                edges[p] += 1
                edges[p + length] -= 1
            seen.add(b[p : p + length])
        gone = np.cumsum(edges[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i, t] = (len(b), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [2, 20_000])
def test_suffix_dedup(spark, docs, none, most):
    hashed = {(r.doc_id, r.text): r.h for r in pick(docs, doc_id="doc_id", text="text").withColumn("h", F.hash(F.coalesce("text", F.lit("")))).collect()}
    want = brute_dedup([(i, h, t) for (i, t), h in hashed.items()])
    got = suffix_dedup.dedup(docs, most_spans=most).collect()
    assert len(got) == docs.count()
    text_of = {}
    for (i, t), v in want.items():
        text_of.setdefault(i, set()).add(v)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in text_of[-(2**63) if r.doc_id is None else r.doc_id]
    assert suffix_dedup.dedup(none).count() == 0


def test_suffix_dedup_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute_dedup([(r.doc_id, 0, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op2_suffix_dedup(spark, SF).collect()}
    assert got == {i: v for (i, _), v in want.items()}


def test_long_texts_come_in_pieces(monkeypatch):
    r = np.random.default_rng(2)
    raw, off = r.integers(97, 100, 9000).astype(np.uint8), np.array([0, 4000, 9000])
    whole = suffix_dedup.owned(raw, off)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    seen = set()
    for a, b, part, cuts, lo in suffix_dedup.pieces(raw, off):
        for _, _, row, p, n in zip(*suffix_dedup.owned(part, cuts)):
            seen.update((a + row, lo + p + k) for k in range(n))
    assert seen == {(row, p + k) for _, _, row, p, n in zip(*whole) for k in range(n)} and len(seen) == 9000 - 2 * 99


def test_blind_tries_order_suffixes():
    r = random.Random(4)
    text = "".join(r.choice("ab") for _ in range(40)) * 12 + "".join(r.choice("ab") for _ in range(400))
    data, starts = text.encode(), list(range(len(text) - 100))
    trie = suffix_dedup.BlindTrie(data, 0, starts[0], 0)
    for k in starts[1:]:
        trie.add(k, k)
    leaves = [data[m[0][1] : m[0][1] + 100] for m in trie.leaves()]
    assert leaves == sorted({data[k : k + 100] for k in starts})


# 3


def test_resampling(spark, none):
    r = random.Random(0)
    good, bad = [words(r, 1, "etaoin") for _ in range(300)], ["moron", "idiot", "clown"]
    rows, labels = [], []
    for i in range(1500):
        w = [r.choice(good) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            w[::9] = [r.choice(bad) for _ in w[::9]]
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = resampling.resample(df, lab).collect()
    held = [x for x in got if x.doc_id % 2 == 0]
    assert np.mean([x.selected == (x.doc_id % 5 != 0) for x in held]) > 0.97
    chosen = sorted((-x.gumbel_key, x.doc_id) for x in got)[: sum(x.selected for x in got)]
    assert {i for _, i in chosen} == {x.doc_id for x in got if x.selected}
    assert resampling.resample(none, lab).count() == 0
    assert resampling.resample(df, lab.limit(0)).where("NOT selected").count() == 0


def test_resampling_of_odd_rows(spark, docs):
    lab = spark.createDataFrame([(11, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    got = resampling.resample(docs, lab)
    assert got.count() == docs.count() and got.where("log_weight IS NULL OR selected IS NULL").count() == 0


@pytest.mark.parametrize("k", [1, 2, 5, 9, 10])
def test_largest(spark, k):
    values = [5, 5, 5, -(2**40), 2**40, 0, 1, 5, -3, 7]
    got = resampling.largest(spark.createDataFrame([(v,) for v in values], "x long"), "x", k)
    want = sorted(values, reverse=True)[k - 1]
    assert got == (want, sum(v > want for v in values))


# 4


def test_quality_rules(docs, none):
    con = duckdb.connect()
    con.register("documents", pick(docs, doc_id="doc_id", text="text").toPandas())
    got = quality_rules.repetition_measures(docs).withColumn("base_failed", quality_rules.base_failed()).withColumn("kept", quality_rules.verdict())
    want = con.sql(quality_rules.ORACLE)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(None if r[k] != r[k] else int(r[k]) if got.columns[j] == "doc_id" and r[k] is not None else r[k] for j, k in enumerate(order))) for r in want.fetchall())
    assert quality_rules.repetition_measures(none).count() == 0
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


# 5


def test_escapes_are_reversible():
    r = random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "/s>", "/INST]", "INST]", " ", "x", "\n"]
    for _ in range(3000):
        t, role = ("".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(2))
        out = chat_format.render_turn(role, t)
        assert [x[:2] for x in chat_format.parse(out)] == [(role, t)] and chat_format.unescape(chat_format.escape(t)) == t
    for bad in ("x", "<s>a[INST]b", "<s>a[INST]b[/INST]</s>x"):
        with pytest.raises(ValueError):
            list(chat_format.parse(bad))


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 0, None, None), (2, None, "assistant", None), (2, 0, "assistant", "</s>[INST]"), (3, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*x, "y", "z") for x in rows], "conv_id long, turn long, role string, text string, n_turns string, `Role.x` string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert got[1].formatted == "<s>user[INST]a[/INST]</s>" * 2 + "<s>assistant[INST]b[/INST]</s>"
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nassistant\nb\n").hexdigest()
    assert got[2].loss_chars == 10 and [got[2].formatted[a:b] for a, b in got[2].loss_spans] == ["", "<\\/s>[\\INST]"]
    assert got[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[3].formatted_chars == 200_000 + len("<s>user[INST][/INST]</s>")
    for r in got.values():  # the text as a whole parses into the same turns
        assert len(list(chat_format.parse(r.formatted))) == r.n_turns
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# 6


def brute_components(fps):
    """Component of each (id, fingerprint) row over links of at most two bits."""
    distinct = sorted(set(f for _, f in fps))
    low = {f: min(i for i, g in fps if g == f and i is not None) for f in distinct if any(i is not None and g == f for i, g in fps)}
    root = {f: f for f in low}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(low):
        for b in list(low)[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for f in low:
        least[find(f)] = min(least.get(find(f), low[f]), low[f])
    return {f: least[find(f)] for f in low}


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    fps = [(r.doc_id, simhash.fingerprint((r.text or "").encode(), 3)) for r in rows]
    want = brute_components(fps)
    assert sorted(((r.doc_id or -1, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((i or -1, f"{f:016x}", want.get(f)) for i, f in fps), key=str)
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprints_use_sparks_hash(spark):
    text = "The Quick\tbrown FOX é\x0bJumps"
    w = text.encode().lower().split()
    hashes = [spark.sql("SELECT xxhash64(decode(unhex('%s'), 'UTF-8')) AS h" % b" ".join(w[k : k + 3]).hex()).first().h % 2**64 for k in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode(), 3) == want and simhash.fingerprint(b" \n", 3) == 0


def test_links_of_clusters(spark):
    """Chains, balls and far points, with cells of many members."""
    r = random.Random(7)
    fps = set()
    for _ in range(6):
        f = r.getrandbits(64)
        fps.add(f)
        for _ in range(60):
            f ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.add(f)
        fps |= {f ^ (1 << k) for k in range(40)} | {f ^ 0b1111 << k for k in range(0, 60, 4)}
    rows = [(k, f) for k, f in enumerate(sorted(fps))]
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, f - 2**64 if f >= 2**63 else f) for _, f in rows], "id long, f0 long")
    roots = {x.u: x.root for x in simhash.components(simhash.links(nodes, simhash.WHOLE, ["f0"], lambda a, b: F.expr(f"bit_count({a}f0 ^ {b}f0) <= 2"))).collect()}
    want = brute_components(rows)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    groups, got = {}, {}
    for k, f in rows:
        groups.setdefault(want[f], set()).add(k)
        got.setdefault(roots.get(signed(f), signed(f)), set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_hub_and_a_chain(spark):
    """A hub with more neighbours than a key's parts, a chain, and a node without links."""
    hub = [(k, 5) for k in range(6, 1500)]
    chain = [(k + 1, k) for k in range(2000, 2040)]
    edges = spark.createDataFrame(hub + chain + [(2020, 9)], "u long, v long")
    found = simhash.components(edges)
    roots = {x.u: x.root for x in found.collect()}
    assert roots == {k: 5 for k in [*range(6, 1500), *range(2000, 2041)]}
    nodes = spark.createDataFrame([(k, 7000 - k) for k in [3, 5, *roots]], "id long, low long")
    lows = {x.id: x.component_id for x in simhash.lowest(nodes, "id", found).collect()}
    assert lows == {3: 6997, **{k: 7000 - 2040 for k in [5, *roots]}}


def test_near_copies(spark):
    r = random.Random(9)
    rows, groups = [], []
    for _ in range(12):
        w = words(r, 120).split()
        group = []
        for _ in range(6):
            v = list(w)
            if group and r.random() < 0.7:
                v[r.randrange(120)] = "ZZ"
            group.append(len(rows))
            rows.append((len(rows), " ".join(v)))
        groups.append(group)
    docs = spark.createDataFrame([*rows, rows[3], (None, rows[0][1]), (None, None), (500, None)], "doc_id long, text string")
    kept = sorted((x.doc_id if x.doc_id is not None else -1) for x in simhash.stage(spark, docs, SF).collect())
    assert kept == sorted([g[0] for g in groups] + [-1, -1, 500])


# 7


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = sorted(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in docs.collect())
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length and r.length > 0
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0 and all(r.context == at for r in own)
    by_size = {}
    for r in rows:
        by_size.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(len(r.ids) for r in rows) == sum(map(len, want))
    single = [(k, v) for k, v in by_size.items() if sum(r.length for r in v) == k[1]]
    assert len(single) > 90
    have = [b"".join(bytes(r.ids) for r in sorted(v, key=lambda r: r.start)) for _, v in single]
    assert set(have) <= set(want)
    groups = {}
    for own in by_sequence.values():
        groups[own[0].step_group] = groups.get(own[0].step_group, 0) + own[0].context
    assert max(groups.values()) <= packing.STEP_TOKENS
    assert packing.pack_documents(none).count() == 0
    r = packing.digest(packing.pack_documents(docs)).first()
    assert r.ids_crc32 >= 0


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(packing.vocabulary_path()), packing.word_ids(packing.vocabulary_path())
    r = random.Random(1)
    letters = [*"abzAZ019.,'!?-éÉßÀñµª²½×÷ÿŒœİıΣσς\u0301\u00a0\u00ad\x1f\t\r<|>#你好한글ﬁ’“🙂 \n", "<|endoftext|>", "'ll", "'S"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packer_leaves_little_cut():
    r, p, seen = random.Random(3), packing.Packer(0), {}
    sizes = [r.choice([1, 5, 200, 255, 256, 257, 700, 1023, 1500, 2047, 2048, 2049, 9000]) for _ in range(800)]
    out = [row for k, n in enumerate(sizes) for s in p.add(k, np.arange(n, dtype="<u4").tobytes()) for row in s] + [row for s in p.finish() for row in s]
    for row in out:
        seen.setdefault(row[0], []).append(row)
    for k, n in enumerate(sizes):
        assert b"".join(x[3] for x in sorted(seen[k], key=lambda x: x[1])) == np.arange(n, dtype="<u4").tobytes()
    assert len(out) < 2.2 * sum(-(-n // 2048) for n in sizes)


# 8


def test_sharding(spark, docs, none):
    docs = docs.select("*", F.lit("t").alias("run"), F.lit("f").alias("file"), F.lit("r").alias(sharding.RUN), F.lit(None).cast("string").alias("schema"))
    store = sharding.ShardStore(spark, scratch(spark, "test-shards"))
    parts = [numbered(docs).where(F.coalesce(F.pmod(F.hash("c0"), F.lit(3)), F.lit(0)) == k).toDF(*docs.columns) for k in range(3)]
    for part in parts:
        store.append(part)
    before = store.manifest()
    assert store.versions() == [1, 2, 3] and before.agg(F.sum("rows")).first()[0] == docs.count()
    old = store.manifest(1).count()
    assert store.compact() == 4 and store.manifest(1).count() == old
    assert store.manifest().count() < before.count() and store.compact() == 4
    store.expire(0)
    got = store.rows()
    assert got.columns == docs.columns and "Text" in docs.columns and "text" in docs.columns
    assert numbered(got).exceptAll(numbered(docs)).count() == 0 and got.count() == docs.count()
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(), docs.schema, 4)
    assert store.versions() == [1, 2, 3, 4]
    empty = sharding.shard(none, scratch(spark, "test-shards"))
    assert empty.rows().columns == none.columns and empty.rows().count() == 0 and empty.manifest().count() == 0


def test_sharding_query(spark):
    got = sharding.op8_sharding(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))
    assert got.exceptAll(docs).count() == 0 and got.count() == docs.count()


def test_which_shards_merge(spark, monkeypatch):
    """Against a plain model: shards of a tier in the order of their names, cut where their sizes reach the target."""
    monkeypatch.setattr(sharding, "TARGET", 5000)
    r = random.Random(8)
    live = [(f"arrivals-{r.randrange(10**9):x}/p{k}", "r", 1, r.choice([0, 1, 3, 5, 70, 300, 900, 1023, 1024, 1500, 4999, 5000, 9000])) for k in range(300)]
    store = sharding.ShardStore(spark, scratch(spark, "test-shards"))
    got = store.plan(spark.createDataFrame(live, "file string, run string, rows long, bytes long")).collect()
    runs, sums = {}, Counter()
    for file, _, _, size in sorted(live):
        if size < 5000:
            tier = math.floor(math.log(max(size, 1)) / math.log(4))
            runs.setdefault((tier, sums[tier] // 5000), []).append(file)
            sums[tier] += size
    want = sorted(sorted(v) for v in runs.values() if len(v) > 1)
    found = {}
    for x in got:
        found.setdefault(x.run, []).append(x.file)
    assert sorted(sorted(v) for v in found.values()) == want and len(want) > 5
    assert sorted({x.place for x in got}) == list(range(len(want)))
    monkeypatch.setattr(sharding, "PLANNED", 20)
    parted = store.plan(spark.createDataFrame(live, "file string, run string, rows long, bytes long")).collect()
    assert sorted({x.place for x in parted}) == list(range(len({x.run for x in parted}))) and len({x.run.split("-")[1] for x in parted}) > 5


def test_tiers_are_merged_step_by_step(spark):
    """Three small shards make one of the next tier, which meets others of its size; sizes grow to the target and stay there."""
    store = sharding.ShardStore(spark, scratch(spark, "test-shards"))
    rows = lambda k, n: spark.range(n).select((F.col("id") + k * 10**6).alias("doc_id"), F.sha2(F.concat(F.col("id"), F.lit(f"-{k}")), 512).alias("text")).coalesce(1)
    for k in range(6):
        store.append(rows(k, 1500))
        store.settle(0)
    sizes = sorted(x.bytes for x in store.manifest().collect())
    tiers = [math.floor(math.log(x, 4)) for x in sizes]
    assert len(set(tiers)) == len(tiers) and store.rows().select("doc_id").distinct().count() == 9000 == store.rows().count()


def test_a_store_after_a_lost_writer(spark):
    base = scratch(spark, "test-shards")
    store, rows = sharding.ShardStore(spark, base), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    store.append(rows)
    rows.toDF("c0", "c1").write.parquet(f"{base}/data/arrivals-{'0' * 32}")  # written, never committed
    rows.write.parquet(f"{base}/manifest/_aside-x")
    store.append(rows)
    assert store.rows().count() == 2
    store.expire()  # what is young may still be committed
    assert spark.read.parquet(f"{base}/data/arrivals-{'0' * 32}").count() == 1
    store.expire(0)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{base}/data/arrivals-{'0' * 32}")
    assert store.rows().count() == 2 and store.versions() == [1, 2]
    # another writer takes the version that an append was about to commit
    commit, raced = store.commit, []

    def slow(live, schema, version):
        if not raced:
            raced.append(version)
            sharding.ShardStore(spark, base).append(rows)
        commit(live, schema, version)

    store.commit = slow
    assert store.append(rows) == 4 and store.rows().count() == 4


# 9


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/x?y#z", "http://com/", "http://com", "x://a.net/es/", "x://net/fr/?", "x://anet/es/", "http://example.com/en", "a://b://c.com/en/", "http://u@example.com:80/en/", "http://example.com./en/", "http://É.com/\n/x", "http://www.example.com/en/#", "http://m.www.example.com/en/a"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    rows = [(k % 15, u) for k, u in enumerate(urls)] * 2
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    got = url_filter.filter_urls(spark.createDataFrame([(*x, "h", "r") for x in rows], "page_id long, url string, host string, rule string"))
    want = con.sql(url_filter.ORACLE)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rule_precedence(spark):
    R = url_filter.Rule
    rules = [R("block", "a.com", "/x"), R("allow", "a.com", "/x"), R("allow", "b.a.com", "/"), R("block", "COM", "/long/path/here")]
    df = spark.createDataFrame([(0, "http://a.com/xyz"), (1, "http://b.a.com/xyz"), (2, "http://b.a.com/long/path/here/"), (3, "http://c.org/")], "page_id long, url string")
    want = {0: ("a.com/x", "block"), 1: ("b.a.com/", "allow"), 2: ("com/long/path/here", "block"), 3: (None, "block")}
    for limit in (url_filter.MOST_IN_ROW, 0):  # within the row, and by a shuffle
        got = url_filter.filter_urls(df, rules, default="block", most_in_row=limit)
        assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want


def test_rules_need_no_shuffle(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert "Exchange" not in url_filter.filter_urls(pages)._jdf.queryExecution().executedPlan().toString()
    both = [sorted(map(tuple, url_filter.filter_urls(pages, most_in_row=n).collect()), key=str) for n in (5, 0)]
    assert both[0] == both[1] and len(both[0]) == pages.count()


# 10


def test_top_k(spark):
    r = np.random.default_rng(0)
    rows = [(int(k), [float(x) for x in r.normal(size=6)]) for k in range(260)]
    rows += [(300, rows[50][1]), (301, rows[50][1]), (302, rows[50][1]), (302, rows[50][1]), (303, None), (304, [1.0, None]), (305, [float("nan")] * 6), (306, [float("inf")] * 6), (350, [1e30] * 6), (307, [-2e29, 5.0]), (308, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<float>, rank int")
    got = [tuple(x) for x in topk_search.top_k(df).orderBy("query_id", "rank").collect()]
    vecs = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vecs.append((i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    want = []
    for at, (q, own) in enumerate(vecs):
        if q % 50 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v)))), i) for k, (i, v) in enumerate(vecs) if k != at)
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s[:5])]
    want.sort()
    assert got == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk_search.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk_search.top_k(few.limit(0)).count() == 0


def test_top_k_of_many_shards(spark, monkeypatch):
    """Clustered vectors in small shards, a third of them one vector: blocks go only to shards that their bounds reach."""
    monkeypatch.setattr(topk_search, "SHARD", 64)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    r = np.random.default_rng(2)
    points = np.concatenate([c + r.normal(size=(60, 5)) for c in r.normal(size=(16, 5)) * 60] + [np.tile(r.normal(size=5) * 60, (400, 1))]).astype(np.float32)
    df = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(points)], "vec_id long, embedding array<float>").repartition(4)
    got = topk_search.top_k(df)
    whole = np.floor(256 * points.astype(np.float64))
    want = []
    for q in range(0, len(points), 50):
        s = sorted((-int(x), i) for i, x in enumerate(whole @ whole[q]) if i != q)
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s[:5])]
    assert sorted(map(tuple, got.collect())) == want
    space = topk_search.Space(whole, len(points) // 64)
    cells = space.cell(whole)
    assert len(space.shares) > 8 and abs(sum(space.shares) - 1) < 1e-9 and (np.bincount(cells) / len(cells) == np.array(space.shares)).all()


def test_top_k_prunes_and_shares(monkeypatch):
    """Over clustered points most leaves are passed over, and a shared kth score passes over more."""
    r = np.random.default_rng(1)
    centers = r.normal(size=(40, 8)) * 4000
    points = np.floor(np.concatenate([c + r.normal(size=(100, 8)) * 50 for c in centers]))
    tree = topk_search.ball_tree(np.arange(len(points)), points)
    counted = []
    monkeypatch.setattr(topk_search, "scores", lambda q, p, f=topk_search.scores: counted.append(q.shape[0] * p.shape[0]) or f(q, p))

    def block(kth):
        return {"ids": np.array([-1, -2]), "queries": points[[5, 3000]], "best": [[], []], "kth": np.array(kth, np.int64)}

    first = block([topk_search.LOW] * 2)
    topk_search.search(tree, first, 5)
    alone = sum(counted)
    counted.clear()
    again = block(first["kth"])
    topk_search.search(tree, again, 5)
    assert alone < 0.3 * 2 * len(points) and sum(counted) <= alone
    want = [sorted((-int(s), k) for k, s in enumerate(points @ q))[:5] for q in points[[5, 3000]]]
    assert first["best"] == want and again["best"] == want
