"""Tables at the edge of what the operators take: empty ones, and ids that repeat."""

from pyspark.sql import functions as F

from recordloom.llm import sharding, topk_search


def test_sharding_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op8_sharding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "text_md5"] and got.count() == 0


def test_rows_after_an_empty_append(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    store.expire()
    store.append(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"))
    store.expire()
    assert sorted(x.doc_id for x in store.rows().select(F.col("doc_id")).collect()) == [1, 2]


def test_top_k_of_vectors_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=9)
    whole = [[int(256 * x) for x in v] for _, v in rows]
    want = []
    for at in (0, 1):
        pairs = sorted((-sum(a * b for a, b in zip(whole[at], v)), rows[k][0]) for k, v in enumerate(whole) if k != at)
        want += [(0, n + 1, i, -s) for n, (s, i) in enumerate(pairs)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
