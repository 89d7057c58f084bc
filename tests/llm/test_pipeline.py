import inspect

import corpus_pipeline
import pyarrow as pa

from recordloom.llm import quality_rules, resampling

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    from recordloom.llm.common import stored

    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs, _ = stored(step(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns and docs.schema == before.schema
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            seen.append(docs.count())
        else:
            assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(docs.columns)
            assert docs.select("doc_id").distinct().count() == seen[-1]
    assert seen[1] < seen[0] and seen == sorted(seen, reverse=True)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.where("length <= 0 OR offset < 0").count() == 0


BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_to_workers_are_bounded_by_bytes(spark, monkeypatch):
    """Fewer rows than Spark's own bound, 12 MB of texts: once they were one batch."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    monkeypatch.setattr(quality_rules, "map_rows", lambda df, run: df.mapInArrow(sizes, "rows long, bytes long"))
    spark.conf.unset(BOUND)
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 800) AS text")
    got = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, SF).collect()
    assert sum(x.rows for x in got) == 3000
    assert max(x.bytes for x in got) < 3 << 20


def test_a_bound_of_the_session_is_kept_and_changes_no_weight(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    spark.conf.unset(BOUND)
    want = sorted(map(tuple, resampling.resample(docs, labels).collect()))
    spark.conf.set(BOUND, "3000")
    try:
        kept = dict(corpus_pipeline.STAGES)["quality_classifier"](spark, docs, SF)
        assert spark.conf.get(BOUND) == "3000"
        assert sorted(map(tuple, resampling.resample(docs, labels).collect())) == want
        assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == [x[0] for x in want if x[3]]
    finally:
        spark.conf.unset(BOUND)
