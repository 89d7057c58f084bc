import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from recordloom import api
from recordloom import value as V
from recordloom.plans import queries as plans
from recordloom.plans.formats import spread

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(want.columns) == names
    order = [want.columns.index(c) for c in names]
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


@pytest.mark.parametrize("fmt", ["json", "cbor", "messagepack", "yaml", "avro"])
def test_files_through_each_format(spark, tmp_path, fmt):
    records = [(f"f{i}", p, V.to_envelope(("m", [(("s", "b"), ("i64", -i)), (("s", "a"), ("s", f"x{p}\n"))]))) for i in range(1, 4) for p in range(20)]
    df = spark.createDataFrame(records, "src string, pos long, value string").repartition(3)
    options = {"schema": '{"type":"record","name":"r","fields":[{"name":"b","type":"long"},{"name":"a","type":"string"}]}', "codec": "snappy"} if fmt == "avro" else {}
    api.write_records(df, fmt, str(tmp_path / "out"), **options)
    back = api.read_records(spark, fmt, str(tmp_path / "out"))
    # widths of integers are the format's: text shows the records alike
    assert [V.display(V.from_envelope(r.value)) for r in back.orderBy("src", "pos").collect()] == [V.display(V.from_envelope(r[2])) for r in records]
    typed = api.decode(back, "a string, b int")
    assert typed.groupBy("b").count().where("count = 20").count() == 3


def test_transcoding_and_folders(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text('h1,h2\n"x\ny",2\n')
    (source / "b.csv").write_text("1,é\n")
    api.transcode(spark, "csv", str(source), "json", str(tmp_path / "json"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*")))
    assert text == '["h1","h2"]\n["x\\ny","2"]\n["1","é"]\n'
    assert not list((tmp_path / "json").glob("_aside*/*"))
    api.transcode(spark, "json", str(tmp_path / "json" / "part-*"), "csv", str(tmp_path / "csv"))
    assert api.read_csv_rows(spark, str(tmp_path / "csv"), 2).where("_c0 = 'x\ny'").count() == 1
    api.write_records(api.read_records(spark, "csv", str(source)).limit(1), "json", str(tmp_path / "json"), mode="overwrite")
    assert len(list((tmp_path / "json").glob("part-*"))) == 1


def test_errors_fail_the_job_and_leave_no_file(spark, tmp_path):
    (tmp_path / "bad.json").write_text("1 {")
    with pytest.raises(PythonException):
        api.read_records(spark, "json", str(tmp_path / "bad.json")).collect()
    df = spark.createDataFrame([("f", 0, V.to_envelope(("s", "x"))), ("f", 1, V.to_envelope(V.UNIT))], "src string, pos long, value string")
    with pytest.raises(Exception, match="line can't hold"):
        api.write_records(df, "raw", str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("part-*"))
    with pytest.raises(api.EngineError):
        api.write_records(df, "protobuf", str(tmp_path / "out"))


def test_native_readers(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes(b"a\r\nb\rc\n\r\r\n")
    assert [r.value for r in api.read_raw_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b\rc", "\r"]
    (tmp_path / "bad.txt").write_bytes(b"\xff\n")
    with pytest.raises(Exception, match="UTF-8"):
        api.read_raw_lines(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "c.csv").write_bytes(b'a,\n"",b""c\n"x\ny","q""r"\n')
    assert [tuple(r) for r in api.read_csv_rows(spark, str(tmp_path / "c.csv"), 2).collect()] == [("a", ""), ("", 'b""c'), ("x\ny", 'q"r')]
    for text in (b"a,b\n1\n", b"a,b\n1,2,3\n"):
        (tmp_path / "r.csv").write_bytes(text)
        with pytest.raises(Exception, match="cells wide"):
            api.read_csv_rows(spark, str(tmp_path / "r.csv"), 2).collect()
    (tmp_path / "j.json").write_text('{"a":1}\n{"a":2}\n')
    assert api.read_json_lines(spark, str(tmp_path / "j.json"), "a int").agg(F.sum("a")).first()[0] == 3
    (tmp_path / "k.json").write_text('{"a":1}\nx\n')
    with pytest.raises(Exception):
        api.read_json_lines(spark, str(tmp_path / "k.json"), "a int").collect()


def test_functions(spark):
    df = spark.createDataFrame([(V.to_envelope(("q", [V.UNIT, ("u8", 1)])),), (None,)], "value string")
    assert [tuple(r) for r in df.select(api.display("value"), api.to_json("value"), api.kind("value")).collect()] == [("[(), 1]", "[null,1]", "q"), (None, None, None)]


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"k":1} {"k":2}')
    records = api.stream_records(spark, "json", str(source))
    query = api.stream_transcode(records, "messagepack", str(tmp_path / "out"), str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        (source / "b.json").write_text('{"k":3}')
        query.processAllAvailable()
    finally:
        query.stop()
    back = api.decode(api.read_records(spark, "messagepack", str(tmp_path / "out" / "batch-*")), "k int")
    assert sorted(r.k for r in back.collect()) == [1, 2, 3]


def test_projection_reaches_the_scan(spark):
    plan = api.encode_rows(plans.table(spark, SF, "lineitem").select("l_orderkey"), "cbor")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_the_entry_works_without_the_llm_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "recordloom").mkdir()
    for p in (root / "recordloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "recordloom" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) == set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    assert importlib.util.find_spec("recordloom.plans")


def test_parts_of_a_file_share_tasks_and_keep_their_places(spark, tmp_path):
    lines = [f"line {k}" for k in range(2_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("x\n")
    rows = api.read_records(spark, "raw", str(tmp_path), split_bytes=10)
    assert rows.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    got = [(r.pos, V.from_envelope(r.value)[1]) for r in rows.where("src like '%a.txt'").orderBy("pos").collect()]
    assert [t for _, t in got] == lines and [p for p, _ in got][:3] == [0, 7, 14]
    assert rows.count() == 2_001
    (tmp_path / "none").mkdir()
    assert api.read_records(spark, "raw", str(tmp_path / "none"), split_bytes=10).count() == 0


def test_a_table_of_one_row_group_is_dealt_out_however_many_splits_it_has(spark, tmp_path):
    spark.range(200_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")  # many splits, one of which holds the rows
    try:
        rows = spark.read.parquet(str(tmp_path / "t"))
        assert rows.rdd.getNumPartitions() >= 4
        assert max(len(p) for p in spread(rows).rdd.glom().collect()) < 100_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    even = spark.range(1000).repartition(4)
    assert spread(even) is even


def test_blocks_and_batches_are_bounded_by_bytes(spark):
    rows = spark.range(64).coalesce(1).select("id", F.expr("cast(repeat('x', 500000) as binary)").alias("text"))
    for fmt, options in (("cbor", {"byte_strings": True}), ("messagepack", {})):
        blocks = api.encode_rows(rows, fmt, **options)
        assert max(r[0] for r in blocks.select(F.length("block")).collect()) < 3_000_000
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"]) for b in batches)
        assert max(r["size"] for r in blocks.mapInArrow(sizes, "size long, n long").collect()) < 8_000_000
        back = api.decode_blocks(blocks, fmt, rows.schema)
        assert max(r["size"] for r in back.mapInArrow(sizes, "size long, n long").collect()) < 8_000_000
        assert back.select("id", F.length("text")).distinct().count() == 64
