"""Queries that go through files, the registry, the command line and single functions, each with the SQL that gives the same rows."""

from __future__ import annotations

import io
import tempfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli, registry
from ..codecs import avro, decoder, protobuf, raw
from ..functions import values
from ..operators.transcode import decode, decode_blocks, encode, encode_rows, transcode
from ..shared import scratch
from ..sinks.records import write_records
from ..sources.records import read_records

#: The ANSI styles of readable JSON output, as SQL sees them.
BOLD, QUOTE, CHARS, KEY_QUOTE, KEY_CHARS, NUMBER = "1", "2;32", "32", "2;34", "34", "34"

#: Rows of a piece of a table that is dealt out.
DEALT = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table whose largest piece holds more than twice its share of the rows, such as one row group however many splits its file
    has, is dealt out by rows; others are not shuffled. The rows are counted by Parquet's footers."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("piece")).count().collect()]
    share = sum(counts) / cores
    return rows.repartition(max(cores, sum(counts) // DEALT)) if counts and max(counts) > 2 * share else rows


def through_files(name: str, fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    """A table written as files of records by the sink, and read again by the source."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, path = spread(table(spark, sf_dir, name)), scratch(spark, f"files-{fmt}")
        options = {"schema": avro.schema_of(encodable(rows).schema), "codec": "deflate"} if fmt == "avro" else {}
        write_records(encode(rows), fmt, path, **options)
        return decode(read_records(spark, fmt, path), rows.schema)

    return query


def cells(column: pa.Array) -> list:
    """A column's cells; those of numbers by numpy, which is faster."""
    return column.to_pylist() if column.null_count or pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def encodable(rows: DataFrame) -> DataFrame:
    """Times as text, as records hold them."""
    return rows.select([F.col(c).cast("string").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in rows.dtypes])


def strings(rows: DataFrame, column: str) -> DataFrame:
    """src, pos, value: one string a record."""
    return rows.select(F.lit("one").alias("src"), F.monotonically_increasing_id().alias("pos"), F.to_json(F.array(F.lit("s"), F.col(column))).alias("value"))


def file_raw_roundtrip_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "files-raw")
    write_records(strings(table(spark, sf_dir, "nation"), "n_name"), "raw", path)
    return read_records(spark, "raw", path).select(values.display("value").alias("n_name"))


def file_raw_split_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files that are entered in their middle."""
    path = scratch(spark, "files-raw")
    write_records(strings(spread(table(spark, sf_dir, "customer").select("c_name")), "c_name"), "raw", path)
    return read_records(spark, "raw", path, split_bytes=1000).select(values.display("value").alias("c_name"))


def file_avro_split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avro files that are entered at their sync markers."""
    rows, path = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")), scratch(spark, "files-avro")
    write_records(encode(rows), "avro", path, schema=avro.schema_of(rows.schema), codec="snappy")
    return decode(read_records(spark, "avro", path, split_bytes=50_000), rows.schema)


def file_csv_roundtrip_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "nation"), scratch(spark, "files-csv")
    cells = F.to_json(F.array(F.lit("i32"), F.col("n_nationkey").cast("string"))), F.to_json(F.array(F.lit("s"), F.col("n_name"))), F.to_json(F.array(F.lit("i32"), F.col("n_regionkey").cast("string")))
    write_records(rows.select(F.lit("one").alias("src"), F.col("n_nationkey").cast("long").alias("pos"), F.format_string('["q",[%s,%s,%s]]', *cells).alias("value")), "csv", path)
    return decode(read_records(spark, "csv", path), rows.schema)


def file_toml_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TOML file is one document: the table as an array of tables."""
    rows, path = table(spark, sf_dir, "region"), scratch(spark, "files-toml")
    one = rows.coalesce(1).agg(F.collect_list(F.struct("r_regionkey", "r_name")).alias("region"))  # a region is one of five
    write_records(encode(one), "toml", path)
    return decode(read_records(spark, "toml", path), one.schema).select(F.inline("region"))


def transcode_json_to_messagepack_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = spread(table(spark, sf_dir, "customer")), scratch(spark, "files-transcoded")
    write_records(encode(rows), "json", f"{path}/json")
    transcode(spark, "json", f"{path}/json", "messagepack", f"{path}/messagepack")
    return decode(read_records(spark, "messagepack", f"{path}/messagepack"), rows.schema)


def pump_props_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's pump, JSON to CBOR and back, over each batch of texts."""

    def run(batches):
        for batch in batches:
            there, back = io.BytesIO(), io.BytesIO()
            texts = "\n".join(batch.column(0).to_pylist()).encode()
            if cli.main(["-jC"], io.BytesIO(texts), there) or cli.main(["-cJ"], io.BytesIO(there.getvalue()), back):
                raise RuntimeError("the pump stopped")
            yield pa.RecordBatch.from_arrays([pa.array(back.getvalue().decode().splitlines(), pa.string())], names=["line"])

    return spread(table(spark, sf_dir, "events").select("props")).mapInArrow(run, "line string")


def json_styles_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "region"))
    return rows.select(*(values.to_json("value", style).alias(style) for style in ("compact", "indented", "readable")))


def to_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"))
    return encode(rows).select(values.to_json("value").alias("line"))


def csv_cells_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and booleans in cells."""
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("large"))
    return decode_blocks(encode_rows(rows, "csv", rows_as="sequence"), "csv", rows.schema)


def cbor_bytes_roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("text").cast("binary").alias("text"))
    return decode_blocks(encode_rows(rows, "cbor", byte_strings=True), "cbor", rows.schema).select("doc_id", F.col("text").cast("string").alias("text"))


def raw_line_ends_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""Lines that end with \r\n, and a last one without an end."""
    blocks = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("\r\n"), "n_name", F.lit("\r")).cast("binary").alias("block"))

    def run(batches):
        for batch in batches:
            found = [v[1] for block in batch.column(0) for v in raw.decode(block.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["line"])

    return blocks.mapInArrow(run, "line string")


def with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "customer"))
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name")
    key = F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("c_nationkey")
    return rows.select("c_custkey", name, key, F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"))


NULLS = "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM customer"


def nulls(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = with_nulls(spark, sf_dir)
        return decode_blocks(encode_rows(rows, fmt), fmt, rows.schema)

    return query


def null_display_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(with_nulls(spark, sf_dir).select("c_custkey", "c_name", "c_nationkey")).select(values.display("value").alias("text"))


def float_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many 32-bit and 64-bit floats the record of each vector holds."""
    rows = encode(spread(table(spark, sf_dir, "embeddings")).select("vec_id", "embedding", F.col("label").cast("double").alias("label")))
    count = lambda tag: F.size(F.regexp_extract_all("value", F.lit(f'\\["({tag})"'))).cast("long")
    return rows.select(F.regexp_extract("value", r'\["i64","([0-9]+)"\]', 1).cast("long").alias("vec_id"), count("f32").alias("n_f32"), count("f64").alias("n_f64"))


LINE_PROTO = """syntax = "proto3"; package shop;
enum Flag { NONE = 0; A = 1; N = 2; R = 3; }
message Line {
  message Part { int64 key = 1; sint64 supplier = 2; }
  int64 order = 1; Part part = 2; Flag flag = 3; repeated double amounts = 4; map<string, double> rates = 5; oneof when { string shipped = 6; bool open = 7; } sint32 number = 8;
}"""


def protobuf_nested_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, repeated, enumerated and map fields of messages that the public library writes."""
    descriptors = protobuf.link([protobuf.ProtoParser(LINE_PROTO, "line.proto").parse()]).SerializeToString()

    fields = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    flags = {"A": 1, "N": 2, "R": 3}

    def run(batches):
        kind = protobuf.Descriptors(descriptors).message(".shop.Line")
        for batch in batches:
            out = []
            for order, part, supplier, number, quantity, price, discount, tax, flag, status in zip(*map(cells, batch.columns)):
                m = kind(order=order, number=number, shipped=status, flag=flags.get(flag, 0), amounts=(quantity, price))
                m.part.key, m.part.supplier = part, supplier
                rates = m.rates
                rates["tax"], rates["discount"] = tax, discount
                out.append(m.SerializeToString())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["block"])

    blocks = spread(table(spark, sf_dir, "lineitem").select(fields)).mapInArrow(run, "block binary")
    schema = "order long, part struct<key: long, supplier: long>, flag string, amounts array<double>, rates map<string, double>, shipped string, number int"
    rows = decode_blocks(blocks, "protobuf", schema, descriptors=descriptors, message=".shop.Line")
    picked = {"l_orderkey": "order", "l_partkey": "part.key", "l_suppkey": "part.supplier", "l_linenumber": "number", "l_returnflag": "flag", "l_linestatus": "shipped", "l_quantity": "amounts[0]", "l_extendedprice": "amounts[1]", "l_tax": "rates['tax']", "l_discount": "rates['discount']"}
    return rows.select(*(F.expr(e).alias(n) for n, e in picked.items()))


def registry_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A .proto file added to a registry, compiled and cached, and the documented message read by it."""
    with tempfile.TemporaryDirectory() as home:  # a user's folders, on the driver alone
        source = Path(home) / "schemas" / "example" / "person.proto"
        source.parent.mkdir(parents=True)
        source.write_text('syntax = "proto3"; package example; message Person { string name = 1; int32 age = 2; }')
        paths = registry.Paths(env={registry.HOME_VARIABLE: home})
        added = registry.add_file(paths, str(source), str(Path(home) / "schemas"))
        before = registry.is_cache_stale(paths)
        found = registry.compile_descriptor_set(paths)
        after = registry.is_cache_stale(paths)
        file = added.relative_to(paths.data).as_posix()
    blocks = spark.createDataFrame([(bytearray(b"\x0a\x04John\x10\x22"),)], "block binary")
    rows = decode_blocks(blocks, "protobuf", "name string, age int", descriptors=found.data, message=".example.Person")
    return rows.select("name", "age", F.lit(file).alias("file"), F.lit(before).alias("stale_before"), F.lit(after).alias("stale_after"))


#: Input that each format refuses, and the error's name.
REFUSED = [("json", b"1 {", "JsonError"), ("csv", b"a,b\nc\n", "CsvError"), ("raw", b"\xff\n", "RawError"), ("avro", b"Obj", "AvroError"), ("cbor", b"\x82\x01", "Truncated"), ("messagepack", b"\xc1", "MessagePackError"), ("toml", b"a = ", "TomlError"), ("yaml", b"[", "YamlError"), ("xml", b"", "FormatError")]


def errors_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that come before an error, and the error's name."""

    def run(batches):
        for batch in batches:
            out = []
            for fmt, data in zip(*(c.to_pylist() for c in batch.columns)):
                n, name = 0, None
                try:
                    for _ in decoder(fmt)(data):
                        n += 1
                except cli.EngineError as e:
                    name = type(e).__name__
                out.append((fmt, n, name))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["format", "n_records", "error"])

    rows = spark.createDataFrame([(fmt, bytearray(data)) for fmt, data, _ in REFUSED], "format string, data binary").coalesce(1)
    return rows.mapInArrow(run, "format string, n_records long, error string")


FILES = {
    "file_json_roundtrip_orders": ("orders", "json"),
    "file_cbor_roundtrip_customer": ("customer", "cbor"),
    "file_messagepack_roundtrip_supplier": ("supplier", "messagepack"),
    "file_avro_roundtrip_orders": ("orders", "avro"),
    "file_yaml_roundtrip_supplier": ("supplier", "yaml"),
}
NULL_FORMATS = ("json", "cbor", "messagepack", "avro", "yaml")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        file_raw_roundtrip_nation, file_raw_split_customer, file_avro_split_orders, file_csv_roundtrip_nation, file_toml_region, transcode_json_to_messagepack_customer, pump_props_events, json_styles_region, to_json_events,
        csv_cells_part, cbor_bytes_roundtrip_documents, raw_line_ends_nation, null_display_customer, float_kinds, protobuf_nested_lineitem, registry_person, errors_by_format,
    ]
    return {f.__name__: f for f in own} | {k: through_files(t, fmt) for k, (t, fmt) in FILES.items()} | {f"nulls_{fmt}_customer": nulls(fmt) for fmt in NULL_FORMATS}


def _painted(style: str, text: str) -> str:
    return f"chr(27) || '[{style}m' || {text} || chr(27) || '[0m'"


def _readable() -> str:
    key = lambda k: " || ".join([_painted(KEY_QUOTE, "'\"'"), _painted(KEY_CHARS, f"'{k}'"), _painted(KEY_QUOTE, "'\"'"), _painted(BOLD, "': '")])
    number, name = _painted(NUMBER, "r_regionkey"), " || ".join([_painted(QUOTE, "'\"'"), _painted(CHARS, "r_name"), _painted(QUOTE, "'\"'")])
    return " || ".join([_painted(BOLD, "'{'"), "chr(10) || '  '", key("r_regionkey"), number, _painted(BOLD, "','"), "chr(10) || '  '", key("r_name"), name, "chr(10)", _painted(BOLD, "'}'")])


def oracle_sql() -> dict[str, str]:
    return {k: f"SELECT * FROM {t}" for k, (t, _) in FILES.items()} | {f"nulls_{fmt}_customer": NULLS for fmt in NULL_FORMATS} | {
        "file_raw_roundtrip_nation": "SELECT n_name FROM nation",
        "file_raw_split_customer": "SELECT c_name FROM customer",
        "file_avro_split_orders": "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders",
        "file_csv_roundtrip_nation": "SELECT * FROM nation",
        "file_toml_region": "SELECT * FROM region",
        "transcode_json_to_messagepack_customer": "SELECT * FROM customer",
        "pump_props_events": "SELECT json(props)::VARCHAR AS line FROM events",
        "json_styles_region": "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS compact, '{' || chr(10) || '  \"r_regionkey\": ' || r_regionkey || ',' || chr(10) || '  \"r_name\": \"' || r_name || '\"' || chr(10) || '}' AS indented, " + _readable() + " AS readable FROM region",
        "to_json_events": "SELECT to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type, 'props': props})::VARCHAR AS line FROM events",
        "csv_cells_part": "SELECT p_partkey, p_size, p_retailprice, p_size > 25 AS large FROM part",
        "cbor_bytes_roundtrip_documents": "SELECT doc_id, text FROM documents",
        "raw_line_ends_nation": "SELECT n_name AS line FROM nation UNION ALL SELECT n_name || chr(13) FROM nation",
        "null_display_customer": f"SELECT '{{c_custkey: ' || c_custkey || ', c_name: ' || coalesce(c_name, '()') || ', c_nationkey: ' || coalesce(c_nationkey::VARCHAR, '()') || '}}' AS text FROM ({NULLS})",
        "float_kinds": "SELECT vec_id, len(embedding)::BIGINT AS n_f32, 1::BIGINT AS n_f64 FROM embeddings",
        "protobuf_nested_lineitem": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_tax, l_discount FROM lineitem",
        "registry_person": "SELECT 'John' AS name, 34 AS age, 'proto/example/person.proto' AS file, true AS stale_before, false AS stale_after",
        "errors_by_format": "SELECT * FROM (VALUES " + ", ".join(f"('{fmt}', {int(fmt in ('json', 'csv'))}::BIGINT, '{error}')" for fmt, _, error in REFUSED) + ") AS t(format, n_records, error)",
    }
