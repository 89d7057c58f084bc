"""Queries of the driver contract, each with the SQL that gives the same rows.

A query encodes a table, decodes the encoded bytes again and returns typed columns, or returns the encoded text; so its
SQL is a plain SELECT, or the same text put together in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators.transcode import decode, decode_blocks, encode, encode_rows
from . import formats
from .formats import spread

#: Both sides of a JSON round trip: the default keeps milliseconds only.
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_roundtrip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own JSON functions on both sides."""
    rows = table(spark, sf_dir, "orders")
    text = rows.select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("value"))
    return text.select(F.from_json("value", rows.schema, JSON_OPTIONS | {"mode": "FAILFAST"}).alias("r")).select("r.*")


def roundtrip(name: str, fmt: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """A table through a format's bytes and back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(table(spark, sf_dir, name))
        return decode_blocks(encode_rows(rows, fmt, **options), fmt, rows.schema)

    return query


def json_compact_text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    text = encode_rows(rows, "json", rows_per_block=1)
    return text.select(F.regexp_replace(F.col("block").cast("string"), r"\n\z", "").alias("line"))


def json_props_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real JSON text decoded to records, and a key of each taken out."""
    props = table(spark, sf_dir, "events").select("event_id", F.col("props"))
    native = props.select("event_id", F.from_json("props", "k int", {"mode": "FAILFAST"}).alias("p"))
    return native.select("event_id", F.col("p.k").alias("k"))


def json_values_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text through the record decoder, as blocks."""
    return decode_blocks(spread(table(spark, sf_dir, "events").select("props")).select(F.col("props").cast("binary").alias("block")), "json", "k int").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def raw_roundtrip_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("\n")).cast("binary").alias("block"))

    def run(batches):
        from ..codecs import raw

        for batch in batches:
            found = [v[1] for block in batch.column(0) for v in raw.decode(block.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["n_name"])

    return lines.mapInArrow(run, "n_name string")


def envelope_roundtrip_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "lineitem"))
    return decode(encode(rows), rows.schema)


def messagepack_bytes_roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("text").cast("binary").alias("text"))
    return decode_blocks(encode_rows(rows, "messagepack"), "messagepack", rows.schema).select("doc_id", F.col("text").cast("string").alias("text"))


def protobuf_decode_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages put together in Spark, field by field, and decoded by a parsed .proto file."""
    from ..codecs import protobuf

    proto = protobuf.ProtoParser('syntax = "proto3"; package shop; message Customer { int64 key = 1; string name = 2; }', "shop.proto").parse()
    descriptors = protobuf.link([proto]).SerializeToString()

    def run(batches):
        for batch in batches:
            out = []
            for key, name in zip(*(c.to_pylist() for c in batch.columns)):
                data = name.encode()
                out.append(b"\x08" + varint(key) + b"\x12" + varint(len(data)) + data)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["block"])

    blocks = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).mapInArrow(run, "block binary")
    rows = decode_blocks(blocks, "protobuf", "key long, name string", descriptors=descriptors, message=".shop.Customer")
    return rows.select(F.col("key").alias("c_custkey"), F.col("name").alias("c_name"))


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def display_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "region")).select(values.display("value").alias("text"))


def kinds_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each kind an encoded table holds."""
    return encode(spread(table(spark, sf_dir, "lineitem"))).groupBy(values.kind("value").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


#: name: (table, format, options). Documents of one record take a block each.
ROUNDTRIPS = {
    "csv_roundtrip_documents": ("documents", "csv", {"rows_as": "sequence"}),
    "json_records_roundtrip_lineitem": ("lineitem", "json", {}),
    "cbor_roundtrip_lineitem": ("lineitem", "cbor", {}),
    "messagepack_roundtrip_lineitem": ("lineitem", "messagepack", {}),
    "avro_null_roundtrip_lineitem": ("lineitem", "avro", {"codec": "null"}),
    "avro_deflate_roundtrip_lineitem": ("lineitem", "avro", {"codec": "deflate"}),
    "avro_snappy_roundtrip_lineitem": ("lineitem", "avro", {"codec": "snappy"}),
    "array_roundtrip_embeddings": ("embeddings", "cbor", {}),
    "avro_array_roundtrip_embeddings": ("embeddings", "avro", {}),
    "toml_roundtrip_part": ("part", "toml", {"rows_per_block": 1}),
    "yaml_roundtrip_part": ("part", "yaml", {}),
    "json_indented_roundtrip_supplier": ("supplier", "json", {"style": "indented"}),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [json_roundtrip_orders, json_compact_text_orders, json_props_events, json_values_events, raw_roundtrip_nation, envelope_roundtrip_lineitem, messagepack_bytes_roundtrip_documents, protobuf_decode_customer, display_region, kinds_lineitem]
    return {f.__name__: f for f in own} | {k: roundtrip(t, fmt, **o) for k, (t, fmt, o) in ROUNDTRIPS.items()} | formats.queries()


def oracle_sql() -> dict[str, str]:
    return formats.oracle_sql() | {k: f"SELECT * FROM {t}" for k, (t, _, _) in ROUNDTRIPS.items()} | {
        "json_roundtrip_orders": "SELECT * FROM orders",
        "json_compact_text_orders": "SELECT to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority})::VARCHAR AS line FROM orders",
        "json_props_events": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
        "json_values_events": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
        "raw_roundtrip_nation": "SELECT n_name FROM nation",
        "envelope_roundtrip_lineitem": "SELECT * FROM lineitem",
        "messagepack_bytes_roundtrip_documents": "SELECT doc_id, text FROM documents",
        "protobuf_decode_customer": "SELECT c_custkey, c_name FROM customer",
        "display_region": "SELECT '{r_regionkey: ' || r_regionkey || ', r_name: ' || r_name || '}' AS text FROM region",
        "kinds_lineitem": "SELECT 'm' AS kind, count(*) AS n FROM lineitem",
    }
