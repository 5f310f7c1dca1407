"""Queries over mutable tables: each makes a database or store in a scratch folder, writes to it, and returns what is live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshift.plans.engine import Engine
from loomshift.plans.registry import register
from loomshift.sources.changelog import resolve
from loomshift.sources.kv import KVStore
from loomshift.sources.kvql import parse
from loomshift.sources.storage import scratch_dir
from loomshift.sources.tables import table

_CUSTOMER = "CREATE TABLE customers (c_custkey BIGINT PRIMARY KEY, c_name TEXT NOT NULL, c_nationkey INT, c_acctbal DOUBLE PRECISION, c_mktsegment VARCHAR(20))"


def customers(spark: SparkSession, sf_dir: str) -> Engine:
    """A database with the customer table's rows in a mutable table."""
    engine = Engine(spark, scratch_dir(spark))
    engine.attach("customer", engine.spark.read.parquet(f"{sf_dir}/customer.parquet"))
    engine.execute(_CUSTOMER + "; INSERT INTO customers SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    return engine


@register("param_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'")
def param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch_dir(spark))
    engine.attach("orders", engine.spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return engine.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2::text", [250000, "O"])


@register("dml_insert", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 1000000001, 'new', NULL, CAST(1.5 AS DOUBLE), 'none'")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("INSERT INTO customers VALUES (1000000001, 'new', NULL, 1.5, 'none')")
    return engine.query("SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customers")


@register("dml_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'replaced' ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("INSERT INTO customers (c_custkey, c_name) SELECT c_custkey, 'replaced' FROM customer WHERE c_custkey % 10 = 0")
    return engine.query("SELECT c_custkey, c_name, c_nationkey FROM customers")


@register("dml_update", "SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'FURNITURE' THEN lower(c_name) ELSE c_name END AS c_name FROM customer")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("UPDATE customers SET c_acctbal = c_acctbal + $1, c_name = lower(c_name) WHERE c_mktsegment = 'FURNITURE'", [100])
    return engine.query("SELECT c_custkey, c_acctbal, c_name FROM customers")


@register("dml_update_key", "SELECT c_custkey + 1 AS c_custkey, c_name FROM customer")
def dml_update_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("UPDATE customers SET c_custkey = c_custkey + 1")
    return engine.query("SELECT c_custkey, c_name FROM customers")


@register("dml_delete", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey = 3 OR c_acctbal < 0)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("DELETE FROM customers WHERE c_nationkey = 3 OR c_acctbal < 0")
    return engine.query("SELECT c_custkey, c_nationkey FROM customers")


@register("dml_chain", "SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT -1, CAST(7 AS DOUBLE)")
def dml_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("UPDATE customers SET c_acctbal = 0 WHERE c_mktsegment = 'FURNITURE'; DELETE FROM customers WHERE c_nationkey = 3; INSERT INTO customers (c_custkey, c_name, c_acctbal) VALUES (-1, 'extra', 7)")
    engine.compact("customers")
    return engine.query("SELECT c_custkey, c_acctbal FROM customers")


@register("dml_serial", "SELECT row_number() OVER (ORDER BY n_nationkey) AS id, n_name FROM nation UNION ALL SELECT 25 + row_number() OVER (ORDER BY r_regionkey), r_name FROM region")
def dml_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch_dir(spark))
    for name in ("nation", "region"):
        engine.attach(name, engine.spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    engine.execute("CREATE TABLE places (id BIGSERIAL PRIMARY KEY, name TEXT); INSERT INTO places (name) SELECT n_name FROM nation ORDER BY n_nationkey; INSERT INTO places (name) SELECT r_name FROM region ORDER BY r_regionkey")
    return engine.query("SELECT id, name AS n_name FROM places")


@register("dml_default", "SELECT n_nationkey AS id, 'unknown' AS note, CAST(1.5 AS DOUBLE) AS weight FROM nation")
def dml_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch_dir(spark))
    engine.attach("nation", engine.spark.read.parquet(f"{sf_dir}/nation.parquet"))
    engine.execute("CREATE TABLE notes (id INT PRIMARY KEY, note TEXT DEFAULT 'unknown', weight FLOAT8 DEFAULT 1.5); INSERT INTO notes (id) SELECT n_nationkey FROM nation")
    return engine.query("SELECT * FROM notes")


@register("txn_commit", "SELECT c_custkey, CAST(1 AS DOUBLE) AS c_acctbal FROM customer WHERE c_nationkey >= 5")
def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("BEGIN; UPDATE customers SET c_acctbal = 1; DELETE FROM customers WHERE c_nationkey < 5; COMMIT")
    return engine.query("SELECT c_custkey, c_acctbal FROM customers")


@register("txn_rollback", "SELECT c_custkey, c_acctbal FROM customer")
def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("BEGIN; DELETE FROM customers; ROLLBACK")
    return engine.query("SELECT c_custkey, c_acctbal FROM customers")


@register("txn_overlay", "SELECT 'inside' AS seen, count(*) AS n FROM customer WHERE c_nationkey >= 5 UNION ALL SELECT 'outside', count(*) FROM customer")
def txn_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    other = Engine(spark, engine.root)
    engine.execute("BEGIN; DELETE FROM customers WHERE c_nationkey < 5")
    inside = engine.rows("customers").agg(F.count(F.lit(1)).alias("n")).select(F.lit("inside").alias("seen"), "n")
    outside = other.rows("customers").agg(F.count(F.lit(1)).alias("n")).select(F.lit("outside").alias("seen"), "n")
    return inside.union(outside)


@register("txn_savepoint", "SELECT c_custkey FROM customer WHERE c_nationkey <> 1")
def txn_savepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("BEGIN; DELETE FROM customers WHERE c_nationkey = 1; SAVEPOINT s; DELETE FROM customers; ROLLBACK TO SAVEPOINT s; COMMIT")
    return engine.query("SELECT c_custkey FROM customers")


def _names(spark: SparkSession, sf_dir: str) -> KVStore:
    """Customer names as keys, nation numbers as values."""
    store = KVStore(spark, scratch_dir(spark))
    store.ingest(table(spark, sf_dir, "customer").select(F.col("c_name").cast("binary").alias("key"), F.col("c_nationkey").cast("string").cast("binary").alias("value")))
    return store


def _text(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@register("kv_scan", "SELECT c_name AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200' ORDER BY c_name LIMIT 50")
def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse("SCAN FROM 'Customer#000000100' TO 'Customer#000000200' LIMIT 50")
    return _text(_names(spark, sf_dir).scan(found.start, found.end, found.limit))


@register("kv_batch", "SELECT c_name AS key, CASE WHEN c_name = 'Customer#000000003' THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS value FROM customer WHERE c_name <> 'Customer#000000002' UNION ALL SELECT 'zz', 'new'")
def kv_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _names(spark, sf_dir)
    store.batch(list(parse("BATCH { PUT zz new DELETE 'Customer#000000002' PUT 'Customer#000000003' x }").ops))
    return _text(store.scan())


@register("kv_compact", "SELECT c_name AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_name <> 'Customer#000000001'")
def kv_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _names(spark, sf_dir)
    store.delete("Customer#000000001")
    store.compact()
    return _text(store.scan())


@register("kv_get", "SELECT c_name AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_name = 'Customer#000000042'")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_names(spark, sf_dir).table().where(F.col("key") == F.lit(b"Customer#000000042")))


@register(
    "kv_events_latest",
    """SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t
       WHERE rn = 1 AND event_type <> 'error'""",
)
def kv_events_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user; an error is a tombstone. One aggregation, as change logs are resolved."""
    log = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", F.lit(0).cast("long").alias("__batch"), F.col("event_id").alias("__row"), F.when(F.col("event_type") == "error", "D").otherwise("P").alias("__op")
    )
    return resolve(log, ["user_id", "event_type", "value"], ["user_id"])


@register("kv_merge_runs", "SELECT c_name AS key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE CAST(c_nationkey AS VARCHAR) END AS value FROM customer WHERE c_custkey % 6 <> 0")
def kv_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sorted runs: the newer one overwrites even customers and deletes each third of these."""
    names = table(spark, sf_dir, "customer").withColumn("key", F.col("c_name").cast("binary"))
    new = names.where("c_custkey % 2 = 0").select("key", F.when(F.col("c_custkey") % 6 != 0, F.lit(b"new")).alias("value"))
    old = names.select("key", F.col("c_nationkey").cast("string").cast("binary").alias("value"))
    return _text(KVStore(spark, scratch_dir(spark)).merged([new, old]))


@register("catalog_tables", "SELECT 'public' AS table_schema, 'customers' AS table_name, 'BASE TABLE' AS table_type")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).query("SELECT table_schema, table_name, table_type FROM information_schema.tables")


@register(
    "catalog_columns",
    """SELECT * FROM (VALUES ('c_custkey', 1, 'NO', 'bigint'), ('c_name', 2, 'NO', 'string'), ('c_nationkey', 3, 'YES', 'int'), ('c_acctbal', 4, 'YES', 'double'), ('c_mktsegment', 5, 'YES', 'string'))
       t(column_name, ordinal_position, is_nullable, data_type)""",
)
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).query("SELECT column_name, ordinal_position, is_nullable, data_type FROM information_schema.columns WHERE table_name = 'customers' ORDER BY ordinal_position")


@register("show_setting", "SELECT 'UTF8' AS server_encoding")
def show_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, scratch_dir(spark)).query("SHOW server_encoding")
