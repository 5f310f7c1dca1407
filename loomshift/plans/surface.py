"""Queries through the engine's SQL surface, the command language and the client: what a user of the text interfaces meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshift.functions.wire import wire_text
from loomshift.plans.engine import Engine
from loomshift.plans.mutable import customers
from loomshift.plans.registry import register
from loomshift.sources.kv import BatchWriter, KVClient, KVError, KVStore
from loomshift.sources.kvql import QueryBuilder, lex, parse, run
from loomshift.sources.storage import scratch_dir
from loomshift.sources.tables import table
from loomshift.streaming.ingest import ingest_stream


def attached(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """A database with read-only tables."""
    engine = Engine(spark, scratch_dir(spark))
    for name in names:
        engine.attach(name, engine.spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return engine


# DML


@register("dml_insert_join", "SELECT c_custkey AS id, n_name AS nation, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, n_name")
def dml_insert_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = attached(spark, sf_dir, "customer", "nation", "orders")
    engine.execute("""CREATE TABLE homes (id BIGINT PRIMARY KEY, nation TEXT, n BIGINT);
        INSERT INTO homes SELECT c_custkey, n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, n_name""")
    return engine.query("SELECT id, nation, n FROM homes")


@register(
    "dml_on_conflict_update",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN 'seen' ELSE c_name END AS c_name FROM customer
       UNION ALL SELECT -c_custkey - 1, CAST(1 AS DOUBLE), 'new' FROM customer WHERE c_custkey % 50 = 0""",
)
def dml_on_conflict_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("""INSERT INTO customers (c_custkey, c_name, c_acctbal) SELECT c_custkey, 'seen', 1000 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT -c_custkey - 1, 'new', 1 FROM customer WHERE c_custkey % 50 = 0
        ON CONFLICT (c_custkey) DO UPDATE SET c_acctbal = customers.c_acctbal + excluded.c_acctbal, c_name = excluded.c_name WHERE customers.c_acctbal > 0""")
    return engine.query("SELECT c_custkey, c_acctbal, c_name FROM customers")


@register("dml_on_conflict_nothing", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT -1, 'first'")
def dml_on_conflict_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("INSERT INTO customers (c_custkey, c_name) SELECT c_custkey, 'lost' FROM customer ON CONFLICT DO NOTHING; INSERT INTO customers (c_custkey, c_name) VALUES (-1, 'first'), (-1, 'second') ON CONFLICT (c_custkey) DO NOTHING")
    return engine.query("SELECT c_custkey, c_name FROM customers")


@register("dml_update_from", "SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_name END AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dml_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.attach("nation", engine.spark.read.parquet(f"{sf_dir}/nation.parquet"))
    engine.execute("UPDATE customers AS c SET c_name = n.n_name FROM nation n WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1")
    return engine.query("SELECT c_custkey, c_name FROM customers")


@register("dml_delete_using", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT (n_regionkey = 2 AND c_acctbal > 0)")
def dml_delete_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.attach("nation", engine.spark.read.parquet(f"{sf_dir}/nation.parquet"))
    engine.execute("DELETE FROM customers USING nation n JOIN nation m ON n.n_nationkey = m.n_nationkey WHERE customers.c_nationkey = n.n_nationkey AND m.n_regionkey = 2 AND c_acctbal > 0")
    return engine.query("SELECT c_custkey FROM customers")


@register("dml_literal", "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN ':p1 $1 it''s' WHEN c_custkey = 8 THEN 'a''b\\c' ELSE c_name END AS c_name FROM customer")
def dml_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("UPDATE customers SET c_name = ':p1 $1 it''s' WHERE customers.c_custkey = $1", [7])
    engine.execute("UPDATE customers SET c_name = $2 WHERE c_custkey = $1", [8, "a'b\\c"])
    return engine.query("SELECT c_custkey, c_name FROM customers")


@register("dml_subquery", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
def dml_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.attach("nation", engine.spark.read.parquet(f"{sf_dir}/nation.parquet"))
    engine.execute("DELETE FROM customers WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
    return engine.query("SELECT c_custkey, c_mktsegment FROM customers")


@register("dml_returning", "SELECT c_custkey, upper(c_name) AS u FROM customer WHERE c_nationkey = 4")
def dml_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).query("UPDATE customers SET c_acctbal = 0 WHERE c_nationkey = 4 RETURNING c_custkey, upper(c_name) AS u")


# functions and predicates in SQL text


@register(
    "sql_functions",
    """SELECT c_custkey, concat(c_name, NULL, '-', c_nationkey) AS joined, c_name || coalesce(nullif(c_mktsegment, 'FURNITURE'), '') AS piped, substring(c_name, 1, 4) AS head, substring(c_name, 3, 5) AS mid, '' AS past, trim(c_name) AS trimmed,
       CAST(c_custkey // 7 AS BIGINT) AS d, CAST(-7 // 2 AS INT) AS neg, c_acctbal / 2 AS half, CAST(c_nationkey AS INT) AS prefix, c_nationkey % 2 = 1 AS odd FROM customer""",
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir, "customer").query("""SELECT c_custkey, concat(c_name, NULL, '-', c_nationkey) AS joined, c_name || nullif(c_mktsegment, 'FURNITURE') AS piped, substr(c_name, -3, 4) AS head, substring(c_name, 3, 5) AS mid,
        substr(c_name, 1000) AS past, trim(E' \\t' || c_name || E'\\n ') AS trimmed, c_custkey / 7 AS d, CAST(-7 / 2 AS INT) AS neg, c_acctbal / 2 AS half, concat(c_nationkey, 'abc')::int AS prefix, (CASE WHEN c_nationkey % 2 = 1 THEN 'Yes' ELSE 'no' END || '')::boolean AS odd
        FROM customer""")


@register("sql_to_char", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t FROM orders")
def sql_to_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir, "orders").query("SELECT o_orderkey, to_char(o_orderdate, 'YYYY') AS t FROM orders")


@register("sql_any_all", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND user_id NOT IN (1, 2) AND value > 3 AND value > 5")
def sql_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir, "events").query("SELECT event_id FROM events WHERE event_type = ANY(ARRAY['click', 'error']) AND user_id <> ALL (ARRAY[1, 2]) AND value > ALL(ARRAY[3, 5])")


@register("sql_similar", "SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, '.*(1|2)0.') AND c_nationkey BETWEEN 3 AND 9 AND NOT regexp_full_match(c_name, '.*9')")
def sql_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir, "customer").query("SELECT c_custkey FROM customer WHERE c_name SIMILAR TO '%(1|2)0_' AND c_nationkey BETWEEN SYMMETRIC 9 AND 3 AND c_name NOT SIMILAR TO '%9'")


@register("sql_like_backslash", "SELECT n_nationkey, n_nationkey % 2 = 0 AS hit FROM nation")
def sql_like_backslash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir, "nation").query(r"SELECT n_nationkey, (CASE WHEN n_nationkey % 2 = 0 THEN 'a\bc' ELSE 'abc' END) LIKE 'a\b%' AS hit FROM nation")


@register("join_theta_only", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey")
def join_theta_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir, "nation", "region").query("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey")


@register("sort_default_nulls", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r ASC NULLS FIRST, n_nationkey LIMIT 8")
def sort_default_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir, "nation").query("SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r, n_nationkey LIMIT 8")


# sessions


@register(
    "session_identity",
    "SELECT 'loomshift' AS u, 'loomshift' AS s, 'loomshift' AS d, 'public' AS c, true AS v, 1 AS pid, 'integer' AS t, '-' AS none, 'loomshift' AS owner, 'UTF8' AS enc, 'fast' AS mode, '127.0.0.1' AS addr, 5432 AS port, true AS now_is, true AS day_is",
)
def session_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch_dir(spark))
    engine.query("SELECT set_config('app.mode', 'fast', false)")
    return engine.query("""SELECT current_user AS u, session_user AS s, current_database() AS d, current_schema() AS c, version() LIKE 'PostgreSQL 15.0%' AS v, pg_backend_pid() AS pid, format_type(23, NULL) AS t, format_type(NULL, NULL) AS none,
        pg_get_userbyid(10) AS owner, current_setting('server_encoding') AS enc, current_setting('app.mode') AS mode, inet_server_addr() AS addr, inet_server_port() AS port, now() > TIMESTAMP '2020-01-01 00:00:00' AS now_is,
        current_date >= DATE '2020-01-01' AS day_is""")


@register("session_prepared", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 20000")
def session_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = attached(spark, sf_dir, "orders")
    engine.prepare("cheap", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = $2 AND o_totalprice < $1")
    return engine.run_prepared("cheap", [20000, "F"])[0].df


@register("session_deallocate", "SELECT 'gone' AS first, 'gone' AS second")
def session_deallocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch_dir(spark))
    for name in ("a", "b"):
        engine.prepare(name, "SELECT 1")
    engine.execute("DEALLOCATE a; DISCARD ALL")
    return engine.spark.createDataFrame([tuple("kept" if n in engine.prepared else "gone" for n in ("a", "b"))], "first string, second string")


@register("session_describe", "SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'half', 'double'), (2, 'low', 'string')) t(place, name, type)")
def session_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = attached(spark, sf_dir, "orders")
    schema = engine.describe("SELECT o_orderkey, o_totalprice / 2 AS half, lower(o_orderstatus) AS low FROM orders WHERE o_orderkey = $1", [1])
    return engine.spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)], "place int, name string, type string")


@register("session_pages", "SELECT CAST(i AS INT) AS page, CASE WHEN i < 2 THEN 10 ELSE 5 END AS size FROM range(3) t(i)")
def session_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = attached(spark, sf_dir, "nation")
    return engine.spark.createDataFrame([(i, len(p)) for i, p in enumerate(engine.pages(engine.query("SELECT * FROM nation"), 10))], "page int, size int")


@register("session_settings", "SELECT 'Europe/Paris' AS timezone, 'on' AS standard_conforming_strings, '' AS unheard_of")
def session_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch_dir(spark))
    engine.execute("SET SESSION timezone TO 'Europe/Paris'")
    shown = [engine.query(f"SHOW {n}") for n in ("timezone", "standard_conforming_strings", "unheard_of")]
    return shown[0].crossJoin(shown[1]).crossJoin(shown[2])  # one row each


@register("wire_text", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 't' ELSE 'f' END AS b, '2024-01-02 03:04:05.5+00' AS ts, CAST(c_custkey AS VARCHAR) AS i, CAST(c_custkey AS VARCHAR) AS whole, NULL AS n FROM customer")
def wire_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("b"), F.lit("2024-01-02 03:04:05.5").cast("timestamp").alias("ts"), F.col("c_custkey").alias("i"), F.col("c_custkey").cast("double").alias("whole"))
    return rows.select("c_custkey", *[wire_text(F.col(c), rows.schema[c].dataType).alias(c) for c in ("b", "ts", "i", "whole")], wire_text(F.lit(None).cast("boolean"), rows.schema["b"].dataType).cast("int").alias("n"))


# DDL and transactions


@register("ddl_index", "SELECT 'by_name' AS indname, false AS indisunique UNION ALL SELECT 'by_nation', true")
def ddl_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("CREATE INDEX by_name ON customers (c_name); CREATE UNIQUE INDEX by_nation ON customers (c_nationkey); CREATE INDEX gone ON customers (c_acctbal); CREATE INDEX IF NOT EXISTS gone ON customers (c_name); DROP INDEX gone; DROP INDEX IF EXISTS gone")
    return engine.query("SELECT indname, indisunique FROM pg_index")


@register("ddl_drop", "SELECT 'kept' AS table_name")
def ddl_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch_dir(spark))
    engine.execute("CREATE TABLE kept (a INT PRIMARY KEY); CREATE TABLE gone (a INT); CREATE TABLE too (a INT); DROP TABLE gone, too; DROP TABLE IF EXISTS gone")
    return engine.query("SELECT table_name FROM information_schema.tables")


@register("ddl_create_as", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey")
def ddl_create_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = attached(spark, sf_dir, "nation")
    engine.execute("CREATE TABLE regions AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
    return engine.query("SELECT n_regionkey, n FROM regions")


@register("ddl_truncate", "SELECT CAST(0 AS BIGINT) AS n")
def ddl_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("TRUNCATE TABLE customers")
    return engine.query("SELECT count(*) AS n FROM customers")


@register("txn_release", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2)")
def txn_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("BEGIN; DELETE FROM customers WHERE c_nationkey = 1; SAVEPOINT a; DELETE FROM customers WHERE c_nationkey = 2; RELEASE SAVEPOINT a; COMMIT")
    return engine.query("SELECT c_custkey FROM customers")


@register("txn_ddl", "SELECT 'customers' AS table_name UNION ALL SELECT 'made'")
def txn_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("BEGIN; CREATE TABLE lost (a INT PRIMARY KEY); INSERT INTO lost VALUES (1); ROLLBACK")
    engine.execute("BEGIN; CREATE TABLE made (a INT PRIMARY KEY); INSERT INTO made VALUES (1); COMMIT")
    return engine.query("SELECT table_name FROM information_schema.tables")


@register("txn_failed", "SELECT 'failed' AS inside, 'ROLLBACK' AS tag, count(*) AS n FROM customer")
def txn_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = customers(spark, sf_dir)
    engine.execute("BEGIN; DELETE FROM customers")
    seen = []
    for text in ("INSERT INTO nowhere VALUES (1)", "SELECT 1"):
        try:
            engine.execute(text)
        except RuntimeError:
            seen.append("failed")
    tag = engine.execute("COMMIT")[0].tag
    return engine.query("SELECT count(*) AS n FROM customers").select(F.lit(seen[-1]).alias("inside"), F.lit(tag).alias("tag"), "n")


# the key-value store's interfaces

def _store(spark: SparkSession, sf_dir: str) -> KVStore:
    store = KVStore(spark, scratch_dir(spark))
    store.ingest(table(spark, sf_dir, "nation").select(F.col("n_name").cast("binary").alias("key"), F.col("n_regionkey").cast("string").cast("binary").alias("value")))
    return store


@register("kv_get_command", "SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation ORDER BY n_nationkey LIMIT 1")
def kv_get_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "nation").orderBy("n_nationkey").first()["n_name"]
    found = run(_store(spark, sf_dir), QueryBuilder().get(name).build())
    return spark.createDataFrame([(found["key"], found["value"])], "key string, value string").select("key", F.unbase64("value").cast("string").alias("value"))


@register("kv_offset", "SELECT n_name AS key FROM nation ORDER BY n_name LIMIT 5 OFFSET 3")
def kv_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).scan(limit=5, offset=3).select(F.col("key").cast("string").alias("key"))


@register("kv_stream_scan", "SELECT n_name AS key FROM nation WHERE n_name >= 'C' AND n_name < 'K'")
def kv_stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k.decode(),) for k, _ in _store(spark, sf_dir).stream("C", "K")], "key string")


@register("kv_client", "SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_nationkey >= 3 UNION ALL SELECT 'k' || i, 'v' || i FROM range(7) t(i)")
def kv_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = KVClient(_store(spark, sf_dir))
    names = [r.n_name for r in table(spark, sf_dir, "nation").where("n_nationkey < 3").collect()]
    with BatchWriter(client.store, chunk=4) as writer:
        for i in range(7):
            writer.put(f"k{i}", f"v{i}")
        for n in names:
            writer.delete(n)
    return spark.createDataFrame([(k, v.decode()) for k, v in client.scan()], "key string, value string")


@register("kv_errors", "SELECT * FROM (VALUES (0, 'not_found'), (1, 'bad_request'), (2, 'bad_request'), (3, 'bad_request'), (4, 'ok'), (5, 'ok')) t(place, code)")
def kv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = KVClient(_store(spark, sf_dir))
    texts = ["GET nothing", "GET", "PUT 'a", "BATCH { }", "DELETE nothing", "SCAN LIMIT 1"]
    return spark.createDataFrame([(i, found.get("code", found["status"])) for i, found in enumerate(map(client.query_raw, texts))], "place int, code string")


@register("kv_lexical", """SELECT * FROM (VALUES (0, 'keyword', 'PUT'), (1, 'text', 'a:1/b'), (2, 'text', 'x "y" \\'), (3, 'keyword', 'LIMIT'), (4, 'number', '10'), (5, 'mark', '{')) t(place, kind, text)""")
def kv_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lex("""put a:1/b "x \\"y\\" \\\\" limit 10 {""")
    return spark.createDataFrame([(i, t.kind, t.text) for i, t in enumerate(found)], "place int, kind string, text string")


@register("kv_commands", "SELECT n_name AS key FROM nation WHERE n_name >= 'A' AND n_name < 'F' AND n_name <> 'CANADA' UNION ALL SELECT 'BB'")
def kv_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    for text in ("PUT BB 'two'", "DELETE CANADA", "delete 'FRANCE'"):
        run(store, text)
    found = parse(QueryBuilder().scan().from_("A").to("F").build())
    return store.scan(found.start, found.end, found.limit).select(F.col("key").cast("string").alias("key"))


@register("kv_limits", "SELECT 'bad_request' AS long_command, 'bad_request' AS empty_value, 'bad_request' AS empty_key")
def kv_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, out = KVStore(spark, scratch_dir(spark)), []
    for step in (lambda: run(store, "GET " + "x" * (1 << 20)), lambda: store.put("k", ""), lambda: store.put("", "v")):
        try:
            step()
            out.append("ok")
        except KVError as e:
            out.append(e.code)
    return spark.createDataFrame([tuple(out)], "long_command string, empty_value string, empty_key string")


@register("kv_health", "SELECT 'ok' AS status, CAST(25 AS BIGINT) AS keys, CAST(1 AS BIGINT) AS batches, true AS has_bytes")
def kv_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    found = {r["name"]: r["value"] for r in store.metrics().collect()}
    return spark.createDataFrame([(store.health()["status"], int(found["keys"]), int(found["batches"]), found["bytes"] > 0)], "status string, keys long, batches long, has_bytes boolean")


@register("kv_stream_ingest", "SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def kv_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files into the store; a micro-batch that is run again after later writes changes nothing."""
    folder = scratch_dir(spark)
    pairs = table(spark, sf_dir, "nation").select(F.col("n_name").cast("binary").alias("key"), F.col("n_regionkey").cast("string").cast("binary").alias("value"))
    pairs.write.parquet(f"{folder}/in")
    store = KVStore(spark, f"{folder}/store")
    ingest_stream(spark.readStream.schema(pairs.schema).parquet(f"{folder}/in"), store, f"{folder}/progress").awaitTermination()
    name = pairs.first()["key"]
    store.put("late", "x")
    store.delete("late")
    store.ingest(spark.createDataFrame([(bytes(name), b"stale")], pairs.schema), source=f"{folder}/progress", epoch=0)
    return store.table().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


# the catalogue, types and files


@register("catalog_pg", "SELECT * FROM (VALUES ('customers', 1, 'c_custkey', true, 'bigint'), ('customers', 2, 'c_name', true, 'string'), ('customers', 3, 'c_nationkey', false, 'int'), ('customers', 4, 'c_acctbal', false, 'double'), ('customers', 5, 'c_mktsegment', false, 'string')) t(relname, attnum, attname, attnotnull, typname)")
def catalog_pg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).query("""SELECT c.relname, a.attnum, a.attname, a.attnotnull, t.typname FROM pg_catalog.pg_class c JOIN pg_catalog.pg_namespace n ON c.relnamespace = n.oid
        JOIN pg_catalog.pg_attribute a ON a.attrelid = c.oid JOIN pg_type t ON t.oid = a.atttypid WHERE n.nspname = 'public' AND c.relkind = 'r'""")


@register("catalog_identity", "SELECT 'customers' AS tablename, 'loomshift' AS tableowner, 'loomshift' AS usename, true AS rolsuper, 'customers_pkey' AS conname, 'p' AS contype, 'public' AS nspname")
def catalog_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).query("""SELECT t.tablename, t.tableowner, u.usename, r.rolsuper, k.conname, k.contype, n.nspname FROM pg_tables t, pg_user u, pg_roles r, pg_constraint k, pg_namespace n
        WHERE t.tableowner = u.usename AND r.rolname = u.usename AND n.nspname = t.schemaname""")


_TYPED = "i INTEGER, b BIGINT, s SMALLINT, r REAL, f FLOAT8, n NUMERIC(12,2), t TEXT, v VARCHAR(9), o BOOLEAN, z TIMESTAMP"


@register(
    "types_declared",
    """SELECT * FROM (VALUES (1, 'i', 'int'), (2, 'b', 'bigint'), (3, 's', 'bigint'), (4, 'r', 'float'), (5, 'f', 'double'), (6, 'n', 'decimal(12,2)'), (7, 't', 'string'), (8, 'v', 'string'), (9, 'o', 'boolean'), (10, 'z', 'timestamp'))
       t(ordinal_position, column_name, data_type)""",
)
def types_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch_dir(spark))
    engine.execute(f"CREATE TABLE typed (k INT PRIMARY KEY, {_TYPED})")
    return engine.query("SELECT ordinal_position - 1 AS ordinal_position, column_name, data_type FROM information_schema.columns WHERE table_name = 'typed' AND column_name <> 'k'")


@register(
    "types_round_trip",
    """SELECT c_custkey AS k, CAST(c_nationkey AS INT) AS i, c_custkey * 1000000000 AS b, CAST(c_nationkey AS BIGINT) AS s, CAST(0.5 AS DOUBLE) AS r, c_acctbal AS f, CAST(round(c_acctbal, 2) AS DOUBLE) AS n, c_name AS t, substring(c_name, 1, 9) AS v, c_acctbal > 0 AS o,
       CAST(NULL AS VARCHAR) AS z FROM customer""",
)
def types_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type through a write, a compaction, an update and a read."""
    engine = attached(spark, sf_dir, "customer")
    engine.execute(f"CREATE TABLE typed (k BIGINT PRIMARY KEY, {_TYPED})")
    engine.execute("INSERT INTO typed SELECT c_custkey, c_nationkey, c_custkey * 1000000000, c_nationkey, 0.25, c_acctbal, round(c_acctbal, 2), c_name, substr(c_name, 1, 9), c_acctbal > 0, TIMESTAMP '2024-01-01 00:00:00' FROM customer")
    engine.compact("typed")
    engine.execute("UPDATE typed SET r = r * 2, z = NULL")
    return engine.query("SELECT k, i, b, s, CAST(r AS DOUBLE) AS r, f, CAST(n AS DOUBLE) AS n, t, v, o, CAST(z AS STRING) AS z FROM typed")


@register("copy_files", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey < 10")
def copy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out to CSV and Parquet, and back into an emptied table."""
    engine = customers(spark, sf_dir)
    engine.execute(f"DELETE FROM customers WHERE c_nationkey >= 10; COPY customers TO '{engine.root}/out_csv' WITH (FORMAT csv, HEADER, DELIMITER ';', NULL 'none'); COPY customers (c_custkey, c_name) TO '{engine.root}/out_parquet' (FORMAT parquet)")
    engine.execute(f"TRUNCATE TABLE customers; COPY customers (c_custkey, c_name) FROM '{engine.root}/out_parquet' (FORMAT parquet); COPY customers FROM '{engine.root}/out_csv' WITH (FORMAT csv, HEADER true, DELIMITER ';', NULL 'none')")
    return engine.query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customers")
