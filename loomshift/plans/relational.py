"""Read-only relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshift.functions import predicates, scalars
from loomshift.operators import relational
from loomshift.plans.engine import Engine
from loomshift.plans.registry import register
from loomshift.sources.storage import scratch_dir
from loomshift.sources.tables import table


@register(
    "q_flagship",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, count(*) AS n
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND l_returnflag = 'R' GROUP BY n_name ORDER BY rev DESC, n_name LIMIT 10""",
)
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, join chain, grouping and top k. Catalyst picks each join's strategy by size."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("rev"), F.count("*").alias("n"))
        .orderBy(F.desc("rev"), "n_name")
        .limit(10)
    )


def by_sql(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    """Register a query that an engine runs over attached tables; `oracle` where DuckDB needs another spelling."""

    @register(name, oracle or text)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, scratch_dir(spark))
        for t in tables.split():
            engine.attach(t, engine.spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        return engine.query(text)


# scans, projection, parameters
by_sql("scan_project", "customer", "SELECT c_custkey AS id, c_name AS customer_name, c_acctbal FROM customer")
by_sql("project_star", "region", "SELECT * FROM region")
by_sql("project_qualified_star", "nation region", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
by_sql("project_literals", "", "SELECT 1 AS i, CAST(1.5 AS DOUBLE) AS d, 'text' AS t, true AS b, CAST(NULL AS INT) AS n")
by_sql("select_without_from", "", "SELECT 2 + 3 AS five, upper('ox') AS up")

# predicates
by_sql("filter_compare", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus <> 'F' AND NOT (o_orderdate < TIMESTAMP '1996-06-01 00:00:00')")
by_sql(
    "filter_kleene",
    "nation",
    """SELECT n_nationkey, nullif(n_regionkey, 1) = 2 AND n_nationkey > 10 AS a, nullif(n_regionkey, 1) = 2 OR n_nationkey > 10 AS o,
       NOT (nullif(n_regionkey, 1) = 2) AS n, nullif(n_regionkey, 1) IN (2, NULL) AS i FROM nation""",
)
by_sql("filter_like", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_brand NOT LIKE 'Brand#1_'")
by_sql("filter_ilike", "part", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_type NOT ILIKE 'standard%'")
by_sql("filter_in", "events", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3)")
by_sql("filter_between", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-03-01 00:00:00' AND l_quantity NOT BETWEEN 5 AND 45")
by_sql("filter_null", "nation", "SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 2) IS NULL UNION ALL SELECT n_nationkey + 100 FROM nation WHERE nullif(n_regionkey, 2) IS NOT NULL")
by_sql("filter_is_true", "nation", "SELECT n_nationkey, (nullif(n_regionkey, 2) = 1) IS TRUE AS t, (nullif(n_regionkey, 2) = 1) IS NOT TRUE AS nt, (nullif(n_regionkey, 2) = 1) IS FALSE AS f FROM nation")
by_sql("filter_distinct_from", "nation", "SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 2) IS DISTINCT FROM 1 AND nullif(n_regionkey, 3) IS NOT DISTINCT FROM nullif(n_regionkey, 3)")
by_sql("filter_any", "events", "SELECT event_id FROM events WHERE event_type = ANY (ARRAY['click', 'error'])", "SELECT event_id FROM events WHERE event_type = ANY(['click', 'error'])")
by_sql("filter_regex", "customer", "SELECT c_custkey FROM customer WHERE c_name RLIKE '0[13579]$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0[13579]$')")

# joins
by_sql("join_inner_equi", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
by_sql("join_left", "orders lineitem", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40")
by_sql("join_right", "supplier nation", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
by_sql("join_full", "supplier nation", "SELECT n_name, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey < 15) n FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 5) s ON s_nationkey = n_nationkey")
by_sql("join_theta", "nation", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
by_sql("join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
by_sql("join_comma", "region nation supplier", "SELECT r_name, n_name, s_suppkey FROM region, nation, supplier WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey")
by_sql("join_self_alias", "nation", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
by_sql("join_three_way", "region nation supplier", "SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
by_sql("join_using", "nation region", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) n JOIN (SELECT r_regionkey AS k, r_name FROM region) r USING (k)")
by_sql("join_natural", "nation region", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) n NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) r")
by_sql("join_semi", "orders lineitem", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
by_sql("join_anti", "orders lineitem", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")

# aggregation
by_sql("agg_global", "lineitem", "SELECT count(*) AS n, count(l_tax) AS c, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS s, round(avg(l_discount), 6) AS a, min(l_shipdate) AS lo, max(l_comment) AS hi FROM (SELECT *, l_returnflag AS l_comment FROM lineitem) t")
by_sql("agg_empty", "lineitem", "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_quantity) AS lo FROM lineitem WHERE l_quantity < 0")
by_sql("agg_group_multi", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
by_sql("agg_null_group", "nation", "SELECT nullif(n_regionkey, 1) AS k, count(*) AS n, count(nullif(n_nationkey, 3)) AS c FROM nation GROUP BY nullif(n_regionkey, 1)")
by_sql("agg_sum_int", "lineitem", "SELECT l_returnflag, CAST(sum(l_linenumber) AS DOUBLE) AS s FROM lineitem GROUP BY l_returnflag")
by_sql("agg_avg", "orders", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderpriority")
by_sql("agg_minmax", "orders", "SELECT o_orderstatus, min(o_orderdate) AS lo, max(o_orderdate) AS hi, min(o_orderpriority) AS first_priority, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus")
by_sql("agg_expr", "lineitem", "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_linestatus")
by_sql("agg_ratio", "lineitem", "SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 4) AS mean_price FROM lineitem GROUP BY l_returnflag")
by_sql("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
by_sql("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
by_sql("agg_group_expr", "orders", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
by_sql("agg_group_ordinal", "nation", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 ORDER BY 2 DESC, 1")
by_sql("agg_string", "nation", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
by_sql("agg_filter_clause", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_orderpriority")

# order and limits
by_sql("sort_nulls", "nation", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY nullif(n_regionkey, 2) ASC NULLS FIRST, n_nationkey) AS BIGINT) AS up, CAST(row_number() OVER (ORDER BY nullif(n_regionkey, 2) DESC NULLS LAST, n_nationkey) AS BIGINT) AS down FROM nation")
by_sql("sort_nulls_last", "nation", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY nullif(n_regionkey, 2) ASC NULLS LAST, n_nationkey) AS BIGINT) AS up FROM nation")
by_sql("sort_expression", "nation", "SELECT n_name, length(n_name) AS size FROM nation ORDER BY length(n_name) DESC, n_name LIMIT 7", "SELECT n_name, CAST(length(n_name) AS INT) AS size FROM nation ORDER BY length(n_name) DESC, n_name LIMIT 7")
by_sql("topk_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
by_sql("agg_order_limit", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5")

# set operations and subqueries
by_sql("set_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
by_sql("set_union_all", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
by_sql("set_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
by_sql("set_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
by_sql("select_distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
by_sql("cte_subquery", "orders", "WITH spent AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY o_custkey) SELECT o_custkey, CAST(s AS DOUBLE) AS s FROM spent WHERE s > (SELECT avg(s) FROM spent) * 2")
by_sql("in_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")

# scalar functions
by_sql("fn_arith_int", "orders", "SELECT o_orderkey, o_custkey + 1 AS a, o_custkey - 5 AS s, o_custkey * 2 AS m, o_custkey div 7 AS d, o_custkey % 7 AS r, -o_custkey AS n, -7 % 3 AS neg FROM orders", "SELECT o_orderkey, o_custkey + 1 AS a, o_custkey - 5 AS s, o_custkey * 2 AS m, o_custkey // 7 AS d, o_custkey % 7 AS r, -o_custkey AS n, -7 % 3 AS neg FROM orders")
by_sql("fn_arith_double", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 6) AS q, round(l_extendedprice * l_tax, 6) AS t FROM lineitem")
by_sql("fn_case", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
by_sql("fn_coalesce_nullif", "nation", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 2), -1) AS c, nullif(n_name, 'x') AS n, greatest(n_regionkey, 2) AS g, least(n_regionkey, 2) AS l FROM nation")
by_sql("fn_abs", "customer", "SELECT c_custkey, abs(c_acctbal) AS a, abs(-c_nationkey) AS k FROM customer")
by_sql("fn_cast", "customer", "SELECT c_custkey, CAST(c_acctbal AS INT) AS i, CAST(c_custkey AS STRING) AS t, CAST('12' AS INT) AS n, CAST(c_nationkey AS BOOLEAN) AS b, c_nationkey::DOUBLE AS d FROM customer", "SELECT c_custkey, CAST(trunc(c_acctbal) AS INT) AS i, CAST(c_custkey AS VARCHAR) AS t, CAST('12' AS INT) AS n, CAST(c_nationkey AS BOOLEAN) AS b, c_nationkey::DOUBLE AS d FROM customer")


@register(
    "fn_string",
    """SELECT c_custkey, lower(c_name) AS lo, upper(c_name) AS up, CAST(length(c_name) AS INT) AS n, substring(c_name, 3, 5) AS mid, substring(c_name, 1, 4) AS head, '' AS past,
       trim(c_name) AS trimmed, concat(c_name, NULL, '-', c_nationkey) AS joined FROM customer""",
)
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    padded = F.concat(F.lit(" \t"), name, F.lit("\n "))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lower(name).alias("lo"),
        F.upper(name).alias("up"),
        F.length(name).alias("n"),
        scalars.substr(name, 3, 5).alias("mid"),
        scalars.substr(name, -3, 4).alias("head"),
        scalars.substr(name, 1000).alias("past"),
        scalars.trim_space(padded).alias("trimmed"),
        scalars.concat_skip_nulls(name, F.lit(None), F.lit("-"), F.col("c_nationkey")).alias("joined"),
    )


@register("fn_to_char", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t FROM orders")
def fn_to_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.to_char(F.col("o_orderdate")).alias("t"))


@register("fn_sum_double", "SELECT n_regionkey, CAST(sum(n_nationkey) AS DOUBLE) AS s FROM nation GROUP BY n_regionkey")
def fn_sum_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(scalars.sum_double(F.col("n_nationkey")).alias("s"))


@register("predicate_helpers", "SELECT n_nationkey, n_name LIKE '%A%' AS l, n_name ILIKE '%a_a%' AS i, nullif(n_regionkey, 1) NOT IN (2, 3) AS n, n_nationkey BETWEEN 3 AND 9 AS b FROM nation WHERE nullif(n_regionkey, 1) IS DISTINCT FROM 4")
def predicate_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.nullif(F.col("n_regionkey"), F.lit(1))
    return (
        table(spark, sf_dir, "nation")
        .where(predicates.is_distinct(region, F.lit(4)))
        .select(
            "n_nationkey",
            predicates.like(F.col("n_name"), "%A%").alias("l"),
            predicates.like(F.col("n_name"), "%a_a%", ignore_case=True).alias("i"),
            predicates.in_list(region, [2, 3], negate=True).alias("n"),
            predicates.between(F.col("n_nationkey"), F.lit(9), F.lit(3), symmetric=True).alias("b"),
        )
    )


@register("join_checked", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def join_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right side is sent out only if its size, which is counted, allows it."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return relational.join_checked(table(spark, sf_dir, "orders"), rich, "o_custkey").select("o_orderkey", "c_mktsegment")


@register("join_range", "SELECT o_orderkey, lo FROM orders JOIN (SELECT CAST(i * 700 AS BIGINT) AS lo, CAST(i * 700 + 1000 AS BIGINT) AS hi FROM range(40) t(i)) s ON o_custkey >= lo AND o_custkey < hi")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping ranges by buckets: an equi-join in place of a nested loop."""
    spans = spark.range(40).selectExpr("id * 700 AS lo", "id * 700 + 1000 AS hi")
    return relational.range_join(table(spark, sf_dir, "orders"), spans, "o_custkey", "lo", "hi", 500).select("o_orderkey", "lo")


@register("agg_salted", "SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag")
def agg_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few, hot keys in two steps."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_extendedprice")
    return relational.grouped_salted(rows, ["l_returnflag"], 16, {"n": F.count(F.lit(1)), "top": F.max("l_extendedprice")}, {"n": F.sum("n"), "top": F.max("top")})


@register("distinct_on", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user."""
    return relational.distinct_on(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))
