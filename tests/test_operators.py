from pyspark.sql import functions as F

from loomshift.functions import predicates, scalars, types
from loomshift.operators import relational


def test_joins_and_grouping(spark):
    a = spark.range(20).selectExpr("id", "id % 3 as k")
    b = spark.range(3).selectExpr("id as k", "id * 10 as v")
    assert relational.join_checked(a, b, "k").count() == relational.join_checked(a, b, "k", most_rows=1).count() == 20
    spans = spark.createDataFrame([(0, 5), (4, 12)], "lo long, hi long")
    got = sorted((r.id, r.lo) for r in relational.range_join(a, spans, "id", "lo", "hi", 4).collect())
    assert got == sorted([(i, 0) for i in range(5)] + [(i, 4) for i in range(4, 12)])
    two = relational.grouped_salted(a, ["k"], 4, {"n": F.count(F.lit(1)), "s": F.sum("id")}, {"n": F.sum("n"), "s": F.sum("s")})
    assert sorted(map(tuple, two.collect())) == [(0, 7, 63), (1, 7, 70), (2, 6, 57)]
    assert sorted((r.k, r.id) for r in relational.distinct_on(a, ["k"], F.col("id")).collect()) == [(0, 18), (1, 19), (2, 17)]


def test_nulls_in_predicates_and_scalars(spark):
    df = spark.createDataFrame([(None, "a\\b"), (1, " x\n"), (2, None)], "n int, t string")
    one = df.select(
        predicates.in_list(F.col("n"), [1, None]).alias("i"),
        predicates.in_list(F.col("n"), [1, None], negate=True).alias("ni"),
        predicates.is_true(F.col("n") == 1).alias("t"),
        predicates.is_false(F.col("n") == 1).alias("f"),
        predicates.is_distinct(F.col("n"), F.lit(1)).alias("d"),
        predicates.like(F.col("t"), "a\\_").alias("l"),
        scalars.concat_skip_nulls("n", "t").alias("c"),
        scalars.trim_space(F.col("t")).alias("tr"),
        scalars.text_to_int(F.lit("12abc")).alias("p"),
        scalars.text_to_bool(F.lit("Yes")).alias("b"),
        scalars.int_div(F.lit(-7), F.lit(2)).alias("q"),
        scalars.format_type(F.col("n") + 22).alias("o"),
    ).collect()
    assert [r.i for r in one] == [None, True, None] and [r.ni for r in one] == [None, False, None]
    assert [r.t for r in one] == [False, True, False] and [r.f for r in one] == [False, False, True]
    assert [r.d for r in one] == [True, False, True] and [r.l for r in one] == [True, False, None]
    assert [r.c for r in one] == ["a\\b", "1 x\n", "2"] and one[1].tr == "x"
    assert one[0].p == 12 and one[0].b and one[0].q == -3 and [r.o for r in one] == ["-", "integer", "???"]


def test_type_names():
    names = {"INT": "int", "int2": "bigint", "numeric(10,2)": "decimal(10,2)", "NUMERIC": "double", "varchar(5)": "string", "character varying(9)": "string", "timestamp with time zone": "timestamp", "uuid": "string", "double precision": "double", "BOOL": "boolean"}
    assert {n: types.spark_type(n).simpleString() for n in names} == names
    assert types.varchar_length("VARCHAR(12)") == 12 and types.is_serial("BigSerial")
