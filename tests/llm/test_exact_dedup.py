from loomshift.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, digest string"


def test_groups_with_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (2, "a"), (None, "a"), (None, "n"), (7, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "k", "d") for r in rows], SCHEMA)
    out = [tuple(r)[:4] for r in exact_dedup.assign_groups(docs).collect()]
    assert len(out) == len(rows)
    assert sorted(out, key=str) == sorted(
        [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, False), (None, 2, 4, False), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (None, None, 1, True), (7, 7, 1, True)],
        key=str,
    )
    kept = exact_dedup.keep_one(docs.withColumn("none", docs["text"]).withColumn("row", docs["text"]).withColumn("salt", docs["doc_id"])).drop("none", "row", "salt")
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "5", "7", "None"]


def test_hot_group_and_empty(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text", "'' as k", "'' as d")
    out = exact_dedup.assign_groups(docs)
    assert out.where("kept").count() == 2001 and out.where("group_size = 1000 and keep_id = 2997").count() == 1000
    assert exact_dedup.assign_groups(docs.limit(0)).count() == 0
