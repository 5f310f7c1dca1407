from loomshift.llm import shared


def rows(path, spark):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def test_tables_go_when_nothing_reads_them(spark):
    outer = shared.written(spark.range(3), "outer")
    with shared.tidy() as kept:
        first = shared.written(spark.range(3), "first")
        with shared.tidy() as inner:
            second, third = shared.written(spark.range(3), "second"), shared.written(spark.range(3), "third")
            inner.append(second)
        assert rows(second.loomshift_path, spark) and not rows(third.loomshift_path, spark)
        last = shared.written(second.union(first), "last")
        kept.append(last)
    assert not any(rows(t.loomshift_path, spark) for t in (first, second)) and last.count() == 6 and outer.count() == 3
    for t in (outer, last):
        shared.drop_written(t)
        assert not rows(t.loomshift_path, spark)


def test_a_failure_inside_leaves_no_tables(spark):
    made = []
    try:
        with shared.tidy():
            made.append(shared.written(spark.range(3), "made"))
            raise ValueError
    except ValueError:
        pass
    assert not rows(made[0].loomshift_path, spark)


def test_ranges_of_texts_are_bounded_by_bytes():
    assert shared.by_bytes([1, 1, 9, 1, 1, 1], 3) == [(0, 2), (2, 3), (3, 6)] and shared.by_bytes([], 3) == []
