from spanloom import runtime


def test_lookup_of_heavy_and_null_keys(spark):
    left = runtime.materialize(spark.range(40_000).selectExpr("case when id < 30000 then 'hot' when id < 30010 then null else concat('k', id % 500) end as k", "id"))
    right = spark.createDataFrame([("hot", 1), ("k7", 2)], "k string, v int")
    heavy = runtime.find_heavy(left, "k", left.count())
    assert [r["k"] for r in heavy.collect()] == ["hot"]
    for how in ("left", "inner"):
        a = runtime.lookup(left, right, "k", heavy, how).select("id", "k", "v")
        b = left.join(right, "k", how).select("id", "k", "v")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_store_round_trip(spark):
    df = spark.createDataFrame([(1, b"x"), (2, None)], "a int, b binary")
    assert sorted(runtime.store(df).collect()) == sorted(df.collect())
