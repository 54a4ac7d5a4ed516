import random

from spanloom.operators import reconcile

SCHEMA = "id string, v int, name string, score double, updated_at int"


def diff(spark, rows, a, b):
    left, right = (reconcile.latest_versions(spark.createDataFrame(x, SCHEMA), "id", "updated_at") for x in (a, b))
    return rows(reconcile.differences(left, right, "id", "only_left", "only_right", ("updated_at",)))


def test_differences_of_every_kind(spark, rows):
    a = [("k1", 1, "x", 0.5, 9), ("k1", 7, "old", 0.1, 3), ("k2", None, "x", None, 1), ("k3", 1, None, 1.0, 1), ("k5", 1, "", 1.0, None), ("k5", 1, "", 1.0, None)]
    b = [("k1", 1, "x", 0.5, 1), ("k2", None, "y", 2.0, 1), ("k4", 1, None, 1.0, 1), ("k5", 1, None, 1.0, 5)]
    assert diff(spark, rows, a, b) == [("k2", "name"), ("k2", "score"), ("k3", "only_left"), ("k4", "only_right"), ("k5", "name")]


def test_nulls_that_trade_places_are_seen(spark, rows):
    assert diff(spark, rows, [("k", None, "1", None, 1)], [("k", 1, None, None, 1)]) == [("k", "name"), ("k", "v")]


def test_empty_sides(spark, rows):
    assert diff(spark, rows, [], []) == []
    assert diff(spark, rows, [("k", 1, "", 0.0, 1)], []) == [("k", "only_left")]


def test_many_rows_against_brute_force(spark, rows):
    rng = random.Random(4)
    a = {f"k{i}": [i % 5, f"n{i % 3}", i / 7] for i in range(3000)}
    b = {k: list(v) for k, v in a.items()}
    want = set()
    for k in rng.sample(sorted(a), 40):
        if rng.random() < 0.3:
            del b[k]
            want.add((k, "only_left"))
        else:
            b[k][1] = None
            want.add((k, "name"))
    got = diff(spark, rows, [(k, *v, 1) for k, v in a.items()], [(k, *v, 1) for k, v in b.items()])
    assert set(got) == want and len(got) == len(want)


def test_extra_and_clashing_columns(spark, rows):
    left = spark.createDataFrame([("k", 1, 2, "l")], "id string, a_0 int, b_key int, only_here string")
    right = spark.createDataFrame([("k", 1, 3)], "id string, a_0 int, b_key int")
    assert rows(reconcile.differences(left, right, "id", "l", "r")) == [("k", "b_key")]


def test_null_keys_are_compared_like_values(spark, rows):
    assert diff(spark, rows, [(None, 1, "x", 0.0, 1)], [(None, 1, "y", 0.0, 1)]) == [(None, "name")]
