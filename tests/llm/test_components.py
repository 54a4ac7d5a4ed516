import random

from spanloom.llm import components

SCHEMA = "kind string, ids array<string>, groups array<struct<keep:string, members array<struct<card:string>>>>".replace("members array", "members:array")


def brute(sets):
    label = {}
    for s in sets:
        s = {x for x in s if x is not None}
        if len(s) > 1:
            merged = set(s)
            for x in s:
                merged |= label.get(x, {x})
            for x in merged:
                label[x] = merged
    return sorted((x, min(g)) for x, g in label.items())


def test_chains_stars_and_cliques(spark, rows):
    rng = random.Random(2)
    sets = [[f"c{i:04d}", f"c{i + 1:04d}"] for i in range(300)]  # one long chain
    sets += [["hub", f"leaf{i}"] for i in range(200)] + [[f"q{rng.randrange(60)}" for _ in range(rng.randint(1, 4))] for _ in range(40)]
    sets += [["self", "self"], [None, "alone"], [], [None], ["t", None, "u"], ["t", "u"]]
    rng.shuffle(sets)
    df = spark.createDataFrame([(s,) for s in sets] + [(None,)], "members array<string>")
    assert rows(components.group_ids(df, "members")) == brute(sets)


def test_empty(spark):
    assert components.group_ids(spark.createDataFrame([], "members array<string>"), "members").count() == 0


def test_which_decisions_match(spark, rows):
    g = lambda *cards: ("k", [(c,) for c in cards])
    df = spark.createDataFrame([("merge", ["a", "b"], [g("c", "d"), g("e", None)]), ("keep", ["x", "y"], None), (None, ["x", "z"], None), ("merge", None, [g("b", "f"), None])], SCHEMA)
    assert rows(components.group_ids(components.merge_matches(df), "members")) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("f", "a")]


def test_heavy_hub_takes_the_broadcast_path(spark):
    sets = [["hub", f"leaf{i:05d}"] for i in range(24_000)] + [[f"p{i:04d}", f"p{i + 1:04d}"] for i in range(0, 2000, 2)]
    df = spark.createDataFrame([(s,) for s in sets], "members array<string>")
    got = {r["card_id"]: r["group_id"] for r in components.group_ids(df, "members").collect()}
    assert len(got) == 24_001 + 2000 and got["leaf23999"] == got["hub"] == "hub"
    assert all(got[f"p{i:04d}"] == got[f"p{i + 1:04d}"] == f"p{i:04d}" for i in range(0, 2000, 2))


def test_colliding_codes_are_set_apart(spark, rows):
    from pyspark.sql import functions as F

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "a string, b string")
    coded = rows(components._codes(edges, lambda c: F.when(F.col(c).isin("a", "b", "e"), 8).otherwise(F.xxhash64(c)).cast("bigint")))
    assert [c for c, _ in coded] == list("abcde") and len({v for _, v in coded}) == 5
    assert dict(coded)["a"] == 1 and dict(coded)["b"] == 3 and dict(coded)["e"] == 5
