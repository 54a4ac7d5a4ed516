import json
import random

from spanloom.operators import drift


def changes(spark, rows, *files):
    data = [("s", i + 1, json.dumps(o) if isinstance(o, dict) else o) for i, f in enumerate(files) for o in f]
    return rows(report(spark.createDataFrame(data, "stream_name string, file_seq bigint, raw string")))


TARGET = {"first": "integer", "verdict": "string", "b": "list of integers"}


def report(df, target=TARGET):
    return drift.change_report(drift.ingest(df, "raw", target, exact=True), "stream_name", "file_seq", target)


def lines(n, seed, **names):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lo = rng.randint(0, 25)
        hi = lo + rng.randint(1, 6)
        row = {"first": lo, "last": hi, "code": f"{rng.randrange(16**6):06X}", "verdict": rng.choice(["story", "not"]), "ms": rng.randint(1000, 90000)}
        out.append({names.get(k, k): v for k, v in row.items()})
    return out


def test_no_change_and_first_file(spark, rows):
    assert changes(spark, rows, lines(20, 1), lines(20, 2)) == []


def test_added_and_removed(spark, rows):
    later = [{k: v for k, v in o.items() if k != "verdict"} | {"pass": 1} for o in lines(20, 3)]
    assert changes(spark, rows, lines(20, 1), later) == [(2, "added", "pass", ""), (2, "removed", "verdict", "")]


def test_renamed_pairs_keep_their_order(spark, rows):
    assert changes(spark, rows, lines(25, 1), lines(25, 2, first="begin", last="stop")) == [(2, "renamed", "first", "begin"), (2, "renamed", "last", "stop")]


def test_renamed_and_retyped(spark, rows):
    later = [{**{k: v for k, v in o.items() if k != "first"}, "start": f"{o['first']:02d}"} for o in lines(25, 2)]
    assert changes(spark, rows, lines(25, 1), later) == [(2, "renamed", "first", "start"), (2, "retyped", "start", "")]


def test_types_nulls_bad_lines_and_repeats(spark, rows):
    one = [{"a": 1, "b": [1], "c": None}, {"a": None, "b": [2]}, "not json", "[1]", None, ""]
    two = [{"a": 1.5, "b": ["x"], "c": [{"k": 1}]}] * 2
    assert changes(spark, rows, one, two) == [(2, "added", "c", ""), (2, "retyped", "a", ""), (2, "retyped", "b", "")]


def test_empty_table(spark, rows):
    df = spark.createDataFrame([], "stream_name string, file_seq bigint, raw string")
    assert rows(report(df)) == []


def test_ingest_rescues_and_promotes(spark):
    raw = ['{"first": 1, "x": [1, 2], "tag": "t"}', '{"first": "07", "x": "no"}', '{"first": 1.5, "start": 9}', "broken", None, '{"first": null, "start": 4}']
    df = spark.createDataFrame([(i, r, 5) for i, r in enumerate(raw)], "n int, raw string, first int")
    table = drift.ingest(df, "raw", {"first": "integer", "x": "list of integers"}, {"start": "first"})
    got = {r["n"]: r for r in table.collect()}
    assert [got[i]["first"] for i in range(6)] == [1, 7, None, None, None, 4]
    assert got[0]["x"] == [1, 2] and json.loads(got[0]["_rescued"]) == {"tag": "t"}
    assert json.loads(got[1]["_rescued"]) == {"x": "no"} and got[1]["line_first"] == 5
    assert json.loads(got[2]["_rescued"])["first"] == 1.5
    assert json.loads(got[3]["_rescued"]) == {"_line": "broken"} and got[4]["_rescued"] is None
    more = {r["n"]: r for r in drift.promote(table, {"tag": "string"}).collect()}
    assert more[0]["tag"] == "t" and more[0]["_rescued"] is None and json.loads(more[1]["_rescued"]) == {"x": "no"}


def test_renamed_values_are_replayed_into_typed_columns(spark):
    own, other = lines(25, 2, first="begin", last="stop"), lines(25, 4)
    data = [(s, f, json.dumps(o)) for s, f, part in (("s", 1, lines(25, 1)), ("s", 2, own), ("s", 3, lines(25, 3)), ("t", 4, lines(25, 5, first="begin", last="stop")), ("t", 5, other), ("u", 6, lines(25, 6, first="begin"))) for o in part]
    df = spark.createDataFrame([*data, ("s", 2, "broken"), ("s", 2, '{"begin": 7, "first": 3}'), ("s", 2, '{"begin": "none"}'), (None, 9, '{"begin": 1}')], "stream_name string, file_seq bigint, raw string")
    target = {"first": "integer", "last": "integer"}
    names = drift.approved_names(df, report(df, target), "stream_name", "file_seq", list(target))
    got = drift.promote(drift.ingest(df, "raw", target).join(names, ["stream_name", "file_seq"], "left"), target, "names").collect()
    assert "names" not in got[0].asDict() and len(got) == df.count()
    at = lambda f: sorted((r["first"], r["last"]) for r in got if r["file_seq"] == f and r["last"] is not None)
    assert at(2) == sorted((o["begin"], o["stop"]) for o in own) and len(at(4)) == 25 and at(5) == sorted((o["first"], o["last"]) for o in other)
    assert len([r for r in got if r["file_seq"] == 6 and r["first"] is not None]) == 25
    kept = [json.loads(r["_rescued"]) for r in got if r["_rescued"] and "ms" not in r["_rescued"]]
    assert sorted(map(json.dumps, kept)) == sorted(map(json.dumps, [{"_line": "broken"}, {"begin": 7}, {"begin": "none"}, {"begin": 1}]))


def test_typed_and_rescued_fields_give_one_report(spark, rows):
    files = [lines(25, 1), lines(25, 2, first="begin", last="stop"), [{**o, "ms": str(o["ms"])} for o in lines(25, 3, first="begin", last="stop")]]
    df = spark.createDataFrame([("s", i, json.dumps(o)) for i, f in enumerate(files) for o in f], "stream_name string, file_seq bigint, raw string")
    want = [(1, "renamed", "first", "begin"), (1, "renamed", "last", "stop"), (2, "retyped", "ms", "")]
    every = {"first": "integer", "last": "integer", "begin": "integer", "code": "string", "verdict": "string", "ms": "integer"}
    assert rows(report(df, {})) == rows(report(df, every)) == want


def test_exact_ingestion_keeps_values_as_written(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(['{"first": 7}', '{"first": "07"}', '{"first": 7.0}', '{"x": []}', '{"x": [1, null]}'])], "n int, raw string")
    table = drift.ingest(df, "raw", {"first": "integer", "x": "list of integers"}, exact=True)
    got = {r["n"]: r for r in table.collect()}
    assert [got[i]["first"] for i in range(3)] == [7, None, None] and got[3]["x"] == [] and json.loads(got[4]["_rescued"]) == {"x": [1, None]}
    replayed = {r["n"]: r["first"] for r in drift.promote(table, {"first": "integer"}).collect()}
    assert [replayed[i] for i in range(3)] == [7, 7, 7]


def test_assignment_is_the_best_of_all():
    import itertools

    rng = random.Random(7)
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (3, 6)):
        left, right = [f"l{i}" for i in range(n)], [f"r{i}" for i in range(m)]
        value = {(f, g): rng.random() for f in left for g in right if rng.random() < 0.7}
        got = drift.best_pairs(value, left, right)
        assert len(set(got.values())) == len(got) and all(p in value for p in got.items())
        options = itertools.permutations([*right, *[None] * n], n)
        best = max(sum(value.get((f, g), 0.0) for f, g in zip(left, o) if g) for o in options)
        assert abs(sum(value[p] for p in got.items()) - best) < 1e-9


def test_many_renamed_fields_at_once(spark, rows):
    def wide(seed, prefix):
        rng = random.Random(seed)
        return [{f"{prefix}{j}": rng.randint(100 * j, 100 * j + 60) for j in range(9)} for _ in range(30)]

    assert changes(spark, rows, wide(1, "a"), wide(2, "z")) == [(2, "renamed", f"a{j}", f"z{j}") for j in range(9)]


def test_casts_lose_nothing(spark):
    raw = ['{"v": "3-6"}', '{"v": "4, 5"}', '{"v": 9}', '{"v": [{"i": 2}, {"i": 5}]}', '{"v": [{"seg": 2, "kept": true}]}', '{"v": [{"seg": 2, "kept": false}]}', '{"v": [{"a": 1, "b": 2}]}', '{"v": "x"}', '{"v": ["7", "8"]}', '{"v": []}']
    df = spark.createDataFrame(list(enumerate(raw)), "n int, raw string")
    got = {r["n"]: r["v"] for r in drift.ingest(df, "raw", {"v": "list of integers"}).collect()}
    assert [got[i] for i in range(10)] == [[3, 4, 5, 6], [4, 5], [9], [2, 5], [2], None, None, None, [7, 8], []]
    flags = spark.createDataFrame(list(enumerate(['{"v": "yes"}', '{"v": 0}', '{"v": true}', '{"v": 2}', '{"v": "R-1; R-2"}'])), "n int, raw string")
    assert [r["v"] for r in drift.ingest(flags, "raw", {"v": "boolean"}).orderBy("n").collect()] == [True, False, True, None, None]
    assert drift.ingest(flags, "raw", {"v": "list of strings"}).orderBy("n").collect()[4]["v"] == ["R-1", "R-2"]
