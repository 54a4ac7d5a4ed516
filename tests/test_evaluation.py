from pyspark.sql import functions as F

from spanloom.operators import chains, claims, evaluation, publish
from spanloom.operators.evaluation import Rule
from spanloom.plans.eval_queries import FEATURES, RULES

SPANS = "corpus string, ref string, id string, no int, lo int, hi int, next_ref string, story boolean"


def test_scores_of_matched_left_over_and_missing_spans(spark):
    golden = spark.createDataFrame([("c", "p1", "g1", 0, 0, 3, "p2", True), ("c", "p1", "g2", 1, 6, 8, None, True), ("c", "p1", "g3", 2, 10, 12, None, False), ("c", "p2", "g4", 0, 0, 1, None, True), ("c", None, "g5", 0, 0, 1, None, True)], SPANS)
    found = spark.createDataFrame([("c", "p1", "f1", 0, 0, 3, "p2", True), ("c", "p1", "f2", 1, 10, 12, None, True), ("c", "p1", "f3", 2, 20, 22, None, True), ("c", "p9", "f4", 0, 0, 1, None, True), ("c", "p1", "f5", 3, 5, 4, None, True)], SPANS)
    r = evaluation.evaluate(golden, found).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 2, 2, 0)
    assert r["precision"] == 0.3333 and r["mean_iou"] == r["median_iou"] == 1.0 and r["merge_f1"] == 1.0
    assert r["composite"] == round(0.4 * r["f1"] + 0.4 + 0.2, 4)
    assert evaluation.evaluate(golden.limit(0), found).count() == 0


def verdict(spark, **answers):
    row = {f: answers.get(f) for f in FEATURES}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{f} string" for f in FEATURES))
    r = df.select(evaluation.decide(RULES, "biblical_actors").alias("v"), evaluation.blocking(RULES).alias("b")).first()
    return r["v"]["verdict"], r["v"]["feature"], r["v"]["rule"], r["b"]


def test_decision_table(spark):
    assert verdict(spark)[:3] == ("story", None, "R-C0")
    assert verdict(spark, custom="unsure", event_after_custom="yes")[:2] == ("unsure", "custom")  # an unsure precondition can't be passed over
    assert verdict(spark, custom="no", event_after_custom="no")[0] == "story"
    assert verdict(spark, custom="yes", event_after_custom="no")[:3] == ("not", "event_after_custom", "R-C3")
    assert verdict(spark, event_beyond_speech="no", conflict="yes")[0] == "borderline"
    assert verdict(spark, event_beyond_speech="no", conflict="unsure")[:2] == ("unsure", "conflict")
    assert verdict(spark, biblical_actors="yes")[0] == "out_of_scope" and verdict(spark, biblical_actors="unsure")[:2] == ("unsure", "biblical_actors")
    got = verdict(spark, commentary="yes", actual="no", biblical_actors="yes")
    assert got[:2] == ("not", "commentary") and got[3] == ["commentary:R-B4", "actual:R-C0"]


def test_one_rule_table(spark):
    df = spark.createDataFrame([("yes", "no"), ("yes", "yes"), (None, "no")], "a string, scope string")
    got = df.select(evaluation.decide([Rule("a", "yes", "not", "R")], "scope").alias("v")).select("v.verdict").collect()
    assert [r[0] for r in got] == ["not", "not", "story"]


def test_ship_filter_names_the_first_gate(spark):
    s = spark.createDataFrame([(i, "p", n, n, c) for n, (i, c) in enumerate([("a", "YES"), ("b", "LOW"), ("c", "YES"), ("d", "YES"), ("e", "YES"), ("f", "LOW"), ("g", "YES"), ("h", None)])], "id string, ref string, lo int, hi int, classification string")
    cell = lambda *segs: spark.createDataFrame([("p", x) for x in segs], "ref string, seg int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r["id"]: (r["ships"], r["why"]) for r in evaluation.ship_filter(s, cell(0, 1, 3, 4, 5, 6), cell(3), cell(0, 3, 6), ids("f", "g"), ids("g", "zz")).collect()}
    assert got == {"a": (True, None), "b": (False, "grade"), "c": (False, "no_evidence"), "d": (False, "judges"), "e": (False, "other_run"), "f": (True, None), "g": (False, "removed"), "h": (False, "grade")}


def test_gate_on_its_limit(spark):
    df = spark.createDataFrame([("s", 0.1, 0.9), ("t", 0.11, None)], "scope string, a double, b double")
    got = {(r["scope"], r["check"]): r["status"] for r in evaluation.gate(df, [("a", "red", "max", 0.1), ("b", "red", "min", 0.9)]).collect()}
    assert got == {("s", "a"): "green", ("s", "b"): "green", ("t", "a"): "red", ("t", "b"): "amber"}


def test_ids_refuse_ties_revive_redirect_and_retire(spark, rows):
    stories = spark.createDataFrame([("s1", "p", 0, 3), ("s2", "p", 10, 11), ("s3", "q", 0, 1), ("s4", "r", 5, 6), ("old", "t", 0, 0)], "story string, ref string, lo int, hi int")
    registry = spark.createDataFrame([("a", "p", 0, 2, "active"), ("b", "p", 3, 3, "active"), ("c", "q", 0, 0, "active"), ("d", "q", 1, 1, "active"), ("e", "r", 5, 6, "retired"), ("f", "z", 0, 0, "active"), ("old", "y", 0, 0, "retired"), ("old-v2", "y", 0, 0, "active")], "id string, ref string, lo int, hi int, status string")
    got = rows(publish.assign_ids(stories, registry))
    assert got == rows(spark.createDataFrame([("s1", "a", "kept"), ("s1", "b", "redirected"), ("s3", None, "refused"), ("s4", "e", "revived"), ("s2", "s2", "minted"), ("old", "old-v3", "minted"), (None, "f", "retired"), (None, "old-v2", "retired")], "story string, id string, how string"))
    assert publish.assign_ids(stories.limit(0), registry.limit(0)).count() == 0


def test_verdicts_claims_and_extras(spark, rows):
    spans = spark.createDataFrame([("a", "p", 0, 3), ("b", "p", 5, 6), ("c", "q", 0, 0)], "id string, ref string, lo int, hi int")
    reviews = spark.createDataFrame([("p", 0, 3, "yes"), ("p", 2, 2, "no"), ("p", 6, 9, "no"), (None, 0, 0, "yes"), ("p", 5, 4, "yes")], "ref string, lo int, hi int, said string")
    assert rows(claims.attach_verdicts(spans, reviews)) == [("a", "exact", True), ("b", "overlap", False), ("c", None, None)]
    cell = lambda *x: spark.createDataFrame(list(x), "id string, ref string, seg int")
    got = rows(claims.two_level_claims(cell(("e1", "p", 1)), cell(("e1", "p", 5), ("e2", "p", 6)), spans))
    assert got == rows(spark.createDataFrame([("e1", "a", True), ("e2", "b", False), (None, "c", None)], "entry string, id string, strict boolean"))
    one = lambda *x: spark.createDataFrame(list(x), "ref string, no int, id string, lo int, hi int")
    assert rows(claims.add_extras(one(("p", 0, "a", 0, 3)), one(("p", 0, "x", 3, 4), ("p", 1, "y", 5, 6), ("p", 2, "z", 6, 7), ("q", 0, "w", 0, 0), (None, 0, "n", 0, 0)))) == [("p", "y"), ("q", "w")]


def test_tight_segments_either_way(spark, rows):
    p = spark.createDataFrame([("e", "p", "one two three four five six seven eight"), ("n", "p", None)], "id string, ref string, text string")
    s = spark.createDataFrame([("p", 0, "one two three four five"), ("p", 1, "nothing of the kind is here"), ("p", 2, "x one two three four five six seven eight y z"), ("p", 3, None)], "ref string, seg int, text string")
    assert [r[2] for r in rows(claims.tight_segments(p, s))] == [0, 2]


def test_changes_are_refused_until_none_clashes(spark):
    s = spark.createDataFrame([("a", "p", 0, 1), ("b", "p", 3, 4), ("c", "p", 8, 9), ("d", "p", 9, 9)], "id string, ref string, lo int, hi int")
    c = spark.createDataFrame([("a", 0, 2), ("b", 2, 5), ("c", 7, 9), ("zz", 0, 0)], "id string, new_lo int, new_hi int")
    assert {r["id"]: r["applied"] for r in claims.refuse_clashing(s, c).collect()} == {"a": False, "b": False, "c": True, "zz": True}


def test_steps_status_notes_and_rounds(spark, rows):
    st = spark.createDataFrame([("u", "a", "done", "green"), ("u", "b", "pending", None), ("u", "c", "pending", None), ("v", "a", "done", "red"), ("v", "b", "pending", None)], "unit string, step string, state string, color string")
    assert rows(claims.ready_steps(st, spark.createDataFrame([("b", "a"), ("c", "b")], "step string, needs string"))) == [("u", "b")]
    rec = lambda *x: spark.createDataFrame(list(x), "unit string, step string, state string, cost double")
    assert rows(claims.merge_status(rec(("u", "a", "done", 2.0), ("w", "a", "done", 1.0)), rec(("u", "a", "skipped", 0.0), ("x", "a", "done", 3.0)))) == [("u", "a", "skipped", 2.0), ("w", "a", "done", 1.0), ("x", "a", "done", 3.0)]
    old = spark.createDataFrame([("a", "A", True), ("b", "B", False), ("c", "C", None)], "id string, note string, approved boolean")
    new = spark.createDataFrame([("a", "x", None), ("b", "y", "too long"), ("d", "z", None)], "id string, note string, problem string")
    assert rows(claims.merge_notes(old, new)) == [("a", "A", True, "approved"), ("b", "y", False, "held"), ("c", "C", False, "kept"), ("d", "z", False, "drafted")]
    done = spark.createDataFrame([("u", 1, "x"), ("u", 1, "y"), ("u", 2, "x"), ("u", 3, "x"), ("u", 3, "y"), ("v", 2, "x")], "who string, round int, item string")
    assert rows(claims.completed_rounds(done, done, "who")) == [("u", 1), ("v", 0)]


def test_boundaries_from_roles(spark, rows):
    r = spark.createDataFrame([("s", i, x in "iu", x == "u") for i, x in enumerate("oiioiiio")] + [("t", 0, False, False), ("t", 1, False, False)] + [("v", i, x == "i", x == "u") for i, x in enumerate("iu")], "k string, clause int, inside boolean, unclear boolean")
    assert rows(chains.boundary_from_roles(r, ["k"])) == [("s", 1, 6, False, False), ("t", 0, 1, True, True), ("v", 0, 0, False, True)]
    assert rows(chains.boundary_from_roles(r, ["k"], longest=True))[0] == ("s", 4, 6, False, False)


def test_actor_and_marker_scalars(spark):
    from spanloom.functions import text

    df = spark.createDataFrame([("Moses, and Aaron",), ("Rabbi Eli and Moses",), ("Elijah",), ("r.Eliezer",), (None,)], "c string")
    got = df.select(text.only_named(F.col("c"), ["moses", "aaron", "eli"], ["rabbi", "r."], ["man"]).alias("o"), text.names_token(F.col("c"), "r.").alias("r")).collect()
    assert [r["o"] for r in got] == [True, False, False, False, False] and [r["r"] for r in got] == [False, False, False, True, None]
    a = spark.createDataFrame([('```json\n{"stories": [{"a": 1},]}\n```',), ('[{"stories": [{"b": 2}]}]',), ('[{"c": 3}, {"d": 4}]',), ("no json",), (None,)], "c string")
    assert [r[0] for r in a.select(text.answer_list(F.col("c"))).collect()] == [['{"a":1}'], ['{"b":2}'], ['{"c":3}', '{"d":4}'], [], []]
    v = spark.createDataFrame([("YES", ["legal frame"], 5), ("YES", [], 2), ("YES", [], 1), ("LOW_CONFIDENCE", ["speech only"], 4), ("NOT_A_STORY", ["legal"], 0), ("YES", None, None)], "c string, w array<string>, n int")
    assert [r[0] for r in v.select(text.needs_validation(F.col("c"), F.col("w"), F.col("n"))).collect()] == [True, False, True, True, False, True]
    e = spark.createDataFrame([("", "s", ["x"]), (None, "", ["x", "y"]), (None, None, None)], "a string, b string, e array<string>")
    assert [r[0] for r in e.select(text.pick_summary(F.col("a"), F.col("b"), events=F.col("e"))).collect()] == ["s", "x; y", "(no summary available)"]
