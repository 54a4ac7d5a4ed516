import random

import pytest

from spanloom.operators import publish, scoring, spans


def frame(spark, data):
    return spark.createDataFrame(data, "id string, ref string, lo int, hi int")


def sample(seed, n=60):
    rng = random.Random(seed)
    return [(f"s{i:03d}", rng.choice(["p1", "p2", "p3"]), lo, lo + rng.randint(0, 5)) for i, lo in enumerate(rng.randint(0, 40) for _ in range(n))]


def test_validator_cases(spark, rows):
    pages = spark.createDataFrame([("p", 9)], "ref string, last int")
    data = [("null", "p", None, 3), ("swap", "p", 5, 2), ("swap_off", "p", 12, 4), ("off", "p", 10, 12), ("before", "p", -4, -1), ("clamp", "p", -2, 20), ("keep", "p", 0, 9), ("nopage", "q", 0, 1)]
    got = {r[0]: r[1:] for r in rows(spans.validate(frame(spark, data), pages), "id", "action", "lo", "hi")}
    assert got == {"null": ("drop", None, None), "swap": ("collapse", 5, 5), "swap_off": ("drop", None, None), "off": ("drop", None, None), "before": ("drop", None, None), "clamp": ("clamp", 0, 9), "keep": ("keep", 0, 9), "nopage": ("drop", None, None)}


def test_greedy_match_against_loops(spark):
    a, b = sample(1), sample(2)
    got = {(r["g_id"], r["f_id"]) for r in spans.greedy_match(frame(spark, a), frame(spark, b)).collect()}
    want = set()
    for p in ("p1", "p2", "p3"):
        free = sorted([x for x in b if x[1] == p], key=lambda x: (x[2], x[3], x[0]))
        for g in sorted([x for x in a if x[1] == p], key=lambda x: (x[2], x[3], x[0])):
            best, at = 0.0, None
            for f in free:
                inter = max(0, min(g[3], f[3]) - max(g[2], f[2]) + 1)
                score = inter / ((g[3] - g[2] + 1) + (f[3] - f[2] + 1) - inter)
                if score > best:
                    best, at = score, f
            if at and best >= 0.3:
                want.add((g[0], at[0]))
                free.remove(at)
    assert got == want


def test_iou_at_the_limit_and_ties(spark, rows):
    a = frame(spark, [("g", "p", 0, 9)])
    assert rows(spans.greedy_match(a, frame(spark, [("x", "p", 0, 2)])), "f_id") == [("x",)]
    assert rows(spans.greedy_match(a, frame(spark, [("b", "p", 0, 4), ("a", "p", 5, 9)])), "f_id") == [("b",)]


def test_cell_components_of_chains_over_pages(spark):
    data = [(f"n{i:02d}", "p", 2 * i, 2 * i + 2) for i in range(40)] + [("z1", "q", 0, 1), ("z1", "r", 5, 6), ("z2", "r", 6, 7), ("alone", "s", 0, 0)]
    got = {r["id"]: r["component"] for r in spans.cell_components(frame(spark, data)).collect()}
    assert {got[f"n{i:02d}"] for i in range(40)} == {"n00"} and got["z1"] == got["z2"] == "z1" and got["alone"] == "alone"


def test_islands_and_clashes_of_empty(spark):
    empty = frame(spark, [])
    assert spans.merge_islands(empty).count() == spans.clashes(empty).count() == spans.greedy_match(empty, empty).count() == 0


def test_section_state(spark, rows):
    marks = spark.createDataFrame([("p", 0, None), ("p", 1, "close"), ("p", 2, None), ("p", 3, "open"), ("p", 4, None), ("q", 0, None)], "ref string, seg int, mark string")
    assert [r[2] for r in rows(spans.section_state(marks, "open", "close"), "ref", "seg", "in_section")] == [True, False, False, True, True, False]


def test_permanent_ids_one_to_one(spark, rows):
    new = spark.createDataFrame([("a", "p", 0, 5), ("b", "p", 4, 9), ("c", "q", 0, 1)], "story string, ref string, lo int, hi int")
    old = frame(spark, [("x", "p", 0, 4), ("y", "p", 5, 9), ("c", "z", 0, 0)])
    assert rows(publish.assign_ids(new, old)) == [(None, "c", "retired"), ("a", "x", "kept"), ("b", "y", "kept"), ("c", "c-v2", "minted")]


def test_corrections_in_order(spark, rows):
    df = spark.createDataFrame([("a", "p", 2, 6, "YES"), ("b", "p", 0, 1, "YES")], "id string, ref string, lo int, hi int, classification string")
    todo = spark.createDataFrame([(2, "a", "trim_end", "1"), (1, "a", "extend_end", "4"), (3, "a", "reclassify", "NO"), (1, "b", "remove", None)], "seq int, id string, op string, value string")
    assert rows(publish.apply_corrections(df, todo), "id", "lo", "hi", "classification") == [("a", 2, 9, "NO")]


@pytest.mark.parametrize("n", [3, 17])
def test_pointers_end_circle_and_dangle(spark, rows, n):
    data = [(f"k{i}", f"k{i + 1}") for i in range(n)] + [(f"k{n}", None), ("x", "y"), ("y", "x"), ("d", "nowhere")]
    got = dict(rows(scoring.follow_pointers(spark.createDataFrame(data, "id string, to string"), "id", "to")))
    assert all(got[f"k{i}"] == f"k{n}" for i in range(n + 1)) and got["x"] is None and got["d"] is None


def test_story_fold_cases_in_order(spark, rows):
    none, low, high = "NOT_A_STORY", "LOW_CONFIDENCE", "HIGH_CONFIDENCE"
    #       the earlier page's last story, the later page's first one: (lo, hi, classification, to_next, from_prev); labels at the break
    cases = {
        "1": ((5, 8, none, False, False), (1, 3, high, False, False), True), "2": ((5, 9, high, False, False), (1, 2, none, False, False), True),
        "3": ((9, 9, none, False, False), (0, 2, none, False, False), True), "4": ((5, 8, low, True, False), (0, 2, high, False, False), True),
        "5": ((5, 9, low, True, False), (1, 2, low, False, True), True), "flags": ((5, 9, low, False, False), (0, 2, high, False, True), False),
        "mid-page": ((5, 6, low, True, False), (0, 2, low, False, True), True), "unflagged": ((5, 9, low, False, False), (0, 2, low, False, False), True),
        "one flag": ((5, 9, low, True, False), (1, 2, low, False, False), True), "no story": ((5, 9, none, True, False), (0, 2, low, False, True), False),
    }
    stories = [(k, i, f"{k}{i}", 0, *x) for k, (a, b, _) in cases.items() for i, x in enumerate((a, b))]
    pages = [(k, i, 9, v[2], v[2]) for k, v in cases.items() for i in (0, 1)]
    # b joins a by labels and leaves c first on its page no more: c, alone then, can't be reached; e is promoted before the flags are asked
    stories += [("chain", 0, "a", 0, 5, 9, low, True, False), ("chain", 1, "b", 0, 0, 9, low, True, False), ("chain", 2, "c", 0, 0, 3, low, False, True)]
    stories += [("late", 0, "d", 0, 5, 9, high, True, False), ("late", 1, "e", 0, 0, 9, none, False, False), ("late", 2, "f", 0, 0, 3, low, False, False)]
    pages += [("chain", i, 9, True, True) for i in range(3)] + [("late", 0, 9, True, False), ("late", 1, 9, True, True), ("late", 2, 9, True, True)]
    s = spark.createDataFrame(stories, "corpus string, page_seq int, id string, no int, lo int, hi int, classification string, to_next boolean, from_prev boolean")
    p = spark.createDataFrame(pages, "corpus string, page_seq int, last int, event_at_start boolean, event_at_end boolean")
    want = [("11", "10", "1", high, 1, 3), ("21", "20", "2", high, 1, 2), ("31", "30", "3", low, 0, 2), ("41", "40", "4", high, 0, 2), ("51", "50", "5", low, 0, 2)]
    want += [("flags1", "flags0", "flags", high, 0, 2), ("b", "a", "4", low, 0, 9), ("f", "e", "1", low, 0, 3), ("e", "d", "flags", high, 0, 9)]
    assert rows(publish.fold_stories(s, p)) == sorted(want)
