import random

import numpy as np

from spanloom.operators import intervals

SCHEMA = "ref string, a int, b int, lo int, extra string"


def brute(ranges):
    out, cover = [], {}
    for k, lo, hi in ranges:
        if k is not None and lo is not None and hi is not None and lo <= hi:
            cover.setdefault(k, set()).update(range(lo, hi + 1))
    for k, cells in cover.items():
        runs = []
        for c in sorted(cells):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        out += [(k, "period", *r) for r in runs] + [(k, "gap", p[1] + 1, n[0] - 1) for p, n in zip(runs, runs[1:])]
    return sorted(out)


def test_against_brute_force_with_a_hot_entity(spark, rows):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "a", "b", "c", None]), lo, lo + rng.randint(-2, 4), 0, "x") for lo in (rng.randint(0, 60) for _ in range(300))]
    data += [("a", None, 3, 0, None), ("a", 3, None, 0, None)] + data[:20]
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = rows(intervals.periods_and_gaps(df, "ref", "a", "b"))
    assert [tuple(g) for g in got] == brute([r[:3] for r in data])


def test_continuous_scale_joins_only_touching(spark, rows):
    df = spark.createDataFrame([("x", 0, 10), ("x", 10, 20), ("x", 21, 30)], "k string, s bigint, e bigint")
    assert rows(intervals.periods_and_gaps(df, "k", "s", "e", adjacent=0)) == [("x", "gap", 20, 21), ("x", "period", 0, 20), ("x", "period", 21, 30)]


def test_empty_table(spark):
    assert intervals.periods_and_gaps(spark.createDataFrame([], SCHEMA), "ref", "a", "b").count() == 0


def test_merge_order_does_not_matter():
    rng = np.random.default_rng(3)
    code, lo = rng.integers(0, 5, 400), rng.integers(-1000, 1000, 400)
    hi = lo + rng.integers(0, 30, 400)
    whole = intervals.coalesce_runs(code, lo, hi, 1)
    parts = [intervals.coalesce_runs(code[i::7], lo[i::7], hi[i::7], 1) for i in range(7)]
    joined = intervals.coalesce_runs(*(np.concatenate(x) for x in zip(*parts)), 1)
    assert all((a == b).all() for a, b in zip(whole, joined))


def test_entry_ranges_cover_both_pages_and_cells(spark, rows):
    kind = "entry_id string, detector_span array<struct<ref:string,start_segment:int,end_segment:int,next_ref:string,start_segment_page2:int,end_segment_page2:int>>, expert_segments array<struct<ref:string,seg:int>>"
    df = spark.createDataFrame([("e", [("p1", 3, 5, "p2", 0, 1), (None, 1, 2, None, None, None), None], [("p1", 6), (None, 4), ("p1", None)]), ("f", None, []), ("g", [], None)], kind)
    got = rows(intervals.periods_and_gaps(intervals.entry_ranges(df), "ref", "first_seg", "last_seg"))
    assert got == [("p1", "period", 3, 6), ("p2", "period", 0, 1)]
