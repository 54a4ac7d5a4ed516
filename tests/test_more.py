import random

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import passages, scoring


def grams(t, n=4):
    w = t.split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_fuzzy_location_against_all_windows(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(12)]
    corpus = [("g", i, " ".join(rng.choice(vocab) for _ in range(9))) for i in range(25)]
    asked = [(f"q{k}", "g", " ".join(t for _, _, t in corpus[k : k + 3])) for k in (2, 9, 17)] + [("no", "g", "nothing of this is there")]
    got = {r["id"]: (r["first_pos"], r["last_pos"], r["coverage"]) for r in passages.locate_fuzzy(spark.createDataFrame(asked, "id string, `group` string, text string"), spark.createDataFrame(corpus, "`group` string, pos int, text string")).collect()}
    assert "no" not in got
    seg = {p: grams(t) for _, p, t in corpus}
    for i, _, t in asked[:3]:
        want = grams(t)
        top = max(len(want & set().union(*(seg[p] for p in range(s, e + 1)))) for s in seg for e in range(s, min(25, s + 14)))
        assert abs(got[i][2] - top / len(want)) < 0.05 and got[i][1] - got[i][0] < 14


def test_alignment(spark, rows):
    pairs = spark.createDataFrame([("a", "one two three four five six", "zero one two three four five six seven"), ("b", "x y", "x y"), ("c", None, "x")], "id string, needle string, hay string")
    assert rows(passages.align(pairs)) == [("a", 1.0, 1, 7), ("b", 0.0, None, None), ("c", 0.0, None, None)]


def test_folding_and_offsets(spark):
    r = spark.range(1).select(text.accent_fold(F.lit("Émile ŠÀ-9 ok")).alias("f"), text.kept_offsets(F.lit("אַב"), "[\\u0591-\\u05C7]").alias("o")).first()
    assert r["f"] == "emile sa ok" and r["o"] == [0, 2]


def test_bootstrap_is_stable_and_covers(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(400)], "id int, hit boolean")
    a, b = (scoring.bootstrap_share(x, "hit").first() for x in (df, df.repartition(9)))
    assert a == b and a["low"] < 0.25 < a["high"] and a["high"] - a["low"] < 0.12


def test_confusion_with_totals_and_zero_denominators(spark):
    df = spark.createDataFrame([("a", True, True), ("a", False, True), ("b", True, False), ("b", None, True)], "g string, t boolean, c boolean")
    got = {r["g"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) for r in scoring.confusion(df, "t", "c", ["g"]).collect()}
    assert got == {"a": (1, 1, 0, 0.5, 1.0), "b": (0, 0, 1, 0.0, 0.0), None: (1, 1, 1, 0.5, 0.5)}


def test_upper_median(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", None)], "g string, v int")
    assert rows(scoring.upper_median(df, "g", "v")) == [("a", 3)]


def test_edges(spark, rows):
    t = spark.createDataFrame([("a", "p", 3, 5), ("b", "p", 9, 9), ("c", "q", 0, 0)], "id string, ref string, lo int, hi int")
    f = spark.createDataFrame([("p", 2, 4), ("p", 5, 9)], "ref string, lo int, hi int")
    assert rows(scoring.edge_scores(t, f, "id"), "id", "score") == [("a", "NEAR"), ("b", "MISS"), ("c", "NONE")]


def _locate_one(query, segments, n=6):
    """The exact locator for one query, word by word: what ``locate_exact`` must equal. ``segments`` has one text per place."""
    tokens, owner = [w for s in segments for w in s.split()], [i for i, s in enumerate(segments) for _ in s.split()]
    at = {}
    for i in range(len(tokens) - n + 1):
        at.setdefault(tuple(tokens[i : i + n]), []).append(i)
    ws = query.split()
    hits = [at.get(tuple(ws[i : i + n]), []) for i in range(len(ws) - n + 1)]
    cluster = [(i, h[0]) for i, h in enumerate(hits) if len(h) == 1]
    for by in (0, 1):
        runs = []
        for a in sorted(cluster, key=lambda a: a[by]):
            if runs and a[1] - runs[-1][-1][1] <= 500:
                runs[-1].append(a)
            else:
                runs.append([a])
        cluster = max(runs, key=len, default=[])
    if not cluster:
        return None
    offset, slack = sorted(p - i for i, p in cluster)[len(cluster) // 2], max(25, len(ws) // 4)
    near = [[p for p in h if abs(p - i - offset) <= slack] for i, h in enumerate(hits)]
    spots = [p for h in near for p in h] + [cluster[0][1]]
    return owner[min(spots)], owner[max(spots) + n - 1], len(cluster), round(sum(map(bool, near)) / len(hits), 6)


def test_exact_location_takes_the_running_text(spark):
    rng = random.Random(3)
    formula = "and so it was told to them all at the gate".split()
    segments = [" ".join(rng.choice(formula) if rng.random() < 0.5 else f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))) for _ in range(400)]
    segments[50:52] = ["one two three", "four five six"]  # only runs over the break are there
    segments[100:103] = [" ".join(formula), "here stands a lone mark of its own", " ".join(formula)]
    segments[200] = " ".join(formula)
    asked = {"break": "one two three four five six", "extent": " ".join(segments[100:103]), "common": " ".join(formula), "short": "one two", "far": " ".join(segments[20:30] + segments[300:306])}
    asked |= {f"r{k}": " ".join(segments[k : k + rng.randint(2, 40)][: rng.randint(5, 40)]) for k in range(0, 360, 9)}
    corpus = spark.createDataFrame([("g", i, s) for i, s in enumerate(segments)] + [("other", 1, segments[50] + " " + segments[51])], "`group` string, pos int, text string")
    queries = spark.createDataFrame([(k, "g", v) for k, v in asked.items()] * 2, "id string, `group` string, text string")
    got = {r["id"]: (r["first_pos"], r["last_pos"], r["anchors"], r["coverage"]) for r in passages.locate_exact(queries, corpus).collect()}
    assert got["break"] == (50, 51, 1, 1.0) and got["extent"][:2] == (100, 102) and "common" not in got
    assert got == {k: x for k, v in asked.items() if (x := _locate_one(v, segments))}
    assert "break" not in {r["id"] for r in passages.locate(queries, corpus).collect()}


def test_fallback_locator_alignment_limits_and_markers(spark, rows):
    from spanloom.operators import passages

    corpus = spark.createDataFrame([("c", i, t) for i, t in enumerate(["a b c d e f g h", "i j k l m n o p", "q r s t u v w x", "a b c d zz e f g h"])], "group string, pos int, text string")
    asked = spark.createDataFrame([("x", "c", "i j k l m n o p"), ("y", "c", "q r s t no way r s t u v"), ("z", "c", "nothing here at all of it"), ("n", "c", None)], "id string, group string, text string")
    got = {r["id"]: (r["how"], r["first_pos"], r["last_pos"], r["coverage"]) for r in passages.locate_any(asked, corpus).collect()}
    assert got["x"] == ("exact", 1, 1, 1.0) and got["y"][:3] == ("fuzzy", 2, 2) and set(got) == {"x", "y"}
    pair = spark.createDataFrame([("a", "one two three four five six", "zero one two three four five six"), ("b", "one two three four five six seven eight nine ten", "one two three four five x x x x x x x x x x x x")], "id string, needle string, hay string")
    assert rows(passages.align(pair, 5, 0.85, 1.6)) == [("a", 1.0, 1, 7), ("b", 0.5, None, None)]
    t = spark.createDataFrame([("He said:  Once a man came", "once A man went"), ("short", "nothing like it"), (None, "x"), ("x" * 60, "x" * 55)], "t string, m string")
    assert [r["found_at"] for r in passages.find_marker(t, "t", "m").collect()] == [9, -1, None, 0]


def test_resampled_shares_need_no_rows(spark):
    from spanloom.operators import scoring

    rows_ = spark.createDataFrame([(i, i % 4 != 0) for i in range(400)] + [(500, None)], "k int, hit boolean")
    r = scoring.bootstrap_share(rows_, "hit").first()
    assert r["share"] == 0.75 and 0.69 < r["low"] < 0.72 and 0.78 < r["high"] < 0.81
    assert scoring.bootstrap_share(rows_.limit(0), "hit").first()["share"] is None
    lists = spark.createDataFrame([("a", 80, 100), ("b", 60, 100)], "list string, hits int, n int")
    e = scoring.estimate_missing(lists, 1000, 54, 60).first()
    assert abs(e["point"] - 1000 * 0.9 * 0.3 / 0.7) < 1e-6 and e["low"] < e["point"] < e["high"] and e["high"] - e["low"] < 300
    assert scoring.estimate_missing(lists, 1000, 54, 60).first() == e


def test_planted_parallels_are_found(spark):
    from spanloom.operators import passages

    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    story = [word() for _ in range(30)]
    texts = [(0, "x", story), (1, "y", [word() for _ in range(10)] + story[5:25] + [word() for _ in range(10)]), (2, "x", story[:20] + [word()]), (3, "z", [word() for _ in range(30)]), (4, "y", story), (5, None, None)]
    docs = spark.createDataFrame([(i, g, " ".join(t) if t else None) for i, g, t in texts], "id bigint, group string, text string")
    got = {(r["a"], r["b"]): (r["shared"], r["overlap"]) for r in passages.shared_passages(docs).collect()}
    assert got == {(0, 1): (16, round(16 / 26, 6)), (1, 2): (11, round(11 / 17, 6))}  # 2 is of the same group as 0, and 4 is a copy of it


def _stretch_of(want, seg, seeds=12, back=6, width=14, enough=0.97):
    """The fuzzy locator for one query, stretch by stretch: what ``locate_fuzzy`` must equal. ``seg`` has the runs of each place."""
    votes = {p: len(want & g) for p, g in seg.items() if want & g}
    found = []
    for s in sorted(votes, key=lambda p: (-votes[p], p))[:seeds]:
        for start in range(s - back, s + 1):
            held, first, last, cover = set(), None, None, 0.0
            for p in (p for p in range(start, start + width) if p in votes):
                held |= want & seg[p]
                first = p if first is None else first
                if round(len(held) / len(want), 6) > cover:
                    cover, last = round(len(held) / len(want), 6), p
                if cover >= enough:
                    break
            found.append((cover, first - last, -first))
    return (lambda c, short, early: (-early, -early - short, c))(*max(found)) if found else None


def test_fuzzy_location_stores_no_pairs_of_query_and_segment(spark):
    import os

    rng = random.Random(6)
    formula = "and so it was told to them all at the gate".split()
    corpus = {p: " ".join(formula + [f"w{rng.randrange(90)}" for _ in range(6)]) if p % 7 else " ".join(rng.choice(formula) for _ in range(9)) for p in range(-20, 1200)}
    asked = {f"q{k}": " ".join([corpus[k], corpus[k + 1]]) + " w1 w2" * (k % 3) for k in range(0, 900, 9)} | {"far": f"{corpus[40]} {corpus[700]}", "no": "nothing of this is there"}
    seg = {p: grams(t) for p, t in corpus.items()}
    queries = spark.createDataFrame([(i, "g", t) for i, t in asked.items()] * 2 + [("lost", "h", corpus[3]), (None, "g", corpus[3]), ("null", "g", None)], "id string, `group` string, text string")
    places = spark.createDataFrame([("g", p, t) for p, t in corpus.items()] + [("g", 5, corpus[5]), ("g", None, corpus[5]), ("g", 9, None)], "`group` string, pos int, text string")
    folder = spark.sparkContext.getCheckpointDir() or ""
    used = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder.removeprefix("file:")) for f in fs)
    before = used()
    found = passages.locate_fuzzy(queries, places)
    folder = spark.sparkContext.getCheckpointDir()
    stored = used() - before
    wanted = {i: x for i, t in asked.items() if (x := _stretch_of(grams(t), seg))}
    assert {r["id"]: (r["first_pos"], r["last_pos"], r["coverage"]) for r in found.collect()} == wanted and "no" not in wanted
    assert 0 < stored < 500_000, stored  # the texts; every query shares a formula with every segment, which is 700,000 hits
    cut = passages.locate_fuzzy(queries, places, part=4000)  # in many parts and blocks
    assert {r["id"]: (r["first_pos"], r["last_pos"], r["coverage"]) for r in cut.collect()} == wanted
