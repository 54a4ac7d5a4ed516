import math
import random

from spanloom.llm import consensus

LABELS = ["story", "not", "borderline", "out_of_scope"]


def simulate(n_items, seed):
    rng = random.Random(seed)
    truth = {f"i{i}": rng.choice(LABELS) for i in range(n_items)}
    skills = {f"s{j}": p for j, p in enumerate([0.9, 0.85, 0.8, 0.7, 0.6])} | {"spam": 0.25, "swap": None}
    claims = []
    for i, t in truth.items():
        for s, p in skills.items():
            if rng.random() < 0.8:
                if p is None:
                    said = {"story": "not", "not": "story"}.get(t, t)
                else:
                    said = t if rng.random() < p else rng.choice([x for x in LABELS if x != t])
                claims.append((i, s, said))
    return truth, claims


def test_held_out_accuracy_beats_majority(spark):
    truth, claims = simulate(400, 1)
    items, sources = consensus.discover(spark.createDataFrame(claims, "item string, source string, said string"), LABELS)
    got = {r["item"]: r["label"] for r in items.collect()}
    right = sum(got[i] == t for i, t in truth.items()) / len(truth)
    votes = {}
    for i, _, v in claims:
        votes.setdefault(i, []).append(v)
    majority = sum(max(LABELS, key=v.count) == truth[i] for i, v in votes.items()) / len(truth)
    assert right > 0.93 and right > majority
    weight = {r["source"]: r["weight"] for r in sources.collect()}
    assert weight["s0"] > weight["s4"] > weight["spam"]


def test_few_labels_weigh_little(spark):
    truth, claims = simulate(60, 2)
    claims.append(("i0", "newcomer", truth["i0"]))
    _, sources = consensus.discover(spark.createDataFrame(claims, "item string, source string, said string"), LABELS)
    weight = {r["source"]: r["weight"] for r in sources.collect()}
    assert weight["newcomer"] < weight["s3"]


def test_empty_nulls_and_unknown_labels(spark):
    items, sources = consensus.discover(spark.createDataFrame([("a", None, "story"), (None, "s", "not"), ("a", "s", "?")], "item string, source string, said string"), LABELS)
    assert items.count() == 0 and sources.count() == 0


def test_standing_verdicts(spark, rows):
    entries = spark.createDataFrame([("e", [("round_10", "r", "NO"), ("round_9", "r", "yes"), ("round_1", None, "yes"), None]), ("e", [("round_10", "r", "NO")])], "entry_id string, verdicts array<struct<round:string,reviewer:string,read_as:string>>")
    answers = spark.sql("select * from values ('e','j','Not a story',timestamp_ntz'2024-01-02 00:00:00',1L),('e','j',null,timestamp_ntz'2024-01-03 00:00:00',2L),('e','j','story',timestamp_ntz'2024-01-01 00:00:00',3L),('e','k','border-line ',timestamp_ntz'2024-01-01 00:00:00',4L) t(entry_id,judge,verdict,answered_at,answer_id)")
    assert rows(consensus.entry_claims(entries, answers), "source", "said") == [("judge:j", "not"), ("judge:k", "borderline"), ("reviewer:r", "not")]


def test_joined_rounds_give_the_same(spark, rows):
    _, claims = simulate(120, 3)
    df = spark.createDataFrame(claims, "item string, source string, said string")
    near, far = consensus.discover(df, LABELS), consensus.discover(df, LABELS, annotators=0)
    assert rows(near[0]) == rows(far[0]) and len(rows(near[0])) == len({c[0] for c in claims})
    assert rows(near[1], "source", "n_claims", "accuracy", "weight", "settled") == rows(far[1], "source", "n_claims", "accuracy", "weight", "settled")


def test_reported_weights_are_chi_squared_over_summed_squared_distances(spark):
    _, claims = simulate(200, 4)
    items, sources = consensus.discover(spark.createDataFrame(claims, "item string, source string, said string"), LABELS)
    label = {r["item"]: r["label"] for r in items.collect()}
    said = {}
    for i, s, v in claims:
        said.setdefault(s, []).append((v, label[i]))
    for r in sources.collect():
        assert r["settled"]
        own, n = said[r["source"]], r["n_claims"]
        of = {t: sum(b == t for _, b in own) for t in LABELS}
        off = sum(math.log(4) - math.log((own.count((a, b)) + consensus.PRIOR_ANY + consensus.PRIOR_RIGHT * (a == b)) / (of[b] + 4 * consensus.PRIOR_ANY + consensus.PRIOR_RIGHT)) for a, b in own)
        assert abs(r["weight"] - n * (1 - 2 / (9 * n) + consensus.Z * math.sqrt(2 / (9 * n))) ** 3 / off) < 1e-5
