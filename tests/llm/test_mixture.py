import numpy as np
import pandas as pd

from spanloom.llm import mixture


def test_permutation_is_one():
    for n in (1, 2, 7, 64, 1000):
        index = np.arange(n)
        got = mixture.permute(index, np.full(n, n), np.full(n, 5))
        assert sorted(got) == list(range(n))
    assert (mixture.permute(index, np.full(n, n), np.full(n, 6)) != got).any()


def test_draws_take_exactly_the_quotas():
    quotas = np.array([100, 0, 7, 1])
    drawn = list(mixture.shard_counts(0, 100, quotas, 16, 1))
    counts = np.array([c for _, c, _ in drawn])
    assert [s for s, _, _ in drawn] == list(range(7)) and (counts.sum(axis=0) == quotas).all() and (counts.sum(axis=1)[:-1] == 16).all()
    assert (np.array([f for _, _, f in drawn]) == np.cumsum(counts, axis=0) - counts).all()
    assert list(mixture.shard_counts(0, 10, np.array([0, 0]), 16, 1)) == []


def test_a_shard_is_the_same_in_any_range():
    quotas = np.array([300_000_000, 200_000_000, 12_345])
    shards = -(-int(quotas.sum()) // 512)
    far = {s: (tuple(c), tuple(f)) for s, c, f in mixture.shard_counts(shards - 40, shards, quotas, 512, 3)}
    assert len(far) == 40 and all(far[s] == (tuple(c), tuple(f)) for s, c, f in mixture.shard_counts(shards - 7, shards - 3, quotas, 512, 3))
    last = far[shards - 1]
    assert tuple(np.add(last[0], last[1])) == tuple(quotas)


def test_huge_nodes_split_by_their_shares():
    quotas = np.array([3 * 10**12, 10**12, 5])
    left = mixture._halve(quotas, 10**12, (1, 2))
    assert left.sum() == 10**12 and (left <= quotas).all() and abs(left[0] / 10**12 - 0.75) < 1e-6


def test_a_million_shards(spark):
    quotas = np.array([1_500_000, 500_000])
    drawn = mixture.draw_shards(spark, quotas, 2, 5).groupBy("source_no").agg({"n": "sum", "*": "count"}).collect()
    assert {r["source_no"]: r["sum(n)"] for r in drawn} == {0: 1_500_000, 1: 500_000}


def test_quotas_are_capped():
    plan = pd.DataFrame({"source": list("abc"), "tokens": [1000, 10, 0], "blocks": [100, 1, 0], "target_share": [0.5, 0.5, None], "max_repeats": [1, 3, None]})
    assert mixture.plan_quotas(plan, 1000, 10).quota.tolist() == [50, 3, 0]


def test_mix_of_small_sources(spark):
    docs = [(i, "big", f"word{i} and more words in document {i}") for i in range(400)] + [(1000 + i, "small", "tiny text here") for i in range(4)] + [(2000, "untargeted", "abc"), (2001, None, "abc"), (2002, "big", None), (2003, "big", "")]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), ("untargeted", 0.0, 2)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed, report = mixture.mix(d, t, block_tokens=16, shard_blocks=8)
    mixed, report = mixed.collect(), {r["source"]: r for r in report.collect()}
    assert len({(r["shard"], r["slot"]) for r in mixed}) == len(mixed) and all(len(r["ids"]) == r["n_tokens"] for r in mixed)
    assert set(report) == {"big", "small", "absent", "untargeted"}
    assert report["small"]["mixed_tokens"] == 3 * report["small"]["tokens"] and report["small"]["most_uses"] == 3
    assert abs(report["big"]["share_of_total"] - 0.5) < 0.02 and report["absent"]["mixed_tokens"] == report["untargeted"]["mixed_tokens"] == 0
    uses = {}
    for r in mixed:
        uses.setdefault((r["source"], r["block_no"]), []).append(r["repeat"])
    assert all(len(set(v)) == len(v) for v in uses.values())
    for s, r in report.items():
        assert r["mixed_tokens"] == sum(m["n_tokens"] for m in mixed if m["source"] == s)


def test_packing_is_a_round_trip(spark):
    from spanloom.llm import encoding

    docs = [(i, "s", " ".join(["w"] * (i % 37))) for i in range(120)]
    coded = encoding.encode(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), "text", ["doc_id", "source"], packed=True)
    pieces = mixture.pack(coded, mixture.range_totals(coded), 16).collect()
    blocks, whole = {}, {}
    for p in sorted(pieces, key=lambda p: (p["block_no"], p["at"])):
        assert len(p["ids"]) == 3 * p["n"]
        blocks[p["block_no"]] = blocks.get(p["block_no"], 0) + p["n"]
        whole[p["doc_id"]] = whole.get(p["doc_id"], b"") + bytes(p["ids"])
    assert [blocks[k] for k in sorted(blocks)][:-1] == [16] * (len(blocks) - 1)
    assert whole == {r["doc_id"]: bytes(r["ids"]) for r in coded.collect() if len(r["ids"])}


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixture.mix(d, t)
    assert mixed.count() == 0 and report.count() == 1
