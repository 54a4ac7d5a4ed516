"""Consensus from annotators who disagree and aren't equally reliable (problem 3).

Confidence-aware truth discovery. Each annotator weighs as much as the lower chi-squared quantile for the number of its claims
over the sum of their squared distances from the current labels, that is one over an upper bound of its error variance: someone
with few claims has a wide bound and so little weight, however well those few fit. Labels are then chosen anew so that the
weighted sum of squared distances to all claims is least, and so on in turn, until no label changes.

The squared distance of a claim from a label is how surprising the two are together: minus the logarithm of the probability that
this label is drawn (all being equally likely) and that this annotator then says so. Annotators who swap two labels, or fall
back on one, are thereby read as they mean it, and one who says anything of anything tells nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import find_heavy, lookup, store

#: The level of the error variance's upper bound, and its standard normal quantile.
ALPHA, Z = 0.05, -1.959963984540054
#: Counts that every annotator starts with: off the right label, and on it in addition.
PRIOR_ANY, PRIOR_RIGHT = 0.25, 1.0
#: The rounds at most; whether the labels had settled by then is reported.
ROUNDS = 30
#: Up to so many annotators their tables go to every executor (8 MB with four labels); beyond, claims and tables are joined.
ANNOTATORS = 65_536


def chi_squared(n: Column) -> Column:
    """The lower ``ALPHA / 2`` quantile of chi-squared with ``n`` degrees of freedom: exact for one and two, by Wilson and
    Hilferty's cube from three on."""
    cube = n * F.pow(1 - 2 / (9 * n) + Z * F.sqrt(2 / (9 * n)), 3.0)
    return F.when(n <= 1, F.lit(0.000982069)).when(n <= 2, F.lit(-2 * math.log(1 - ALPHA / 2))).otherwise(cube)


def weigh(counts: DataFrame, k: int) -> DataFrame:
    """``(source, said, claims, right, weight, d0, d1, ...)`` from ``(source, said, n0, n1, ...)``: of how many items with each
    label an annotator says so, and the weighted squared distance of its saying so from each label. An annotator's few rows meet."""
    own = Window.partitionBy("source")
    n = [F.col(f"n{i}") for i in range(k)]
    start = [PRIOR_ANY + F.when(F.col("said") == i, PRIOR_RIGHT).otherwise(0.0) for i in range(k)]
    df = counts.withColumns({f"t{i}": F.sum(n[i]).over(own) + k * PRIOR_ANY + PRIOR_RIGHT for i in range(k)})
    df = df.withColumns({f"d{i}": math.log(k) - F.log((n[i] + start[i]) / F.col(f"t{i}")) for i in range(k)})
    # an annotator need not have said everything: totals are over what it did say
    claims = F.sum(reduce(lambda a, b: a + b, n)).over(own)
    off = F.sum(reduce(lambda a, b: a + b, (n[i] * F.col(f"d{i}") for i in range(k)))).over(own)
    right = F.sum(reduce(lambda a, b: a + b, (F.when(F.col("said") == i, n[i]).otherwise(0) for i in range(k)))).over(own)
    df = df.withColumns({"claims": claims, "right": right, "weight": chi_squared(claims) / off})
    return df.select("source", "said", "claims", "right", "weight", *(F.round(F.col("weight") * F.col(f"d{i}"), 12).alias(f"d{i}") for i in range(k)))


def commonness(n: list[int]) -> list[float]:
    """The weighted squared distance of each label for being rare: the labels' shares weigh in like one more annotator."""
    whole, k = sum(n), len(n)
    shares = [(x + PRIOR_ANY) / (whole + k * PRIOR_ANY) for x in n]
    spread = sum(-p * math.log(p) for p in shares)
    return [-math.log(p) / (math.log(k) + spread) for p in shares]


def first_tables(k: int) -> tuple[np.ndarray, list[float]]:
    """The first round is a vote: distance 0 or 1, all annotators alike."""
    return 1.0 - np.eye(k), [0.0] * k


# --- annotators whose tables fit every executor -----------------------------------------------------------------------


def _score(tables, base: list[float], k: int, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's habits end to end, the item that each belongs to, and the distance of each item to each label."""
    lists = b.column("habits")
    lengths = np.diff(lists.offsets.to_numpy())
    habits, of = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lengths)
    far = tables[habits % k] if len(tables) == k else tables[habits]
    return habits, of, np.stack([np.bincount(of, weights=far[:, i], minlength=len(lists)) + base[i] for i in range(k)], axis=1)


def _count(tables, base: list[float], k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Under the labels nearest to all claims: how many claims of each habit are about items of each label; habit -1 counts items."""
    seen: dict[int, int] = {}
    for b in batches:
        if b.num_rows:
            habits, of, far = _score(tables.value, base, k, b)
            label = np.round(far, 9).argmin(axis=1)
            for code, n in zip(*np.unique(np.concatenate([habits.astype(np.int64) * k + label[of], label - k]), return_counts=True)):
                seen[int(code)] = seen.get(int(code), 0) + int(n)
    codes = np.array(list(seen), dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(codes // k), pa.array((codes % k).astype(np.int32)), pa.array(list(seen.values()), type=pa.int64())], ["habit", "label", "n"])


def _label(tables, base: list[float], weights, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        habits, of, far = _score(tables.value, base, k, b)
        far = np.round(far, 9)
        mean = np.bincount(of, weights=weights.value[habits], minlength=b.num_rows) / np.bincount(of, minlength=b.num_rows)
        near = np.exp(-(far - far.min(axis=1, keepdims=True)) / mean[:, None])
        yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(near.max(axis=1) / near.sum(axis=1))], ["item", "label", "confidence"])


def weigh_all(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``weigh`` for all annotators at once: from ``n[source, said, label]`` their weights and weighted squared distances."""
    k = n.shape[1]
    distance = math.log(k) - np.log((n + PRIOR_ANY + PRIOR_RIGHT * np.eye(k)) / (n.sum(axis=1, keepdims=True) + k * PRIOR_ANY + PRIOR_RIGHT))
    claims = np.maximum(n.sum(axis=(1, 2)), 1)
    cube = claims * (1 - 2 / (9 * claims) + Z * np.sqrt(2 / (9 * claims))) ** 3
    quantile = np.where(claims <= 1, 0.000982069, np.where(claims <= 2, -2 * math.log(1 - ALPHA / 2), cube))
    weight = quantile / (n * distance).sum(axis=(1, 2))
    return weight, np.round(weight[:, None, None] * distance, 12)


def _discover_near(claims: DataFrame, known: list, k: int) -> tuple[DataFrame, DataFrame, int, bool]:
    """All rounds over one compact table, an item a row with what its annotators said as numbers: no round shuffles a claim."""
    spark = claims.sparkSession
    kind = claims.schema["source"].dataType.simpleString()
    codes = spark.createDataFrame([(s, i) for i, s in enumerate(known)], f"source {kind}, code int")
    habits = F.collect_list((F.col("code") * k + F.col("said")).cast("int"))  # at most one for each of the few annotators
    items = store(claims.join(F.broadcast(codes), "source").groupBy("item").agg(habits.alias("habits")))
    tables, base = first_tables(k)
    n, weight = np.zeros((max(len(known), 2), k, k)), np.zeros(max(len(known), 2))
    settled, rounds = False, 0
    for rounds in range(1, ROUNDS + 1):
        counted = items.mapInArrow(partial(_count, spark.sparkContext.broadcast(tables), base, k), "habit bigint, label int, n bigint").groupBy("habit", "label").agg(F.sum("n").alias("n"))
        before, n, sizes = n, np.zeros_like(n), [0] * k
        for r in counted.collect():  # at most one row for each annotator and two labels
            if r["habit"] < 0:
                sizes[r["label"]] = r["n"]
            else:
                n[r["habit"] // k, r["habit"] % k, r["label"]] = r["n"]
        if settled := bool((n == before).all()):
            break
        base = commonness(sizes)
        weight, distance = weigh_all(n)
        tables = distance.reshape(-1, k)
    weights = np.repeat(weight, k)
    truth = items.mapInArrow(partial(_label, spark.sparkContext.broadcast(tables), base, spark.sparkContext.broadcast(weights), k), f"item {claims.schema['item'].dataType.simpleString()}, label int, confidence double")
    rows = [(s, int(n[i].sum()), int(np.trace(n[i])), float(weight[i])) for i, s in enumerate(known)]
    sources = spark.createDataFrame(rows, f"source {kind}, claims bigint, right bigint, weight double")
    return truth, sources, rounds, settled


# --- any number of annotators -----------------------------------------------------------------------------------------


def _discover_far(claims: DataFrame, k: int, total: int) -> tuple[DataFrame, DataFrame, int, bool]:
    """The same by joins: claims meet their annotators' distances, and their items' labels, by shuffles that spare hot keys."""
    claims = store(claims.withColumn("habit", F.xxhash64("source", "said")))
    hot_item, hot_source = find_heavy(claims, "item", total), find_heavy(claims, "source", total)
    first = lambda i: F.when(F.col("said") == i, 0.0).otherwise(1.0)
    far = claims.select("item", *(first(i).alias(f"d{i}") for i in range(k)), F.lit(1.0).alias("weight"))
    base, before, settled, rounds, table = [0.0] * k, None, False, 0, None
    while True:
        sums = far.groupBy("item").agg(*(F.round(F.sum(f"d{i}") + base[i], 9).alias(f"s{i}") for i in range(k)), F.avg("weight").alias("mean"))
        least = F.least(*(F.col(f"s{i}") for i in range(k)))
        label = F.array_position(F.array(*(F.col(f"s{i}") for i in range(k))), least).cast("int") - 1
        near = [F.exp(-(F.col(f"s{i}") - least) / F.col("mean")) for i in range(k)]
        truth = store(sums.select("item", label.alias("label"), (1 / reduce(lambda a, b: a + b, near)).alias("confidence")))
        if settled or rounds == ROUNDS:
            return truth, table.select("source", "claims", "right", "weight").distinct(), rounds, settled
        counts = store(lookup(claims, truth.select("item", "label"), "item", hot_item, "inner").groupBy("source", "said").agg(*(F.count_if(F.col("label") == i).alias(f"n{i}") for i in range(k))))
        rounds += 1
        mark = counts.agg(F.count("*"), F.sum(F.xxhash64(*counts.columns).cast("decimal(38,0)"))).first()
        settled, before = mark == before, mark
        n = {r["label"]: r["count"] for r in truth.groupBy("label").count().collect()}
        base = commonness([n.get(i, 0) for i in range(k)])
        table = store(weigh(counts, k))
        by_source = table.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("said", F.struct("weight", *(f"d{i}" for i in range(k)))))).alias("own"))  # a label a row
        met = lookup(claims.select("item", "source", "said"), by_source, "source", hot_source, "inner").select("item", F.col("own")[F.col("said")].alias("o"))
        far = met.select("item", "o.*")


def discover(claims: DataFrame, labels: list[str], annotators: int = ANNOTATORS) -> tuple[DataFrame, DataFrame]:
    """Consensus per item and reliability per annotator from ``claims`` (``item``, ``source``, ``said``), one row per item and source.

    Returns items ``(item, label, confidence, agreement, n_sources)``, where ``confidence`` is how near the label is against all
    labels (annotators weighing as they do beside the item's mean one) and ``agreement`` the share of the item's pairs of
    annotators that said the same (null for one), and sources ``(source, n_claims, accuracy, weight, rounds, settled)``, where
    ``accuracy`` is the share of claims that are the item's label, ``weight`` the one by which the labels were chosen, ``rounds`` how
    many rounds there were, and ``settled`` whether the last changed nothing. Rows with a null, or with a label that isn't in
    ``labels``, are passed over. Ties go to the label that comes first in ``labels``. No claims give two empty tables.
    """
    k = len(labels)
    code = F.create_map(*(F.lit(x) for i, v in enumerate(labels) for x in (v, i)))
    claims = store(claims.select("item", "source", code[F.col("said")].alias("said")).where("item is not null and source is not null and said is not null"))
    known = [r["source"] for r in claims.select("source").distinct().limit(annotators + 1).collect()]
    if len(known) <= annotators:
        truth, sources, rounds, settled = _discover_near(claims, sorted(known), k)
    else:
        truth, sources, rounds, settled = _discover_far(claims, k, claims.count())
    votes = claims.groupBy("item").agg(*(F.count_if(F.col("said") == i).alias(f"v{i}") for i in range(k)))
    n_votes = reduce(lambda a, b: a + b, (F.col(f"v{i}") for i in range(k)))
    same = reduce(lambda a, b: a + b, (F.col(f"v{i}") * (F.col(f"v{i}") - 1) for i in range(k)))
    name = F.lit(labels)[F.col("label")] if labels else F.lit(None)
    items = truth.join(votes, "item").select("item", name.alias("label"), F.round("confidence", 6).alias("confidence"), F.when(n_votes > 1, same / (n_votes * (n_votes - 1))).alias("agreement"), n_votes.alias("n_sources"))
    return items, sources.select("source", F.col("claims").alias("n_claims"), F.round(F.col("right") / F.col("claims"), 6).alias("accuracy"), F.round("weight", 6).alias("weight"), F.lit(rounds).alias("rounds"), F.lit(settled).alias("settled"))


LABELS = ["story", "not", "borderline", "out_of_scope"]
#: The readings of a verdict's letters.
READINGS = {"story": "story", "isstory": "story", "yes": "story", "not": "not", "notastory": "not", "no": "not", "borderline": "borderline", "outofscope": "out_of_scope"}


def reading(verdict: Column) -> Column:
    """The label that a verdict's letters spell, in whatever case and with whatever marks between; null if none."""
    table = F.create_map(*(F.lit(x) for kv in READINGS.items() for x in kv))
    return table[F.regexp_replace(F.lower(verdict), "[^a-z]", "")]


def entry_claims(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """The standing verdicts on ruler entries: of each judge the latest answer that has one, of each reviewer the last round's."""
    judged = answers.select(F.col("entry_id").alias("item"), F.concat(F.lit("judge:"), "judge").alias("source"), reading(F.col("verdict")).alias("said"), F.struct(F.col("answered_at").alias("at"), F.lit(None).cast("bigint").alias("place"), F.col("answer_id").alias("no")).alias("order"))
    read = entries.select("entry_id", F.posexplode("verdicts").alias("at", "v"))
    round_no = F.regexp_extract("v.round", r"(\d+)", 1).try_cast("bigint")
    reviewed = read.select(F.col("entry_id").alias("item"), F.concat(F.lit("reviewer:"), "v.reviewer").alias("source"), reading(F.col("v.read_as")).alias("said"), F.struct(F.lit(None).cast("timestamp_ntz").alias("at"), round_no.alias("place"), F.col("at").cast("bigint").alias("no")).alias("order"))
    both = judged.unionByName(reviewed).where("item is not null and source is not null and said is not null")
    return both.groupBy("item", "source").agg(F.max_by("said", F.struct("order", "said")).alias("said"))


def entry_consensus(entries: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    return discover(entry_claims(entries, answers), LABELS)
