"""Scores against labels, intervals of shares, agreement, and ordered decision tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import wilson


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` rounded to four places, 0 when ``b`` is 0."""
    return F.when(b == 0, 0.0).otherwise(F.round(a / b, 4))


def confusion(rows: DataFrame, truth: str, call: str, by: list[str]) -> DataFrame:
    """Counts, precision, recall and F1 per group and, where a group's columns are null, over all. Rows with a null truth or call don't count."""
    t, c = F.col(truth), F.col(call)
    counted = rows.where(t.isNotNull() & c.isNotNull()).rollup(*by).agg(F.count_if(t & c).alias("tp"), F.count_if(~t & c).alias("fp"), F.count_if(t & ~c).alias("fn"), F.count_if(~t & ~c).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumns({"precision": p, "recall": r, "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def with_wilson(df: DataFrame, hits: str, n: str) -> DataFrame:
    return df.withColumn("low", wilson(F.col(hits), F.col(n), False)).withColumn("high", wilson(F.col(hits), F.col(n), True))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """The middle value of each group, of two middle ones the upper."""
    w = Window.partitionBy(by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(by, F.col(value).alias("median"))


def follow_pointers(pointers: DataFrame, key: str, to: str) -> DataFrame:
    """``(key, target)``: where each chain of pointers ends; null for chains that run in a circle or to a key that doesn't exist.

    Pointers are doubled each round, so a chain of n takes about log2(n) rounds; the state is checkpointed.
    """
    from spanloom.runtime import find_heavy, lookup, store

    state = store(pointers.select(F.col(key).alias("k"), F.coalesce(F.col(to), F.col(key)).alias("at"), F.col(to).isNull().alias("done")))
    longest = state.count()  # no chain that ends is longer
    for _ in range(longest.bit_length() + 1):
        if state.where("not done").isEmpty():
            break
        nxt = state.select(F.col("k").alias("at"), F.col("at").alias("_a"), F.col("done").alias("_d"))
        state = store(lookup(state, nxt, "at", find_heavy(state, "at", longest)).select("k", F.when(F.col("done"), F.col("at")).otherwise(F.col("_a")).alias("at"), (F.col("done") | F.coalesce("_d", F.lit(True))).alias("done")))
    return state.select(F.col("k").alias(key), F.when(F.col("done"), F.col("at")).alias("target"))


def resample(counts: DataFrame, draws: int = 1000, seed: int = 1) -> DataFrame:
    """``(list, draw, share)``: shares of hits in resamples of each list, from its counts (``list, hits, n``) alone.

    Drawing n rows with replacement out of n, of which so many hit, gives a binomial number of hits: no row is repeated, and a list takes
    as much however long it is. Lists are few (one small row each); the draws of a list depend on its name and the seed only.
    """

    def run(batches):
        import zlib

        import numpy as np
        import pandas as pd

        for b in batches:
            for name, hits, n in zip(b["list"], b["hits"], b["n"]):
                if n:
                    got = np.random.default_rng((seed, zlib.crc32(str(name).encode()))).binomial(int(n), hits / n, draws) / n
                    yield pd.DataFrame({"list": name, "draw": range(1, draws + 1), "share": got})

    return counts.select(F.col("list").cast("string"), F.col("hits").cast("bigint"), F.col("n").cast("bigint")).mapInPandas(run, "list string, draw int, share double")


def bootstrap_share(rows: DataFrame, hit: str, draws: int = 1000, seed: int = 1) -> DataFrame:
    """``(share, low, high)`` of a 0/1 column, with the 2.5 and 97.5 percentiles over resamples; nulls don't count."""
    n = rows.where(F.col(hit).isNotNull()).agg(F.lit("all").alias("list"), F.coalesce(F.sum(F.col(hit).cast("int")), F.lit(0)).alias("hits"), F.count("*").alias("n"))
    ends = resample(n, draws, seed).agg(F.percentile("share", 0.025).alias("low"), F.percentile("share", 0.975).alias("high"))
    return n.select((F.col("hits") / F.nullif(F.col("n"), F.lit(0))).alias("share")).crossJoin(ends)


def estimate_missing(lists: DataFrame, shipped: int, sample_hits: int, sample_n: int, draws: int = 1000, seed: int = 1) -> DataFrame:
    """``(point, low, high)``: how many stories are missing beyond the shipped ones: S p (1 - r) / r.

    ``lists`` has ``list, hits, n``: per expert list, entries on the site and all; r is their pooled share, p the share of real stories in
    a sample of the shipped. Lists and sample are resampled; the bounds are the draws of rank 2.5 and 97.5 percent.
    """
    spark = lists.sparkSession
    sample = spark.createDataFrame([("_sample", sample_hits, sample_n)], "list string, hits bigint, n bigint")
    sized = lists.select(F.col("list").cast("string"), F.col("hits").cast("bigint"), F.col("n").cast("bigint"))
    each = resample(sized.unionByName(sample), draws, seed).join(F.broadcast(sized.select("list", "n")), "list", "left")
    per = each.groupBy("draw").agg(F.sum(F.col("share") * F.col("n")).alias("k"), F.sum("n").alias("n"), F.max(F.when(F.col("list") == "_sample", F.col("share"))).alias("p"))
    per = per.where("k > 0").select((F.lit(shipped) * F.col("p") * (1 - F.col("k") / F.col("n")) / (F.col("k") / F.col("n"))).alias("missing"))
    ends = per.agg(F.percentile_approx("missing", 0.025, 100_000).alias("low"), F.percentile_approx("missing", 0.975, 100_000).alias("high"))
    whole = sized.agg((F.sum("hits") / F.sum("n")).alias("r"))
    point = F.lit(shipped * sample_hits / sample_n if sample_n else 0.0) * (1 - F.col("r")) / F.nullif(F.col("r"), F.lit(0.0))
    return whole.select(point.alias("point")).crossJoin(ends)


def edge_scores(targets: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """How well the first found span over each target (``key, ref, lo, hi``) meets its start: HIT, NEAR (one off), MISS, or NONE."""
    over = targets.select(key, "ref", F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi")).join(found.select("ref", "lo", "hi"), "ref").where("lo <= t_hi and t_lo <= hi")
    first = over.groupBy(key).agg(F.min(F.struct("lo", "hi")).alias("f"))
    off = F.abs(F.col("f.lo") - F.col("lo"))
    return targets.join(first, key, "left").withColumn("score", F.when(F.col("f").isNull(), "NONE").when(off == 0, "HIT").when(off == 1, "NEAR").otherwise("MISS")).drop("f")
