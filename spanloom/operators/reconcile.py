"""Differences between two copies of a table (problem 4).

Both sides are reduced to checksums over ranges of the hashed key. The trees are compared from the root down: only the
parts of a range whose checksums differ are split further, and only rows in differing leaves are compared field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import materialize

#: Rows that a leaf range holds on average, and the bits by which a range is split at each step of the descent (4 bisections).
LEAF_ROWS, STEP_BITS = 32, 4


def latest_versions(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: the one with the largest version (null counts as oldest; ties go to the largest remaining values)."""
    rest = [c for c in df.columns if c not in (key, version)]
    newest = df.groupBy(key).agg(F.max(F.struct(F.col(version).isNotNull().alias("_dated"), F.col(version), *rest)).alias("_r"))
    return newest.select(key, f"_r.{version}", *(f"_r.{c}" for c in rest))


def _row_sum(cols: list[str]) -> Column:
    """A row's checksum; the null pattern goes in too, as the hash skips nulls."""
    return F.xxhash64(F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in cols)), *cols)


def _digest(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    place = F.shiftrightunsigned(F.xxhash64(key), 1)  # 63 bits: a range of keys is a common prefix
    return df.select(place.alias("place"), _row_sum([key, *cols]).alias("digest"))


def _ranges(digests: DataFrame, bits: int) -> DataFrame:
    half = F.col("digest").bitwiseAND(F.lit(0xFFFFFFFF))
    return digests.groupBy(F.shiftrightunsigned("place", 63 - bits).alias("range")).agg(F.count("*").alias("n"), F.sum(half).alias("low"), F.sum(F.shiftright("digest", 32)).alias("high"), F.bit_xor("digest").alias("mix"))


def _roll_up(ranges: DataFrame, bits: int) -> DataFrame:
    return ranges.groupBy(F.shiftrightunsigned("range", bits).alias("range")).agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bit_xor("mix").alias("mix"))


def mismatched_leaves(left: DataFrame, right: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, int]:
    """The leaf ranges whose checksums differ, found by descending from the root, and the bits of a leaf."""
    digests = [_digest(x, key, cols) for x in (left, right)]
    sizes = [x.count() for x in digests]
    bits = STEP_BITS
    while bits < 60 and max(sizes) / 2**bits > LEAF_ROWS:
        bits += STEP_BITS
    levels = {bits: [materialize(_ranges(x, bits)) for x in digests]}
    for b in range(bits - STEP_BITS, 0, -STEP_BITS):
        levels[b] = [_roll_up(x, STEP_BITS) for x in levels[b + STEP_BITS]]
    suspects = None
    for b in sorted(levels):
        a, z = levels[b]
        if suspects is not None:  # only the parts of ranges that differed one level up
            a, z = (x.join(suspects, F.shiftrightunsigned(x["range"], STEP_BITS) == suspects["_up"], "left_semi") for x in (a, z))
        same = (a["n"] == z["n"]) & (a["low"] == z["low"]) & (a["high"] == z["high"]) & (a["mix"] == z["mix"])
        unlike = a.join(z, a["range"] == z["range"], "full_outer").where(~F.coalesce(same, F.lit(False)))
        suspects = unlike.select(F.coalesce(a["range"], z["range"]).alias("_up"))
        if b < bits:
            suspects = materialize(suspects)
    return suspects.withColumnRenamed("_up", "range"), bits


def differences(left: DataFrame, right: DataFrame, key: str, only_left: str, only_right: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(key, difference)``: ``only_left`` / ``only_right`` for a key that one side lacks, else one row per differing column.

    Both sides must be unique on ``key``. Columns that both sides have are compared, but for ``ignore``; values differ unless
    equal or both null (NaN equals NaN). A null key is compared like a value. Two empty tables give an empty result.
    """
    cols = [c for c in left.columns if c in right.columns and c not in (key, *ignore)]
    left, right = (x.select(key, *cols) for x in (left, right))
    leaves, bits = mismatched_leaves(left, right, key, cols)
    place = F.shiftrightunsigned(F.shiftrightunsigned(F.xxhash64(key), 1), 63 - bits)
    leaves = materialize(leaves)

    def at_leaves(x: DataFrame, tag: str) -> DataFrame:
        near = x.withColumn("range", place).join(leaves, "range", "left_semi")
        return near.select(F.col(key).alias(f"{tag}_key"), F.lit(True).alias(f"{tag}_in"), *(F.col(c).alias(f"{tag}_{i}") for i, c in enumerate(cols)))

    both = at_leaves(left, "a").join(at_leaves(right, "b"), F.col("a_key").eqNullSafe(F.col("b_key")), "full_outer")
    fields = [F.when(~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}")), F.lit(c)) for i, c in enumerate(cols)]
    found = F.when(F.col("b_in").isNull(), F.array(F.lit(only_left))).when(F.col("a_in").isNull(), F.array(F.lit(only_right))).otherwise(F.array_compact(F.array(*fields)) if fields else F.array().cast("array<string>"))
    return both.select(F.when(F.col("a_in").isNull(), F.col("b_key")).otherwise(F.col("a_key")).alias(key), F.explode(found).alias("difference"))
