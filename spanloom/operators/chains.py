"""Chains of segments, boundaries from clause roles, and hints at page breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def continuations(segments: DataFrame) -> DataFrame:
    """``segments`` (``ref, seg, band, names, fresh, pronoun, flow``) with ``continues``: whether a segment goes on from the one before it.

    It does if that one is likely a story, this one doesn't open afresh, and it begins with a pronoun, or with a word of flow and
    shares a name or follows a HIGH one, or shares a name.
    """
    w = Window.partitionBy("ref").orderBy("seg")
    before, known = F.lag("band").over(w), F.lag("names").over(w)
    shared = F.coalesce(F.arrays_overlap("names", known), F.lit(False))
    goes_on = F.col("pronoun") | F.col("flow") & (shared | (before == "HIGH")) | shared
    return segments.withColumn("continues", F.coalesce(before.isin("HIGH", "MEDIUM") & ~F.col("fresh") & goes_on, F.lit(False)))


def story_groups(linked: DataFrame) -> DataFrame:
    """``(ref, lo, hi, n)``: runs of segments, each from a likely one that doesn't continue, over all that go on from it."""
    member = F.col("band").isin("HIGH", "MEDIUM") | F.col("continues")
    begins = F.when(member & ~F.col("continues"), 1).otherwise(0)
    w = Window.partitionBy("ref").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    df = linked.withColumn("group", F.sum(begins).over(w)).where(member)
    return df.groupBy("ref", "group").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi"), F.count("*").alias("n")).drop("group")


def boundary_from_roles(roles: DataFrame, by: list[str], longest: bool = False) -> DataFrame:
    """``(*by, first, last, kept_full, needs_review)`` from the roles of clauses (``*by, clause, inside, unclear``).

    First to last clause inside the story, or the longest unbroken run of them (the earliest of equal ones). Without any, the whole
    stays and is to be reviewed; so is a boundary beside or on an unclear clause.
    """
    w = Window.partitionBy(*by).orderBy("clause")
    df = roles.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    if longest:
        ins = df.where("inside").withColumn("_run", F.col("clause") - F.row_number().over(w))
        runs = ins.groupBy(*by, "_run").agg(F.min("clause").alias("a"), F.max("clause").alias("b"))
        best = runs.groupBy(*by).agg(F.max(F.struct((F.col("b") - F.col("a")).alias("l"), (-F.col("a")).alias("e"), F.col("a"), F.col("b"))).alias("r")).select(*by, F.col("r.a").alias("first"), F.col("r.b").alias("last"))
    else:
        best = df.where("inside").groupBy(*by).agg(F.min("clause").alias("first"), F.max("clause").alias("last"))
    whole = df.groupBy(*by).agg(F.count("*").alias("n"))
    out = whole.join(best, by, "left")
    near = df.join(out.select(*by, "first", "last"), by).groupBy(*by).agg(F.max(F.col("unclear") & F.col("clause").isin(F.col("first") - 1, F.col("first"), F.col("last"), F.col("last") + 1)).alias("_u"))
    out = out.join(near, by, "left")
    first, last = F.coalesce("first", F.lit(0)), F.coalesce("last", F.col("n") - 1).cast("int")
    return out.select(*by, first.alias("first"), last.alias("last"), ((first == 0) & (last == F.col("n") - 1)).alias("kept_full"), (F.col("first").isNull() | F.coalesce("_u", F.lit(False))).alias("needs_review"))


def page_hints(first: Column, last: Column) -> tuple[Column, Column]:
    """Whether a page's first text seems to go on from the page before, and whether its last breaks off."""
    starts = F.coalesce(first.rlike(r"^(And|He|She|They) |^\p{Ll}"), F.lit(False))
    ends = F.coalesce(F.rtrim(last).rlike("[,:]$") | F.contains(F.lower(F.right(last, F.lit(30))), F.lit("and then")), F.lit(False))
    return starts, ends
