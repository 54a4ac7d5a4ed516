"""Attaching verdicts, claims and decisions to spans; unions of runs; sequential extras; fixpoint refusals; resumable work."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.passages import shingles, words
from spanloom.operators.spans import cells, clashes, exact_else_overlap
from spanloom.runtime import store


def attach_verdicts(spans: DataFrame, reviews: DataFrame) -> DataFrame:
    """``(id, match, accepted)``: spans with the verdicts on them, by equal bounds or else by overlap; accepted if any accepts and not all reject.

    ``reviews`` has ``ref, lo, hi, said`` ('yes', 'no' or else). Spans without verdicts have null in both."""
    got = exact_else_overlap(spans.select("id", "ref", "lo", "hi"), reviews.where("lo <= hi and ref is not null"), "id")
    said = got.groupBy("id").agg(F.bool_or("exact").alias("e"), (F.max(F.col("r_said") == "yes") & ~F.min(F.col("r_said") == "no")).alias("accepted"))
    return spans.select("id").join(said, "id", "left").select("id", F.when(F.col("e"), "exact").when(F.col("e").isNotNull(), "overlap").alias("match"), "accepted")


def tight_segments(passages: DataFrame, segments: DataFrame, n: int = 4, least: float = 0.5) -> DataFrame:
    """``(id, ref, seg, share)``: segments of a passage's page that it mostly holds, or that mostly hold it, by runs of ``n`` words.

    ``passages`` has ``id, ref, text``, ``segments`` has ``ref, seg, text``. Both meet by their runs, so no pair's texts are laid side by side."""
    grams = lambda df, *by: df.select(*by, words(F.col("text")).alias("w")).select(*by, F.explode(F.array_distinct(shingles(F.col("w"), n))).alias("g")).distinct()
    a, b = grams(passages, "id", "ref"), grams(segments, "ref", "seg")
    na, nb = a.groupBy("id", "ref").agg(F.count("*").alias("na")), b.groupBy("ref", "seg").agg(F.count("*").alias("nb"))
    shared = a.join(b, ["ref", "g"]).groupBy("id", "ref", "seg").agg(F.count("*").alias("s"))
    share = F.greatest(F.col("s") / F.col("na"), F.col("s") / F.col("nb"))
    return shared.join(na, ["id", "ref"]).join(nb, ["ref", "seg"]).select("id", "ref", "seg", F.round(share, 6).alias("share")).where(F.col("share") > least)


def two_level_claims(tight: DataFrame, window: DataFrame, spans: DataFrame) -> DataFrame:
    """``(entry, id, strict)``: spans claimed by entries through their tight cells, else through their window; unclaimed spans with a null entry."""
    own = cells(spans.select("id", "ref", "lo", "hi")).select("id", "ref", "seg")
    strict = tight.select(F.col("id").alias("entry"), "ref", "seg").join(own, ["ref", "seg"]).select("entry", "id").distinct()
    loose = window.select(F.col("id").alias("entry"), "ref", "seg").join(own, ["ref", "seg"]).select("entry", "id").distinct().join(strict.select("entry").distinct(), "entry", "left_anti")
    claimed = strict.withColumn("strict", F.lit(True)).unionByName(loose.withColumn("strict", F.lit(False)))
    left = spans.select("id").distinct().join(claimed.select("id").distinct(), "id", "left_anti")
    return claimed.unionByName(left.select(F.lit(None).cast("string").alias("entry"), "id", F.lit(None).cast("boolean").alias("strict")))


def first_reason(pool: DataFrame, key: str, exclusions: list[tuple[str, DataFrame]], otherwise: str) -> DataFrame:
    """``(key, reason)``: of each row the first of the named exclusions (tables of keys, in order) that holds it."""
    df, reason = pool.select(key).distinct(), None
    for i, (name, keys) in enumerate(exclusions):
        df = df.join(keys.select(key).distinct().withColumn(f"_{i}", F.lit(True)), key, "left")
        reason = F.when(F.col(f"_{i}"), name) if reason is None else reason.when(F.col(f"_{i}"), name)
    return df.select(key, reason.otherwise(otherwise).alias("reason"))


def add_extras(base_: DataFrame, extra: DataFrame) -> DataFrame:
    """``(ref, id)`` of the extra spans that overlap no base span of their page and no extra span taken before, in order of ``no``, ``id``.

    Sequential within a page by definition; pages stream by, sorted."""
    pick = lambda df, side: df.where("lo <= hi and ref is not null").select("ref", F.lit(side).alias("side"), "no", "id", "lo", "hi")
    rows = pick(base_, 0).unionByName(pick(extra, 1)).repartition("ref").sortWithinPartitions("ref", "side", "no", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held = None, []
        for b in batches:
            out: list[tuple[str, str]] = []
            for r in b.to_pylist():
                if r["ref"] != page:
                    page, held = r["ref"], []
                if r["side"] == 0 or all(r["lo"] > hi or r["hi"] < lo for lo, hi in held):
                    held.append((r["lo"], r["hi"]))
                    if r["side"]:
                        out.append((page, r["id"]))
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in out], type=pa.string()) for i in (0, 1)], ["ref", "id"])

    return rows.mapInArrow(run, "ref string, id string")


def refuse_clashing(spans: DataFrame, changes: DataFrame) -> DataFrame:
    """``(id, applied)`` of each change (``id, new_lo, new_hi``): changes are refused as long as they make their spans overlap others.

    All changes are made; those of spans in a clash that wasn't there before are dropped, and so on until none clashes. Each round
    refuses at least one, and in practice nearly all that ever will be."""
    before = store(clashes(spans).select("id", "next_id"))
    open_ = store(changes.select("id", "new_lo", "new_hi").distinct())
    while True:
        now = spans.select("id", "ref", "lo", "hi").join(open_, "id", "left").select("id", "ref", F.coalesce("new_lo", "lo").alias("lo"), F.coalesce("new_hi", "hi").alias("hi"))
        met = clashes(now).select("id", "next_id").join(before, ["id", "next_id"], "left_anti")
        bad = store(met.select(F.explode(F.array("id", "next_id")).alias("id")).distinct().join(open_, "id", "left_semi"))
        if bad.isEmpty():
            return changes.select("id").distinct().join(open_.select("id", F.lit(True).alias("applied")), "id", "left").na.fill(False, ["applied"])
        open_ = store(open_.join(bad, "id", "left_anti"))


def ready_steps(states: DataFrame, depends: DataFrame) -> DataFrame:
    """``(unit, step)`` of the pending steps whose dependencies (``step, needs``) are all done or skipped and not red.

    ``states`` has ``unit, step, state, color``."""
    fine = states.where("state in ('done', 'skipped') and coalesce(color, '') <> 'red'").select("unit", F.col("step").alias("needs"))
    pending = states.where("state = 'pending'").select("unit", "step")
    stuck = pending.join(depends, "step").join(fine, ["unit", "needs"], "left_anti").select("unit", "step").distinct()
    return pending.join(stuck, ["unit", "step"], "left_anti")


def to_do(wanted: DataFrame, done: DataFrame, key: list[str], failed: str = "failed") -> DataFrame:
    """Rows of ``wanted`` without a result under the same key (say fingerprint and page), or whose result failed: what a resumed run does."""
    return wanted.join(done.where(~F.coalesce(F.col(failed), F.lit(False))).select(*key), key, "left_anti")


def merge_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(unit, step, state, cost)``: new records over old ones; units that this run didn't touch, and costs it skipped, stay."""
    a, b = old.select("unit", "step", F.col("state").alias("_s"), F.col("cost").alias("_c")), new.select("unit", "step", "state", "cost")
    both = b.join(a, ["unit", "step"], "full_outer")
    cost = F.when(F.col("state") == "skipped", F.coalesce(F.nullif(F.col("cost"), F.lit(0.0)), "_c")).otherwise(F.when(F.col("state").isNull(), F.col("_c")).otherwise(F.col("cost")))
    return both.select("unit", "step", F.coalesce("state", "_s").alias("state"), cost.alias("cost"))


def merge_notes(old: DataFrame, drafts: DataFrame) -> DataFrame:
    """``(id, note, approved, state)``: approved text is kept, a new draft replaces other text, a draft with a problem is held.

    ``old`` has ``id, note, approved``; ``drafts`` has ``id, note, problem``."""
    both = old.select("id", F.col("note").alias("_n"), F.coalesce("approved", F.lit(False)).alias("_a"), F.lit(True).alias("_o")).join(drafts.select("id", "note", "problem", F.lit(True).alias("_d")), "id", "full_outer")
    keep = F.col("_d").isNull() | F.coalesce("_a", F.lit(False))
    note = F.when(keep, F.col("_n")).otherwise(F.col("note"))
    state = F.when(F.col("_d").isNull(), "kept").when(F.coalesce("_a", F.lit(False)), "approved").when(F.col("problem").isNotNull(), "held").otherwise("drafted")
    return both.select("id", note.alias("note"), (F.coalesce("_a", F.lit(False)) & note.eqNullSafe(F.col("_n"))).alias("approved"), state.alias("state"))


def completed_rounds(done: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """``(by, completed)``: how many rounds (``by, round, item``; from 1) are full, one after the other, before the first that isn't.

    ``items`` (``item``) is the list that a full round covers."""
    whole = items.select("item").distinct().agg(F.count("*").alias("whole"))
    n = done.join(items.select("item").distinct(), "item", "left_semi").groupBy(by, "round").agg(F.count_distinct("item").alias("n")).crossJoin(F.broadcast(whole))
    full = n.where(F.col("n") == F.col("whole")).withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("round"))).where(F.col("k") == F.col("round"))
    return done.select(by).distinct().join(full.groupBy(by).agg(F.max("k").alias("completed")), by, "left").select(by, F.coalesce("completed", F.lit(0)).alias("completed"))
