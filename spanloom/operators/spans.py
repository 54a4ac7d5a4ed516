"""Closed spans of segments on pages: repair, overlap, matching, trimming, merging and comparison.

A span is a row with ``ref``, ``lo`` and ``hi`` (inclusive) and whatever else; a cell is one (ref, segment).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Length of the common part of two closed intervals, 0 if none."""
    return F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo) + 1)


def iou(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    inter = overlap(a_lo, a_hi, b_lo, b_hi)
    return inter / ((a_hi - a_lo + 1) + (b_hi - b_lo + 1) - inter)


def validate(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """``spans`` with ``action`` (drop, collapse, clamp, keep) and repaired ``lo`` and ``hi``; ``pages`` has ``ref, last``.

    In order: a missing bound drops the span; an end before its start collapses it to the start if that lies on the page and
    drops it otherwise; a span off the page, or of an unknown page, is dropped; the rest is cut to the page.
    """
    df = spans.join(pages.select("ref", "last"), "ref", "left")
    on_page = (F.col("lo") >= 0) & (F.col("lo") <= F.col("last"))
    action = (
        F.when(F.col("lo").isNull() | F.col("hi").isNull() | F.col("last").isNull(), "drop")
        .when((F.col("hi") < F.col("lo")) & on_page, "collapse")
        .when((F.col("hi") < F.col("lo")) | (F.col("hi") < 0) | (F.col("lo") > F.col("last")), "drop")
        .when((F.col("lo") < 0) | (F.col("hi") > F.col("last")), "clamp")
        .otherwise("keep")
    )
    df = df.withColumn("action", action)
    lo = F.when(F.col("action") == "clamp", F.greatest("lo", F.lit(0))).otherwise(F.col("lo"))
    hi = F.when(F.col("action") == "collapse", F.col("lo")).when(F.col("action") == "clamp", F.least("hi", "last")).otherwise(F.col("hi"))
    return df.withColumns({"lo": F.when(F.col("action") != "drop", lo), "hi": F.when(F.col("action") != "drop", hi)}).drop("last")


def cells(spans: DataFrame) -> DataFrame:
    """One row per segment of each span, as ``seg``; a page holds its spans' cells, so this grows with the spans' lengths only."""
    return spans.where("lo <= hi").withColumn("seg", F.explode(F.sequence("lo", "hi")))


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of spans that share a segment, with ``shared`` and ``iou``; the right side's columns get the prefix ``r_``.

    The page is the equi-key; the range condition is evaluated within the join.
    """
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    on = (left["ref"] == r["r_ref"]) & (left["lo"] <= r["r_hi"]) & (r["r_lo"] <= left["hi"])
    args = (F.col("lo"), F.col("hi"), F.col("r_lo"), F.col("r_hi"))
    return left.join(r, on).withColumns({"shared": overlap(*args), "iou": iou(*args)})


def exact_else_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Right spans with the same bounds; for left spans without one, all that overlap. Unmatched left spans have none."""
    pairs = overlap_join(left, right)
    same = (F.col("lo") == F.col("r_lo")) & (F.col("hi") == F.col("r_hi"))
    has = F.max(same.cast("int")).over(Window.partitionBy(key)) == 1
    return pairs.withColumn("exact", same).withColumn("_has", has).where(F.col("exact") | ~F.col("_has")).drop("_has")


def greedy_match(golden: DataFrame, found: DataFrame, least: float = 0.3, order: tuple[str, ...] = ("lo", "hi", "id")) -> DataFrame:
    """``(ref, g_id, f_id, iou)``: each golden span in ``order`` takes the unused found span with the largest IoU.

    The first in ``order`` wins a tie; below ``least`` nothing is taken. Sequential within a page by definition, and
    grouped by page.
    """

    def match(page: str, golden: list[dict], free: list[dict], out: list[tuple]) -> None:
        for a in golden:
            best, at = 0.0, -1
            for i, b in enumerate(free):
                inter = max(0, min(a["hi"], b["hi"]) - max(a["lo"], b["lo"]) + 1)
                score = inter / ((a["hi"] - a["lo"] + 1) + (b["hi"] - b["lo"] + 1) - inter)
                if score > best:
                    best, at = score, i
            if at >= 0 and best >= least:
                out.append((page, a["id"], free.pop(at)["id"], best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by page; a page may run over several batches."""
        page, sides = None, ([], [])
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if r["ref"] != page:
                    match(page, *sides, out)
                    page, sides = r["ref"], ([], [])
                sides[r["side"]].append(r)
            yield frame(out)
        out = []
        match(page, *sides, out)
        yield frame(out)

    def frame(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([t[i] for t in out], type=k) for i, k in enumerate(kinds)], ["ref", "g_id", "f_id", "iou"])

    pick = lambda df, side: df.where("lo <= hi and ref is not null").select("ref", "lo", "hi", F.lit(side).alias("side"), *(c for c in dict.fromkeys((*order, "id")) if c not in ("lo", "hi")))
    rows = pick(golden, 0).unionByName(pick(found, 1)).repartition("ref").sortWithinPartitions("ref", "side", *order)
    return rows.mapInArrow(run, "ref string, g_id string, f_id string, iou double")


def islands(spans: DataFrame, gap: int = 0) -> DataFrame:
    """``spans`` with ``island``: spans of a page that overlap, or lie up to ``gap`` segments apart, share a number."""
    order = Window.partitionBy("ref").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("lo") > reach + gap), 1).otherwise(0)
    return spans.withColumn("_s", starts).withColumn("island", F.sum("_s").over(order.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_s")


def merge_islands(spans: DataFrame, gap: int = 0) -> DataFrame:
    """Each island as one span with ``n``, the number of spans in it."""
    return islands(spans, gap).groupBy("ref", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))


def clashes(spans: DataFrame) -> DataFrame:
    """Neighbouring spans (by lo, hi, id) of a page of which the next starts before the last one has ended."""
    order = Window.partitionBy("ref").orderBy("lo", "hi", "id")
    nxt = spans.withColumn("next_id", F.lead("id").over(order)).withColumn("next_lo", F.lead("lo").over(order)).withColumn("next_hi", F.lead("hi").over(order))
    kind = F.when(F.col("next_hi") <= F.col("hi"), "contains").otherwise("overlaps")
    return nxt.where(F.col("next_lo") <= F.col("hi")).select("ref", "id", "next_id", kind.alias("kind"))


def label_trim(spans: DataFrame, labels: DataFrame, key: str, filler: str, needs: str) -> DataFrame:
    """Spans without ``filler`` segments at their edges, applied only if a ``needs`` segment is left; the rest stay as they are.

    ``labels`` has ``ref, seg, label`` and may have ``ruling`` and ``names``: a segment with a ruling that names someone whom the span
    names too (``names`` of ``spans``) stays at the end. Spans for which a boolean column ``exempt`` of theirs is true are left alone. An
    end beyond the page's labels stays. The result has ``new_lo`` and ``new_hi``.
    """
    ruled = "ruling" in labels.columns and "names" in spans.columns
    told = spans.select(key, "ref", "lo", "hi", *([F.col("names").alias("_names")] if ruled else []))
    ends = labels.groupBy("ref").agg(F.max("seg").alias("_end"))
    seen = told.join(labels.select("ref", "seg", "label", *(["ruling", "names"] if ruled else [])), "ref").where("seg between lo and hi")
    solid = F.when(F.col("label") != filler, F.col("seg"))
    stays = F.when((F.col("label") != filler) | (F.coalesce(F.col("ruling") & F.arrays_overlap("names", "_names"), F.lit(False)) if ruled else F.lit(False)), F.col("seg"))
    cut = seen.groupBy(key).agg(F.min(solid).alias("_lo"), F.max(stays).alias("_hi"), F.max(F.col("label") == needs).alias("_ok"))
    df = spans.join(cut, key, "left").join(ends, "ref", "left")
    keep = F.coalesce(F.col("_ok"), F.lit(False)) & (~F.coalesce("exempt", F.lit(False)) if "exempt" in spans.columns else F.lit(True))
    hi = F.when(F.col("hi") > F.col("_end"), F.col("hi")).otherwise(F.col("_hi"))
    return df.withColumn("new_lo", F.when(keep, F.col("_lo")).otherwise(F.col("lo"))).withColumn("new_hi", F.when(keep, hi).otherwise(F.col("hi"))).drop("_lo", "_hi", "_ok", "_end")


def snap_starts(spans: DataFrame, opens: DataFrame, key: str, reach: int = 3) -> DataFrame:
    """``new_lo``: the first opening segment after the start, up to ``reach`` on and before the end; else the one just before.

    ``opens`` has ``ref, seg`` of segments that open with an introducer. One-segment spans stay.
    """
    near = spans.select(key, "ref", "lo", "hi").join(opens.select("ref", "seg"), "ref").where(f"seg between lo - 1 and least(hi - 1, lo + {reach}) and seg <> lo and hi > lo")
    best = near.groupBy(key).agg(F.min(F.when(F.col("seg") > F.col("lo"), F.col("seg"))).alias("_on"), F.max(F.when(F.col("seg") == F.col("lo") - 1, F.col("seg"))).alias("_back"))
    return spans.join(best, key, "left").withColumn("new_lo", F.coalesce("_on", "_back", "lo")).drop("_on", "_back")


def trim_ends(spans: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """``new_hi``: the end without trailing marked segments while more than two are left. ``marked`` has ``ref, seg``. Spans for which a
    boolean column ``exempt`` of theirs is true, as those that go on on the next page, are left alone."""
    own = cells(spans.select(key, "ref", "lo", "hi"))
    tail = own.join(marked.select("ref", "seg").distinct().withColumn("_m", F.lit(True)), ["ref", "seg"], "left")
    last = tail.groupBy(key).agg(F.max(F.when(F.col("_m").isNull() | (F.col("seg") <= F.col("lo") + 1), F.col("seg"))).alias("_hi"))
    kept = F.when(F.coalesce("exempt", F.lit(False)), F.col("hi")) if "exempt" in spans.columns else F.lit(None).cast("int")
    return spans.join(last, key, "left").withColumn("new_hi", F.coalesce(kept, "_hi", "hi")).drop("_hi")


def section_state(marks: DataFrame, opener: str, closer: str) -> DataFrame:
    """``in_section`` of every segment of ``marks`` (``ref, seg, mark``): between an opener and the next closer.

    Before a page's first mark the state is what that mark implies: inside if it closes. Pages without marks are outside.
    """
    so_far = Window.partitionBy("ref").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("ref").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.when(F.col("mark").isin(opener, closer), F.col("mark"))
    state = F.coalesce(F.last(known, True).over(so_far) == opener, F.first(known, True).over(whole) == closer, F.lit(False))
    return marks.withColumn("in_section", state)


def free_neighbours(spans: DataFrame, segments: DataFrame, key: str, reach: int = 1) -> DataFrame:
    """Segments in no span, up to ``reach`` from one, with the first span (by lo, hi, key) that claims them."""
    taken = cells(spans).select("ref", "seg").distinct()
    around = spans.select(key, "ref", "lo", "hi").withColumn("seg", F.explode(F.concat(F.sequence(F.col("lo") - reach, F.col("lo") - 1), F.sequence(F.col("hi") + 1, F.col("hi") + reach))))
    free = around.join(segments.select("ref", F.col("seg_idx").alias("seg")), ["ref", "seg"], "left_semi").join(taken, ["ref", "seg"], "left_anti")
    return free.groupBy("ref", "seg").agg(F.min(F.struct("lo", "hi", key))[key].alias(key))


def nearest(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``distance`` of each point (``ref, seg``) to the nearest span of its page, null without one, and its bucket."""
    d = F.greatest(F.lit(0), F.col("lo") - F.col("seg"), F.col("seg") - F.col("hi"))
    near = points.select(key, "ref", "seg").join(spans.select("ref", "lo", "hi"), "ref").groupBy(key).agg(F.min(d).alias("distance"))
    bucket = F.when(F.col("distance").isNull(), "none").when(F.col("distance") == 0, "inside").when(F.col("distance") <= 1, "next").when(F.col("distance") <= 6, "near").otherwise("far")
    return points.join(near, key, "left").withColumn("bucket", bucket)


def cell_components(spans: DataFrame) -> DataFrame:
    """``(id, component)``: spans that share cells, directly or by way of others; spans may lie on several pages (several rows).

    One label round per step of the longest chain, at most doubling: labels are handed on through cells and then through the
    labels' own spans. The state between rounds is checkpointed.
    """
    from spanloom.runtime import counted, find_heavy, lookup, store

    own = store(cells(spans).select("id", "ref", "seg").distinct())
    label = store(own.select("id").distinct().withColumn("component", F.col("id")))
    while True:
        by_cell = own.join(label, "id").groupBy("ref", "seg").agg(F.min("component").alias("_c"))
        low = own.join(by_cell, ["ref", "seg"]).groupBy("id").agg(F.min("_c").alias("_c"))
        step, n = counted(label.join(low, "id").select("id", F.least("component", "_c").alias("_n"), "component"))
        jump = step.select(F.col("id").alias("_n"), F.col("_n").alias("_j"))
        new = store(lookup(step, jump, "_n", find_heavy(step, "_n", n), "inner").select("id", F.least("_n", "_j").alias("new"), "component"))
        settled = new.where("new <> component").isEmpty()
        label = new.select("id", F.col("new").alias("component"))
        if settled:
            return label


def run_diff(old: DataFrame, new: DataFrame, key: str, bounds: list[str], call: str) -> DataFrame:
    """``(key, change)`` between two runs: added, removed, moved (bounds differ), reclassified; unchanged rows don't come."""
    a = old.select(key, F.struct(*bounds).alias("_ab"), F.col(call).alias("_ac"), F.lit(True).alias("_a"))
    b = new.select(key, F.struct(*bounds).alias("_bb"), F.col(call).alias("_bc"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_ab").eqNullSafe(F.col("_bb")), "moved").when(~F.col("_ac").eqNullSafe(F.col("_bc")), "reclassified")
    return both.select(key, change.alias("change")).where("change is not null")


def first_copies(rows: DataFrame, fingerprint: str, order: str) -> DataFrame:
    """``first_of``: for a row whose fingerprint came earlier, the ``order`` of the first; null for the first itself."""
    first = rows.groupBy(fingerprint).agg(F.min(order).alias("_first"))
    return rows.join(first, fingerprint, "left").withColumn("first_of", F.when(F.col("_first") < F.col(order), F.col("_first"))).drop("_first")
