"""Permanent identifiers, page folds, corrections and id registries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.spans import cells
from spanloom.runtime import store


def assign_ids(stories: DataFrame, registry: DataFrame) -> DataFrame:
    """``(story, id, how)``: what becomes of every story and every id that was in use.

    ``stories`` has ``story, ref, lo, hi``; ``registry`` has ``id, ref, lo, hi`` and may have ``status`` ('active', the default, or 'retired').
    Pairs are taken from those that share most cells down, one story per id, active ids first ('kept'), then retired ones
    ('revived'). Where a free story or id has several free partners with equally many cells the match is ambiguous: those stories
    are refused (null id), and so are the ids, until someone decides. Other stories get a new id ('minted'): their own name, or its
    next free version. Active ids that no story took lead to the id of the story that they share most cells with ('redirected', with
    that story), or are 'retired'. One pass for each number of shared cells, which is bounded by the longest span.
    """
    status = F.col("status") if "status" in registry.columns else F.lit("active")
    known = registry.withColumn("_pool", F.when(status == "retired", 1).otherwise(0))
    a, b = cells(stories).select("story", "ref", "seg").distinct(), cells(known).select("id", "_pool", "ref", "seg").distinct()
    pairs = store(a.join(b, ["ref", "seg"]).groupBy("_pool", "story", "id").agg(F.count("*").alias("n")))
    used = None
    for level in sorted(pairs.select("_pool", "n").distinct().collect(), key=lambda r: (r["_pool"], -r["n"])):
        here = pairs.where((F.col("_pool") == level["_pool"]) & (F.col("n") == level["n"]))
        if used is not None:
            here = here.join(used.select("story").distinct(), "story", "left_anti").join(used.select("id").distinct(), "id", "left_anti")
        rivals = F.greatest(F.count("*").over(Window.partitionBy("story")), F.count("*").over(Window.partitionBy("id")))
        now = here.select("story", "id", F.when(rivals > 1, "refused").otherwise("revived" if level["_pool"] else "kept").alias("how"))
        used = store(now if used is None else used.unionByName(now))
    if used is None:
        used = pairs.select("story", "id", F.lit("").alias("how"))
    held = known.select(F.regexp_extract("id", r"^(.*?)(?:-v(\d+))?$", 1).alias("stem"), F.coalesce(F.regexp_extract("id", r"-v(\d+)$", 1).try_cast("int"), F.lit(1)).alias("v")).groupBy("stem").agg(F.max("v").alias("v"))
    fresh = stories.select("story").distinct().join(used.select("story").distinct(), "story", "left_anti")
    minted = fresh.join(held, fresh["story"] == held["stem"], "left").select("story", F.when(F.col("v").isNull(), F.col("story")).otherwise(F.concat("story", F.lit("-v"), F.col("v") + 1)).alias("id"), F.lit("minted").alias("how"))
    taken = used.where("how <> 'refused'")
    refused = used.where("how = 'refused'").select("story", F.lit(None).cast("string").alias("id"), "how").distinct()
    free = known.where("_pool = 0").select("id").distinct().join(used.select("id").distinct(), "id", "left_anti")
    most = pairs.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "story")).alias("b")).select("id", F.col("b.story").alias("story"))
    left = free.join(most, "id", "left").select("story", "id", F.when(F.col("story").isNull(), "retired").otherwise("redirected").alias("how"))
    return taken.unionByName(refused).unionByName(minted).unionByName(left)


def fold_stories(stories: DataFrame, pages: DataFrame) -> DataFrame:
    """``(id, merged_into, how, classification, lo2, hi2)``: stories merged over page breaks, by labels and then by flags alone.

    ``stories`` has ``corpus, page_seq, id, no`` (place on the page), ``lo, hi, classification, to_next, from_prev``; ``pages`` has
    ``corpus, page_seq, last, event_at_start`` (segment 0 or 1 tells an event) and ``event_at_end`` (the last one does). On each break
    the story that reaches furthest down the earlier page, a, meets the one nearest the top of the later page, b. Where both pages
    tell events at the break, the first of these cases that holds merges b into a, a reaching the last but one segment at least:

    1. a is no story, b is one and begins on segment 0 or 1: a takes b's classification;
    2. a is a story, b none that begins on 0 or 1;
    3. neither is one, b begins on 0 or 1: a becomes LOW_CONFIDENCE;
    4. both are, b begins on 0, either is flagged to run over: the higher classification;
    5. both are, b begins on 1, a reaches the last segment, both are flagged: the same, and b's part begins on 0.

    After that, all breaks again in order ('flags'): a story a that isn't merged yet and ends on the last segment takes in b on 0 if
    either is flagged and neither is classified as no story. A merged b is gone from its page, which may change the next break.
    ``how`` names the case, ``classification`` is a's after it, and ``lo2, hi2`` are a's segments on the later page. The second pass follows
    the first one page behind in one sorted stream, so three pages are held at a time.
    """
    df = stories.join(pages.select("corpus", "page_seq", "last", "event_at_start", "event_at_end"), ["corpus", "page_seq"])
    df = df.select("corpus", "page_seq", "id", F.coalesce("no", F.lit(2**31 - 1)).alias("no"), "lo", "hi", "classification", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("to_next", "from_prev", "event_at_start", "event_at_end")), "last")
    ranks = {"NOT_A_STORY": 1, "LOW_CONFIDENCE": 2, "HIGH_CONFIDENCE": 3, "YES": 4}
    names, kinds = ["id", "merged_into", "how", "classification", "lo2", "hi2"], [pa.string()] * 4 + [pa.int32()] * 2

    def meet(before: list[dict], page: list[dict]) -> tuple[dict, dict] | None:
        if not before or not page or before[0]["corpus"] != page[0]["corpus"] or before[0]["page_seq"] + 1 != page[0]["page_seq"]:
            return None
        ends, starts = [r for r in before if r["hi"] is not None], [r for r in page if r["lo"] is not None]
        return (min(ends, key=lambda r: (-r["hi"], r["no"], r["id"])), min(starts, key=lambda r: (r["lo"], r["no"], r["id"]))) if ends and starts else None

    def higher(a: str | None, b: str | None) -> str | None:
        return a if ranks.get(a, 0) >= ranks.get(b, 0) else b

    def merge(page: list[dict], a: dict, b: dict, how: str, classification: str | None, lo2: int) -> tuple:
        a.update(classification=classification, merged=True)
        page[:] = [r for r in page if r is not b]
        return b["id"], a["id"], how, classification, lo2, b["hi"]

    def by_labels(before: list[dict], page: list[dict], out: list[tuple]) -> None:
        if not (pair := meet(before, page)):
            return
        a, b = pair
        if not (a["event_at_end"] and b["event_at_start"] and a["hi"] >= a["last"] - 1 and b["lo"] <= 1):
            return
        x, y, none = a["classification"], b["classification"], "NOT_A_STORY"
        real = [c not in (none, None) for c in (x, y)]
        if x == none and real[1]:
            out.append(merge(page, a, b, "1", y, b["lo"]))
        elif real[0] and y == none:
            out.append(merge(page, a, b, "2", x, b["lo"]))
        elif x == none and y == none:
            out.append(merge(page, a, b, "3", "LOW_CONFIDENCE", b["lo"]))
        elif all(real) and b["lo"] == 0 and (a["to_next"] or b["from_prev"]):
            out.append(merge(page, a, b, "4", higher(x, y), 0))
        elif all(real) and b["lo"] == 1 and a["hi"] >= a["last"] and a["to_next"] and b["from_prev"]:
            out.append(merge(page, a, b, "5", higher(x, y), 0))

    def by_flags(before: list[dict], page: list[dict], out: list[tuple]) -> None:
        if not (pair := meet(before, page)):
            return
        a, b = pair
        if not a.get("merged") and a["hi"] == a["last"] and (a["to_next"] or b["from_prev"]) and "NOT_A_STORY" not in (a["classification"], b["classification"]) and b["lo"] < 1:
            out.append(merge(page, a, b, "flags", higher(a["classification"], b["classification"]), b["lo"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[dict] = []
        second: list[dict] = []
        page: list[dict] = []

        def closed(out: list[tuple]) -> None:
            """``page`` is whole: the first pass takes the break before it, the second the one before that."""
            nonlocal first, second, page
            by_labels(second, page, out)
            by_flags(first, second, out)
            first, second, page = second, page, []

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t[i] for t in out], type=k) for i, k in enumerate(kinds)], names)

        at = None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if at not in (None, (r["corpus"], r["page_seq"])):
                    closed(out)
                at = (r["corpus"], r["page_seq"])
                page.append(r)
            yield rows(out)
        out = []
        closed(out)
        by_flags(first, second, out)
        yield rows(out)

    return df.repartition("corpus").sortWithinPartitions("corpus", "page_seq").mapInArrow(run, "id string, merged_into string, how string, classification string, lo2 int, hi2 int")


def apply_corrections(spans: DataFrame, corrections: DataFrame) -> DataFrame:
    """``spans`` (``id, ref, lo, hi, classification``) after corrections (``seq, id, op, value``), in order of ``seq``.

    Operations: trim_start, trim_end, extend_start, extend_end (by value), reclassify (to value), remove. Corrections of one
    span are few, and are folded in order over its row.
    """
    todo = corrections.where("id is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "value"))).alias("_ops"))
    state = F.struct(F.col("lo"), F.col("hi"), F.col("classification").alias("c"), F.lit(False).alias("gone"))
    n = lambda o: F.coalesce(o["value"].try_cast("int"), F.lit(0))

    def step(s, o):
        op = o["op"]
        lo = F.when(op == "trim_start", s["lo"] + n(o)).when(op == "extend_start", s["lo"] - n(o)).otherwise(s["lo"])
        hi = F.when(op == "trim_end", s["hi"] - n(o)).when(op == "extend_end", s["hi"] + n(o)).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(op == "reclassify", o["value"]).otherwise(s["c"]).alias("c"), (s["gone"] | (op == "remove")).alias("gone"))

    df = spans.join(todo, "id", "left").withColumn("_s", F.when(F.col("_ops").isNull(), state).otherwise(F.aggregate("_ops", state, step)))
    return df.where("not _s.gone").withColumns({"lo": F.col("_s.lo"), "hi": F.col("_s.hi"), "classification": F.col("_s.c")}).drop("_ops", "_s")


def extend_for_display(spans: DataFrame, segments: DataFrame, back: int, forward: int) -> DataFrame:
    """``(id, pos_lo, pos_hi)``: spans widened in corpus order, across pages, within the corpus. ``segments`` has ``corpus, ref, seg, pos``."""
    at = segments.select("corpus", "ref", "seg", "pos")
    edges = segments.groupBy("corpus").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    lo = spans.join(at.select("ref", F.col("seg").alias("lo"), "corpus", F.col("pos").alias("p_lo")), ["ref", "lo"])
    both = lo.join(at.select("ref", F.col("seg").alias("hi"), F.col("pos").alias("p_hi")), ["ref", "hi"]).join(edges, "corpus")
    return both.select("id", F.greatest(F.col("p_lo") - back, "_first").alias("pos_lo"), F.least(F.col("p_hi") + forward, "_last").alias("pos_hi"))


def page_documents(segments: DataFrame) -> DataFrame:
    """One JSON text per page, its segments in order: what a page source hands out and a page sink takes."""
    seg = F.array_sort(F.collect_list(F.struct(F.col("seg_idx").alias("index"), "english", "hebrew")))
    return segments.groupBy("corpus", "ref").agg(F.to_json(F.struct(F.first("ref").alias("ref"), seg.alias("segments"))).alias("doc"))

