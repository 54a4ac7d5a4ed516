"""Queries of verdicts, claims, promotions, registries, unions of runs, samples, orders and resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import claims, evaluation, spans
from spanloom.operators.evaluation import DEFINITE, is_story, kind
from spanloom.plans import base, eval_queries
from spanloom.plans.base import GOOD, LABELLED, MGOOD, MIRROR, PAGE, SEG, STORY, with_
from spanloom.plans.eval_queries import DEF, ENTRY, IS_STORY, KIND, LISTED, RANGES, SHIP, CELLS
from spanloom.runtime import read


def _good(spark: SparkSession, d: str, table: str = "stories_main", *more: str) -> DataFrame:
    return base.stories(spark, d, table, *more).where("lo <= hi and ref is not null")


def _seeded(seed: int, c: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def verdict_attach(spark: SparkSession, d: str) -> DataFrame:
    """Stories with what reviewers said of detector spans with the same bounds, or else of those that overlap."""
    e = eval_queries._entries(spark, d).select("detector_span", F.explode("verdicts").alias("v")).select(F.explode("detector_span").alias("s"), F.regexp_replace(F.lower("v.read_as"), "[^a-z]", "").alias("said"))
    return claims.attach_verdicts(_good(spark, d), e.where("said is not null").select("s.ref", F.col("s.start_segment").alias("lo"), F.col("s.end_segment").alias("hi"), "said"))


def _tight(spark: SparkSession, d: str) -> DataFrame:
    """Segments in which the text of an entry's listed cells stands, on the cells' page."""
    seg = base.segments(spark, d).select("ref", F.col("seg_idx").alias("seg"), "english")
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "english"))), lambda x: x["english"]), " ")
    e = eval_queries._listed_cells(spark, d).join(seg, ["ref", "seg"]).where("english is not null").groupBy(F.col("entry_id").alias("id"), "ref").agg(own.alias("text"))
    return claims.tight_segments(e, base.segments(spark, d).select("ref", F.col("seg_idx").alias("seg"), F.coalesce("english", F.lit("")).alias("text")))


def tight_segments(spark: SparkSession, d: str) -> DataFrame:
    return _tight(spark, d)


def two_level_claims(spark: SparkSession, d: str) -> DataFrame:
    """Stories claimed by listed entries: by the segments their text stands in, else by the cells that the expert lists."""
    window = eval_queries._listed_cells(spark, d).select(F.col("entry_id").alias("id"), "ref", "seg")
    return claims.two_level_claims(_tight(spark, d), window, _good(spark, d))


def decision_hits(spark: SparkSession, d: str) -> DataFrame:
    """Stories that a member of a decision's groups touches, and whether a member has exactly their bounds."""
    m = read(spark, d, "boundary_decisions").select("kind", F.explode("groups").alias("g")).select("kind", F.explode("g.members").alias("m")).select("kind", "m.ref", F.col("m.start_segment").alias("lo"), F.col("m.end_segment").alias("hi")).where("kind is not null and ref is not null and lo <= hi").distinct()
    pairs = spans.overlap_join(_good(spark, d).select("id", "ref", "lo", "hi"), m)
    return pairs.groupBy("id", F.col("r_kind").alias("kind")).agg(F.max((F.col("lo") == F.col("r_lo")) & (F.col("hi") == F.col("r_hi"))).alias("exact"))


def promotion_pool(spark: SparkSession, d: str) -> DataFrame:
    """Stories called doubtful: promoted, or the first reason why not."""
    s = _good(spark, d, "stories_main", "classification")
    pool = s.where(F.coalesce(kind(F.col("classification")) == "LOW_CONFIDENCE", F.lit(False)))
    shipped = evaluation.overlapping(pool, eval_queries._shipped_cells(spark, d), "id")
    adjusted = read(spark, d, "boundary_decisions").where("kind = 'adjust'").select(F.explode("ids").alias("id")).where("id is not null")
    listed = evaluation.overlapping(pool, eval_queries._listed_cells(spark, d), "id")
    unlisted = pool.select("id").join(listed, "id", "left_anti")
    section = eval_queries.section_moved(spark, d)
    return claims.first_reason(pool, "id", [("overlaps a shipped story", shipped), ("removed by decision", adjusted), ("in a section", section), ("no evidence", unlisted)], "promoted")


def strongest_call(spark: SparkSession, d: str) -> DataFrame:
    """The strongest classification of the stories that touch an entry's listed cells, or 'absent'."""
    rank = F.when(kind(F.col("classification")) == "YES", 4).when(kind(F.col("classification")) == "HIGH_CONFIDENCE", 3).when(kind(F.col("classification")) == "LOW_CONFIDENCE", 2).otherwise(1)
    own = spans.cells(_good(spark, d, "stories_main", "classification").select("ref", "lo", "hi", rank.alias("rank"))).groupBy("ref", "seg").agg(F.max("rank").alias("rank"))
    best = eval_queries._listed_cells(spark, d).join(own, ["ref", "seg"], "left").groupBy("entry_id").agg(F.max("rank").alias("r"))
    return best.select("entry_id", F.when(F.col("r") == 4, "YES").when(F.col("r") == 3, "HIGH_CONFIDENCE").when(F.col("r") == 2, "LOW_CONFIDENCE").when(F.col("r") == 1, "NOT_A_STORY").otherwise("absent").alias("call"))


def nearest_pick(spark: SparkSession, d: str) -> DataFrame:
    """For each note the story that it overlaps most; of equal ones the one that starts first."""
    n = read(spark, d, "boundary_notes").where("page_ref is not null and start_segment <= end_segment").select(F.col("note_id").alias("n"), F.col("page_ref").alias("ref"), F.col("start_segment").alias("lo"), F.col("end_segment").alias("hi")).distinct()
    pairs = spans.overlap_join(n, _good(spark, d).select("id", "ref", "lo", "hi"))
    return pairs.groupBy(F.col("n").alias("note_id")).agg(F.min(F.struct((-F.col("shared")).alias("s"), "r_lo", "r_id"))["r_id"].alias("id"))


def run_union(spark: SparkSession, d: str) -> DataFrame:
    """Spans of both copies, equal ones once, with the copies they come from."""
    parts = [_good(spark, d, t).select("ref", "lo", "hi", F.lit(n).alias("run")) for t, n in (("stories_main", "main"), ("stories_mirror", "mirror"))]
    return parts[0].unionByName(parts[1]).groupBy("ref", "lo", "hi").agg(F.array_join(F.array_sort(F.collect_set("run")), "+").alias("runs"))


def mixed_union(spark: SparkSession, d: str) -> DataFrame:
    """Ruler entries and stories that none claims, in one table; what a side lacks is null."""
    e = eval_queries._entries(spark, d).select(F.lit("entry").alias("what"), F.col("entry_id").alias("key"), "ref", "expert_listed")
    s = two_level_claims(spark, d).where("entry is null").select("id").join(_good(spark, d, "stories_main", "classification"), "id").select(F.lit("story").alias("what"), F.col("id").alias("key"), "ref", "classification")
    return e.unionByName(s, allowMissingColumns=True)


def extra_stories(spark: SparkSession, d: str) -> DataFrame:
    """The mirror's stories that overlap none of the main copy's, nor each other in order."""
    a, b = (_good(spark, d, t, "span_no").withColumnRenamed("span_no", "no") for t in ("stories_main", "stories_mirror"))
    return claims.add_extras(a, b)


def first_per_page(spark: SparkSession, d: str) -> DataFrame:
    """Both copies end to end: the first story of each page wins; pages by number, those without one last."""
    parts = [_good(spark, d, t).select("ref", "id", F.lit(i).alias("part"), "lo") for i, t in enumerate(("stories_main", "stories_mirror"))]
    one = parts[0].unionByName(parts[1]).groupBy("ref").agg(F.min(F.struct("part", "lo", "id"))["id"].alias("id"))
    return one.select("ref", "id", F.coalesce(text.page_order(F.col("ref")), F.lit(999)).alias("page_key"))


def splice_partition(spark: SparkSession, d: str) -> DataFrame:
    """How many pages are in both copies with the mirror newer or not, and in one only: the four parts make up the whole."""
    a, b = (base.stories(spark, d, t).where("ref is not null").groupBy("ref").agg(F.max("updated_at").alias(n)) for t, n in (("stories_main", "ours"), ("stories_mirror", "theirs")))
    part = F.when(F.col("ours").isNull(), "mirror only").when(F.col("theirs").isNull(), "main only").when(F.col("theirs") > F.col("ours"), "replaced").otherwise("kept")
    return a.join(b, "ref", "full_outer").groupBy(part.alias("part")).agg(F.count("*").alias("pages"))


def tiered_sample(spark: SparkSession, d: str) -> DataFrame:
    """Ten stories of each classification, sure ones first within the seeded order."""
    tier = F.when(F.col("score") >= 0.7, 0).when(F.col("score") >= 0.4, 1).otherwise(2)
    s = base.stories(spark, d, "stories_main", "classification", "score").select("id", kind(F.col("classification")).alias("label"), tier.alias("tier")).where("label is not null")
    w = Window.partitionBy("label").orderBy("tier", _seeded(11, F.col("id")), "id")
    return s.withColumn("k", F.row_number().over(w)).where("k <= 10")


def must_read(spark: SparkSession, d: str) -> DataFrame:
    """Stories that both copies classify differently, all of them, and twenty others by seeded order."""
    from spanloom.plans.span_queries import run_diff

    must = run_diff(spark, d).where("change = 'reclassified'").select("id", F.lit("must").alias("why"))
    rest = base.stories(spark, d).select("id").join(must, "id", "left_anti").orderBy(_seeded(5, F.col("id")), "id").limit(20)
    return must.unionByName(rest.withColumn("why", F.lit("sampled")))


def simple_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents by seeded order."""
    return read(spark, d, "documents").select("doc_id").distinct().orderBy(_seeded(13, F.col("doc_id")), "doc_id").limit(50)


def longest_first(spark: SparkSession, d: str) -> DataFrame:
    """Corpora in the order in which they are worked on: most pages first."""
    n = base.pages(spark, d).groupBy("corpus").agg(F.count("*").alias("pages"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pages"), "corpus")))


def hand_out_order(spark: SparkSession, d: str) -> DataFrame:
    """Each corpus's stories in the order in which they are handed out: page, segment, id."""
    w = Window.partitionBy("corpus").orderBy(F.coalesce(text.page_order(F.col("ref")), F.lit(999)), "lo", "id")
    return _good(spark, d).select("corpus", "id", F.row_number().over(w).alias("place"))


def every_fifth_page(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth page of each corpus: the sampling operator's own feature."""
    return base.pages(spark, d).where("page_seq % 5 = 0").select("corpus", "ref", "page_seq")


def first_shown(spark: SparkSession, d: str) -> DataFrame:
    """The first three missed entries of each corpus, as a report shows them."""
    w = Window.partitionBy("corpus").orderBy("entry_id")
    return eval_queries._steps(spark, d).where("not shipped").withColumn("k", F.row_number().over(w)).where("k <= 3").select("corpus", "k", "entry_id")


def remark_groups(spark: SparkSession, d: str) -> DataFrame:
    """Equal remarks on one page: the first, how many, and all their ids."""
    n = read(spark, d, "boundary_notes").select("corpus", "page_ref", "note", "note_id").distinct()
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("note_id")), lambda x: x.cast("string")), ",")
    return n.groupBy("corpus", "page_ref", "note").agg(F.min("note_id").alias("first_id"), F.count("*").alias("n"), ids.alias("ids"))


def shipped_counts(spark: SparkSession, d: str) -> DataFrame:
    s = base.stories(spark, d).join(eval_queries.ship_list(spark, d), "id")
    return s.groupBy("corpus").agg(F.count("*").alias("stories"), F.count_if("ships").alias("shipped"), F.count_if(F.col("why") == "judges").alias("dropped"))


def rule_pricing(spark: SparkSession, d: str) -> DataFrame:
    """What each candidate rule would add: spans, how many of them touch listed cells, and that share with its interval."""
    a = _good(spark, d, "stories_main", "classification").select("id", "ref", "lo", "hi", kind(F.col("classification")).alias("a"))
    b = base.stories(spark, d, "stories_mirror", "classification").select("id", kind(F.col("classification")).alias("b"))
    on = evaluation.overlapping(a, eval_queries._listed_cells(spark, d), "id").withColumn("on", F.lit(True))
    sure = lambda c: F.coalesce(F.col(c).isin(*DEFINITE), F.lit(False))
    rule = F.when(sure("a") & ~sure("b"), "one run").when(~sure("a") & sure("b"), "other run").when((F.col("a") == "LOW_CONFIDENCE") & (F.col("b") == "LOW_CONFIDENCE"), "low in both")
    n = a.join(b, "id").join(on, "id", "left").withColumn("rule", rule).where("rule is not null").groupBy("rule").agg(F.count("*").alias("added"), F.count_if("on").alias("listed"))
    return n.withColumns({"low": text.wilson(F.col("listed"), F.col("added"), False), "mid": F.round(F.col("listed") / F.col("added"), 3), "high": text.wilson(F.col("listed"), F.col("added"), True)})


def refused_changes(spark: SparkSession, d: str) -> DataFrame:
    """Stories widened by a segment at either end, as far as none comes to overlap another."""
    s = _good(spark, d).select("id", "ref", "lo", "hi")
    return claims.refuse_clashing(s, s.select("id", (F.col("lo") - 1).alias("new_lo"), (F.col("hi") + 1).alias("new_hi")))


STEPS = ["text", "labels", "stories", "mirror", "judges"]


def ready_steps(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus, which of five steps could run now: each needs the one before it done, and not red."""
    seg = base.segments(spark, d).withColumn("label", base.label(F.col("english")))
    page = seg.groupBy("corpus", "ref").agg(F.bool_and(F.col("label") == "TRIAGE_FAILED").alias("bad")).groupBy("corpus").agg(F.max("bad").alias("bad"))
    known = read(spark, d, "stories_main").where("corpus is not null").select("corpus").distinct().withColumn("m", F.lit(True))
    df = page.join(known, "corpus", "left")
    state = lambda c: F.when(c, "done").otherwise("pending")
    there = [F.lit(True), F.lit(True), F.col("m").isNotNull(), F.lit(False), F.lit(False)]  # nothing says that the last two have run
    steps = F.array(*(F.struct(F.lit(s).alias("step"), state(t).alias("state"), (F.when(F.col("bad"), "red") if s == "labels" else F.lit("green")).alias("color")) for s, t in zip(STEPS, there)))
    depends = spark.createDataFrame(list(zip(STEPS[1:], STEPS)), "step string, needs string")  # five rows
    return claims.ready_steps(df.select(F.col("corpus").alias("unit"), F.explode(steps).alias("s")).select("unit", "s.*"), F.broadcast(depends))


def resume_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a resumed run still has to do: those without a story in the mirror under the same text's fingerprint, or blank ones."""
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.coalesce("english", F.lit("")).alias("t")))), lambda x: x["t"]))
    page = base.segments(spark, d).groupBy("ref").agg(F.substring(F.sha2(body, 256), 1, 16).alias("fingerprint"), F.bool_and(F.trim(F.coalesce("english", F.lit(""))) == "").alias("failed"))
    done = page.join(base.stories(spark, d, "stories_mirror").select("ref").distinct(), "ref", "left_semi")
    return claims.to_do(page.select("ref", "fingerprint"), done, ["ref", "fingerprint"])


def status_merge(spark: SparkSession, d: str) -> DataFrame:
    """The status of corpora after a run over the mirror's: other records and earlier costs stay."""
    rec = lambda t, skip: base.stories(spark, d, t, "criteria_met_count").groupBy("corpus").agg(F.sum(F.coalesce("criteria_met_count", F.lit(0))).cast("double").alias("cost"), F.count("*").alias("n")).select(F.col("corpus").alias("unit"), F.lit("run").alias("step"), F.when((F.col("n") % 2 == 0) & F.lit(skip), "skipped").otherwise("done").alias("state"), F.when((F.col("n") % 2 == 0) & F.lit(skip), 0.0).otherwise(F.col("cost")).alias("cost"))
    return claims.merge_status(rec("stories_main", False), rec("stories_mirror", True))


def note_merge(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the main copy merged with the mirror's as drafts: sure ones count as approved, empty drafts are held."""
    a = base.stories(spark, d, "stories_main", "one_sentence_summary", "classification").select("id", F.col("one_sentence_summary").alias("note"), (kind(F.col("classification")) == "YES").alias("approved"))
    b = base.stories(spark, d, "stories_mirror", "one_sentence_summary").select("id", F.col("one_sentence_summary").alias("note"), F.when(F.coalesce(F.trim("one_sentence_summary"), F.lit("")) == "", "empty").alias("problem"))
    return claims.merge_notes(a, b).select("id", "note", "approved", "state")


def open_history(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last week and, of earlier ones, those without a later event of their user: the part of a history that is read."""
    ev = read(spark, d, "events").select("event_id", "user_id", "ts", (F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7) + 1).cast("int").alias("week"))
    last = ev.agg(F.max("week").alias("last"))
    newest = ev.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    now = ev.crossJoin(F.broadcast(last)).where("week = last").select("event_id")
    return now.unionByName(newest.select("event_id")).distinct()


def rounds_completed(spark: SparkSession, d: str) -> DataFrame:
    """Per user: weeks in a row, from the first, with all kinds of event."""
    ev = read(spark, d, "events").select("user_id", (F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7) + 1).cast("int").alias("round"), F.col("event_type").alias("item"))
    return claims.completed_rounds(ev, ev, "user_id")


def queries() -> dict:
    fs = [verdict_attach, tight_segments, two_level_claims, decision_hits, promotion_pool, strongest_call, nearest_pick, run_union, mixed_union, extra_stories, first_per_page, splice_partition, tiered_sample, must_read, simple_sample, longest_first, hand_out_order, every_fifth_page, first_shown, remark_groups, shipped_counts, rule_pricing, refused_changes, ready_steps, resume_pages, status_merge, note_merge, open_history, rounds_completed]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    from spanloom.plans.span_queries import oracle_sql as span_sql

    w = r"list_filter(string_split(trim(regexp_replace(lower(regexp_replace({}, '<[^>]+>', ' ', 'g')), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'), ' '), ' '), lambda x: x <> '')"
    gram = lambda rel, by, c: f"SELECT DISTINCT {by}, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT {by}, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT {by}, {w.format(c)} AS w FROM {rel}))"
    own_text = "(SELECT entry_id AS id, l.ref, string_agg(english, ' ' ORDER BY seg) AS body FROM listed l JOIN seg s ON s.ref = l.ref AND s.seg_idx = l.seg WHERE english IS NOT NULL GROUP BY ALL)"
    tight = f"ta AS ({gram(own_text, 'id, ref', 'body')}), tb AS ({gram('(SELECT ref, seg_idx AS seg, coalesce(english, chr(32)) AS english FROM seg)', 'ref, seg', 'english')}), tna AS (SELECT id, ref, count(*) AS na FROM ta GROUP BY ALL), tnb AS (SELECT ref, seg, count(*) AS nb FROM tb GROUP BY ALL), tight AS (SELECT * FROM (SELECT id, ref, seg, round(greatest(count(*) / any_value(na), count(*) / any_value(nb)), 6) AS share FROM ta JOIN tb USING (ref, g) JOIN tna USING (id, ref) JOIN tnb USING (ref, seg) GROUP BY id, ref, seg) WHERE share > 0.5)"
    claims_ = "own AS (SELECT id, ref, unnest(range(lo, hi + 1)) AS seg FROM good), st AS (SELECT DISTINCT t.id AS entry, own.id FROM tight t JOIN own ON own.ref = t.ref AND own.seg = t.seg), ls AS (SELECT DISTINCT l.entry_id AS entry, own.id FROM listed l JOIN own ON own.ref = l.ref AND own.seg = l.seg WHERE l.entry_id NOT IN (SELECT entry FROM st)), cl AS (SELECT entry, id, true AS strict FROM st UNION ALL SELECT entry, id, false FROM ls), tc AS (SELECT * FROM cl UNION ALL SELECT DISTINCT NULL, id, NULL::boolean FROM good WHERE id NOT IN (SELECT id FROM cl))"
    page_key = lambda c: f"(try_cast(regexp_extract({c}, '(\\d+)[ab]$', 1) AS int) * 2 + CASE WHEN suffix({c}, 'b') THEN 1 ELSE 0 END)"
    md5 = lambda seed, c: f"md5('{seed}:' || {c}::varchar)"
    K = KIND.format("classification")
    wil = lambda s: f"round((listed * 1.0 / added + 1.96 * 1.96 / (2 * added) {s} 1.96 * sqrt((listed * 1.0 / added) * (1 - listed * 1.0 / added) / added + 1.96 * 1.96 / (4.0 * added * added))) / (1 + 1.96 * 1.96 / added), 3)"
    week = "(floor(date_diff('day', DATE '2024-01-01', ts::date) / 7) + 1)::int"
    steps = eval_queries.ALL_STEPS
    return {
        "verdict_attach": with_(STORY, GOOD, ENTRY)
        + """, v AS (SELECT s.ref AS ref, s.start_segment AS lo, s.end_segment AS hi, regexp_replace(lower(x.read_as), '[^a-z]', '', 'g') AS said FROM (SELECT unnest(detector_span) AS s, x FROM (SELECT detector_span, unnest(verdicts) AS x FROM e))),
p AS (SELECT g.id, g.lo = v.lo AND g.hi = v.hi AS ex, said FROM good g JOIN v ON v.ref = g.ref AND v.lo <= v.hi AND g.lo <= v.hi AND v.lo <= g.hi WHERE said IS NOT NULL), q AS (SELECT *, bool_or(ex) OVER (PARTITION BY id) AS has FROM p),
a AS (SELECT id, bool_or(ex) AS ex, bool_or(said = 'yes') AND NOT bool_and(said = 'no') AS accepted FROM q WHERE ex OR NOT has GROUP BY id)
SELECT g.id, CASE WHEN ex THEN 'exact' WHEN ex IS NOT NULL THEN 'overlap' END AS match, accepted FROM good g LEFT JOIN a USING (id)""",
        "tight_segments": with_(SEG, ENTRY, LISTED, tight) + "SELECT id, ref, seg, share FROM tight",
        "two_level_claims": with_(SEG, STORY, GOOD, ENTRY, LISTED, tight, claims_) + "SELECT * FROM tc",
        "mixed_union": with_(SEG, STORY, GOOD, ENTRY, LISTED, tight, claims_) + "SELECT 'entry' AS what, entry_id AS key, ref, expert_listed, NULL AS classification FROM e UNION ALL SELECT 'story', id, ref, NULL, classification FROM good WHERE id IN (SELECT id FROM tc WHERE entry IS NULL)",
        "decision_hits": with_(STORY, GOOD) + ", m AS (SELECT DISTINCT kind, m.ref AS ref, m.start_segment AS lo, m.end_segment AS hi FROM (SELECT kind, unnest(g.members) AS m FROM (SELECT kind, unnest(groups) AS g FROM boundary_decisions)) WHERE kind IS NOT NULL AND m.ref IS NOT NULL AND m.start_segment <= m.end_segment) SELECT g.id, m.kind, bool_or(g.lo = m.lo AND g.hi = m.hi) AS exact FROM good g JOIN m ON m.ref = g.ref AND g.lo <= m.hi AND m.lo <= g.hi GROUP BY ALL",
        "promotion_pool": with_(*steps, f"sec AS ({span_sql()['section_state']})")
        + f""", pool AS (SELECT * FROM good WHERE {K} = 'LOW_CONFIDENCE'), pc AS (SELECT id, ref, unnest(range(lo, hi + 1))::int AS seg FROM pool), x AS (SELECT id, bool_or((pc.ref, pc.seg) IN (SELECT (ref, seg) FROM sh)) AS sh, bool_or((pc.ref, pc.seg) IN (SELECT (ref, seg) FROM listed)) AS li, bool_and(coalesce(in_section, false)) AS se FROM pc LEFT JOIN sec ON sec.ref = pc.ref AND sec.seg = pc.seg GROUP BY id)
SELECT id, CASE WHEN sh THEN 'overlaps a shipped story' WHEN id IN (SELECT id FROM adj WHERE id IS NOT NULL) THEN 'removed by decision' WHEN se THEN 'in a section' WHEN NOT li THEN 'no evidence' ELSE 'promoted' END AS reason FROM x""",
        "strongest_call": with_(STORY, GOOD, ENTRY, LISTED) + f", c AS (SELECT ref, seg, max(rank) AS rank FROM (SELECT ref, unnest(range(lo, hi + 1)) AS seg, CASE {K} WHEN 'YES' THEN 4 WHEN 'HIGH_CONFIDENCE' THEN 3 WHEN 'LOW_CONFIDENCE' THEN 2 ELSE 1 END AS rank FROM good) GROUP BY ALL) SELECT entry_id, CASE max(rank) WHEN 4 THEN 'YES' WHEN 3 THEN 'HIGH_CONFIDENCE' WHEN 2 THEN 'LOW_CONFIDENCE' WHEN 1 THEN 'NOT_A_STORY' ELSE 'absent' END AS call FROM listed LEFT JOIN c USING (ref, seg) GROUP BY entry_id",
        "nearest_pick": with_(STORY, GOOD) + ", n AS (SELECT DISTINCT note_id, page_ref AS ref, start_segment AS lo, end_segment AS hi FROM boundary_notes WHERE page_ref IS NOT NULL AND start_segment <= end_segment), p AS (SELECT note_id, g.id, row_number() OVER (PARTITION BY note_id ORDER BY least(n.hi, g.hi) - greatest(n.lo, g.lo) DESC, g.lo, g.id) AS k FROM n JOIN good g ON g.ref = n.ref AND g.lo <= n.hi AND n.lo <= g.hi) SELECT note_id, id FROM p WHERE k = 1",
        "run_union": with_(STORY, MIRROR, GOOD, MGOOD) + ", u AS (SELECT DISTINCT ref, lo, hi, 'main' AS run FROM good UNION ALL SELECT DISTINCT ref, lo, hi, 'mirror' FROM mgood) SELECT ref, lo, hi, string_agg(run, '+' ORDER BY run) AS runs FROM u GROUP BY ref, lo, hi",
        "extra_stories": "WITH RECURSIVE " + ", ".join((STORY, MIRROR, GOOD, MGOOD))
        + """, b AS (SELECT ref, id, lo, hi, row_number() OVER (PARTITION BY ref ORDER BY span_no NULLS FIRST, id) AS k FROM mgood), a AS (SELECT ref, list({'lo': lo, 'hi': hi}) AS l FROM good GROUP BY ref),
w AS (SELECT r.ref, 0::bigint AS k, coalesce(a.l, []) AS used, NULL::varchar AS id FROM (SELECT DISTINCT ref FROM b) r LEFT JOIN a USING (ref)
  UNION ALL SELECT w.ref, b.k, CASE WHEN len(list_filter(w.used, lambda x: x.lo <= b.hi AND b.lo <= x.hi)) = 0 THEN list_append(w.used, {'lo': b.lo, 'hi': b.hi}) ELSE w.used END, CASE WHEN len(list_filter(w.used, lambda x: x.lo <= b.hi AND b.lo <= x.hi)) = 0 THEN b.id END FROM w JOIN b ON b.ref = w.ref AND b.k = w.k + 1)
SELECT ref, id FROM w WHERE id IS NOT NULL""",
        "first_per_page": with_(STORY, MIRROR, GOOD, MGOOD) + f", u AS (SELECT ref, id, 0 AS part, lo FROM good UNION ALL SELECT ref, id, 1, lo FROM mgood), k AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY part, lo, id) AS k FROM u) SELECT ref, id, coalesce({page_key('ref')}, 999) AS page_key FROM k WHERE k = 1",
        "splice_partition": with_(STORY, MIRROR) + ", j AS (SELECT a.u AS ours, b.u AS theirs FROM (SELECT ref, max(updated_at) AS u FROM story WHERE ref IS NOT NULL GROUP BY ref) a FULL JOIN (SELECT ref, max(updated_at) AS u FROM mirror WHERE ref IS NOT NULL GROUP BY ref) b ON a.ref = b.ref) SELECT CASE WHEN ours IS NULL THEN 'mirror only' WHEN theirs IS NULL THEN 'main only' WHEN theirs > ours THEN 'replaced' ELSE 'kept' END AS part, count(*) AS pages FROM j GROUP BY 1",
        "tiered_sample": with_(STORY) + f", t AS (SELECT id, {K} AS label, CASE WHEN score >= 0.7 THEN 0 WHEN score >= 0.4 THEN 1 ELSE 2 END AS tier FROM story WHERE {K} IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tier, {md5(11, 'id')}, id) AS k FROM t) SELECT id, label, tier, k FROM k WHERE k <= 10",
        "must_read": "WITH d AS (" + span_sql()["run_diff"] + f"), m AS (SELECT id FROM d WHERE change = 'reclassified'), r AS (SELECT DISTINCT story_id AS id FROM stories_main WHERE story_id NOT IN (SELECT id FROM m)) SELECT id, 'must' AS why FROM m UNION ALL SELECT id, 'sampled' FROM (SELECT id FROM r ORDER BY {md5(5, 'id')}, id LIMIT 20)",
        "simple_sample": f"SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY {md5(13, 'doc_id')}, doc_id LIMIT 50",
        "longest_first": with_(SEG, PAGE) + "SELECT corpus, count(*) AS pages, row_number() OVER (ORDER BY count(*) DESC, corpus) AS place FROM page GROUP BY corpus",
        "hand_out_order": with_(STORY, GOOD) + f"SELECT corpus, id, row_number() OVER (PARTITION BY corpus ORDER BY coalesce({page_key('ref')}, 999), lo, id) AS place FROM good",
        "every_fifth_page": with_(SEG, PAGE) + "SELECT corpus, ref, page_seq FROM page WHERE page_seq % 5 = 0",
        "first_shown": with_(*steps) + "SELECT corpus, k, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY entry_id) AS k FROM steps WHERE NOT shipped) WHERE k <= 3",
        "remark_groups": "SELECT corpus, page_ref, note, min(note_id) AS first_id, count(*) AS n, string_agg(note_id::varchar, ',' ORDER BY note_id) AS ids FROM (SELECT DISTINCT corpus, page_ref, note, note_id FROM boundary_notes) GROUP BY ALL",
        "shipped_counts": with_(STORY, MIRROR, GOOD, MGOOD, ENTRY, RANGES, CELLS, SHIP) + "SELECT corpus, count(*) AS stories, count(*) FILTER (why IS NULL) AS shipped, count(*) FILTER (why = 'judges') AS dropped FROM ship JOIN story USING (id) GROUP BY corpus",
        "rule_pricing": with_(STORY, MIRROR, GOOD, ENTRY, LISTED)
        + f""", a AS (SELECT id, ref, lo, hi, {K} AS a FROM good), b AS (SELECT id, {K} AS b FROM mirror), o AS (SELECT DISTINCT id FROM (SELECT id, ref, unnest(range(lo, hi + 1)) AS seg FROM a) JOIN listed USING (ref, seg)),
s AS (SELECT id, a, b, coalesce(a IN ('YES', 'HIGH_CONFIDENCE'), false) AS x, coalesce(b IN ('YES', 'HIGH_CONFIDENCE'), false) AS y FROM a JOIN b USING (id)), r AS (SELECT CASE WHEN x AND NOT y THEN 'one run' WHEN NOT x AND y THEN 'other run' WHEN a = 'LOW_CONFIDENCE' AND b = 'LOW_CONFIDENCE' THEN 'low in both' END AS rule, id IN (SELECT id FROM o) AS o FROM s),
n AS (SELECT rule, count(*) AS added, count(*) FILTER (o) AS listed FROM r WHERE rule IS NOT NULL GROUP BY rule) SELECT rule, added, listed, {wil('-')} AS low, round(listed / added, 3) AS mid, {wil('+')} AS high FROM n""",
        "ready_steps": with_(SEG, LABELLED) + ", p AS (SELECT corpus, max(bad::int) AS bad FROM (SELECT corpus, ref, bool_and(label = 'TRIAGE_FAILED') AS bad FROM labelled GROUP BY ALL) GROUP BY corpus) SELECT corpus AS unit, CASE WHEN m THEN 'mirror' ELSE 'stories' END AS step FROM (SELECT corpus, bad, corpus IN (SELECT corpus FROM stories_main) AS m FROM p) WHERE m OR bad = 0",
        "resume_pages": with_(SEG, MIRROR) + ", p AS (SELECT ref, substring(sha256(string_agg(coalesce(english, ''), chr(10) ORDER BY seg_idx)), 1, 16) AS fingerprint, bool_and(trim(coalesce(english, ''), ' ') = '') AS failed FROM seg GROUP BY ref) SELECT ref, fingerprint FROM p WHERE failed OR ref NOT IN (SELECT ref FROM mirror WHERE ref IS NOT NULL)",
        "status_merge": with_(STORY, MIRROR) + ", a AS (SELECT corpus AS unit, sum(coalesce(criteria_met_count, 0))::double AS cost FROM story GROUP BY corpus), b AS (SELECT corpus AS unit, count(*) % 2 = 0 AS skip, sum(coalesce(criteria_met_count, 0))::double AS cost FROM mirror GROUP BY corpus) SELECT coalesce(a.unit, b.unit) AS unit, 'run' AS step, CASE WHEN b.unit IS NULL THEN 'done' WHEN skip THEN 'skipped' ELSE 'done' END AS state, CASE WHEN b.unit IS NULL OR skip THEN a.cost ELSE b.cost END AS cost FROM a FULL JOIN b ON a.unit IS NOT DISTINCT FROM b.unit",
        "note_merge": with_(STORY, MIRROR) + f", a AS (SELECT id, one_sentence_summary AS n, coalesce({K} = 'YES', false) AS ap FROM story), b AS (SELECT id, one_sentence_summary AS n, trim(coalesce(one_sentence_summary, ''), ' ') = '' AS bad FROM mirror), j AS (SELECT coalesce(a.id, b.id) AS id, b.id IS NULL AS nod, coalesce(ap, false) AS ap, a.n AS x, b.n AS y, bad FROM a FULL JOIN b ON a.id = b.id), k AS (SELECT *, CASE WHEN nod OR ap THEN x ELSE y END AS note FROM j) SELECT id, note, ap AND note IS NOT DISTINCT FROM x AS approved, CASE WHEN nod THEN 'kept' WHEN ap THEN 'approved' WHEN bad THEN 'held' ELSE 'drafted' END AS state FROM k",
        "open_history": f"WITH e AS (SELECT event_id, user_id, ts, {week} AS week FROM events) SELECT event_id FROM e WHERE week = (SELECT max(week) FROM e) UNION SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k = 1",
        "rounds_completed": f"WITH e AS (SELECT user_id, {week} AS round, event_type AS item FROM events), n AS (SELECT user_id, round, count(DISTINCT item) = (SELECT count(DISTINCT item) FROM e WHERE item IS NOT NULL) AS ok FROM e GROUP BY ALL), f AS (SELECT user_id, round, row_number() OVER (PARTITION BY user_id ORDER BY round) AS k FROM n WHERE ok) SELECT u.user_id, coalesce(max(k), 0)::int AS completed FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN f ON f.user_id IS NOT DISTINCT FROM u.user_id AND f.k = f.round GROUP BY u.user_id",
    }
