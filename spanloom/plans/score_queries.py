"""Queries of scores, agreement, gates, samples and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import scoring, spans
from spanloom.plans import base
from spanloom.plans.base import GOOD, MGOOD, MIRROR, PAGE, SEG, STORY, with_
from spanloom.runtime import read


def _entries(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "ruler_entries").dropDuplicates(["entry_id"])
    return df.select("entry_id", "corpus", "ref", "expert_listed", F.coalesce(F.size("detector_span") > 0, F.lit(False)).alias("proposed"))


def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Whether the detector proposed what the expert lists, per corpus and over all."""
    return scoring.confusion(_entries(spark, d), "expert_listed", "proposed", ["corpus"])


def wilson_by_judge(spark: SparkSession, d: str) -> DataFrame:
    """The share of answers that call a story, per judge, with its interval."""
    said = F.lower(F.trim("verdict"))
    n = read(spark, d, "judge_answers").where("verdict is not null").groupBy("judge").agg(F.count_if(said == "story").alias("hits"), F.count("*").alias("n"))
    return scoring.with_wilson(n, "hits", "n")


def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often two judges of one entry say the same, per pair of judges."""
    a = read(spark, d, "judge_answers").where("verdict is not null").groupBy("entry_id", "judge").agg(F.max_by("verdict", F.struct("answered_at", "answer_id")).alias("verdict"))
    b = a.select("entry_id", F.col("judge").alias("other"), F.col("verdict").alias("other_verdict"))
    both = a.join(b, "entry_id").where("judge < other")
    return both.groupBy("judge", "other").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == F.col("other_verdict")).alias("same"))


def judge_stability(spark: SparkSession, d: str) -> DataFrame:
    """Of entries a judge answered more than once: how many times all answers were the same."""
    per = read(spark, d, "judge_answers").where("verdict is not null").groupBy("judge", "entry_id").agg(F.count_distinct("answer_id").alias("n"), F.count_distinct("verdict").alias("kinds"))
    return per.where("n > 1").groupBy("judge").agg(F.count("*").alias("again"), F.count_if(F.col("kinds") == 1).alias("stable"))


def boundary_stats(spark: SparkSession, d: str) -> DataFrame:
    """IoU of stories that both copies have, per corpus: mean, upper median and share of good ones."""
    a, b = (base.stories(spark, d, t).where("lo <= hi and ref is not null").select("id", "corpus", "ref", "lo", "hi") for t in ("stories_main", "stories_mirror"))
    pair = a.join(b.select("id", F.col("ref").alias("r"), F.col("lo").alias("l"), F.col("hi").alias("h")), "id").where("ref = r").withColumn("iou", F.round(spans.iou(F.col("lo"), F.col("hi"), F.col("l"), F.col("h")), 9))
    stats = pair.groupBy("corpus").agg(F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.avg((F.col("iou") >= 0.8).cast("double")), 6).alias("good"), F.count("*").alias("n"))
    return stats.join(scoring.upper_median(pair, "corpus", "iou"), "corpus")


def density_buckets(spark: SparkSession, d: str) -> DataFrame:
    per = base.stories(spark, d).where("lo <= hi and ref is not null").groupBy("ref").agg(F.count("*").alias("n"))
    return base.pages(spark, d).join(per, "ref", "left").groupBy(F.least(F.coalesce("n", F.lit(0)), F.lit(4)).cast("int").alias("stories")).agg(F.count("*").alias("pages"))


def recall_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Of listed entries, per corpus: proposed, proposed on a listed cell (strict) and on the page only (loose)."""
    e = read(spark, d, "ruler_entries").where("expert_listed").dropDuplicates(["entry_id"])
    cells = e.select("entry_id", F.explode("expert_segments").alias("c")).select("entry_id", "c.ref", "c.seg").where("ref is not null and seg is not null")
    ranges = e.select("entry_id", F.explode("detector_span").alias("s")).select("entry_id", "s.ref", F.col("s.start_segment").alias("lo"), F.col("s.end_segment").alias("hi")).where("lo <= hi")
    strict = cells.join(ranges, ["entry_id", "ref"]).where("seg between lo and hi").select("entry_id").distinct().withColumn("s", F.lit(True))
    loose = cells.join(ranges, ["entry_id", "ref"], "left_semi").select("entry_id").distinct().withColumn("l", F.lit(True))
    df = e.select("entry_id", "corpus", F.coalesce(F.size("detector_span") > 0, F.lit(False)).alias("p")).join(strict, "entry_id", "left").join(loose, "entry_id", "left")
    return df.groupBy("corpus").agg(F.count("*").alias("listed"), F.count_if("p").alias("proposed"), F.count_if("s").alias("strict"), F.count_if("l").alias("loose"))


def gate_text(spark: SparkSession, d: str) -> DataFrame:
    """Checks of each corpus's text: missing segments, blank texts, order of pages; each against its limit."""
    seg = base.segments(spark, d)
    page = seg.groupBy("corpus", "ref", "page_seq").agg((F.max("seg_idx") + 1 - F.count("*")).alias("missing"), F.count_if(F.coalesce(F.trim("english"), F.lit("")) == "").alias("blank"), F.count("*").alias("n"))
    per = page.groupBy("corpus").agg(F.sum("missing").cast("double").alias("missing_segments"), F.round(F.sum("blank") / F.sum("n"), 6).alias("blank_share"), (F.max("page_seq") - F.min("page_seq") + 1 - F.count_distinct("page_seq")).cast("double").alias("page_holes"))
    long = per.unpivot("corpus", ["missing_segments", "blank_share", "page_holes"], "check", "measured")
    limit = F.when(F.col("check") == "blank_share", 0.05).otherwise(0.0)
    return long.withColumn("limit", limit).withColumn("status", F.when(F.col("measured") <= F.col("limit"), "green").when(F.col("check") == "page_holes", "amber").otherwise("red"))


def completeness(spark: SparkSession, d: str) -> DataFrame:
    """Pages that stories name and the text has, or hasn't, and the other way round."""
    named = base.stories(spark, d).where("ref is not null").groupBy("ref").agg(F.count("*").alias("stories"))
    both = base.pages(spark, d).select("ref", "last").join(named, "ref", "full_outer")
    return both.select("ref", F.when(F.col("last").isNull(), "no_text").when(F.col("stories").isNull(), "no_story").otherwise("both").alias("state"))


def additive_guard(spark: SparkSession, d: str) -> DataFrame:
    """What forbids replacing one copy by the other: rows lost and judgements changed."""
    a, b = (base.stories(spark, d, t, "classification").select("id", "classification") for t in ("stories_main", "stories_mirror"))
    both = a.join(b.withColumnRenamed("classification", "new").withColumn("there", F.lit(True)), "id", "left")
    return both.select("id", F.when(F.col("there").isNull(), "lost").when(~F.col("classification").eqNullSafe(F.col("new")), "changed").alias("violation")).where("violation is not null")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five documents of each source, by a seeded hash that both engines share."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id")
    return read(spark, d, "documents").where("source is not null").withColumn("k", F.row_number().over(w)).where("k <= 5").select("source", "k", "doc_id")


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Notes of each corpus in batches of twenty, in seeded order."""
    w = Window.partitionBy("corpus").orderBy(F.md5(F.concat(F.lit("3:"), F.col("note_id").cast("string"))), "note_id")
    return read(spark, d, "boundary_notes").select("corpus", "note_id").distinct().select("corpus", "note_id", F.floor((F.row_number().over(w) - 1) / 20).cast("int").alias("batch"))


def weekly_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Events by campaign week (seven days from the first day) and type, with the users of each."""
    ev = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    week = (F.floor(F.date_diff("day", F.lit("2024-01-01").cast("date")) / 7) + 1).cast("int")
    return ev.groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"))


def last_active_week(spark: SparkSession, d: str) -> DataFrame:
    week = (F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7) + 1).cast("int")
    return read(spark, d, "events").groupBy("user_id").agg(F.max(week).alias("last_week"))


def ledger_insert(spark: SparkSession, d: str) -> DataFrame:
    """Decisions not yet in a ledger of those taken before 2025: the earliest row of each id, inserted once."""
    rows = read(spark, d, "boundary_decisions").groupBy("decision_id").agg(F.min("decided_at").alias("decided_at"))
    old = rows.where("decided_at < timestamp_ntz'2025-01-01 00:00:00'")
    return rows.join(old, "decision_id", "left_anti").select("decision_id")


def dedupe_counts(spark: SparkSession, d: str) -> DataFrame:
    """Equal remarks on one page: how often, and the first of them."""
    return read(spark, d, "boundary_notes").groupBy("corpus", "page_ref", "note").agg(F.count_distinct("note_id").alias("n"), F.min("note_id").alias("first_id"))


def pointer_targets(spark: SparkSession, d: str) -> DataFrame:
    """Stories of a page that point at the next one while they overlap it: where each chain ends."""
    w = Window.partitionBy("ref").orderBy("lo", "hi", "id")
    s = base.stories(spark, d).where("lo <= hi and ref is not null")
    to = F.when(F.lead("lo").over(w) <= F.col("hi"), F.lead("id").over(w))
    return scoring.follow_pointers(s.select("id", to.alias("to")), "id", "to")


def edge_scores(spark: SparkSession, d: str) -> DataFrame:
    """How the starts that boundary notes name meet the stories over them."""
    notes = read(spark, d, "boundary_notes").where("page_ref is not null and start_segment is not null").groupBy("note_id").agg(F.min("page_ref").alias("ref"), F.min("start_segment").alias("lo"), F.max(F.coalesce("end_segment", "start_segment")).alias("hi"))
    return scoring.edge_scores(notes, base.stories(spark, d).where("lo <= hi and ref is not null"), "note_id").select("note_id", "score")


def bootstrap_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of listed entries that the detector proposed, with a bootstrap interval."""
    return scoring.bootstrap_share(_entries(spark, d).where("expert_listed"), "proposed")


def missing_estimate(spark: SparkSession, d: str) -> DataFrame:
    """How many stories are missing beyond the shipped ones, from the listed entries of each corpus that are shipped."""
    from spanloom.plans import eval_queries

    lists = eval_queries._steps(spark, d).groupBy(F.col("corpus").alias("list")).agg(F.count_if("shipped").alias("hits"), F.count("*").alias("n"))
    shipped = eval_queries.ship_list(spark, d).where("ships").count()
    return scoring.estimate_missing(lists, shipped, 54, 60)


def queries() -> dict:
    fs = [edge_scores, bootstrap_share, missing_estimate, label_confusion, wilson_by_judge, judge_agreement, judge_stability, boundary_stats, density_buckets, recall_funnel, gate_text, completeness, additive_guard, stratified_sample, batches, weekly_buckets, last_active_week, ledger_insert, dedupe_counts, pointer_targets]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    entry = "e AS (SELECT DISTINCT ON (entry_id) entry_id, corpus, ref, expert_listed, detector_span, expert_segments, verdicts FROM ruler_entries)"
    w = lambda s: f"round((hits * 1.0 / n + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt((hits * 1.0 / n) * (1 - hits * 1.0 / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 3)"
    r = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE round({a} * 1.0 / ({b}), 4) END"
    standing = "a AS (SELECT entry_id, judge, verdict FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, judge ORDER BY answered_at DESC, answer_id DESC) AS k FROM judge_answers WHERE verdict IS NOT NULL) WHERE k = 1)"
    week = "(floor(date_diff('day', DATE '2024-01-01', ts::date) / 7) + 1)::int"
    return {
        "label_confusion": "WITH " + entry + ", f AS (SELECT corpus, expert_listed AS t, coalesce(len(detector_span), 0) > 0 AS c FROM e WHERE expert_listed IS NOT NULL), g AS (SELECT corpus, count(*) FILTER (t AND c) AS tp, count(*) FILTER (NOT t AND c) AS fp, count(*) FILTER (t AND NOT c) AS fn, count(*) FILTER (NOT t AND NOT c) AS tn FROM f GROUP BY ROLLUP (corpus)) SELECT *, " + f"{r('tp', 'tp + fp')} AS precision, {r('tp', 'tp + fn')} AS recall, {r('2 * tp', '2 * tp + fp + fn')} AS f1 FROM g",
        "wilson_by_judge": f"WITH g AS (SELECT judge, count(*) FILTER (lower(trim(verdict, ' ')) = 'story') AS hits, count(*) AS n FROM judge_answers WHERE verdict IS NOT NULL GROUP BY judge) SELECT judge, hits, n, {w('-')} AS low, {w('+')} AS high FROM g",
        "judge_agreement": f"WITH {standing} SELECT a.judge, b.judge AS other, count(*) AS n, count(*) FILTER (a.verdict = b.verdict) AS same FROM a JOIN a b ON a.entry_id = b.entry_id AND a.judge < b.judge GROUP BY ALL",
        "judge_stability": "WITH p AS (SELECT judge, entry_id, count(DISTINCT answer_id) AS n, count(DISTINCT verdict) AS kinds FROM judge_answers WHERE verdict IS NOT NULL GROUP BY ALL) SELECT judge, count(*) AS again, count(*) FILTER (kinds = 1) AS stable FROM p WHERE n > 1 GROUP BY judge",
        "boundary_stats": with_(STORY, MIRROR, GOOD, MGOOD)
        + """, i AS (SELECT a.corpus, a.lo, a.hi, b.lo AS l, b.hi AS h, greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) AS x FROM good a JOIN mgood b ON a.id = b.id AND a.ref = b.ref),
u AS (SELECT corpus, round(x * 1.0 / ((hi - lo + 1) + (h - l + 1) - x), 9) AS iou FROM i), k AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY iou) - 1 AS j, count(*) OVER (PARTITION BY corpus) AS n FROM u)
SELECT corpus, round(avg(iou), 6) AS mean_iou, round(avg((iou >= 0.8)::int), 6) AS good, count(*) AS n, max(CASE WHEN j = n // 2 THEN iou END) AS median FROM k GROUP BY corpus""",
        "density_buckets": with_(SEG, PAGE, STORY, GOOD) + ", c AS (SELECT ref, count(*) AS n FROM good GROUP BY ref) SELECT least(coalesce(n, 0), 4)::int AS stories, count(*) AS pages FROM page LEFT JOIN c USING (ref) GROUP BY 1",
        "recall_funnel": "WITH "
        + entry
        + """, l AS (SELECT * FROM e WHERE expert_listed), c AS (SELECT entry_id, x.ref AS ref, x.seg AS seg FROM (SELECT entry_id, unnest(expert_segments) AS x FROM l) WHERE x.ref IS NOT NULL AND x.seg IS NOT NULL),
d AS (SELECT entry_id, s.ref AS ref, s.start_segment AS lo, s.end_segment AS hi FROM (SELECT entry_id, unnest(detector_span) AS s FROM l) WHERE s.start_segment <= s.end_segment)
SELECT corpus, count(*) AS listed, count(*) FILTER (coalesce(len(detector_span), 0) > 0) AS proposed, count(*) FILTER (entry_id IN (SELECT entry_id FROM c JOIN d USING (entry_id, ref) WHERE seg BETWEEN lo AND hi)) AS strict, count(*) FILTER (entry_id IN (SELECT entry_id FROM c JOIN d USING (entry_id, ref))) AS loose FROM l GROUP BY corpus""",
        "gate_text": with_(SEG)
        + """, p AS (SELECT corpus, ref, page_seq, max(seg_idx) + 1 - count(*) AS missing, count(*) FILTER (coalesce(trim(english, ' '), '') = '') AS blank, count(*) AS n FROM seg GROUP BY ALL),
g AS (SELECT corpus, sum(missing)::double AS a, round(sum(blank) / sum(n), 6) AS b, (max(page_seq) - min(page_seq) + 1 - count(DISTINCT page_seq))::double AS c FROM p GROUP BY corpus),
l AS (SELECT corpus, 'missing_segments' AS "check", a AS measured, 0.0 AS "limit" FROM g UNION ALL SELECT corpus, 'blank_share', b, 0.05 FROM g UNION ALL SELECT corpus, 'page_holes', c, 0.0 FROM g)
SELECT corpus, "check", measured, "limit"::double AS "limit", CASE WHEN measured <= "limit" THEN 'green' WHEN "check" = 'page_holes' THEN 'amber' ELSE 'red' END AS status FROM l""",
        "completeness": with_(SEG, PAGE, STORY) + ", n AS (SELECT ref, count(*) AS stories FROM story WHERE ref IS NOT NULL GROUP BY ref) SELECT coalesce(page.ref, n.ref) AS ref, CASE WHEN last IS NULL THEN 'no_text' WHEN stories IS NULL THEN 'no_story' ELSE 'both' END AS state FROM page FULL JOIN n ON page.ref = n.ref",
        "edge_scores": with_(STORY, GOOD)
        + """, t AS (SELECT note_id, min(page_ref) AS ref, min(start_segment) AS lo, max(coalesce(end_segment, start_segment)) AS hi FROM boundary_notes WHERE page_ref IS NOT NULL AND start_segment IS NOT NULL GROUP BY note_id),
f AS (SELECT note_id, min(g.lo) AS f FROM t JOIN good g ON g.ref = t.ref AND g.lo <= t.hi AND t.lo <= g.hi GROUP BY note_id)
SELECT note_id, CASE WHEN f IS NULL THEN 'NONE' WHEN abs(f - lo) = 0 THEN 'HIT' WHEN abs(f - lo) = 1 THEN 'NEAR' ELSE 'MISS' END AS score FROM t LEFT JOIN f USING (note_id)""",
        "additive_guard": with_(STORY, MIRROR) + ", v AS (SELECT a.id, CASE WHEN b.id IS NULL THEN 'lost' WHEN a.classification IS DISTINCT FROM b.classification THEN 'changed' END AS violation FROM story a LEFT JOIN mirror b ON a.id = b.id) SELECT * FROM v WHERE violation IS NOT NULL",
        "stratified_sample": "WITH k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id::varchar), doc_id) AS k FROM documents WHERE source IS NOT NULL) SELECT source, k, doc_id FROM k WHERE k <= 5",
        "batches": "WITH n AS (SELECT DISTINCT corpus, note_id FROM boundary_notes) SELECT corpus, note_id, ((row_number() OVER (PARTITION BY corpus ORDER BY md5('3:' || note_id::varchar), note_id) - 1) // 20)::int AS batch FROM n",
        "weekly_buckets": f"SELECT {week} AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY ALL",
        "last_active_week": f"SELECT user_id, max({week}) AS last_week FROM events GROUP BY user_id",
        "ledger_insert": "SELECT decision_id FROM boundary_decisions GROUP BY decision_id HAVING min(decided_at) >= TIMESTAMP '2025-01-01' OR min(decided_at) IS NULL",
        "dedupe_counts": "SELECT corpus, page_ref, note, count(DISTINCT note_id) AS n, min(note_id) AS first_id FROM boundary_notes GROUP BY ALL",
        "pointer_targets": "WITH RECURSIVE "
        + STORY
        + ", "
        + GOOD
        + """, p AS (SELECT id, CASE WHEN lead(lo) OVER w <= hi THEN lead(id) OVER w END AS t FROM good WINDOW w AS (PARTITION BY ref ORDER BY lo, hi, id)),
walk AS (SELECT id, id AS spot FROM p UNION ALL SELECT walk.id, p.t FROM walk JOIN p ON p.id = walk.spot WHERE p.t IS NOT NULL)
SELECT walk.id, spot AS target FROM walk JOIN p ON p.id = walk.spot WHERE p.t IS NULL""",
    }
