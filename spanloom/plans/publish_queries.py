"""Queries of permanent ids, page folds, corrections, display spans, page documents and replayed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import publish
from spanloom.plans import base
from spanloom.plans.base import GOOD, MGOOD, MIRROR, SEG, STORY, with_
from spanloom.runtime import read
from spanloom.streaming import ledger


def _good(spark: SparkSession, d: str, table: str = "stories_main", *more: str) -> DataFrame:
    return base.stories(spark, d, table, *more).where("lo <= hi and ref is not null")


def _replay(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table as a stream. The path is a pattern, as a stream of a lone file must be."""
    return spark.readStream.schema(read(spark, d, table).schema).parquet(f"{d}/{table}.parque[t]")


def permanent_ids(spark: SparkSession, d: str) -> DataFrame:
    """The mirror's stories take over the ids of the main copy where they share cells; ids of stories called none are retired ones."""
    new = _good(spark, d, "stories_mirror").select(F.concat(F.lit("new-"), "id").alias("story"), "ref", "lo", "hi")
    status = F.when(F.upper(F.trim("classification")) == "NOT_A_STORY", "retired").otherwise("active")
    return publish.assign_ids(new, _good(spark, d, "stories_main", "classification").select("id", "ref", "lo", "hi", status.alias("status")))


def page_fold(spark: SparkSession, d: str) -> DataFrame:
    """Stories merged over page breaks: by labels and classification (W16), then by flags (W17)."""
    kind = F.regexp_replace(F.upper(F.trim("classification")), r"\s+", "_")
    s = _good(spark, d, "stories_main", "span_no", "classification", "continues_to_next_page", "continues_from_previous_page").select("corpus", "page_seq", "id", F.col("span_no").alias("no"), "lo", "hi", kind.alias("classification"), F.col("continues_to_next_page").alias("to_next"), F.col("continues_from_previous_page").alias("from_prev"))
    seg = base.segments(spark, d).select("ref", "corpus", "page_seq", "seg_idx", (base.label(F.col("english")) == "NARRATIVE_EVENT").alias("event"))
    pages = seg.groupBy("ref").agg(F.min("corpus").alias("corpus"), F.min("page_seq").alias("page_seq"), F.max("seg_idx").alias("last"), F.coalesce(F.bool_or(F.col("event") & (F.col("seg_idx") <= 1)), F.lit(False)).alias("event_at_start"), F.max_by("event", "seg_idx").alias("event_at_end"))
    return publish.fold_stories(s, pages)


def corrected_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stories after corrections that follow from their numbers: one trimmed, extended, reclassified or removed in each ten."""
    s = _good(spark, d, "stories_main", "classification").select("id", "ref", "lo", "hi", "classification")
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("int") % 10
    op = F.when(k == 1, "trim_end").when(k == 2, "extend_start").when(k == 3, "reclassify").when(k == 4, "remove")
    todo = s.select(F.lit(1).alias("seq"), "id", op.alias("op"), F.when(k == 3, "NOT_A_STORY").otherwise("1").alias("value")).where("op is not null")
    return publish.apply_corrections(s, todo)


def display_spans(spark: SparkSession, d: str) -> DataFrame:
    seg = base.segments(spark, d).where("pos is not null").withColumnRenamed("seg_idx", "seg")
    return publish.extend_for_display(_good(spark, d).select("id", "ref", "lo", "hi"), seg, 2, 6)


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = publish.page_documents(base.segments(spark, d))
    return docs.select("ref", F.size(F.from_json("doc", "segments array<struct<index:int>>")["segments"]).alias("n"))


def stream_weeks(spark: SparkSession, d: str) -> DataFrame:
    """The events replayed as a stream into weekly counts."""
    stream = _replay(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    weeks = ledger.drain(ledger.weekly_counts(stream), "complete")
    return weeks.select(F.to_date("week").alias("week"), "event_type", "n")


def stream_standing(spark: SparkSession, d: str) -> DataFrame:
    """Judges' answers replayed as a stream: the standing one of each judge on each entry."""
    stream = _replay(spark, d, "judge_answers").where("verdict is not null").withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    last = ledger.drain(ledger.standing_answers(stream), "complete")
    return last.select("entry_id", "judge", "verdict")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ledger.sessions(ev).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def queries() -> dict:
    return {f.__name__: f for f in (permanent_ids, page_fold, corrected_spans, display_spans, page_documents, stream_weeks, stream_standing, event_sessions)}


def oracle_sql() -> dict[str, str]:
    k = r"regexp_extract(id, '(\d+)$', 1)::int % 10"
    status = "CASE WHEN upper(trim(classification, ' ')) = 'NOT_A_STORY' THEN 1 ELSE 0 END"
    ids = f"""WITH RECURSIVE {STORY}, {MIRROR}, {GOOD}, {MGOOD}, pc AS (SELECT 'new-' || a.id AS story, b.id, b.pool, count(*) AS n FROM (SELECT id, ref, unnest(range(lo, hi + 1)) AS seg FROM mgood) a JOIN (SELECT id, {status} AS pool, ref, unnest(range(lo, hi + 1)) AS seg FROM good) b ON a.ref = b.ref AND a.seg = b.seg GROUP BY ALL),
lv AS (SELECT pool, n, row_number() OVER (ORDER BY pool, n DESC) AS l FROM (SELECT DISTINCT pool, n FROM pc)),
w AS (SELECT 0::bigint AS l, []::varchar[] AS us, []::varchar[] AS ui, []::struct(story varchar, id varchar, how varchar)[] AS res
  UNION ALL SELECT l, list_concat(us, coalesce(list(story) FILTER (story IS NOT NULL), [])), list_concat(ui, coalesce(list(id) FILTER (id IS NOT NULL), [])), list_concat(res, coalesce(list({{'story': story, 'id': id, 'how': how}}) FILTER (story IS NOT NULL), []))
  FROM (SELECT x.l, x.us, x.ui, x.res, x.story, x.id, CASE WHEN greatest(count(*) OVER (PARTITION BY x.story), count(*) OVER (PARTITION BY x.id)) > 1 THEN 'refused' WHEN x.pool = 1 THEN 'revived' ELSE 'kept' END AS how FROM (SELECT w.l + 1 AS l, w.us, w.ui, w.res, pc.story, pc.id, lv.pool FROM w JOIN lv ON lv.l = w.l + 1 LEFT JOIN pc ON pc.pool = lv.pool AND pc.n = lv.n AND NOT list_contains(w.us, pc.story) AND NOT list_contains(w.ui, pc.id)) x) GROUP BY l, us, ui, res),
used AS (SELECT u.story AS story, u.id AS id, u.how AS how FROM (SELECT unnest(res) AS u FROM (SELECT res FROM w ORDER BY l DESC LIMIT 1)))
SELECT story, id, how FROM used WHERE how <> 'refused' UNION ALL SELECT DISTINCT story, NULL, how FROM used WHERE how = 'refused'
UNION ALL SELECT 'new-' || id, 'new-' || id, 'minted' FROM mgood WHERE 'new-' || id NOT IN (SELECT story FROM used)
UNION ALL SELECT m.story, g.id, CASE WHEN m.story IS NULL THEN 'retired' ELSE 'redirected' END FROM (SELECT id FROM good WHERE {status} = 0 AND id NOT IN (SELECT id FROM used)) g LEFT JOIN (SELECT id, arg_min(story, (-n, story)) AS story FROM pc GROUP BY id) m USING (id)"""
    return {
        "permanent_ids": ids,
        "corrected_spans": with_(STORY, GOOD) + f"SELECT id, ref, CASE WHEN {k} = 2 THEN lo - 1 ELSE lo END AS lo, CASE WHEN {k} = 1 THEN hi - 1 ELSE hi END AS hi, CASE WHEN {k} = 3 THEN 'NOT_A_STORY' ELSE classification END AS classification FROM good WHERE {k} <> 4",
        "display_spans": with_(SEG, STORY, GOOD) + ", p AS (SELECT corpus, ref, seg_idx, pos FROM seg WHERE pos IS NOT NULL), e AS (SELECT corpus, min(pos) AS a, max(pos) AS z FROM p GROUP BY corpus) SELECT g.id, greatest(x.pos - 2, e.a) AS pos_lo, least(y.pos + 6, e.z) AS pos_hi FROM good g JOIN p x ON x.ref = g.ref AND x.seg_idx = g.lo JOIN p y ON y.ref = g.ref AND y.seg_idx = g.hi JOIN e ON e.corpus = x.corpus",
        "page_documents": with_(SEG) + "SELECT ref, count(*)::int AS n FROM seg GROUP BY corpus, ref",
        "stream_weeks": "SELECT date_trunc('week', ts)::date AS week, event_type, count(*) AS n FROM events GROUP BY ALL",
        "stream_standing": "SELECT entry_id, judge, verdict FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, judge ORDER BY answered_at DESC, answer_id DESC) AS k FROM judge_answers WHERE verdict IS NOT NULL) WHERE k = 1",
        "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
    }
