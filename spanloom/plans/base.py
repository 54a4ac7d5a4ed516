"""Clean views of the test tables that the queries of the span engine start from, for both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import read

#: How a segment's English is labelled: the first rule that fits; a segment without text failed, the rest tells an event.
LABEL_RULES = [("DELIBERATION", r"taught|difference between|objected|question was asked|from the .* you may learn|if two hold|how is this meant"), ("HABITUAL", r"used to "), ("VERBAL_ACT", r"said|answered|asked")]


def label(c: Column) -> Column:
    from spanloom.functions.text import first_rule

    return F.when(c.isNull() | (F.trim(c) == ""), "TRIAGE_FAILED").otherwise(first_rule(c, LABEL_RULES, "NARRATIVE_EVENT"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """One row per segment: rows loaded twice have the same texts."""
    df = read(spark, d, "segments").where("ref is not null and seg_idx is not null")
    return df.groupBy("ref", "seg_idx").agg(F.min("corpus").alias("corpus"), F.min("page_seq").alias("page_seq"), F.min("pos").alias("pos"), F.max("hebrew").alias("hebrew"), F.max("english").alias("english"))


def stories(spark: SparkSession, d: str, table: str = "stories_main", *more: str) -> DataFrame:
    """Current versions of stories, as spans ``id, corpus, ref, page_seq, lo, hi`` and what else is asked for; only that is read."""
    from spanloom.operators.reconcile import latest_versions

    raw = read(spark, d, table).select("story_id", "corpus", "ref", "page_seq", "start_segment", "end_segment", "updated_at", *more)
    df = latest_versions(raw, "story_id", "updated_at")
    return df.withColumnsRenamed({"story_id": "id", "start_segment": "lo", "end_segment": "hi"})


def pages(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("ref").agg(F.min("corpus").alias("corpus"), F.min("page_seq").alias("page_seq"), F.max("seg_idx").alias("last"))


SEG = "seg AS (SELECT ref, seg_idx, min(corpus) AS corpus, min(page_seq) AS page_seq, min(pos) AS pos, max(hebrew) AS hebrew, max(english) AS english FROM segments WHERE ref IS NOT NULL AND seg_idx IS NOT NULL GROUP BY ref, seg_idx)"
PAGE = "page AS (SELECT ref, min(corpus) AS corpus, min(page_seq) AS page_seq, max(seg_idx) AS last FROM seg GROUP BY ref)"
STORY = "story AS (SELECT story_id AS id, start_segment AS lo, end_segment AS hi, * EXCLUDE (story_id, start_segment, end_segment, rn) FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY updated_at DESC NULLS LAST) AS rn FROM stories_main) WHERE rn = 1)"
MIRROR = STORY.replace("story AS", "mirror AS").replace("stories_main", "stories_mirror")
LABELLED = "labelled AS (SELECT *, CASE WHEN english IS NULL OR trim(english, ' ') = '' THEN 'TRIAGE_FAILED' " + " ".join(f"WHEN regexp_matches(lower(english), '{p}') THEN '{n}'" for n, p in LABEL_RULES) + " ELSE 'NARRATIVE_EVENT' END AS label FROM seg)"
GOOD = "good AS (SELECT * FROM story WHERE lo <= hi AND ref IS NOT NULL)"
MGOOD = "mgood AS (SELECT * FROM mirror WHERE lo <= hi AND ref IS NOT NULL)"


def with_(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "
