"""The general training-data problems as queries over the test tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import drift, intervals, nested, reconcile
from spanloom.runtime import materialize, read, store

#: The fields of boundary answers that problem 7's table has; the names under which files give them come from the change report.
ANSWER_TARGET = {"item": "string", "code": "string", "action": "string", "first": "integer", "last": "integer", "segments": "list of integers", "verdict": "string", "rules": "list of strings", "reason": "string"}

#: Fields that came up in the files later, approved for columns of their own: their rescued values are replayed.
ANSWER_APPROVED = {"confidence": "number", "elapsed_ms": "number", "flags": "list of strings", "note": "string", "pass": "integer", "reader": "string", "second_reader": "boolean"}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ranges = intervals.entry_ranges(read(spark, d, "ruler_entries"))
    return intervals.periods_and_gaps(ranges, "ref", "first_seg", "last_seg").select("ref", "kind", F.col("lo").cast("int").alias("first_seg"), F.col("hi").cast("int").alias("last_seg"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    main, mirror = (materialize(reconcile.latest_versions(read(spark, d, t), "story_id", "updated_at")) for t in ("stories_main", "stories_mirror"))
    return reconcile.differences(main, mirror, "story_id", "only_in_main", "only_in_mirror", ignore=("updated_at",))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found_nodes(read(spark, d, "run_records"))


def p5_stories(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of stories, each naming its record and page."""
    return nested.run_record_tables(read(spark, d, "run_records"))["stories"].select(F.col("doc_key").alias("rec_id"), "page_place", F.col("place").alias("story_place"), "start_segment", "end_segment", "classification", "one_sentence_summary")


def _p5_table(name: str, *columns: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        own = {"page_place": "page_no", "story_place": "story_no", "place": "place"}
        df = nested.run_record_tables(read(spark, d, "run_records"))[name]
        return df.select(F.col("doc_key").alias("rec_id"), *(F.col(c).alias(own.get(c, c)) for c in columns))

    query.__doc__ = f"The flat table of {name}, each row naming its record and the nodes that hold it."
    return query


p5_pages, p5_segments = _p5_table("pages", "place", "ref"), _p5_table("segments", "page_place", "place", "english", "hebrew")
p5_events, p5_weakeners = _p5_table("events", "page_place", "story_place", "place", "event"), _p5_table("weakeners", "page_place", "story_place", "place", "weakener")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "answer_lines").select("stream_name", "file_seq", "raw")
    return drift.change_report(store(drift.ingest(lines, "raw", ANSWER_TARGET, exact=True)), "stream_name", "file_seq", ANSWER_TARGET)


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """All lines under the target schema, values of renamed fields replayed into the fields that the change report leads them to,
    with whatever doesn't fit in ``_rescued``; lines delivered twice once."""
    lines = read(spark, d, "answer_lines").select("stream_name", "file_seq", "line_no", "raw").dropDuplicates(["stream_name", "file_seq", "line_no", "raw"])
    return drift.consistent_table(lines, "stream_name", "file_seq", "raw", ANSWER_TARGET, ANSWER_APPROVED)[0]


def queries() -> dict:
    return {"p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_stories": p5_stories, "p5_pages": p5_pages, "p5_segments": p5_segments, "p5_events": p5_events, "p5_weakeners": p5_weakeners, "p7_found": p7_found, "p7_table": p7_table}


P2_SQL = """
WITH spans AS (SELECT unnest(detector_span) AS s FROM ruler_entries),
cells AS (SELECT unnest(expert_segments) AS c FROM ruler_entries),
ranges AS (
  SELECT s.ref AS ref, s.start_segment AS lo, s.end_segment AS hi FROM spans
  UNION ALL SELECT s.next_ref, s.start_segment_page2, s.end_segment_page2 FROM spans
  UNION ALL SELECT c.ref, c.seg, c.seg FROM cells),
good AS (SELECT ref, lo, hi FROM ranges WHERE trim(ref) <> '' AND lo <= hi),
reach AS (SELECT *, max(hi) OVER (PARTITION BY ref ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM good),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY lo, hi) AS island FROM reach),
periods AS (SELECT ref, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY ref, island),
after AS (SELECT ref, hi + 1 AS lo, lead(lo) OVER (PARTITION BY ref ORDER BY lo) - 1 AS hi FROM periods)
SELECT ref, 'period' AS kind, lo AS first_seg, hi AS last_seg FROM periods
UNION ALL SELECT ref, 'gap', lo, hi FROM after WHERE hi IS NOT NULL
"""

STORY_FIELDS = "run_id corpus ref page_seq span_no start_segment end_segment next_ref start_segment_page2 end_segment_page2 classification criteria_met_count score continues_from_previous_page continues_to_next_page one_sentence_summary".split()


def p4_sql() -> str:
    current = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY updated_at DESC NULLS LAST) AS rn FROM {}) WHERE rn = 1"
    parts = [f"SELECT a.story_id, '{c}' AS difference FROM a JOIN b ON a.story_id = b.story_id WHERE a.{c} IS DISTINCT FROM b.{c}" for c in STORY_FIELDS]
    lacks = ["SELECT story_id, 'only_in_main' AS difference FROM a WHERE story_id NOT IN (SELECT story_id FROM b)", "SELECT story_id, 'only_in_mirror' FROM b WHERE story_id NOT IN (SELECT story_id FROM a)"]
    return f"WITH a AS ({current.format('stories_main')}), b AS ({current.format('stories_mirror')}) " + " UNION ALL ".join(lacks + parts)


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p4_found": p4_sql()}
