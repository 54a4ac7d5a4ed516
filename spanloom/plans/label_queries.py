"""Queries of labels and runs: rounds of verdicts, spans of cells, spliced runs, missing pages, run records' counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import wilson
from spanloom.operators import spans
from spanloom.plans import base
from spanloom.plans.base import GOOD, MGOOD, MIRROR, PAGE, SEG, STORY, with_
from spanloom.runtime import read


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "ruler_entries").select("entry_id", "corpus", "verdicts").distinct()
    v = e.select("entry_id", "corpus", F.explode("verdicts").alias("v")).select("entry_id", "corpus", "v.round", "v.reviewer", "v.read_as")
    return v.withColumn("reading", F.regexp_replace(F.lower("read_as"), "[^a-z]", ""))


def round_precision(spark: SparkSession, d: str) -> DataFrame:
    """Per round: verdicts, the share of stories among the clear ones with its interval, and among all; borderline is neither."""
    n = _verdicts(spark, d).where("reading is not null").groupBy("round").agg(F.count("*").alias("n"), F.count_if(F.col("reading") == "yes").alias("yes"), F.count_if(F.col("reading") == "no").alias("no"), F.count_if(F.col("reading") == "borderline").alias("borderline"))
    clear = F.col("yes") + F.col("no")
    return n.withColumns({"share_of_all": F.round(F.col("yes") / F.col("n"), 4), "low": wilson(F.col("yes"), clear, False), "high": wilson(F.col("yes"), clear, True)})


def last_reading(spark: SparkSession, d: str) -> DataFrame:
    """The reading of the last round (by its number, then the reviewer) of each entry."""
    no = F.regexp_extract("round", r"(\d+)", 1).try_cast("int")
    return _verdicts(spark, d).where("reading is not null").groupBy("entry_id").agg(F.max_by("reading", F.struct(no, "reviewer", "reading")).alias("reading"))


def cell_spans(spark: SparkSession, d: str) -> DataFrame:
    """Expert cells of each entry as spans: unbroken runs of segments on one page."""
    c = read(spark, d, "ruler_entries").select("entry_id", F.explode("expert_segments").alias("c")).select("entry_id", "c.ref", "c.seg").where("ref is not null and seg is not null").distinct()
    order = Window.partitionBy("entry_id", "ref").orderBy("seg")
    return c.withColumn("run", F.col("seg") - F.row_number().over(order)).groupBy("entry_id", "ref", "run").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi")).drop("run")


def spliced_run(spark: SparkSession, d: str) -> DataFrame:
    """The main run with the pages that the mirror has newer versions of replaced whole; where each story comes from."""
    a, b = (base.stories(spark, d, t).where("ref is not null").select("id", "ref", "updated_at") for t in ("stories_main", "stories_mirror"))
    newer = a.groupBy("ref").agg(F.max("updated_at").alias("ours")).join(b.groupBy("ref").agg(F.max("updated_at").alias("theirs")), "ref").where("theirs > ours").select("ref")
    kept = a.join(newer, "ref", "left_anti").select("id", "ref", F.lit("main").alias("source"))
    return kept.unionByName(b.join(newer, "ref", "left_semi").select("id", "ref", F.lit("mirror").alias("source")))


def pages_without(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the text that neither copy has a story on."""
    named = base.stories(spark, d).select("ref").unionByName(base.stories(spark, d, "stories_mirror").select("ref")).where("ref is not null").distinct()
    return base.pages(spark, d).select("corpus", "ref").join(named, "ref", "left_anti").select("corpus", "ref")


def agreed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus: cells covered by the main copy, by the mirror, and by both."""
    a, b = (spans.cells(base.stories(spark, d, t).where("lo <= hi and ref is not null").select("corpus", "ref", "lo", "hi")).select("corpus", "ref", "seg").distinct() for t in ("stories_main", "stories_mirror"))
    both = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), ["corpus", "ref", "seg"], "full_outer")
    return both.groupBy("corpus").agg(F.count_if("a").alias("main"), F.count_if("b").alias("mirror"), F.count_if(F.col("a") & F.col("b")).alias("agreed"))


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Calls and tokens of raw runs by version and model, of documents that are one object."""
    part = lambda p: F.get_json_object("doc", p)
    df = read(spark, d, "run_records").where("ltrim(doc) like '{%'").select(part("$.version").alias("version"), part("$.run_meta.model").alias("model"), *(part(f"$.run_meta.tokens.stage2.{k}").try_cast("bigint").alias(k) for k in ("calls", "input", "output")))
    return df.where("model is not null and calls is not null").groupBy("version", "model").agg(F.count("*").alias("runs"), *(F.sum(k).alias(k) for k in ("calls", "input", "output")))


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of verdicts, commonest first within each judge."""
    n = read(spark, d, "judge_answers").where("verdict is not null").groupBy("judge", "verdict").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("judge").orderBy(F.desc("n"), "verdict")))


def queries() -> dict:
    return {f.__name__: f for f in (round_precision, last_reading, cell_spans, spliced_run, pages_without, agreed_cells, run_counters, verdict_counts)}


def oracle_sql() -> dict[str, str]:
    verdicts = "v AS (SELECT entry_id, corpus, x.round AS round, x.reviewer AS reviewer, regexp_replace(lower(x.read_as), '[^a-z]', '', 'g') AS reading FROM (SELECT entry_id, corpus, unnest(verdicts) AS x FROM (SELECT DISTINCT entry_id, corpus, verdicts FROM ruler_entries)))"
    w = lambda s: f"CASE WHEN yes + no > 0 THEN round((yes * 1.0 / (yes + no) + 1.96 * 1.96 / (2 * (yes + no)) {s} 1.96 * sqrt((yes * 1.0 / (yes + no)) * (1 - yes * 1.0 / (yes + no)) / (yes + no) + 1.96 * 1.96 / (4.0 * (yes + no) * (yes + no)))) / (1 + 1.96 * 1.96 / (yes + no)), 3) END"
    return {
        "round_precision": f"WITH {verdicts}, n AS (SELECT round, count(*) AS n, count(*) FILTER (reading = 'yes') AS yes, count(*) FILTER (reading = 'no') AS no, count(*) FILTER (reading = 'borderline') AS borderline FROM v WHERE reading IS NOT NULL GROUP BY round) SELECT *, round(yes * 1.0 / n, 4) AS share_of_all, {w('-')} AS low, {w('+')} AS high FROM n",
        "last_reading": f"WITH {verdicts}, k AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY try_cast(regexp_extract(round, '(\\d+)', 1) AS int) DESC NULLS LAST, reviewer DESC NULLS LAST, reading DESC) AS k FROM v WHERE reading IS NOT NULL) SELECT entry_id, reading FROM k WHERE k = 1",
        "cell_spans": "WITH c AS (SELECT DISTINCT entry_id, x.ref AS ref, x.seg AS seg FROM (SELECT entry_id, unnest(expert_segments) AS x FROM ruler_entries) WHERE x.ref IS NOT NULL AND x.seg IS NOT NULL), r AS (SELECT *, seg - row_number() OVER (PARTITION BY entry_id, ref ORDER BY seg) AS run FROM c) SELECT entry_id, ref, min(seg) AS lo, max(seg) AS hi FROM r GROUP BY entry_id, ref, run",
        "spliced_run": with_(STORY, MIRROR)
        + """, n AS (SELECT a.ref FROM (SELECT ref, max(updated_at) AS u FROM story WHERE ref IS NOT NULL GROUP BY ref) a JOIN (SELECT ref, max(updated_at) AS u FROM mirror WHERE ref IS NOT NULL GROUP BY ref) b ON a.ref = b.ref AND b.u > a.u)
SELECT id, ref, 'main' AS source FROM story WHERE ref IS NOT NULL AND ref NOT IN (SELECT ref FROM n) UNION ALL SELECT id, ref, 'mirror' FROM mirror WHERE ref IN (SELECT ref FROM n)""",
        "pages_without": with_(SEG, PAGE, STORY, MIRROR) + "SELECT corpus, ref FROM page WHERE ref NOT IN (SELECT ref FROM story WHERE ref IS NOT NULL UNION SELECT ref FROM mirror WHERE ref IS NOT NULL)",
        "agreed_cells": with_(STORY, MIRROR, GOOD, MGOOD)
        + """, a AS (SELECT DISTINCT corpus, ref, unnest(range(lo, hi + 1)) AS seg FROM good), b AS (SELECT DISTINCT corpus, ref, unnest(range(lo, hi + 1)) AS seg FROM mgood),
j AS (SELECT coalesce(a.corpus, b.corpus) AS corpus, a.ref IS NOT NULL AS x, b.ref IS NOT NULL AS y FROM a FULL JOIN b ON a.corpus = b.corpus AND a.ref = b.ref AND a.seg = b.seg)
SELECT corpus, count(*) FILTER (x) AS main, count(*) FILTER (y) AS mirror, count(*) FILTER (x AND y) AS agreed FROM j GROUP BY corpus""",
        "run_counters": """WITH j AS (SELECT CASE WHEN json_valid(doc) THEN doc END AS doc FROM run_records WHERE ltrim(doc) LIKE '{%'),
p AS (SELECT doc ->> '$.version' AS version, doc ->> '$.run_meta.model' AS model, try_cast(doc ->> '$.run_meta.tokens.stage2.calls' AS bigint) AS calls, try_cast(doc ->> '$.run_meta.tokens.stage2.input' AS bigint) AS input, try_cast(doc ->> '$.run_meta.tokens.stage2.output' AS bigint) AS output FROM j)
SELECT version, model, count(*) AS runs, sum(calls)::bigint AS calls, sum(input)::bigint AS input, sum(output)::bigint AS output FROM p WHERE model IS NOT NULL AND calls IS NOT NULL GROUP BY ALL""",
        "verdict_counts": "WITH n AS (SELECT judge, verdict, count(*) AS n FROM judge_answers WHERE verdict IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY judge ORDER BY n DESC, verdict) AS place FROM n) SELECT * FROM k",
    }
