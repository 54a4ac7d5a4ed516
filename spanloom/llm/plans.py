"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import components, consensus, encoding, lookalikes, mixture, stuffing
from spanloom.runtime import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.group_ids(components.merge_matches(read(spark, d, "boundary_decisions")), "members")


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return consensus.entry_consensus(read(spark, d, "ruler_entries"), read(spark, d, "judge_answers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[0].where("n_sources >= 3").select(F.col("item").alias("entry_id"), F.col("label").alias("verdict"))


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Every entry with a standing verdict: its label, how sure that is, and how far the annotators agree."""
    return _consensus(spark, d)[0].withColumnRenamed("item", "entry_id")


def p3_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Every judge and reviewer: verdicts given, expected accuracy and weight."""
    return _consensus(spark, d)[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.quoted_segments(read(spark, d, "boundary_notes"), read(spark, d, "segments"))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every segment's Hebrew in its one form."""
    segments = read(spark, d, "segments").select("ref", "seg_idx", "hebrew")
    return lookalikes.rewrite(segments, "hebrew", "one_form", lookalikes.fit(segments, "hebrew")).drop("hebrew")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(read(spark, d, "documents"), "text", ["doc_id"])


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.junk_pages(read(spark, d, "documents")).select(F.col("page").alias("doc_id"))


P1_SQL = """
WITH RECURSIVE sets AS (
  SELECT list_distinct(list_filter(ids, lambda x: x IS NOT NULL)) AS m FROM boundary_decisions WHERE kind = 'merge'
  UNION ALL
  SELECT list_distinct(list_filter(list_transform(g.members, lambda x: x.card), lambda x: x IS NOT NULL)) FROM (SELECT unnest(groups) AS g FROM boundary_decisions WHERE kind = 'merge')),
half AS (SELECT list_min(m) AS a, unnest(m) AS b FROM sets WHERE len(m) > 1),
edges AS (SELECT DISTINCT a, b FROM half WHERE a <> b UNION SELECT DISTINCT b, a FROM half WHERE a <> b),
walk AS (SELECT a AS card, a AS seen FROM edges UNION SELECT w.card, e.b FROM walk w JOIN edges e ON e.a = w.seen)
SELECT card AS card_id, min(seen) AS group_id FROM walk GROUP BY card
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p3_found": p3_found, "p3_agreement": p3_agreement, "p3_reliability": p3_reliability, "p6_found": p6_found, "p6_texts": p6_texts, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL}
