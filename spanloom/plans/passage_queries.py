"""Queries that find passages: expert texts on their pages and in their corpora, and passages that stories share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import passages
from spanloom.plans import base
from spanloom.plans.base import SEG, with_
from spanloom.runtime import read


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "ruler_entries").where("expert_text is not null").groupBy("entry_id").agg(F.min("corpus").alias("corpus"), F.min("ref").alias("ref"), F.min("expert_text").alias("expert_text"))


def passage_locate(spark: SparkSession, d: str) -> DataFrame:
    """Where in its corpus each expert text stands, by six-word runs that the corpus has in one segment only."""
    asked = _listed(spark, d).select(F.col("entry_id").alias("id"), F.col("corpus").alias("group"), F.col("expert_text").alias("text"))
    text = base.segments(spark, d).select(F.col("corpus").alias("group"), "pos", F.col("english").alias("text"))
    return passages.locate(asked, text).select(F.col("id").alias("entry_id"), "first_pos", "last_pos", "anchors")


def passage_locate_exact(spark: SparkSession, d: str) -> DataFrame:
    """Where in the running text of its corpus each expert text stands, by six-word runs that occur there once, and its extent."""
    asked = _listed(spark, d).select(F.col("entry_id").alias("id"), F.col("corpus").alias("group"), F.col("expert_text").alias("text"))
    text = base.segments(spark, d).select(F.col("corpus").alias("group"), "pos", F.col("english").alias("text"))
    return passages.locate_exact(asked, text).select(F.col("id").alias("entry_id"), "first_pos", "last_pos", "anchors", "coverage")


def passage_containment(spark: SparkSession, d: str) -> DataFrame:
    """How much of each expert text its page's segments hold, segment by segment, where any."""
    seg = base.segments(spark, d).select("ref", "seg_idx", passages.words(F.col("english")).alias("own"))
    asked = _listed(spark, d).select("entry_id", "ref", passages.words(F.col("expert_text")).alias("text"))
    pair = asked.join(seg, "ref").withColumn("share", passages.containment(F.col("own"), F.col("text")))
    return pair.where("share > 0").select("entry_id", "seg_idx", F.round("share", 6).alias("share"))


def shared_passages(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts that share telling passages; at looser limits than the operator's own, as these texts share little."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("group"), "text")
    return passages.shared_passages(docs, least=4, share=0.1)


def text_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of each document among those with the same words: the membership that goes with shared_passages."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group"), "text")
    return passages.text_classes(docs).select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"))


def passage_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The stretch of its corpus that holds most of each expert text."""
    asked = _listed(spark, d).select(F.col("entry_id").alias("id"), F.col("corpus").alias("group"), F.col("expert_text").alias("text"))
    text = base.segments(spark, d).select(F.col("corpus").alias("group"), "pos", F.col("english").alias("text"))
    return passages.locate_fuzzy(asked, text).select(F.col("id").alias("entry_id"), "first_pos", "last_pos", "coverage")


def passage_align(spark: SparkSession, d: str) -> DataFrame:
    """How each expert text aligns with the running text of its page."""
    seg = base.segments(spark, d).where("english is not null")
    page = seg.groupBy("ref").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "english"))), lambda x: x["english"])).alias("hay"))
    pairs = _listed(spark, d).join(page, "ref").select(F.col("entry_id").alias("id"), F.col("expert_text").alias("needle"), "hay")
    return passages.align(pairs).where("matched > 0")


def queries() -> dict:
    return {f.__name__: f for f in (passage_locate, passage_locate_exact, passage_fuzzy, passage_align, passage_containment, shared_passages, text_classes)}


def _words(c: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({c}, '<[^>]+>', ' ', 'g')), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'), ' ')"


def _grams(w: str, n: int) -> str:
    return f"list_distinct(list_transform(range(0, greatest(len({w}) - {n - 1}, 0)), lambda i: array_to_string({w}[i + 1 : i + {n}], ' ')))"


def oracle_sql() -> dict[str, str]:
    listed = "listed AS (SELECT entry_id, min(corpus) AS corpus, min(ref) AS ref, min(expert_text) AS expert_text FROM ruler_entries WHERE expert_text IS NOT NULL GROUP BY entry_id)"
    return {
        "text_classes": f"WITH w AS (SELECT doc_id, {_words('text')} AS words FROM documents WHERE text IS NOT NULL) SELECT doc_id, min(doc_id) OVER (PARTITION BY words) AS class_id FROM w WHERE words <> ''",
        "shared_passages": f"WITH w AS (SELECT doc_id, {_words('text')} AS words FROM documents WHERE text IS NOT NULL), c AS (SELECT min(doc_id) AS class, words FROM w WHERE words <> '' GROUP BY words), r AS (SELECT DISTINCT class, g FROM (SELECT class, unnest({_grams('w', 5)}) AS g FROM (SELECT class, string_split(words, ' ') AS w FROM c))), t AS (SELECT class, g FROM r WHERE g IN (SELECT g FROM r GROUP BY g HAVING count(*) <= 4)), z AS (SELECT class, count(*) AS size FROM t GROUP BY class HAVING count(*) >= 4), p AS (SELECT x.class AS a, y.class AS b, count(*) AS shared FROM t x JOIN t y ON x.g = y.g AND x.class < y.class GROUP BY ALL HAVING count(*) >= 4) SELECT a, b, shared, round(shared / least(za.size, zb.size), 6) AS overlap FROM p JOIN z za ON za.class = a JOIN z zb ON zb.class = b WHERE round(shared / least(za.size, zb.size), 6) >= 0.1",
        "passage_locate": with_(SEG, listed)
        + f""", s AS (SELECT corpus, pos, unnest({_grams('w', 6)}) AS g FROM (SELECT corpus, pos, string_split({_words('english')}, ' ') AS w FROM seg WHERE pos IS NOT NULL AND english IS NOT NULL)),
u AS (SELECT corpus, g, min(pos) AS pos FROM (SELECT DISTINCT corpus, pos, g FROM s) GROUP BY corpus, g HAVING count(*) = 1),
q AS (SELECT DISTINCT entry_id, corpus, unnest({_grams('w', 6)}) AS g FROM (SELECT entry_id, corpus, string_split({_words('expert_text')}, ' ') AS w FROM listed)),
h AS (SELECT entry_id, pos, count(*) AS k FROM q JOIN u USING (corpus, g) GROUP BY ALL),
r AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY entry_id ORDER BY pos) <= 5 THEN 0 ELSE 1 END AS fresh FROM h),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY entry_id ORDER BY pos) AS run FROM r),
e AS (SELECT entry_id, run, sum(k)::bigint AS anchors, min(pos) AS first_pos, max(pos) AS last_pos FROM n GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY anchors DESC, first_pos) AS k FROM e)
SELECT entry_id, first_pos, last_pos, anchors FROM b WHERE k = 1""",
        "passage_containment": with_(SEG, listed)
        + f""", p AS (SELECT entry_id, seg_idx, {_grams('a', 4)} AS a, {_grams('b', 4)} AS b FROM (SELECT entry_id, seg_idx, string_split({_words('english')}, ' ') AS a, string_split({_words('expert_text')}, ' ') AS b FROM listed JOIN seg USING (ref))),
c AS (SELECT entry_id, seg_idx, len(list_intersect(a, b)) * 1.0 / len(a) AS share FROM p WHERE len(a) > 0)
SELECT entry_id, seg_idx, round(share, 6) AS share FROM c WHERE share > 0""",
    }
