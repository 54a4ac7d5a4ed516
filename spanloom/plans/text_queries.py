"""Queries of the text functions over segments, documents and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.plans import base
from spanloom.plans.base import LABELLED, SEG, with_
from spanloom.runtime import read

CLASS_RULES = [("legal", r"liable|exempt|permitted|forbidden"), ("dispute", r"objected|difference between"), ("journey", r"came to|walked|the road to|they sent")]
TERMS = ["said", "asked", "answered", "wept", "laughed", "taught", "objected"]


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    bare = text.strip_html(F.col("english"))
    return base.segments(spark, d).select("ref", "seg_idx", F.length(bare).alias("n_chars"), text.fold_key(bare, 40).alias("key"))


def hebrew_letters(spark: SparkSession, d: str) -> DataFrame:
    return base.segments(spark, d).select("ref", "seg_idx", text.letters_only(F.col("hebrew")).alias("letters"), F.length(text.strip_marks(F.col("hebrew"))).alias("n_unpointed"))


def hebrew_numerals(spark: SparkSession, d: str) -> DataFrame:
    word = F.get(F.split(text.letters_only(F.col("hebrew")), " "), 0)
    return base.segments(spark, d).where("hebrew is not null").select("ref", "seg_idx", text.numeral(word).alias("value"))


def clause_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(text.clauses(F.col("text"))).alias("n_clauses"))


def clause_ranges(spark: SparkSession, d: str) -> DataFrame:
    return base.segments(spark, d).where("english is not null").select("ref", "seg_idx", F.posexplode(text.clause_ranges(F.col("english"))).alias("clause", "r")).select("ref", "seg_idx", "clause", "r.start", "r.end")


def keyword_class(spark: SparkSession, d: str) -> DataFrame:
    return base.segments(spark, d).groupBy("corpus", text.first_rule(F.coalesce("english", F.lit("")), CLASS_RULES, "other").alias("class")).agg(F.count("*").alias("n"))


def likelihood_band(spark: SparkSession, d: str) -> DataFrame:
    """An additive score of surface signs, and its band."""
    e = F.lower(F.coalesce("english", F.lit("")))
    score = F.when(e.rlike("^(once|when) "), 40).otherwise(0) + F.when(e.contains("said"), 10).otherwise(0) + F.when(e.contains("came to"), 15).otherwise(0) - F.when(e.rlike("liable|exempt"), 30).otherwise(0)
    return base.segments(spark, d).select("ref", "seg_idx", score.alias("score"), F.when(score >= 30, "HIGH").when(score >= 10, "MEDIUM").otherwise("LOW").alias("band"))


def reading_minutes(spark: SparkSession, d: str) -> DataFrame:
    return base.segments(spark, d).groupBy("ref").agg(F.sum(F.coalesce(text.word_count(F.col("english")), F.lit(0))).cast("bigint").alias("words")).withColumn("minutes", F.greatest(F.lit(1), F.ceil(F.col("words") / 200)).cast("int"))


def surface_terms(spark: SparkSession, d: str) -> DataFrame:
    found = text.terms_present(F.coalesce("english", F.lit("")), TERMS)
    return base.segments(spark, d).select("ref", "seg_idx", F.array_join(found, "|").alias("terms")).where("terms <> ''")


def language_exposure(spark: SparkSession, d: str) -> DataFrame:
    """How much of each side a reader with a fixed budget per segment is shown."""
    e, h = F.length(F.coalesce("english", F.lit(""))), F.length(F.coalesce("hebrew", F.lit("")))
    return base.segments(spark, d).groupBy("ref").agg(F.sum(F.least(e, F.lit(300))).cast("bigint").alias("english"), F.sum(F.least(h, F.lit(200))).cast("bigint").alias("hebrew"), F.count_if(h > 200).alias("cut"))


def truncated(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 60).alias("short"))


def span_keys(spark: SparkSession, d: str) -> DataFrame:
    key = text.parse_span_key(F.col("story_key"))
    return read(spark, d, "boundary_notes").select("note_id", "story_key").distinct().select("note_id", key["ref"].alias("ref"), key["start"].alias("lo"), key["end"].alias("hi"))


def page_order(spark: SparkSession, d: str) -> DataFrame:
    return base.pages(spark, d).select("ref", text.page_order(F.col("ref")).alias("page_key"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.fingerprint(F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))).alias("fingerprint"))


def triage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus: pages, pages kept, and segments by label. A page is kept if a call failed on it or it tells an event."""
    seg = base.segments(spark, d).withColumn("label", base.label(F.col("english")))
    page = seg.groupBy("corpus", "ref").agg(F.max(F.col("label").isin("TRIAGE_FAILED", "NARRATIVE_EVENT")).alias("kept"), *(F.count_if(F.col("label") == v).alias(v.lower()) for v in ("NARRATIVE_EVENT", "VERBAL_ACT", "DELIBERATION", "HABITUAL", "TRIAGE_FAILED")))
    return page.groupBy("corpus").agg(F.count("*").alias("pages"), F.count_if("kept").alias("kept"), *(F.sum(c).alias(c) for c in ("narrative_event", "verbal_act", "deliberation", "habitual", "triage_failed")))


def keep_rules(spark: SparkSession, d: str) -> DataFrame:
    """Candidate keep rules priced: how many pages each would keep."""
    seg = base.segments(spark, d).withColumn("label", base.label(F.col("english")))
    page = seg.groupBy("ref").agg(F.count_if(F.col("label") == "NARRATIVE_EVENT").alias("n"), F.count_if(F.col("label") == "VERBAL_ACT").alias("v"), F.count("*").alias("s"))
    rules = {"any_event": "n >= 1", "two_events": "n >= 2", "third": "n * 3 >= s", "event_or_speech": "n + v >= 2"}
    return page.select(F.expr("stack({}, {}) as (rule, keep)".format(len(rules), ", ".join(f"'{k}', {v}" for k, v in rules.items())))).groupBy("rule").agg(F.count_if("keep").alias("kept"), F.count("*").alias("pages"))


def queries() -> dict:
    fs = [html_strip, hebrew_letters, hebrew_numerals, clause_counts, clause_ranges, keyword_class, likelihood_band, reading_minutes, surface_terms, language_exposure, truncated, span_keys, page_order, fingerprints, triage_summary, keep_rules]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    ws = r"regexp_replace({}, '\s+', ' ', 'g')"
    bare = "regexp_replace(english, '<[^>]+>', '', 'g')"
    letters = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(hebrew, '<[^>]+>', ' ', 'g'), '[\x{0591}-\x{05C7}]', '', 'g'), '[^\x{05D0}-\x{05EA}]', ' ', 'g'), ' +', ' ', 'g'), ' ')"
    values = ", ".join(f"'{k}': {v}" for k, v in text.NUMERALS.items())
    words = f"CASE WHEN trim({ws.format(bare)}, ' ') = '' THEN 0 ELSE len(string_split(trim({ws.format(bare)}, ' '), ' ')) END"
    e = "lower(coalesce(english, ''))"
    score = f"(CASE WHEN regexp_matches({e}, '^(once|when) ') THEN 40 ELSE 0 END + CASE WHEN contains({e}, 'said') THEN 10 ELSE 0 END + CASE WHEN contains({e}, 'came to') THEN 15 ELSE 0 END - CASE WHEN regexp_matches({e}, 'liable|exempt') THEN 30 ELSE 0 END)"
    classes = " ".join(f"WHEN regexp_matches({e}, '{p}') THEN '{n}'" for n, p in CLASS_RULES)
    terms = "[" + ", ".join(f"'{t}'" for t in sorted(TERMS)) + "]"
    return {
        "html_strip": with_(SEG) + f"SELECT ref, seg_idx, length({bare}) AS n_chars, lower(trim(substring(trim({ws.format(bare)}, ' '), 1, 40), ' ')) AS key FROM seg",
        "hebrew_letters": with_(SEG) + rf"SELECT ref, seg_idx, {letters} AS letters, length(regexp_replace(hebrew, '[\x{{0591}}-\x{{05C7}}]', '', 'g')) AS n_unpointed FROM seg",
        "hebrew_numerals": with_(SEG) + f"SELECT ref, seg_idx, coalesce(list_sum(list_transform(string_split(string_split({letters}, ' ')[1], ''), lambda x: coalesce(MAP {{{values}}}[x], 0))), 0)::int AS value FROM seg WHERE hebrew IS NOT NULL",
        "clause_counts": r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.:?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '')) AS n_clauses FROM documents",
        "clause_ranges": with_(SEG) + r""", p AS (SELECT ref, seg_idx, string_split(regexp_replace(english, '([.:?!])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(2)) AS l FROM seg WHERE english IS NOT NULL), q AS (SELECT ref, seg_idx, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM p), r AS (SELECT ref, seg_idx, i, string_split(x, chr(1))[1] AS t, coalesce(sum(length(replace(x, chr(1), ''))) OVER (PARTITION BY ref, seg_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM q) SELECT ref, seg_idx, row_number() OVER (PARTITION BY ref, seg_idx ORDER BY i) - 1 AS clause, a::bigint AS start, (a + length(t))::bigint AS "end" FROM r WHERE trim(t, ' ') <> ''""",
        "keyword_class": with_(SEG) + f"SELECT corpus, CASE {classes} ELSE 'other' END AS class, count(*) AS n FROM seg GROUP BY ALL",
        "likelihood_band": with_(SEG) + f"SELECT ref, seg_idx, {score} AS score, CASE WHEN {score} >= 30 THEN 'HIGH' WHEN {score} >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM seg",
        "reading_minutes": with_(SEG) + f", w AS (SELECT ref, sum(coalesce({words}, 0))::bigint AS words FROM seg GROUP BY ref) SELECT ref, words, greatest(1, ceil(words / 200))::int AS minutes FROM w",
        "surface_terms": with_(SEG) + f", t AS (SELECT ref, seg_idx, array_to_string(list_filter({terms}, lambda x: contains({e}, x)), '|') AS terms FROM seg) SELECT * FROM t WHERE terms <> ''",
        "language_exposure": with_(SEG) + "SELECT ref, sum(least(length(coalesce(english, '')), 300))::bigint AS english, sum(least(length(coalesce(hebrew, '')), 200))::bigint AS hebrew, count(*) FILTER (length(coalesce(hebrew, '')) > 200) AS cut FROM seg GROUP BY ref",
        "truncated": "SELECT doc_id, CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '...' ELSE text END AS short FROM documents",
        "span_keys": r"SELECT DISTINCT note_id, nullif(regexp_extract(story_key, '^(.*)_(\d+)-(\d+)$', 1), '') AS ref, try_cast(regexp_extract(story_key, '^(.*)_(\d+)-(\d+)$', 2) AS int) AS lo, try_cast(regexp_extract(story_key, '^(.*)_(\d+)-(\d+)$', 3) AS int) AS hi FROM boundary_notes",
        "page_order": with_(SEG) + r"SELECT DISTINCT ref, try_cast(regexp_extract(ref, '(\d+)[ab]$', 1) AS int) * 2 + CASE WHEN suffix(ref, 'b') THEN 1 ELSE 0 END AS page_key FROM seg",
        "fingerprints": "SELECT doc_id, substring(sha256(coalesce(lang, '') || chr(10) || coalesce(text, '')), 1, 16) AS fingerprint FROM documents",
        "triage_summary": with_(SEG, LABELLED)
        + """, p AS (SELECT corpus, ref, max((label IN ('TRIAGE_FAILED', 'NARRATIVE_EVENT'))::int) AS kept, count(*) FILTER (label = 'NARRATIVE_EVENT') AS a, count(*) FILTER (label = 'VERBAL_ACT') AS b, count(*) FILTER (label = 'DELIBERATION') AS c, count(*) FILTER (label = 'HABITUAL') AS h, count(*) FILTER (label = 'TRIAGE_FAILED') AS f FROM labelled GROUP BY corpus, ref)
SELECT corpus, count(*) AS pages, count(*) FILTER (kept = 1) AS kept, sum(a)::bigint AS narrative_event, sum(b)::bigint AS verbal_act, sum(c)::bigint AS deliberation, sum(h)::bigint AS habitual, sum(f)::bigint AS triage_failed FROM p GROUP BY corpus""",
        "keep_rules": with_(SEG, LABELLED)
        + """, p AS (SELECT ref, count(*) FILTER (label = 'NARRATIVE_EVENT') AS n, count(*) FILTER (label = 'VERBAL_ACT') AS v, count(*) AS s FROM labelled GROUP BY ref)
SELECT 'any_event' AS rule, count(*) FILTER (n >= 1) AS kept, count(*) AS pages FROM p UNION ALL SELECT 'two_events', count(*) FILTER (n >= 2), count(*) FROM p UNION ALL SELECT 'third', count(*) FILTER (n * 3 >= s), count(*) FROM p UNION ALL SELECT 'event_or_speech', count(*) FILTER (n + v >= 2), count(*) FROM p""",
    }
