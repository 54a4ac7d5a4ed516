"""Queries of the span operators over stories, segments and ruler entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import spans
from spanloom.plans import base
from spanloom.plans.base import GOOD, LABELLED, MGOOD, MIRROR, PAGE, SEG, STORY, with_


def _good(spark: SparkSession, d: str, table: str = "stories_main") -> DataFrame:
    return base.stories(spark, d, table).where("lo <= hi and ref is not null")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return base.segments(spark, d).select("ref", F.col("seg_idx").alias("seg"), base.label(F.col("english")).alias("label"))


def span_validate(spark: SparkSession, d: str) -> DataFrame:
    return spans.validate(base.stories(spark, d), base.pages(spark, d)).select("id", "action", "lo", "hi")


def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    pairs = spans.overlap_join(_good(spark, d).select("id", "ref", "lo", "hi"), _good(spark, d, "stories_mirror").select("id", "ref", "lo", "hi"))
    return pairs.select("id", "r_id", "shared", F.round("iou", 6).alias("iou"))


def span_exact_else_overlap(spark: SparkSession, d: str) -> DataFrame:
    left, right = (_good(spark, d, t).select("id", "ref", "lo", "hi") for t in ("stories_main", "stories_mirror"))
    return spans.exact_else_overlap(left, right, "id").select("id", "r_id", "exact")


def span_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    left, right = (_good(spark, d, t).select("id", "ref", "lo", "hi") for t in ("stories_main", "stories_mirror"))
    return spans.greedy_match(left, right).withColumn("iou", F.round("iou", 6))


def span_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that both copies' stories cover, and by how many stories of each."""
    a = spans.cells(_good(spark, d).select("ref", "lo", "hi")).groupBy("ref", "seg").agg(F.count("*").alias("n_main"))
    b = spans.cells(_good(spark, d, "stories_mirror").select("ref", "lo", "hi")).groupBy("ref", "seg").agg(F.count("*").alias("n_mirror"))
    return a.join(b, ["ref", "seg"])


def span_islands(spark: SparkSession, d: str) -> DataFrame:
    return spans.merge_islands(_good(spark, d).select("id", "ref", "lo", "hi")).drop("island")


def span_gap_merge(spark: SparkSession, d: str) -> DataFrame:
    return spans.merge_islands(_good(spark, d).select("id", "ref", "lo", "hi"), gap=4).drop("island")


def span_clashes(spark: SparkSession, d: str) -> DataFrame:
    return spans.clashes(_good(spark, d).select("id", "ref", "lo", "hi"))


def span_components(spark: SparkSession, d: str) -> DataFrame:
    """Stories of both copies that share cells, page-2 parts included: one component per chain of them."""
    parts = []
    for t in ("stories_main", "stories_mirror"):
        s = base.stories(spark, d, t, "next_ref", "start_segment_page2", "end_segment_page2")
        parts += [s.select("id", "ref", "lo", "hi"), s.select("id", F.col("next_ref").alias("ref"), F.col("start_segment_page2").alias("lo"), F.col("end_segment_page2").alias("hi"))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("ref is not null and lo <= hi")
    return spans.cell_components(whole)


def span_edge_trim(spark: SparkSession, d: str) -> DataFrame:
    return spans.label_trim(_good(spark, d).select("id", "ref", "lo", "hi"), _labels(spark, d), "id", "DELIBERATION", "NARRATIVE_EVENT").select("id", "new_lo", "new_hi")


OPENER = r"^(once |when |for \d+ days|there were )"


def span_start_snap(spark: SparkSession, d: str) -> DataFrame:
    opens = base.segments(spark, d).where(F.lower("english").rlike(OPENER)).select("ref", F.col("seg_idx").alias("seg"))
    return spans.snap_starts(_good(spark, d).select("id", "ref", "lo", "hi"), opens, "id").select("id", "new_lo")


def span_end_trim(spark: SparkSession, d: str) -> DataFrame:
    marked = _labels(spark, d).where("label = 'DELIBERATION'")
    return spans.trim_ends(_good(spark, d).select("id", "ref", "lo", "hi"), marked, "id").select("id", "new_hi")


def span_free_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return spans.free_neighbours(_good(spark, d).select("id", "ref", "lo", "hi"), base.segments(spark, d), "id")


def span_nearest(spark: SparkSession, d: str) -> DataFrame:
    """How far the cells of boundary notes lie from the nearest story of their page."""
    from spanloom.runtime import read

    notes = read(spark, d, "boundary_notes").where("page_ref is not null and start_segment is not null").select("note_id", F.col("page_ref").alias("ref"), F.col("start_segment").alias("seg")).distinct()
    return spans.nearest(notes, _good(spark, d), "note_id").select("note_id", "distance", "bucket")


def section_state(spark: SparkSession, d: str) -> DataFrame:
    english = F.lower("english")
    mark = F.when(english.rlike("taught|objected"), "open").when(english.rlike("^(once|when) "), "close")
    marks = base.segments(spark, d).select("ref", F.col("seg_idx").alias("seg"), mark.alias("mark"))
    return spans.section_state(marks, "open", "close").select("ref", "seg", "in_section")


def page_context(spark: SparkSession, d: str) -> DataFrame:
    """Each page of a corpus with the next: the last segments of the one and the first of the other."""
    seg = base.segments(spark, d)
    pages = base.pages(spark, d)
    nxt = pages.select("corpus", (F.col("page_seq") - 1).alias("page_seq"), F.col("ref").alias("next_ref"))
    pair = pages.join(nxt, ["corpus", "page_seq"])
    tail = seg.select("ref", F.col("seg_idx"), F.length("english").alias("n")).join(pair.select("ref", "last", "next_ref"), "ref").where("seg_idx > last - 5").groupBy("ref", "next_ref").agg(F.sum("n").alias("tail_chars"))
    head = seg.where("seg_idx < 5").groupBy(F.col("ref").alias("next_ref")).agg(F.sum(F.length("english")).alias("head_chars"))
    return tail.join(head, "next_ref", "left").select("ref", "next_ref", "tail_chars", "head_chars")


def boundary_spans(spark: SparkSession, d: str) -> DataFrame:
    """The last story of each page by extent, and whether it runs to the page's last segment."""
    last = _good(spark, d).groupBy("ref").agg(F.max(F.struct("hi", "lo", "id")).alias("s"))
    return last.join(base.pages(spark, d), "ref").select("ref", "s.id", (F.col("s.hi") >= F.col("last")).alias("reaches_end"))


def run_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = (base.stories(spark, d, t, "classification") for t in ("stories_main", "stories_mirror"))
    return spans.run_diff(a, b, "id", ["ref", "lo", "hi"], "classification")


def first_copies(spark: SparkSession, d: str) -> DataFrame:
    rows = base.segments(spark, d).withColumn("key", text.fold_key(text.strip_html(F.col("english")))).where("length(key) >= 20 and pos is not null")
    return spans.first_copies(rows.select("ref", "seg_idx", "pos", "key"), "key", "pos").where("first_of is not null").select("ref", "seg_idx", "first_of")


def queries() -> dict:
    fs = [span_validate, span_overlap, span_exact_else_overlap, span_greedy_match, span_cells, span_islands, span_gap_merge, span_clashes, span_components, span_edge_trim, span_start_snap, span_end_trim, span_free_neighbours, span_nearest, section_state, page_context, boundary_spans, run_diff, first_copies]
    return {f.__name__: f for f in fs}


def _islands_sql(gap: int) -> str:
    return with_(STORY, GOOD) + f""", reach AS (SELECT ref, lo, hi, max(hi) OVER (PARTITION BY ref ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM good),
num AS (SELECT *, sum(CASE WHEN r IS NULL OR lo > r + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY lo, hi) AS island FROM reach)
SELECT ref, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM num GROUP BY ref, island"""


PAIRS = "pairs AS (SELECT a.id, b.id AS r_id, a.lo, a.hi, b.lo AS r_lo, b.hi AS r_hi, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 AS shared FROM good a JOIN mgood b ON a.ref = b.ref AND a.lo <= b.hi AND b.lo <= a.hi)"


def oracle_sql() -> dict[str, str]:
    from spanloom.plans.eval_queries import greedy

    both = (STORY, MIRROR, GOOD, MGOOD)
    parts = " UNION ALL ".join(f"SELECT id, {r} AS ref, {lo} AS lo, {hi} AS hi FROM {t}" for t in ("story", "mirror") for r, lo, hi in (("ref", "lo", "hi"), ("next_ref", "start_segment_page2", "end_segment_page2")))
    return {
        "span_greedy_match": "WITH RECURSIVE " + ", ".join((*both, "g AS (SELECT ref, id, lo, hi, row_number() OVER (PARTITION BY ref ORDER BY lo, hi, id) AS k FROM good)", "f AS (SELECT ref, id, lo, hi, row_number() OVER (PARTITION BY ref ORDER BY lo, hi, id) AS j FROM mgood)", greedy("m", "g", "f"))) + " SELECT ref, g_id, f_id, round(iou, 6) AS iou FROM m",
        "span_components": f"WITH RECURSIVE {STORY}, {MIRROR}, p AS (SELECT * FROM ({parts}) WHERE ref IS NOT NULL AND lo <= hi), c AS (SELECT DISTINCT id, ref, unnest(range(lo, hi + 1)) AS seg FROM p), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM c a JOIN c b ON a.ref = b.ref AND a.seg = b.seg), w AS (SELECT a AS id, a AS seen FROM e UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.seen) SELECT id, min(seen) AS component FROM w GROUP BY id",
        "span_validate": with_(SEG, PAGE, STORY)
        + """, act AS (SELECT id, lo, hi, last, CASE WHEN lo IS NULL OR hi IS NULL OR last IS NULL THEN 'drop' WHEN hi < lo AND lo BETWEEN 0 AND last THEN 'collapse' WHEN hi < lo OR hi < 0 OR lo > last THEN 'drop' WHEN lo < 0 OR hi > last THEN 'clamp' ELSE 'keep' END AS action FROM story LEFT JOIN page USING (ref))
SELECT id, action, CASE action WHEN 'drop' THEN NULL WHEN 'clamp' THEN greatest(lo, 0) ELSE lo END AS lo, CASE action WHEN 'drop' THEN NULL WHEN 'collapse' THEN lo WHEN 'clamp' THEN least(hi, last) ELSE hi END AS hi FROM act""",
        "span_overlap": with_(*both, PAIRS) + "SELECT id, r_id, shared, round(shared * 1.0 / ((hi - lo + 1) + (r_hi - r_lo + 1) - shared), 6) AS iou FROM pairs",
        "span_exact_else_overlap": with_(*both, PAIRS) + ", e AS (SELECT *, lo = r_lo AND hi = r_hi AS exact FROM pairs), f AS (SELECT *, max(exact::int) OVER (PARTITION BY id) AS has FROM e) SELECT id, r_id, exact FROM f WHERE exact OR has = 0",
        "span_cells": with_(*both) + ", a AS (SELECT ref, unnest(range(lo, hi + 1))::int AS seg FROM good), b AS (SELECT ref, unnest(range(lo, hi + 1))::int AS seg FROM mgood), ca AS (SELECT ref, seg, count(*) AS n_main FROM a GROUP BY ALL), cb AS (SELECT ref, seg, count(*) AS n_mirror FROM b GROUP BY ALL) SELECT * FROM ca JOIN cb USING (ref, seg)",
        "span_islands": _islands_sql(0),
        "span_gap_merge": _islands_sql(4),
        "span_clashes": with_(STORY, GOOD) + ", n AS (SELECT ref, id, hi, lead(id) OVER w AS next_id, lead(lo) OVER w AS nl, lead(hi) OVER w AS nh FROM good WINDOW w AS (PARTITION BY ref ORDER BY lo, hi, id)) SELECT ref, id, next_id, CASE WHEN nh <= hi THEN 'contains' ELSE 'overlaps' END AS kind FROM n WHERE nl <= hi",
        "span_edge_trim": with_(SEG, LABELLED, STORY, GOOD)
        + """, t AS (SELECT id, min(CASE WHEN label <> 'DELIBERATION' THEN seg_idx END) AS a, max(CASE WHEN label <> 'DELIBERATION' THEN seg_idx END) AS b, max((label = 'NARRATIVE_EVENT')::int) AS ok FROM good g JOIN labelled l ON l.ref = g.ref AND l.seg_idx BETWEEN g.lo AND g.hi GROUP BY id), x AS (SELECT ref, max(seg_idx) AS last FROM seg GROUP BY ref)
SELECT g.id, CASE WHEN ok = 1 THEN a ELSE lo END AS new_lo, CASE WHEN ok = 1 AND coalesce(hi <= last, true) THEN b ELSE hi END AS new_hi FROM good g LEFT JOIN t USING (id) LEFT JOIN x USING (ref)""",
        "span_start_snap": with_(SEG, STORY, GOOD)
        + f""", o AS (SELECT ref, seg_idx FROM seg WHERE regexp_matches(lower(english), '{OPENER}')),
n AS (SELECT id, min(CASE WHEN seg_idx > lo THEN seg_idx END) AS fwd, max(CASE WHEN seg_idx = lo - 1 THEN seg_idx END) AS back FROM good JOIN o USING (ref) WHERE hi > lo AND seg_idx BETWEEN lo - 1 AND least(hi - 1, lo + 3) AND seg_idx <> lo GROUP BY id)
SELECT g.id, coalesce(fwd, back, lo) AS new_lo FROM good g LEFT JOIN n USING (id)""",
        "span_end_trim": with_(SEG, LABELLED, STORY, GOOD) + ", c AS (SELECT id, ref, lo, unnest(range(lo, hi + 1))::int AS s FROM good), m AS (SELECT id, max(CASE WHEN label IS DISTINCT FROM 'DELIBERATION' OR s <= c.lo + 1 THEN s END) AS new_hi FROM c LEFT JOIN labelled l ON l.ref = c.ref AND l.seg_idx = s GROUP BY id) SELECT id, new_hi FROM m",
        "span_free_neighbours": with_(SEG, STORY, GOOD)
        + """, taken AS (SELECT DISTINCT ref, unnest(range(lo, hi + 1))::int AS seg FROM good), near AS (SELECT id, ref, lo, hi, lo - 1 AS seg FROM good UNION ALL SELECT id, ref, lo, hi, hi + 1 FROM good),
free AS (SELECT n.*, row_number() OVER (PARTITION BY n.ref, n.seg ORDER BY lo, hi, id) AS k FROM near n WHERE EXISTS (SELECT 1 FROM seg s WHERE s.ref = n.ref AND s.seg_idx = n.seg) AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.ref = n.ref AND t.seg = n.seg))
SELECT ref, seg, id FROM free WHERE k = 1""",
        "span_nearest": with_(STORY, GOOD)
        + """, p AS (SELECT DISTINCT note_id, page_ref AS ref, start_segment AS seg FROM boundary_notes WHERE page_ref IS NOT NULL AND start_segment IS NOT NULL),
n AS (SELECT note_id, min(greatest(0, lo - seg, seg - hi)) AS distance FROM p JOIN good USING (ref) GROUP BY note_id)
SELECT note_id, distance, CASE WHEN distance IS NULL THEN 'none' WHEN distance = 0 THEN 'inside' WHEN distance <= 1 THEN 'next' WHEN distance <= 6 THEN 'near' ELSE 'far' END AS bucket FROM p LEFT JOIN n USING (note_id)""",
        "section_state": with_(SEG)
        + """, m AS (SELECT ref, seg_idx AS seg, CASE WHEN regexp_matches(lower(english), 'taught|objected') THEN 'open' WHEN regexp_matches(lower(english), '^(once|when) ') THEN 'close' END AS mark FROM seg),
s AS (SELECT ref, seg, last_value(mark IGNORE NULLS) OVER (PARTITION BY ref ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, first_value(mark IGNORE NULLS) OVER (PARTITION BY ref ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM m)
SELECT ref, seg, coalesce(l = 'open', f = 'close', false) AS in_section FROM s""",
        "page_context": with_(SEG, PAGE)
        + """, pair AS (SELECT a.ref, a.last, b.ref AS next_ref FROM page a JOIN page b ON a.corpus = b.corpus AND b.page_seq = a.page_seq + 1),
tail AS (SELECT p.ref, p.next_ref, sum(length(english))::bigint AS tail_chars FROM pair p JOIN seg s ON s.ref = p.ref AND s.seg_idx > p.last - 5 GROUP BY ALL), head AS (SELECT ref AS next_ref, sum(length(english))::bigint AS head_chars FROM seg WHERE seg_idx < 5 GROUP BY ref)
SELECT ref, next_ref, tail_chars, head_chars FROM tail LEFT JOIN head USING (next_ref)""",
        "boundary_spans": with_(SEG, PAGE, STORY, GOOD) + ", l AS (SELECT ref, id, hi, row_number() OVER (PARTITION BY ref ORDER BY hi DESC, lo DESC, id DESC) AS k FROM good) SELECT ref, id, hi >= last AS reaches_end FROM l JOIN page USING (ref) WHERE k = 1",
        "run_diff": with_(STORY, MIRROR)
        + """, j AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.ref IS DISTINCT FROM b.ref OR a.lo IS DISTINCT FROM b.lo OR a.hi IS DISTINCT FROM b.hi THEN 'moved' WHEN a.classification IS DISTINCT FROM b.classification THEN 'reclassified' END AS change FROM story a FULL JOIN mirror b ON a.id = b.id)
SELECT id, change FROM j WHERE change IS NOT NULL""",
        "first_copies": with_(SEG) + r""", k AS (SELECT ref, seg_idx, pos, lower(trim(substring(trim(regexp_replace(regexp_replace(english, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), ' '), 1, 150), ' ')) AS key FROM seg WHERE pos IS NOT NULL),
f AS (SELECT *, min(pos) OVER (PARTITION BY key) AS first_of FROM k WHERE length(key) >= 20) SELECT ref, seg_idx, first_of FROM f WHERE first_of < pos""",
    }
