"""Scores of found spans against golden ones, ordered decision tables, ship filters, funnels and gates."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.scoring import ratio
from spanloom.operators.spans import cells, greedy_match

#: Classifications that are no story, and those that are one for certain.
NO_STORY, DEFINITE = ("NOT_A_STORY", "NEEDS_REVIEW"), ("YES", "HIGH_CONFIDENCE")


def kind(classification: Column) -> Column:
    """A classification in its plain spelling; null stays null."""
    return F.upper(F.regexp_replace(F.trim(classification), r"\s+", "_"))


def is_story(classification: Column) -> Column:
    """What isn't said to be none is a story, a null too."""
    return ~F.coalesce(kind(classification).isin(*NO_STORY), F.lit(False))


def outcomes(golden: DataFrame, found: DataFrame) -> DataFrame:
    """``(corpus, ref, g_id, f_id, iou, result)``: TP, FN, FP or TN of each golden span, and FP of each found story left over on a
    golden page. Both sides have ``corpus, ref, id, no, lo, hi, story``; spans meet greedily in list order (``no``, ``id``)."""
    g, f = (df.where("lo <= hi and ref is not null") for df in (golden, found))
    met = greedy_match(g, f, order=("no", "id"))
    rows = g.select("corpus", "ref", F.col("id").alias("g_id"), "story").join(met, ["ref", "g_id"], "left").join(f.select(F.col("id").alias("f_id"), F.col("story").alias("f_story"), "ref"), ["ref", "f_id"], "left")
    hit = F.coalesce("f_story", F.lit(False))
    rows = rows.select("corpus", "ref", "g_id", "f_id", "iou", F.when(F.col("story") & hit, "TP").when(F.col("story"), "FN").when(hit, "FP").otherwise("TN").alias("result"))
    pages = g.groupBy("ref").agg(F.min("corpus").alias("corpus"))
    left = f.where("story").select("ref", F.col("id").alias("f_id")).join(met.select("ref", "f_id"), ["ref", "f_id"], "left_anti").join(pages, "ref")
    return rows.unionByName(left.select("corpus", "ref", F.lit(None).cast("string").alias("g_id"), "f_id", F.lit(None).cast("double").alias("iou"), F.lit("FP").alias("result")))


def evaluate(golden: DataFrame, found: DataFrame) -> DataFrame:
    """Per corpus of golden pages: counts, precision, recall, F1; mean and upper-middle IoU of story pairs, matched anew among
    golden stories only; precision, recall and F1 of spans that go on on a next page (``next_ref``); and the composite of the three."""
    counts = outcomes(golden, found).groupBy("corpus").agg(*(F.count_if(F.col("result") == x).alias(x.lower()) for x in ("TP", "FP", "FN", "TN")))
    g, f = (df.where("lo <= hi and ref is not null") for df in (golden, found))
    pairs = greedy_match(g.where("story"), f, order=("no", "id")).join(f.where("story").select("ref", F.col("id").alias("f_id")), ["ref", "f_id"], "left_semi")
    pairs = pairs.join(g.select("ref", F.col("id").alias("g_id"), "corpus"), ["ref", "g_id"])
    by = Window.partitionBy("corpus").orderBy("iou", "g_id")
    ranked = pairs.withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(Window.partitionBy("corpus")))
    edges = ranked.groupBy("corpus").agg(F.round(F.avg("iou"), 4).alias("mean_iou"), F.round(F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("iou"))), 4).alias("median_iou"), F.round(F.avg((F.col("iou") >= 0.8).cast("double")), 4).alias("good_iou"), F.count("*").alias("pairs"))
    pages = g.groupBy("ref").agg(F.min("corpus").alias("page_corpus"))
    over = lambda df: df.where("next_ref is not null").select("ref", "lo", "hi").distinct()
    gm, fm = over(g).join(pages, "ref"), over(f).join(pages, "ref")
    other = fm.select("ref", F.col("lo").alias("a"), F.col("hi").alias("b"))
    matched = gm.join(other, (gm["ref"] == other["ref"]) & (gm["lo"] <= other["b"]) & (other["a"] <= gm["hi"]), "left_semi")
    count = lambda df, name: df.groupBy(F.col("page_corpus").alias("corpus")).agg(F.count("*").alias(name))
    df = counts.join(edges, "corpus", "left").join(count(gm, "golden_over"), "corpus", "left").join(count(fm, "found_over"), "corpus", "left").join(count(matched, "matched_over"), "corpus", "left")
    df = df.na.fill(0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    df = df.withColumns({"precision": p, "recall": r, "f1": f1, "merge_f1": ratio(2 * F.col("matched_over"), F.col("golden_over") + F.col("found_over"))})
    return df.withColumn("composite", F.round(0.4 * F.col("f1") + 0.4 * F.col("mean_iou") + 0.2 * F.col("merge_f1"), 4))


# --- ordered decision tables ------------------------------------------------------------------------------------------


class Rule(NamedTuple):
    """If ``needs`` hold and ``feature`` is answered ``when``, the verdict falls, under the name ``rule``."""

    feature: str
    when: str
    verdict: str
    rule: str
    ours: bool = False
    needs: tuple[tuple[str, str], ...] = ()


def _is(feature: str, answer: str) -> Column:
    return F.coalesce(F.col(feature) == answer, F.lit(False))


def decide(rules: list[Rule], scope: str, unsure: str = "unsure") -> Column:
    """``struct<verdict, feature, rule, ours>`` by the first rule that decides, over columns named as the features.

    A rule whose precondition is itself unsure, or whose feature is, makes the verdict ``unsure`` there and then, on account of
    that feature. What no rule turns away is a story, unless the feature ``scope`` is answered yes (out_of_scope) or unsure.
    """

    def said(verdict: str, feature: str | None, rule: str, ours: bool) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(feature).cast("string").alias("feature"), F.lit(rule).alias("rule"), F.lit(ours).alias("ours"))

    cases: list[tuple[Column, Column]] = []
    for r in rules:
        met = reduce(lambda a, b: a & b, (_is(k, v) for k, v in r.needs), F.lit(True))
        cases += [(_is(k, unsure), said(unsure, k, r.rule, r.ours)) for k, _ in r.needs]
        cases += [(met & _is(r.feature, unsure), said(unsure, r.feature, r.rule, r.ours)), (met & _is(r.feature, r.when), said(r.verdict, r.feature, r.rule, r.ours))]
    cases += [(_is(scope, "yes"), said("out_of_scope", scope, "R-S1", False)), (_is(scope, unsure), said(unsure, scope, "R-S1", False))]
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])).otherwise(said("story", None, "R-C0", False))


def blocking(rules: list[Rule]) -> Column:
    """The features of all rules that turn a row away by themselves, in the rules' order."""
    held = [F.when(reduce(lambda a, b: a & b, (_is(k, v) for k, v in r.needs), F.lit(True)) & _is(r.feature, r.when), F.lit(f"{r.feature}:{r.rule}")) for r in rules if r.verdict != "story"]
    return F.array_compact(F.array(*held))


# --- filters by cells -------------------------------------------------------------------------------------------------


def overlapping(spans: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The keys of spans (``key, ref, lo, hi``) that share a cell with any of ``other`` (``ref, seg``)."""
    return cells(spans.select(key, "ref", "lo", "hi")).join(other.select("ref", "seg").distinct(), ["ref", "seg"], "left_semi").select(key).distinct()


def ship_filter(stories: DataFrame, evidence: DataFrame, dropped: DataFrame, elsewhere: DataFrame, include: DataFrame, remove: DataFrame) -> DataFrame:
    """``(id, ships, why)``: gates only narrow (definite; evidence on its cells; no judge drop; definite in the other run), an
    explicit ``include`` (``id``) widens, an explicit ``remove`` (``id``) narrows last. ``why`` names the first gate that stopped it.

    ``stories`` has ``id, ref, lo, hi, classification``; ``evidence``, ``dropped`` and ``elsewhere`` are cells (``ref, seg``).
    """
    df = stories.select("id", "ref", "lo", "hi", "classification")
    for name, other in (("_e", overlapping(df, evidence, "id")), ("_d", overlapping(df, dropped, "id")), ("_o", overlapping(df, elsewhere, "id")), ("_i", include.select("id").distinct()), ("_r", remove.select("id").distinct())):
        df = df.join(other.withColumn(name, F.lit(True)), "id", "left")
    gate = F.when(~F.coalesce(kind(F.col("classification")).isin(*DEFINITE), F.lit(False)), "grade").when(F.col("_e").isNull(), "no_evidence").when(F.col("_d").isNotNull(), "judges").when(F.col("_o").isNull(), "other_run")
    why = F.when(F.col("_r").isNotNull(), "removed").when(F.col("_i").isNotNull(), F.lit(None)).otherwise(gate)
    return df.select("id", why.isNull().alias("ships"), why.alias("why"))


def gate(rows: DataFrame, checks: list[tuple[str, str, str, str]]) -> DataFrame:
    """``(scope, check, measured, limit, status)`` from rows with ``scope`` and measured columns; a check is (column, severity, how, limit).

    ``how`` is 'max' (measured may be the limit at most) or 'min'; a failed check is of its severity, amber or red, others are green,
    and what wasn't measured is amber.
    """
    parts = [F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("measured"), F.lit(float(limit)).alias("limit"), F.lit(how).alias("how"), F.lit(severity).alias("severity")) for c, severity, how, limit in checks]
    long = rows.select("scope", F.explode(F.array(*parts)).alias("c")).select("scope", "c.*")
    fine = F.when(F.col("how") == "max", F.col("measured") <= F.col("limit")).otherwise(F.col("measured") >= F.col("limit"))
    return long.select("scope", "check", "measured", "limit", F.when(F.col("measured").isNull(), "amber").when(fine, "green").otherwise(F.col("severity")).alias("status"))
