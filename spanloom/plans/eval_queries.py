"""Queries of evaluation, decision tables, ship filters, funnels and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import evaluation, spans
from spanloom.operators.evaluation import DEFINITE, Rule, is_story, kind
from spanloom.plans import base
from spanloom.plans.base import GOOD, LABELLED, MGOOD, MIRROR, PAGE, SEG, STORY, with_
from spanloom.runtime import read

# The features of the panel and the rules that decide over them, in order.
FEATURES = ["actual", "event_beyond_speech", "conflict", "response_or_consequence", "custom", "event_after_custom", "alluded_only", "commentary", "biblical_actors"]
RULES = [
    Rule("commentary", "yes", "not", "R-B4"),
    Rule("actual", "no", "not", "R-C0"),
    Rule("alluded_only", "yes", "not", "R-C5", True),
    Rule("event_after_custom", "no", "not", "R-C3", True, (("custom", "yes"),)),
    Rule("conflict", "yes", "borderline", "R-C2", False, (("event_beyond_speech", "no"),)),
    Rule("conflict", "no", "not", "R-C2", False, (("event_beyond_speech", "no"),)),
    Rule("response_or_consequence", "no", "not", "R-C5"),
]
#: How judges' verdicts are read as answers of a panel of nine, the n-th judge answering the n-th feature.
ANSWERS = {"story": "yes", "not": "no", "borderline": "unsure", "out_of_scope": "n_a"}
#: Kinds of objection, by the first pattern that a note holds.
OBJECTIONS = [("boundary", r"segment \d+|starts? |ends? |cut |half"), ("merge", r"merge|same figure|same thing"), ("confidence", r"borderline|doubt"), ("classification", r"not an event|not a story|only an example|no event")]


def _stories(spark: SparkSession, d: str, table: str = "stories_main") -> DataFrame:
    df = base.stories(spark, d, table, "span_no", "next_ref", "classification", "one_sentence_summary")
    return df.withColumnsRenamed({"span_no": "no"}).withColumn("story", is_story(F.col("classification")))


def evaluation_scores(spark: SparkSession, d: str) -> DataFrame:
    """The mirror's stories scored against the main copy's, per corpus."""
    return evaluation.evaluate(_stories(spark, d), _stories(spark, d, "stories_mirror")).drop("pairs")


def match_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.outcomes(_stories(spark, d), _stories(spark, d, "stories_mirror")).select("ref", "g_id", "f_id", F.round("iou", 6).alias("iou"), "result")


def panel_features(spark: SparkSession, d: str) -> DataFrame:
    """``entry_id`` and the nine features, from the standing verdicts of the first nine judges."""
    said = F.create_map(*(F.lit(x) for kv in ANSWERS.items() for x in kv))[F.regexp_replace(F.lower(F.trim("verdict")), r"[\s-]+", "_")]
    a = read(spark, d, "judge_answers").where("verdict is not null").groupBy("entry_id", "judge").agg(F.max_by("verdict", F.struct("answered_at", "answer_id")).alias("verdict"))
    return a.groupBy("entry_id").agg(*(F.max(F.when(F.col("judge") == f"judge_{i:02d}", said)).alias(f) for i, f in enumerate(FEATURES, 1)))


def decision_table(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of each judged entry by the ordered table, with what decided it and all that would turn it away."""
    df = panel_features(spark, d)
    return df.select("entry_id", evaluation.decide(RULES, "biblical_actors").alias("v"), F.array_join(evaluation.blocking(RULES), "|").alias("blocking")).select("entry_id", "v.*", "blocking")


def panel_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Which feature decided, for entries whose reviewers' last reading says otherwise."""
    from spanloom.plans.label_queries import last_reading

    want = F.create_map(F.lit("yes"), F.lit("story"), F.lit("no"), F.lit("not"), F.lit("borderline"), F.lit("borderline"), F.lit("outofscope"), F.lit("out_of_scope"))[F.col("reading")]
    both = decision_table(spark, d).join(last_reading(spark, d), "entry_id").where(F.col("verdict") != want)
    return both.groupBy("feature", "verdict").agg(F.count("*").alias("errors"))


def label_edge_trim(spark: SparkSession, d: str) -> DataFrame:
    """Stories trimmed of discussion at their edges; a ruling about someone of the story stays, stories called none are left alone."""
    named = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b(?:rabbi|rav|mar|rab)\s+\w+"), 0)
    s = _stories(spark, d).where("lo <= hi and ref is not null").select("id", "ref", "lo", "hi", named("one_sentence_summary").alias("names"), (F.coalesce(kind(F.col("classification")), F.lit("NOT_A_STORY")) == "NOT_A_STORY").alias("exempt"))
    seg = base.segments(spark, d).select("ref", F.col("seg_idx").alias("seg"), base.label(F.col("english")).alias("label"), F.lower(F.coalesce("english", F.lit(""))).rlike(RULING).alias("ruling"), named("english").alias("names"))
    return spans.label_trim(s, seg, "id", "DELIBERATION", "NARRATIVE_EVENT").select("id", "new_lo", "new_hi")


RULING = r"ruled|said to (him|them|her)|permitted|forbade|decreed|ordered|declared"


def trailing_trim(spark: SparkSession, d: str) -> DataFrame:
    """Stories without trailing discussion; those that go on on the next page, or are called none, are left alone."""
    s = _stories(spark, d).where("lo <= hi and ref is not null")
    s = s.select("id", "ref", "lo", "hi", (F.col("next_ref").isNotNull() | (F.coalesce(kind(F.col("classification")), F.lit("NOT_A_STORY")) == "NOT_A_STORY")).alias("exempt"))
    marked = base.segments(spark, d).select("ref", F.col("seg_idx").alias("seg"), base.label(F.col("english")).alias("label")).where("label = 'DELIBERATION'")
    return spans.trim_ends(s, marked, "id").select("id", "new_hi")


def _in_section(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.plans.span_queries import section_state

    return section_state(spark, d)


def section_moved(spark: SparkSession, d: str) -> DataFrame:
    """Stories all of whose segments lie in a section: they are moved out of the list; those called none are exempt."""
    s = _stories(spark, d).where("lo <= hi and ref is not null").where(F.coalesce(kind(F.col("classification")), F.lit("")) != "NOT_A_STORY")
    inside = spans.cells(s.select("id", "ref", "lo", "hi")).join(_in_section(spark, d), ["ref", "seg"], "left")
    return inside.groupBy("id").agg(F.bool_and(F.coalesce("in_section", F.lit(False))).alias("moved")).where("moved").select("id")


def page_override(spark: SparkSession, d: str) -> DataFrame:
    """Pages kept by labels, or kept all the same because a segment has an introducer."""
    seg = base.segments(spark, d).withColumn("label", base.label(F.col("english")))
    per = seg.groupBy("ref").agg(F.bool_or(F.col("label").isin("TRIAGE_FAILED", "NARRATIVE_EVENT")).alias("by_label"), F.coalesce(F.bool_or(F.lower("english").rlike("once |came to|for \\d+ days")), F.lit(False)).alias("by_words"))
    return per.select("ref", F.when(F.col("by_label"), "label").when(F.col("by_words"), "override").otherwise("skipped").alias("state"))


def story_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus and run: stories that are kept, and those that are definite."""
    s = base.stories(spark, d, "stories_main", "run_id", "classification")
    return s.groupBy("corpus", "run_id").agg(F.count("*").alias("n"), F.count_if(is_story(F.col("classification"))).alias("kept"), F.count_if(kind(F.col("classification")).isin(*DEFINITE)).alias("definite"))


def ensemble_demotion(spark: SparkSession, d: str) -> DataFrame:
    """Stories that the other copy calls none, on pages with one narrative segment at most: demoted, the old class kept."""
    a = base.stories(spark, d, "stories_main", "classification").where(is_story(F.col("classification")))
    b = base.stories(spark, d, "stories_mirror", "classification").select("id", is_story(F.col("classification")).alias("there"))
    seg = base.segments(spark, d).groupBy("ref").agg(F.count_if(base.label(F.col("english")) == "NARRATIVE_EVENT").alias("events"))
    df = a.join(b, "id").where("not there").join(seg, "ref", "left").where(F.coalesce("events", F.lit(0)) <= 1)
    return df.select("id", F.col("classification").alias("was"), F.lit("NOT_A_STORY").alias("classification"), F.lit("ensemble").alias("reason"))


def _cells(spark: SparkSession, d: str, table: str, definite: bool = True) -> DataFrame:
    s = base.stories(spark, d, table, "classification").where("lo <= hi and ref is not null")
    good = kind(F.col("classification")).isin(*DEFINITE) if definite else is_story(F.col("classification"))
    return spans.cells(s.where(good).select("ref", "lo", "hi")).select("ref", "seg").distinct()


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "ruler_entries").dropDuplicates(["entry_id"])


def _listed_cells(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).where("expert_listed")
    return e.select("entry_id", "corpus", F.explode("expert_segments").alias("c")).select("entry_id", "corpus", "c.ref", "c.seg").where("ref is not null and seg is not null").distinct()


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """All proposed cells of entries, those of page 2 included."""
    s = _entries(spark, d).select("entry_id", F.explode("detector_span").alias("s"))
    one = s.select("entry_id", "s.ref", F.col("s.start_segment").alias("lo"), F.col("s.end_segment").alias("hi"))
    two = s.select("entry_id", F.col("s.next_ref").alias("ref"), F.col("s.start_segment_page2").alias("lo"), F.col("s.end_segment_page2").alias("hi"))
    return one.unionByName(two).where("ref is not null and lo <= hi")


def _kept_pages(spark: SparkSession, d: str) -> DataFrame:
    seg = base.segments(spark, d).withColumn("label", base.label(F.col("english")))
    return seg.groupBy("ref").agg(F.bool_or(F.col("label").isin("TRIAGE_FAILED", "NARRATIVE_EVENT")).alias("kept")).where("kept").select("ref")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Each listed entry with the steps that it passed: triage, proposed, story, definite, in both runs, shipped."""
    listed = _listed_cells(spark, d)
    e = _entries(spark, d).where("expert_listed").select("entry_id", "corpus")

    def step(cells_: DataFrame, name: str) -> DataFrame:
        return listed.join(cells_, ["ref", "seg"], "left_semi").select("entry_id").distinct().withColumn(name, F.lit(True))

    parts = [
        listed.join(_kept_pages(spark, d), "ref", "left_semi").select("entry_id").distinct().withColumn("triage", F.lit(True)),
        _ranges(spark, d).select("entry_id").distinct().withColumn("proposed", F.lit(True)),
        step(_cells(spark, d, "stories_main", False), "story"),
        step(_cells(spark, d, "stories_main"), "definite"),
        step(_cells(spark, d, "stories_mirror"), "there"),
        step(_shipped_cells(spark, d), "shipped"),
    ]
    for p in parts:
        e = e.join(p, "entry_id", "left")
    return e.na.fill(False, ["triage", "proposed", "story", "definite", "there", "shipped"]).withColumn("both", F.col("definite") & F.col("there"))


def _shipped_cells(spark: SparkSession, d: str) -> DataFrame:
    ship = ship_list(spark, d).where("ships").select("id")
    s = base.stories(spark, d).where("lo <= hi and ref is not null").join(ship, "id", "left_semi")
    return spans.cells(s.select("ref", "lo", "hi")).select("ref", "seg").distinct()


def ship_list(spark: SparkSession, d: str) -> DataFrame:
    """Which stories ship: definite, on evidence, not dropped by judges, definite in the mirror; keep and adjust decisions last."""
    s = base.stories(spark, d, "stories_main", "classification").where("lo <= hi and ref is not null")
    e = _entries(spark, d)
    cells_ = e.select("entry_id", F.explode("expert_segments").alias("c")).select("entry_id", "c.ref", "c.seg").where("ref is not null and seg is not null")
    said = F.regexp_replace(F.lower(F.trim("verdict")), r"[\s-]+", "_")
    drop = read(spark, d, "judge_answers").where("verdict is not null").groupBy("entry_id").agg((F.count_if(said == "not") * 2 > F.count("*")).alias("no")).where("no").select("entry_id")
    ids = lambda k: read(spark, d, "boundary_decisions").where(F.col("kind") == k).select(F.explode("ids").alias("id")).where("id is not null").distinct()
    evidence = cells_.select("ref", "seg").unionByName(spans.cells(_ranges(spark, d)).select("ref", "seg"))
    return evaluation.ship_filter(s, evidence, cells_.join(drop, "entry_id", "left_semi"), _cells(spark, d, "stories_mirror"), ids("keep"), ids("adjust"))


def full_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Listed entries by the steps they passed, per corpus."""
    return _steps(spark, d).groupBy("corpus").agg(F.count("*").alias("listed"), *(F.count_if(c).alias(c) for c in ("triage", "proposed", "story", "definite", "both", "shipped")))


def miss_causes(spark: SparkSession, d: str) -> DataFrame:
    """Every listed entry that isn't shipped by the first step that lost it; entries found but missed split into lost by triage and kept."""
    why = F.when(~F.col("triage"), "triage").when(~F.col("proposed"), "not_proposed").when(~F.col("story"), "called_none").when(~F.col("definite"), "below_definite").when(~F.col("there"), "other_run").otherwise("site_filter")
    missed = _steps(spark, d).where("not shipped").withColumn("cause", why)
    return missed.groupBy("corpus", "cause").agg(F.count("*").alias("n"), F.count_if(~F.col("proposed") & ~F.col("triage")).alias("triage_lost"), F.count_if(~F.col("proposed") & F.col("triage")).alias("kept_missed"))


def lower_bound_precision(spark: SparkSession, d: str) -> DataFrame:
    """Shipped stories per corpus, those on listed cells, and the share: a lower bound, as the list isn't exhaustive."""
    s = base.stories(spark, d).where("lo <= hi and ref is not null").join(ship_list(spark, d).where("ships").select("id"), "id", "left_semi")
    on = evaluation.overlapping(s, _listed_cells(spark, d), "id").withColumn("on_list", F.lit(True))
    n = s.join(on, "id", "left").groupBy("corpus").agg(F.count("*").alias("shipped"), F.count_if("on_list").alias("listed"))
    return n.withColumn("lower_bound", F.round(F.col("listed") / F.col("shipped"), 3))


def objection_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Per round: accepted and rejected, rejections by kind of objection, and precision with all rejections or only those of the call."""
    from spanloom.functions.text import first_rule

    v = _entries(spark, d).select(F.explode("verdicts").alias("v")).select("v.round", F.regexp_replace(F.lower("v.read_as"), "[^a-z]", "").alias("said"), F.col("v.note").alias("note")).where("said in ('yes', 'no')")
    no = F.col("said") == "no"
    what = first_rule(F.coalesce("note", F.lit("")), OBJECTIONS, "unclassified")
    df = v.withColumn("kind", F.when(no, what)).groupBy("round").agg(F.count_if(~no).alias("accepted"), F.count_if(no).alias("rejected"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("boundary", "merge", "confidence", "classification", "unclassified")))
    n = F.col("accepted") + F.col("rejected")
    return df.withColumns({"lower": F.round(F.col("accepted") / n, 3), "upper": F.round((n - F.col("classification")) / n, 3)})


def density_by_page(spark: SparkSession, d: str) -> DataFrame:
    """Listed entries by how many share their page: entries, those proposed, pages."""
    e = _entries(spark, d).where("expert_listed and ref is not null").select("entry_id", "ref", F.coalesce(F.size("detector_span") > 0, F.lit(False)).alias("found"))
    n = e.withColumn("k", F.least(F.count("*").over(Window.partitionBy("ref")), F.lit(4)).cast("int"))
    return n.groupBy(F.col("k").alias("on_page")).agg(F.count("*").alias("expert"), F.count_if("found").alias("found"), F.count_distinct("ref").alias("pages"))


def median_split(spark: SparkSession, d: str) -> DataFrame:
    """Words of listed passages, found and missed: the averaging median."""
    words = F.size(F.split(F.trim(F.regexp_replace("expert_text", r"\s+", " ")), " "))
    e = _entries(spark, d).where("expert_listed and trim(expert_text) <> ''").select(F.coalesce(F.size("detector_span") > 0, F.lit(False)).alias("found"), words.alias("words"))
    return e.groupBy("found").agg(F.median("words").alias("median_words"), F.count("*").alias("n"))


def run_spread(spark: SparkSession, d: str) -> DataFrame:
    """Stories of each corpus over runs and copies: mean, least, most and their distance."""
    per = [base.stories(spark, d, t, "run_id").groupBy("corpus", "run_id").agg(F.count("*").alias("n")) for t in ("stories_main", "stories_mirror")]
    return per[0].unionByName(per[1]).groupBy("corpus").agg(F.round(F.avg("n"), 4).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") - F.min("n")).alias("spread"))


def trim_depths(spark: SparkSession, d: str) -> DataFrame:
    """How many segments the end trim takes off, as a histogram."""
    s = base.stories(spark, d).where("lo <= hi and ref is not null").select("id", "hi")
    return s.join(trailing_trim(spark, d), "id").groupBy((F.col("hi") - F.col("new_hi")).alias("depth")).agg(F.count("*").alias("n"))


def gate_labels(spark: SparkSession, d: str) -> DataFrame:
    """Pages without labels, pages whose labels all failed, and labels of pages that aren't in the text, per corpus."""
    seg = base.segments(spark, d).withColumn("label", base.label(F.col("english")))
    page = seg.groupBy("corpus", "ref").agg(F.bool_and(F.col("label") == "TRIAGE_FAILED").alias("failed"))
    n = page.groupBy(F.col("corpus").alias("scope")).agg(F.count_if("failed").alias("all_failed"), F.count("*").alias("pages"))
    return evaluation.gate(n, [("all_failed", "red", "max", 0), ("pages", "red", "min", 1)])


def gate_pair(spark: SparkSession, d: str) -> DataFrame:
    """The two copies of each corpus: kept counts within a tenth, and nine tenths of definite passages definite in both.

    A passage is a run of overlapping definite stories of either copy on a page.
    """
    one = lambda t: base.stories(spark, d, t, "classification").where("lo <= hi and ref is not null")
    a, b = one("stories_main"), one("stories_mirror")
    kept = lambda df, n: df.where(is_story(F.col("classification"))).groupBy("corpus").agg(F.count("*").alias(n))
    both = kept(a, "ka").join(kept(b, "kb"), "corpus", "full_outer").na.fill(0)
    definite = lambda df, run: df.where(kind(F.col("classification")).isin(*DEFINITE)).select("corpus", "ref", "lo", "hi", F.lit(run).alias("run"))
    isle = spans.islands(definite(a, 1).unionByName(definite(b, 2))).groupBy("corpus", "ref", "island").agg(F.count_distinct("run").alias("runs"))
    share = isle.groupBy("corpus").agg(F.round(F.count_if(F.col("runs") == 2) / F.count("*"), 4).alias("definite_in_both"))
    df = both.join(share, "corpus", "left").select(F.col("corpus").alias("scope"), F.round(F.abs(F.col("ka") - F.col("kb")) / F.greatest("ka", "kb", F.lit(1)), 4).alias("kept_spread"), "definite_in_both")
    return evaluation.gate(df, [("kept_spread", "red", "max", 0.1), ("definite_in_both", "red", "min", 0.9)])


def gate_density(spark: SparkSession, d: str) -> DataFrame:
    """Kept stories per examined page of each corpus, against half the least and twice the most of the two largest corpora."""
    seg = base.segments(spark, d).withColumn("label", base.label(F.col("english")))
    page = seg.groupBy("ref").agg(F.min("corpus").alias("corpus"), F.bool_or(F.col("label").isin("TRIAGE_FAILED", "NARRATIVE_EVENT")).alias("kept")).where("kept").groupBy("corpus").agg(F.count("*").alias("pages"))
    s = base.stories(spark, d, "stories_main", "classification").where(is_story(F.col("classification"))).groupBy("corpus").agg(F.count("*").alias("stories"))
    n = page.join(s, "corpus", "left").select("corpus", F.coalesce("stories", F.lit(0)).alias("stories"), "pages", F.round(F.coalesce("stories", F.lit(0)) / F.col("pages"), 4).alias("density"))
    top = n.orderBy(F.desc("pages"), "corpus").limit(2).agg((0.5 * F.min("density")).alias("lo"), (2 * F.max("density")).alias("hi"))  # one row
    df = n.crossJoin(F.broadcast(top))
    return df.select("corpus", "stories", "pages", "density", F.when(F.col("density").between(F.col("lo"), F.col("hi")), "green").otherwise("amber").alias("status"))


def gate_judges(spark: SparkSession, d: str) -> DataFrame:
    """Each judge's answers: repeated for one entry, for entries that don't exist, and failed ones."""
    a = read(spark, d, "judge_answers").dropDuplicates(["answer_id"])
    known = _entries(spark, d).select("entry_id").withColumn("k", F.lit(True))
    df = a.join(known, "entry_id", "left")
    n = df.groupBy(F.col("judge").alias("scope")).agg((F.count("entry_id") - F.count_distinct("entry_id")).alias("repeated"), F.count_if(F.col("k").isNull()).alias("unknown_entries"), F.count_if(F.col("verdict").isNull()).alias("failed"))
    return evaluation.gate(n, [("repeated", "red", "max", 0), ("unknown_entries", "red", "max", 0), ("failed", "amber", "max", 2)])


def gate_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run records that are one object: the model and version pins, the token meter and failed triage pages."""
    part = lambda p: F.get_json_object("doc", p)
    df = read(spark, d, "run_records").where("ltrim(doc) like '{%'").select(F.col("rec_id").cast("string").alias("scope"), part("$.run_meta.model").alias("model"), part("$.run_meta.tokens.stage2.calls").try_cast("bigint").alias("calls"), part("$.run_meta.triage_failed.count").try_cast("bigint").alias("triage_failed")).where("model is not null").distinct()
    return evaluation.gate(df, [("calls", "red", "min", 1), ("triage_failed", "amber", "max", 0)])


def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Pages in the text, in either copy and in the notes: how many of each combination."""
    page = base.pages(spark, d).select("ref").withColumn("text", F.lit(True))
    named = lambda df, n: df.where("ref is not null").select("ref").distinct().withColumn(n, F.lit(True))
    df = page.join(named(base.stories(spark, d), "main"), "ref", "full_outer").join(named(base.stories(spark, d, "stories_mirror"), "mirror"), "ref", "full_outer").join(named(read(spark, d, "boundary_notes").withColumnRenamed("page_ref", "ref"), "notes"), "ref", "full_outer")
    return df.na.fill(False, ["text", "main", "mirror", "notes"]).groupBy("text", "main", "mirror", "notes").agg(F.count("*").alias("pages"))


def queries() -> dict:
    fs = [evaluation_scores, match_outcomes, decision_table, panel_attribution, label_edge_trim, trailing_trim, section_moved, page_override, story_tiers, ensemble_demotion, ship_list, full_funnel, miss_causes, lower_bound_precision, objection_bounds, density_by_page, median_split, run_spread, trim_depths, gate_labels, gate_pair, gate_density, gate_judges, gate_runs, coverage_matrix]
    return {f.__name__: f for f in fs}


KIND = "upper(regexp_replace(trim({}, ' '), '\\s+', '_', 'g'))"
IS_STORY = f"NOT coalesce({KIND.format('classification')} IN ('NOT_A_STORY', 'NEEDS_REVIEW'), false)"
DEF = f"coalesce({KIND.format('classification')} IN ('YES', 'HIGH_CONFIDENCE'), false)"
G = f"g AS (SELECT corpus, ref, id, lo, hi, next_ref, {IS_STORY} AS story, row_number() OVER (PARTITION BY ref ORDER BY span_no NULLS FIRST, id) AS k FROM good)"
F_ = f"f AS (SELECT corpus, ref, id, lo, hi, next_ref, {IS_STORY} AS story, row_number() OVER (PARTITION BY ref ORDER BY span_no NULLS FIRST, id) AS j FROM mgood)"


def greedy(name: str, g: str, f: str) -> str:
    """A view ``name (ref, g_id, f_id, iou)`` of the greedy matching of ``g`` (with k) and ``f`` (with j), by recursion over k."""
    return f"""{name}_c AS (SELECT ref, k, list({{'j': j, 'id': f_id, 'iou': iou}} ORDER BY iou DESC, j) AS c FROM (SELECT g.ref, g.k, f.j, f.id AS f_id, greatest(0, least(g.hi, f.hi) - greatest(g.lo, f.lo) + 1)::double / ((g.hi - g.lo + 1) + (f.hi - f.lo + 1) - greatest(0, least(g.hi, f.hi) - greatest(g.lo, f.lo) + 1)) AS iou FROM {g} g JOIN {f} f ON g.ref = f.ref) WHERE iou >= 0.3 GROUP BY ref, k),
{name}_w AS (SELECT ref, 0::bigint AS k, []::bigint[] AS used, NULL::struct(j bigint, id varchar, iou double) AS p FROM (SELECT DISTINCT ref FROM {g})
  UNION ALL SELECT ref, k, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.j) END, p FROM (SELECT w.ref, g.k, w.used, list_filter(coalesce(c.c, []), lambda x: NOT list_contains(w.used, x.j))[1] AS p FROM {name}_w w JOIN {g} g ON g.ref = w.ref AND g.k = w.k + 1 LEFT JOIN {name}_c c ON c.ref = w.ref AND c.k = w.k + 1)),
{name} AS (SELECT w.ref, g.id AS g_id, w.p.id AS f_id, w.p.iou AS iou FROM {name}_w w JOIN {g} g ON g.ref = w.ref AND g.k = w.k WHERE w.p IS NOT NULL)"""


R = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE round(({a}) * 1.0 / ({b}), 4) END"
ENTRY = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id) AS rn FROM ruler_entries) WHERE rn = 1)"
LISTED = "listed AS (SELECT DISTINCT entry_id, corpus, c.ref AS ref, c.seg AS seg FROM (SELECT entry_id, corpus, unnest(expert_segments) AS c FROM e WHERE expert_listed) WHERE c.ref IS NOT NULL AND c.seg IS NOT NULL)"
RANGES = "spans AS (SELECT entry_id, unnest(detector_span) AS s FROM e), ranges AS (SELECT * FROM (SELECT entry_id, s.ref AS ref, s.start_segment AS lo, s.end_segment AS hi FROM spans UNION ALL SELECT entry_id, s.next_ref, s.start_segment_page2, s.end_segment_page2 FROM spans) WHERE ref IS NOT NULL AND lo <= hi)"
CELLS = f"ms AS (SELECT DISTINCT ref, unnest(range(lo, hi + 1)) AS seg FROM good WHERE {IS_STORY}), md AS (SELECT DISTINCT ref, unnest(range(lo, hi + 1)) AS seg FROM good WHERE {DEF}), rd AS (SELECT DISTINCT ref, unnest(range(lo, hi + 1)) AS seg FROM mgood WHERE {DEF})"
SHIP = f"""cell AS (SELECT entry_id, c.ref AS ref, c.seg AS seg FROM (SELECT entry_id, unnest(expert_segments) AS c FROM e) WHERE c.ref IS NOT NULL AND c.seg IS NOT NULL),
ev AS (SELECT ref, seg FROM cell UNION SELECT ref, unnest(range(lo, hi + 1)) FROM ranges),
no_ AS (SELECT entry_id FROM judge_answers WHERE verdict IS NOT NULL GROUP BY entry_id HAVING count(*) FILTER (regexp_replace(lower(trim(verdict, ' ')), '[\\s-]+', '_', 'g') = 'not') * 2 > count(*)),
dropped AS (SELECT DISTINCT ref, seg FROM cell WHERE entry_id IN (SELECT entry_id FROM no_)),
keep_ AS (SELECT DISTINCT unnest(ids) AS id FROM boundary_decisions WHERE kind = 'keep'), adj AS (SELECT DISTINCT unnest(ids) AS id FROM boundary_decisions WHERE kind = 'adjust'),
gc AS (SELECT id, ref, unnest(range(lo, hi + 1)) AS seg FROM good),
has AS (SELECT id, bool_or((ref, seg) IN (SELECT (ref, seg) FROM ev)) AS ev, bool_or((ref, seg) IN (SELECT (ref, seg) FROM dropped)) AS dr, bool_or((ref, seg) IN (SELECT (ref, seg) FROM rd)) AS ot FROM gc GROUP BY id),
ship AS (SELECT good.id, CASE WHEN good.id IN (SELECT id FROM adj WHERE id IS NOT NULL) THEN 'removed' WHEN good.id IN (SELECT id FROM keep_ WHERE id IS NOT NULL) THEN NULL WHEN NOT {DEF} THEN 'grade' WHEN NOT ev THEN 'no_evidence' WHEN dr THEN 'judges' WHEN NOT ot THEN 'other_run' END AS why FROM good JOIN has USING (id))"""
STEPS = """kept AS (SELECT ref FROM labelled GROUP BY ref HAVING bool_or(label IN ('TRIAGE_FAILED', 'NARRATIVE_EVENT'))),
sh AS (SELECT DISTINCT ref, seg FROM gc WHERE id IN (SELECT id FROM ship WHERE why IS NULL)),
st0 AS (SELECT entry_id, bool_or(ref IN (SELECT ref FROM kept)) AS triage, bool_or((ref, seg) IN (SELECT (ref, seg) FROM ms)) AS story, bool_or((ref, seg) IN (SELECT (ref, seg) FROM md)) AS definite, bool_or((ref, seg) IN (SELECT (ref, seg) FROM rd)) AS there, bool_or((ref, seg) IN (SELECT (ref, seg) FROM sh)) AS shipped FROM listed GROUP BY entry_id),
steps AS (SELECT e.entry_id, e.corpus, coalesce(triage, false) AS triage, e.entry_id IN (SELECT entry_id FROM ranges) AS proposed, coalesce(story, false) AS story, coalesce(definite, false) AS definite, coalesce(there, false) AS there, coalesce(shipped, false) AS shipped FROM e LEFT JOIN st0 USING (entry_id) WHERE expert_listed)"""
ALL_STEPS = (SEG, LABELLED, STORY, MIRROR, GOOD, MGOOD, ENTRY, LISTED, RANGES, CELLS, SHIP, STEPS)
FEATURE_SQL = "st AS (SELECT entry_id, judge, regexp_replace(lower(trim(verdict, ' ')), '[\\s-]+', '_', 'g') AS v FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, judge ORDER BY answered_at DESC, answer_id DESC) AS k FROM judge_answers WHERE verdict IS NOT NULL) WHERE k = 1), ft AS (SELECT entry_id, " + ", ".join(f"max(CASE WHEN judge = 'judge_{i:02d}' THEN CASE v WHEN 'story' THEN 'yes' WHEN 'not' THEN 'no' WHEN 'borderline' THEN 'unsure' WHEN 'out_of_scope' THEN 'n_a' END END) AS {f}" for i, f in enumerate(FEATURES, 1)) + " FROM st GROUP BY entry_id)"


def _decide_sql() -> str:
    """The table spelt out case by case, and what blocks."""
    case = """CASE WHEN commentary = 'unsure' THEN ['unsure', 'commentary', 'R-B4', 'f'] WHEN commentary = 'yes' THEN ['not', 'commentary', 'R-B4', 'f']
WHEN actual = 'unsure' THEN ['unsure', 'actual', 'R-C0', 'f'] WHEN actual = 'no' THEN ['not', 'actual', 'R-C0', 'f']
WHEN alluded_only = 'unsure' THEN ['unsure', 'alluded_only', 'R-C5', 't'] WHEN alluded_only = 'yes' THEN ['not', 'alluded_only', 'R-C5', 't']
WHEN custom = 'unsure' THEN ['unsure', 'custom', 'R-C3', 't'] WHEN custom = 'yes' AND event_after_custom = 'unsure' THEN ['unsure', 'event_after_custom', 'R-C3', 't'] WHEN custom = 'yes' AND event_after_custom = 'no' THEN ['not', 'event_after_custom', 'R-C3', 't']
WHEN event_beyond_speech = 'unsure' THEN ['unsure', 'event_beyond_speech', 'R-C2', 'f'] WHEN event_beyond_speech = 'no' AND conflict = 'unsure' THEN ['unsure', 'conflict', 'R-C2', 'f'] WHEN event_beyond_speech = 'no' AND conflict = 'yes' THEN ['borderline', 'conflict', 'R-C2', 'f'] WHEN event_beyond_speech = 'no' AND conflict = 'no' THEN ['not', 'conflict', 'R-C2', 'f']
WHEN response_or_consequence = 'unsure' THEN ['unsure', 'response_or_consequence', 'R-C5', 'f'] WHEN response_or_consequence = 'no' THEN ['not', 'response_or_consequence', 'R-C5', 'f']
WHEN biblical_actors = 'yes' THEN ['out_of_scope', 'biblical_actors', 'R-S1', 'f'] WHEN biblical_actors = 'unsure' THEN ['unsure', 'biblical_actors', 'R-S1', 'f'] ELSE ['story', NULL, 'R-C0', 'f'] END"""
    block = """array_to_string(list_filter([CASE WHEN commentary = 'yes' THEN 'commentary:R-B4' END, CASE WHEN actual = 'no' THEN 'actual:R-C0' END, CASE WHEN alluded_only = 'yes' THEN 'alluded_only:R-C5' END, CASE WHEN custom = 'yes' AND event_after_custom = 'no' THEN 'event_after_custom:R-C3' END, CASE WHEN event_beyond_speech = 'no' AND conflict = 'yes' THEN 'conflict:R-C2' END, CASE WHEN event_beyond_speech = 'no' AND conflict = 'no' THEN 'conflict:R-C2' END, CASE WHEN response_or_consequence = 'no' THEN 'response_or_consequence:R-C5' END], lambda x: x IS NOT NULL), '|')"""
    return f"dt AS (SELECT entry_id, v[1] AS verdict, v[2] AS feature, v[3] AS rule, v[4] = 't' AS ours, blocking FROM (SELECT entry_id, {case} AS v, {block} AS blocking FROM ft))"


def _rec(*views: str) -> str:
    return "WITH RECURSIVE " + ", ".join(views) + " "


def oracle_sql() -> dict[str, str]:
    from spanloom.plans.label_queries import oracle_sql as labels
    from spanloom.plans.span_queries import oracle_sql as span_sql

    both = (STORY, MIRROR, GOOD, MGOOD, G, F_)
    objection = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(note, '')), '{p}') THEN '{k}'" for k, p in OBJECTIONS) + " ELSE 'unclassified' END"
    section = span_sql()["section_state"]
    trailing = f"tt AS (SELECT c.id, CASE WHEN bool_or(ex) THEN max(hi) ELSE max(CASE WHEN label IS DISTINCT FROM 'DELIBERATION' OR s <= lo + 1 THEN s END) END AS new_hi FROM (SELECT id, ref, lo, hi, next_ref IS NOT NULL OR coalesce({KIND.format('classification')}, 'NOT_A_STORY') = 'NOT_A_STORY' AS ex, unnest(range(lo, hi + 1))::int AS s FROM good) c LEFT JOIN labelled l ON l.ref = c.ref AND l.seg_idx = s GROUP BY c.id)"
    status = lambda how, limit, severity: f"CASE WHEN measured IS NULL THEN 'amber' WHEN measured {'<=' if how == 'max' else '>='} {limit} THEN 'green' ELSE '{severity}' END"
    check = lambda rel, name, severity, how, limit: f"SELECT scope, '{name}' AS \"check\", measured, {limit}::double AS \"limit\", {status(how, limit, severity)} AS status FROM (SELECT scope, {name}::double AS measured FROM {rel})"
    names = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '\\b(?:rabbi|rav|mar|rab)\\s+\\w+')"
    return {
        "evaluation_scores": _rec(*both, greedy("m", "g", "f"), "gs AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY ref ORDER BY k) AS k FROM g WHERE story)", greedy("n", "gs", "f"))
        + f""", r AS (SELECT g.corpus, CASE WHEN g.story AND coalesce(f.story, false) THEN 'TP' WHEN g.story THEN 'FN' WHEN coalesce(f.story, false) THEN 'FP' ELSE 'TN' END AS result FROM g LEFT JOIN m ON m.ref = g.ref AND m.g_id = g.id LEFT JOIN f ON f.ref = m.ref AND f.id = m.f_id
  UNION ALL SELECT p.corpus, 'FP' FROM f JOIN (SELECT ref, min(corpus) AS corpus FROM g GROUP BY ref) p ON p.ref = f.ref WHERE f.story AND NOT EXISTS (SELECT 1 FROM m WHERE m.ref = f.ref AND m.f_id = f.id)),
c AS (SELECT corpus, count(*) FILTER (result = 'TP') AS tp, count(*) FILTER (result = 'FP') AS fp, count(*) FILTER (result = 'FN') AS fn, count(*) FILTER (result = 'TN') AS tn FROM r GROUP BY corpus),
i AS (SELECT g.corpus, n.iou, row_number() OVER (PARTITION BY g.corpus ORDER BY n.iou, n.g_id) - 1 AS x, count(*) OVER (PARTITION BY g.corpus) AS y FROM n JOIN f ON f.ref = n.ref AND f.id = n.f_id AND f.story JOIN g ON g.ref = n.ref AND g.id = n.g_id),
b AS (SELECT corpus, round(avg(iou), 4) AS mean_iou, round(max(CASE WHEN x = y // 2 THEN iou END), 4) AS median_iou, round(avg((iou >= 0.8)::int), 4) AS good_iou FROM i GROUP BY corpus),
pg AS (SELECT ref, min(corpus) AS corpus FROM g GROUP BY ref), gm AS (SELECT DISTINCT pg.corpus, g.ref, lo, hi FROM g JOIN pg USING (ref) WHERE next_ref IS NOT NULL), fm AS (SELECT DISTINCT pg.corpus, f.ref, lo, hi FROM f JOIN pg USING (ref) WHERE next_ref IS NOT NULL),
a AS (SELECT c.*, coalesce(mean_iou, 0) AS mean_iou, coalesce(median_iou, 0) AS median_iou, coalesce(good_iou, 0) AS good_iou, (SELECT count(*) FROM gm WHERE gm.corpus = c.corpus) AS golden_over, (SELECT count(*) FROM fm WHERE fm.corpus = c.corpus) AS found_over, (SELECT count(*) FROM gm WHERE gm.corpus = c.corpus AND EXISTS (SELECT 1 FROM fm WHERE fm.ref = gm.ref AND fm.lo <= gm.hi AND gm.lo <= fm.hi)) AS matched_over FROM c LEFT JOIN b USING (corpus)),
z AS (SELECT *, {R('tp', 'tp + fp')} AS precision, {R('tp', 'tp + fn')} AS recall, {R('2 * tp', '2 * tp + fp + fn')} AS f1, {R('2 * matched_over', 'golden_over + found_over')} AS merge_f1 FROM a)
SELECT *, round(0.4 * f1 + 0.4 * mean_iou + 0.2 * merge_f1, 4) AS composite FROM z""",
        "match_outcomes": _rec(*both, greedy("m", "g", "f"))
        + """SELECT g.ref, g.id AS g_id, m.f_id, round(m.iou, 6) AS iou, CASE WHEN g.story AND coalesce(f.story, false) THEN 'TP' WHEN g.story THEN 'FN' WHEN coalesce(f.story, false) THEN 'FP' ELSE 'TN' END AS result FROM g LEFT JOIN m ON m.ref = g.ref AND m.g_id = g.id LEFT JOIN f ON f.ref = m.ref AND f.id = m.f_id
UNION ALL SELECT f.ref, NULL, f.id, NULL, 'FP' FROM f WHERE f.story AND f.ref IN (SELECT ref FROM g) AND NOT EXISTS (SELECT 1 FROM m WHERE m.ref = f.ref AND m.f_id = f.id)""",
        "decision_table": with_(FEATURE_SQL, _decide_sql()) + "SELECT * FROM dt",
        "panel_attribution": with_(FEATURE_SQL, _decide_sql(), f"lr AS ({labels()['last_reading']})") + "SELECT feature, verdict, count(*) AS errors FROM dt JOIN lr USING (entry_id) WHERE verdict <> CASE reading WHEN 'yes' THEN 'story' WHEN 'no' THEN 'not' WHEN 'borderline' THEN 'borderline' WHEN 'outofscope' THEN 'out_of_scope' END GROUP BY ALL",
        "label_edge_trim": with_(SEG, LABELLED, STORY, GOOD)
        + f""", s AS (SELECT id, ref, lo, hi, {names('one_sentence_summary')} AS nm, coalesce({KIND.format('classification')}, 'NOT_A_STORY') = 'NOT_A_STORY' AS ex FROM good),
t AS (SELECT s.id, min(CASE WHEN label <> 'DELIBERATION' THEN seg_idx END) AS a, max(CASE WHEN label <> 'DELIBERATION' OR regexp_matches(lower(coalesce(english, '')), '{RULING}') AND list_has_any({names('english')}, nm) THEN seg_idx END) AS b, bool_or(label = 'NARRATIVE_EVENT') AS ok FROM s JOIN labelled l ON l.ref = s.ref AND l.seg_idx BETWEEN s.lo AND s.hi GROUP BY s.id),
x AS (SELECT ref, max(seg_idx) AS last FROM seg GROUP BY ref)
SELECT s.id, CASE WHEN coalesce(ok, false) AND NOT ex THEN a ELSE lo END AS new_lo, CASE WHEN coalesce(ok, false) AND NOT ex THEN CASE WHEN hi > last THEN hi ELSE b END ELSE hi END AS new_hi FROM s LEFT JOIN t USING (id) LEFT JOIN x USING (ref)""",
        "trailing_trim": with_(SEG, LABELLED, STORY, GOOD, trailing) + "SELECT id, new_hi FROM tt",
        "trim_depths": with_(SEG, LABELLED, STORY, GOOD, trailing) + "SELECT hi - new_hi AS depth, count(*) AS n FROM tt JOIN good USING (id) GROUP BY 1",
        "section_moved": with_(STORY, GOOD, f"ss AS ({section})") + f"SELECT id FROM (SELECT id, ref, unnest(range(lo, hi + 1))::int AS seg FROM good WHERE coalesce({KIND.format('classification')}, '') <> 'NOT_A_STORY') LEFT JOIN ss USING (ref, seg) GROUP BY id HAVING bool_and(coalesce(in_section, false))",
        "page_override": with_(SEG, LABELLED) + "SELECT ref, CASE WHEN bool_or(label IN ('TRIAGE_FAILED', 'NARRATIVE_EVENT')) THEN 'label' WHEN coalesce(bool_or(regexp_matches(lower(english), 'once |came to|for \\d+ days')), false) THEN 'override' ELSE 'skipped' END AS state FROM labelled GROUP BY ref",
        "story_tiers": with_(STORY) + f"SELECT corpus, run_id, count(*) AS n, count(*) FILTER ({IS_STORY}) AS kept, count(*) FILTER ({DEF}) AS definite FROM story GROUP BY ALL",
        "ensemble_demotion": with_(SEG, LABELLED, STORY, MIRROR) + f", ev AS (SELECT ref, count(*) FILTER (label = 'NARRATIVE_EVENT') AS events FROM labelled GROUP BY ref), b AS (SELECT id FROM mirror WHERE NOT ({IS_STORY})) SELECT id, classification AS was, 'NOT_A_STORY' AS classification, 'ensemble' AS reason FROM (SELECT * FROM story WHERE {IS_STORY}) a LEFT JOIN ev USING (ref) WHERE id IN (SELECT id FROM b) AND coalesce(events, 0) <= 1",
        "ship_list": with_(STORY, MIRROR, GOOD, MGOOD, ENTRY, RANGES, CELLS, SHIP) + "SELECT id, why IS NULL AS ships, why FROM ship",
        "full_funnel": with_(*ALL_STEPS) + "SELECT corpus, count(*) AS listed, count(*) FILTER (triage) AS triage, count(*) FILTER (proposed) AS proposed, count(*) FILTER (story) AS story, count(*) FILTER (definite) AS definite, count(*) FILTER (definite AND there) AS both, count(*) FILTER (shipped) AS shipped FROM steps GROUP BY corpus",
        "miss_causes": with_(*ALL_STEPS) + "SELECT corpus, CASE WHEN NOT triage THEN 'triage' WHEN NOT proposed THEN 'not_proposed' WHEN NOT story THEN 'called_none' WHEN NOT definite THEN 'below_definite' WHEN NOT there THEN 'other_run' ELSE 'site_filter' END AS cause, count(*) AS n, count(*) FILTER (NOT proposed AND NOT triage) AS triage_lost, count(*) FILTER (NOT proposed AND triage) AS kept_missed FROM steps WHERE NOT shipped GROUP BY ALL",
        "lower_bound_precision": with_(STORY, MIRROR, GOOD, MGOOD, ENTRY, LISTED, RANGES, CELLS, SHIP) + ", s AS (SELECT corpus, good.id, bool_or((gc.ref, gc.seg) IN (SELECT (ref, seg) FROM listed)) AS li FROM good JOIN gc USING (id) WHERE good.id IN (SELECT id FROM ship WHERE why IS NULL) GROUP BY ALL) SELECT corpus, count(*) AS shipped, count(*) FILTER (li) AS listed, round(count(*) FILTER (li) / count(*), 3) AS lower_bound FROM s GROUP BY corpus",
        "objection_bounds": with_(ENTRY) + f", v AS (SELECT x.round AS round, regexp_replace(lower(x.read_as), '[^a-z]', '', 'g') AS said, x.note AS note FROM (SELECT unnest(verdicts) AS x FROM e)), k AS (SELECT round, said, CASE WHEN said = 'no' THEN {objection} END AS kind FROM v WHERE said IN ('yes', 'no')), c AS (SELECT round, count(*) FILTER (said = 'yes') AS accepted, count(*) FILTER (said = 'no') AS rejected, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("boundary", "merge", "confidence", "classification", "unclassified")) + " FROM k GROUP BY round) SELECT *, round(accepted / (accepted + rejected), 3) AS lower, round((accepted + rejected - classification) / (accepted + rejected), 3) AS upper FROM c",
        "density_by_page": with_(ENTRY) + ", k AS (SELECT ref, coalesce(len(detector_span), 0) > 0 AS found, least(count(*) OVER (PARTITION BY ref), 4)::int AS k FROM e WHERE expert_listed AND ref IS NOT NULL) SELECT k AS on_page, count(*) AS expert, count(*) FILTER (found) AS found, count(DISTINCT ref) AS pages FROM k GROUP BY k",
        "median_split": with_(ENTRY) + ", w AS (SELECT coalesce(len(detector_span), 0) > 0 AS found, len(string_split(trim(regexp_replace(expert_text, '\\s+', ' ', 'g'), ' '), ' ')) AS words FROM e WHERE expert_listed AND trim(expert_text, ' ') <> '') SELECT found, median(words)::double AS median_words, count(*) AS n FROM w GROUP BY found",
        "run_spread": with_(STORY, MIRROR) + ", p AS (SELECT corpus, run_id, count(*) AS n FROM story GROUP BY ALL UNION ALL SELECT corpus, run_id, count(*) FROM mirror GROUP BY ALL) SELECT corpus, round(avg(n), 4) AS mean, min(n) AS least, max(n) AS most, max(n) - min(n) AS spread FROM p GROUP BY corpus",
        "gate_labels": with_(SEG, LABELLED) + ", p AS (SELECT corpus, ref, bool_and(label = 'TRIAGE_FAILED') AS failed FROM labelled GROUP BY ALL), n AS (SELECT corpus AS scope, count(*) FILTER (failed) AS all_failed, count(*) AS pages FROM p GROUP BY corpus) " + check("n", "all_failed", "red", "max", 0) + " UNION ALL " + check("n", "pages", "red", "min", 1),
        "gate_pair": with_(STORY, MIRROR, GOOD, MGOOD)
        + f""", k AS (SELECT coalesce(a.corpus, b.corpus) AS corpus, coalesce(ka, 0) AS ka, coalesce(kb, 0) AS kb FROM (SELECT corpus, count(*) AS ka FROM good WHERE {IS_STORY} GROUP BY corpus) a FULL JOIN (SELECT corpus, count(*) AS kb FROM mgood WHERE {IS_STORY} GROUP BY corpus) b ON a.corpus IS NOT DISTINCT FROM b.corpus),
u AS (SELECT corpus, ref, lo, hi, 1 AS run FROM good WHERE {DEF} UNION ALL SELECT corpus, ref, lo, hi, 2 FROM mgood WHERE {DEF}), r AS (SELECT *, max(hi) OVER (PARTITION BY ref ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM u),
i AS (SELECT *, sum(CASE WHEN x IS NULL OR lo > x THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY lo, hi) AS island FROM r), c AS (SELECT corpus, count(DISTINCT run) AS runs FROM i GROUP BY corpus, ref, island),
n AS (SELECT k.corpus AS scope, round(abs(ka - kb) / greatest(ka, kb, 1), 4) AS kept_spread, (SELECT round(count(*) FILTER (runs = 2) / count(*), 4) FROM c WHERE c.corpus = k.corpus HAVING count(*) > 0) AS definite_in_both FROM k) """
        + check("n", "kept_spread", "red", "max", 0.1) + " UNION ALL " + check("n", "definite_in_both", "red", "min", 0.9),
        "gate_density": with_(SEG, LABELLED, STORY) + f", p0 AS (SELECT ref, min(corpus) AS corpus FROM labelled GROUP BY ref HAVING bool_or(label IN ('TRIAGE_FAILED', 'NARRATIVE_EVENT'))), p AS (SELECT corpus, count(*) AS pages FROM p0 GROUP BY corpus), s AS (SELECT corpus, count(*) AS stories FROM story WHERE {IS_STORY} GROUP BY corpus), n AS (SELECT corpus, coalesce(stories, 0) AS stories, pages, round(coalesce(stories, 0) / pages, 4) AS density FROM p LEFT JOIN s USING (corpus)), t AS (SELECT 0.5 * min(density) AS lo, 2 * max(density) AS hi FROM (SELECT density FROM n ORDER BY pages DESC, corpus LIMIT 2)) SELECT corpus, stories, pages, density, CASE WHEN density BETWEEN lo AND hi THEN 'green' ELSE 'amber' END AS status FROM n, t",
        "gate_judges": with_(ENTRY) + ", a AS (SELECT DISTINCT ON (answer_id) * FROM judge_answers), n AS (SELECT judge AS scope, count(a.entry_id) - count(DISTINCT a.entry_id) AS repeated, count(*) FILTER (e.entry_id IS NULL) AS unknown_entries, count(*) FILTER (verdict IS NULL) AS failed FROM a LEFT JOIN e ON a.entry_id = e.entry_id GROUP BY judge) " + check("n", "repeated", "red", "max", 0) + " UNION ALL " + check("n", "unknown_entries", "red", "max", 0) + " UNION ALL " + check("n", "failed", "amber", "max", 2),
        "gate_runs": "WITH j AS (SELECT rec_id, CASE WHEN json_valid(doc) THEN doc END AS doc FROM run_records WHERE ltrim(doc) LIKE '{%'), n AS (SELECT DISTINCT rec_id::varchar AS scope, doc ->> '$.run_meta.model' AS model, try_cast(doc ->> '$.run_meta.tokens.stage2.calls' AS bigint) AS calls, try_cast(doc ->> '$.run_meta.triage_failed.count' AS bigint) AS triage_failed FROM j WHERE doc ->> '$.run_meta.model' IS NOT NULL) " + check("n", "calls", "red", "min", 1) + " UNION ALL " + check("n", "triage_failed", "amber", "max", 0),
        "coverage_matrix": with_(SEG, PAGE, STORY, MIRROR) + ", u AS (SELECT ref FROM page UNION SELECT ref FROM story WHERE ref IS NOT NULL UNION SELECT ref FROM mirror WHERE ref IS NOT NULL UNION SELECT page_ref FROM boundary_notes WHERE page_ref IS NOT NULL) SELECT ref IN (SELECT ref FROM page) AS \"text\", ref IN (SELECT ref FROM story WHERE ref IS NOT NULL) AS main, ref IN (SELECT ref FROM mirror WHERE ref IS NOT NULL) AS mirror, ref IN (SELECT page_ref FROM boundary_notes WHERE page_ref IS NOT NULL) AS notes, count(*) AS pages FROM u GROUP BY ALL",
    }
