"""Queries of sentence and clause boundaries, markers, names, chains of segments and clause roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import chains
from spanloom.plans import base
from spanloom.plans.base import PAGE, SEG, with_
from spanloom.runtime import read

#: Hebrew markers as they stand in these texts: at a word's start, and as words.
INTRODUCERS, TRAILERS = ["הו", "בי", "לא"], ["לו", "ול", "הו", "אל"]
FORMULAE, FORMULA_VERBS = ["He answered", "Once", "They sent", "Compare"], ["said"]
#: Markers by category, and what each category adds to a segment's likelihood of telling a story.
CATEGORIES = {"story": ["Once ", "came to", "They sent"], "dialogue": [" said", "asked"], "temporal": ["after ", "that same", "For "], "outcome": ["came back", "wept", "died"], "legal": ["permitted", "forbidden", "liable"], "hypothetical": ["may one", "if two"]}
HEBREW_CATEGORIES = {"story": ["הו", "מע"], "dialogue": ["אמ"], "temporal": ["למ"], "outcome": ["נח"], "legal": ["תנ"]}
DISQUALIFIERS = {"law": (["תנ"], ["liable", "exempt", "permitted"]), "question": ([], ["may one", "why did", "?"]), "list": (["אל"], ["first", "second"])}
ACTORS, SIGNALS, GENERIC = ["mar", "elder"], ["rabbi", "rav", "r."], ["people", "wife", "household", "brother"]


def _seg(spark: SparkSession, d: str) -> DataFrame:
    return base.segments(spark, d).select("ref", F.col("seg_idx").alias("seg"), F.coalesce("english", F.lit("")).alias("english"), F.coalesce("hebrew", F.lit("")).alias("hebrew"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _seg(spark, d).select("ref", "seg", F.posexplode(text.sentences(F.col("english"))).alias("n", "sentence"))


def word_edges(spark: SparkSession, d: str) -> DataFrame:
    """Whether a cut in the middle of each text falls between words, and which Hebrew neighbours are letters."""
    half = F.floor(F.length("english") / 2).cast("int")
    mid = F.floor(F.length("hebrew") / 2).cast("int")
    return _seg(spark, d).select("ref", "seg", text.at_word_edge(F.col("english"), half).alias("edge"), text.letter_before(F.col("hebrew"), mid).alias("letter_before"), text.letter_after(F.col("hebrew"), mid).alias("letter_after"))


def marker_places(spark: SparkSession, d: str) -> DataFrame:
    """First introducer at a word's start, last trailing marker as a word, and whether the text begins with one."""
    bare = text.strip_marks(F.col("hebrew"))
    return _seg(spark, d).select("ref", "seg", text.first_marker(bare, INTRODUCERS).alias("first_at"), text.last_marker(bare, TRAILERS).alias("last_at"), text.begins_with(F.col("hebrew"), INTRODUCERS).alias("begins"), text.contains_any(bare, INTRODUCERS).alias("holds"))


def offset_map(spark: SparkSession, d: str) -> DataFrame:
    """Of each Hebrew text without points: its length, and where its last character stands in the original."""
    kept = text.kept_offsets(F.col("hebrew"), "[\\u0591-\\u05C7]")
    return _seg(spark, d).where("hebrew <> ''").select("ref", "seg", F.size(kept).alias("n"), F.element_at(kept, -1).alias("last_at"))


def formula_extension(spark: SparkSession, d: str) -> DataFrame:
    """Where a story that starts on a segment's second clause starts when a formula before it is taken in."""
    c = text.clauses(F.col("english"))
    df = _seg(spark, d).select("ref", "seg", c.alias("c")).where("size(c) > 1")
    return df.select("ref", "seg", F.when(text.opening_formula(F.get("c", F.lit(0)), FORMULAE, FORMULA_VERBS), 0).otherwise(1).alias("start_clause"))


def actor_scope(spark: SparkSession, d: str) -> DataFrame:
    """Titled names of each segment, and whether all its actors are of one kind."""
    named = F.array_join(text.person_names(F.col("english")), ", ")
    df = _seg(spark, d).select("ref", "seg", named.alias("names")).where("names <> ''")
    return df.select("ref", "seg", "names", text.only_named(F.col("names"), ACTORS, SIGNALS, GENERIC).alias("only"), text.names_token(F.col("names"), "rav").alias("rav"))


def accent_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("length(text) > 0").select("doc_id", F.length(text.accent_fold(F.col("text"))).alias("n"))


def _banded(spark: SparkSession, d: str) -> DataFrame:
    e, h = text.marker_categories(F.col("english"), CATEGORIES), text.marker_categories(text.strip_marks(F.col("hebrew")), HEBREW_CATEGORIES)
    df = _seg(spark, d).withColumns({"e": e, "h": h})
    some = lambda c: F.size(c) > 0
    weights = [(some("h.story"), 40), (some("e.story"), 30), (some("h.dialogue"), 3), (some("h.temporal"), 10), (some("h.outcome"), 15), (some("h.legal") | some("e.legal"), -30), (some("e.hypothetical"), -25)]
    score = sum((F.when(test, n).otherwise(0) for test, n in weights), F.lit(0))
    return df.withColumn("score", score).withColumn("band", F.when(F.col("score") >= 30, "HIGH").when(F.col("score") >= 10, "MEDIUM").otherwise("LOW"))


def marker_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Markers by category in both languages, the additive score of seven terms and its band."""
    return _banded(spark, d).select("ref", "seg", "score", "band", F.array_join("e.story", "|").alias("e_story"), F.array_join("h.story", "|").alias("h_story"), F.array_join("e.legal", "|").alias("e_legal"))


def disqualified(spark: SparkSession, d: str) -> DataFrame:
    hits = text.disqualifiers(text.strip_marks(F.col("hebrew")), F.col("english"), DISQUALIFIERS)
    return _seg(spark, d).select("ref", "seg", F.explode(hits).alias("h")).select("ref", "seg", "h.type", "h.marker", "h.language")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    df = _banded(spark, d).select("ref", "seg", "band", text.person_names(F.col("english")).alias("names"), F.col("english").rlike("Compare|§").alias("fresh"), F.col("english").rlike("^(He|She|They|His|Her) ").alias("pronoun"), F.col("english").rlike("^(After|When|So|In the end) ?").alias("flow"))
    return chains.continuations(df)


def continuation_chain(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).where("continues").select("ref", "seg", (F.col("seg") - 1).alias("goes_on_from"))


def chain_groups(spark: SparkSession, d: str) -> DataFrame:
    return chains.story_groups(_linked(spark, d))


def page_hints(spark: SparkSession, d: str) -> DataFrame:
    ends = _seg(spark, d).groupBy("ref").agg(F.min_by("english", "seg").alias("a"), F.max_by("english", "seg").alias("z"))
    starts_mid, ends_mid = chains.page_hints(F.col("a"), F.col("z"))
    return ends.select("ref", starts_mid.alias("starts_mid"), ends_mid.alias("ends_mid"))


def _roles(spark: SparkSession, d: str) -> DataFrame:
    """Clauses with their roles: told and spoken ones are inside the story, discussion and questions are outside."""
    df = _seg(spark, d).select("ref", "seg", F.posexplode(text.clauses(F.col("english"))).alias("clause", "t"))
    speech = F.lower("t").rlike("said|asked|answered")
    outside = F.lower("t").rlike("taught|compare|why|permitted|liable")
    return df.select("ref", "seg", "clause", (~outside).alias("inside"), speech.alias("speech"), F.col("t").endswith("?").alias("unclear"))


def clause_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return chains.boundary_from_roles(_roles(spark, d), ["ref", "seg"])


def clause_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return chains.boundary_from_roles(_roles(spark, d), ["ref", "seg"], longest=True)


def speech_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per page: clauses inside the story, spoken ones among them, their share (null without any), and whether all are."""
    n = _roles(spark, d).groupBy("ref").agg(F.count_if("inside").alias("inside"), F.count_if(F.col("inside") & F.col("speech")).alias("spoken"))
    return n.select("ref", "inside", "spoken", F.when(F.col("inside") > 0, F.round(F.col("spoken") / F.col("inside"), 3)).alias("ratio"), F.when(F.col("inside") > 0, F.col("inside") == F.col("spoken")).alias("all_speech"))


def span_cut_audit(spark: SparkSession, d: str) -> DataFrame:
    """Cuts in the middle of texts: how many fall inside a word, per corpus."""
    corpus = base.segments(spark, d).select("ref", F.col("seg_idx").alias("seg"), "corpus")
    return word_edges(spark, d).join(corpus, ["ref", "seg"]).groupBy("corpus").agg(F.count("*").alias("cuts"), F.count_if(~F.col("edge")).alias("mid_word"))


def exposure_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Per story: characters of either language within the budget, how many texts are cut, and their ratio."""
    from spanloom.operators import spans

    s = spans.cells(base.stories(spark, d).where("lo <= hi and ref is not null").select("id", "ref", "lo", "hi")).join(_seg(spark, d), ["ref", "seg"])
    n = s.groupBy("id").agg(F.sum(F.least(F.length("english"), F.lit(300))).alias("e"), F.sum(F.least(F.length("hebrew"), F.lit(200))).alias("h"), F.count_if((F.length("english") > 300) | (F.length("hebrew") > 200)).alias("cut"))
    return n.select("id", "e", "h", "cut", F.when(F.col("h") > 0, F.round(F.col("e") / F.col("h"), 3)).alias("ratio"))


def queries() -> dict:
    fs = [sentence_split, word_edges, marker_places, offset_map, formula_extension, actor_scope, accent_keys, marker_likelihood, disqualified, continuation_chain, chain_groups, page_hints, clause_boundaries, clause_longest_run, speech_profile, span_cut_audit, exposure_ratio]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    s = "s AS (SELECT ref, seg_idx AS seg, corpus, coalesce(english, '') AS english, coalesce(hebrew, '') AS hebrew FROM seg)"
    bare = r"regexp_replace(hebrew, '[\x{0591}-\x{05C7}]', '', 'g')"
    L, N = r"[\x{05D0}-\x{05EA}]", r"[^\x{05D0}-\x{05EA}]"
    collapsed = r"trim(regexp_replace(regexp_replace(english, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), ' ')"
    stop = r"[\s.:?!,\x{05f4}\x{05f3}()\[\]\x{2013}\x{2014}]"
    clauses = r"list_filter(string_split(regexp_replace(english, '([.:?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '')"
    listed = lambda c, words: f"list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains({c}, w))"
    e, h = ({k: listed(c, v) for k, v in cat.items()} for c, cat in (("english", CATEGORIES), (bare, HEBREW_CATEGORIES)))
    some = lambda x: f"len({x}) > 0"
    score = "(" + " + ".join(f"CASE WHEN {t} THEN {n} ELSE 0 END" for t, n in [(some(h["story"]), 40), (some(e["story"]), 30), (some(h["dialogue"]), 3), (some(h["temporal"]), 10), (some(h["outcome"]), 15), (f"{some(h['legal'])} OR {some(e['legal'])}", -30), (some(e["hypothetical"]), -25)]) + ")"
    names = "list_distinct_ordered"
    p1, p2 = r"(?:Rabbi|Rav|Rabban|Mar|Elder)\s+[A-Z][a-z]+(?:\s+(?:bar|ben|son of)\s+[A-Z][a-z]+)?", r"(?:Rabbi|Rav)\s+[A-Z][a-z]+\s+[A-Z][a-z]+"
    every = f"list_concat(regexp_extract_all(english, '{p1}'), regexp_extract_all(english, '{p2}'))"
    names = f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"
    banded = f"b AS (SELECT *, {score} AS score, CASE WHEN {score} >= 30 THEN 'HIGH' WHEN {score} >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM s)"
    linked = f"k0 AS (SELECT ref, seg, band, {names} AS names, regexp_matches(english, 'Compare|§') AS fresh, regexp_matches(english, '^(He|She|They|His|Her) ') AS pronoun, regexp_matches(english, '^(After|When|So|In the end) ?') AS flow FROM b), k1 AS (SELECT *, lag(band) OVER w AS pb, lag(names) OVER w AS pn FROM k0 WINDOW w AS (PARTITION BY ref ORDER BY seg)), k AS (SELECT *, coalesce(pb IN ('HIGH', 'MEDIUM') AND NOT fresh AND (pronoun OR flow AND (coalesce(list_has_any(names, pn), false) OR pb = 'HIGH') OR coalesce(list_has_any(names, pn), false)), false) AS continues FROM k1)"
    rules = []
    for kind, (hw, ew) in DISQUALIFIERS.items():
        for words, c, language in ((hw, bare, "hebrew"), ([w.lower() for w in ew], "lower(english)", "english")):
            if words:
                rules.append(f"SELECT ref, seg, '{kind}' AS type, {listed(c, words)}[1] AS marker, '{language}' AS language FROM s")
    token = lambda c, n: f"regexp_matches({c}, '(^|[^\\p{{L}}\\p{{N}}_]){n.replace('.', chr(92) + '.')}" + ("([^\\p{L}\\p{N}_]|$)" if n[-1].isalnum() else "") + "')"
    any_of = lambda c, words: "(" + " OR ".join(token(c, w) for w in words) + ")"
    generic = "(" + " OR ".join(f"contains(p, '{g}')" for g in GENERIC) + ")"
    roles = f"r AS (SELECT ref, seg, i - 1 AS clause, NOT regexp_matches(lower(t), 'taught|compare|why|permitted|liable') AS inside, regexp_matches(lower(t), 'said|asked|answered') AS speech, suffix(t, '?') AS unclear FROM (SELECT ref, seg, unnest({clauses}) AS t, generate_subscripts({clauses}, 1) AS i FROM s))"
    bounds = lambda best: f"{roles}, n AS (SELECT ref, seg, count(*) AS n FROM r GROUP BY ALL), {best}, u AS (SELECT r.ref, r.seg, bool_or(unclear AND clause IN (first - 1, first, last, last + 1)) AS u FROM r JOIN best USING (ref, seg) GROUP BY ALL)"
    final = "SELECT ref, seg, coalesce(first, 0)::int AS first, coalesce(last, n - 1)::int AS last, coalesce(first, 0) = 0 AND coalesce(last, n - 1) = n - 1 AS kept_full, first IS NULL OR coalesce(u, false) AS needs_review FROM n LEFT JOIN best USING (ref, seg) LEFT JOIN u USING (ref, seg)"
    edge = f"(length(english) // 2 <= 0 OR length(english) // 2 >= length(english) OR regexp_matches(substring(english, length(english) // 2, 1), '{stop}') OR regexp_matches(substring(english, length(english) // 2 + 1, 1), '{stop}'))"
    return {
        "sentence_split": with_(SEG, s) + rf", p AS (SELECT ref, seg, list_filter(string_split(regexp_replace({collapsed}, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS l FROM s) SELECT ref, seg, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS sentence FROM p",
        "word_edges": with_(SEG, s) + f"SELECT ref, seg, {edge} AS edge, length(hebrew) // 2 > 0 AND regexp_matches(substring(hebrew, length(hebrew) // 2, 1), '{L}') AS letter_before, length(hebrew) // 2 < length(hebrew) AND regexp_matches(substring(hebrew, length(hebrew) // 2 + 1, 1), '{L}') AS letter_after FROM s",
        "marker_places": with_(SEG, s) + f", b AS (SELECT ref, seg, {bare} AS b FROM s), p AS (SELECT *, nullif(regexp_extract(b, '(?s)^(.*?{N})(?:{'|'.join(INTRODUCERS)})', 1), '') AS x, nullif(regexp_extract(b, '(?s)^(.*{N})(?:{'|'.join(TRAILERS)})(?:{N}|$)', 1), '') AS y FROM b) SELECT ref, seg, length(x) AS first_at, length(y) AS last_at, regexp_matches(regexp_replace(b, '^[ :,.!?\"\\x{{201c}}\\x{{201d}}\\x{{05f4}}\\x{{05f3}}]+', ''), '^(?:{'|'.join(INTRODUCERS)})') AS begins, " + " OR ".join(f"contains(b, '{w}')" for w in INTRODUCERS) + " AS holds FROM p",
        "offset_map": with_(SEG, s) + rf"SELECT ref, seg, length({bare}) AS n, length(regexp_extract(hebrew, '(?s)^(.*)[^\x{{0591}}-\x{{05C7}}]', 1)) AS last_at FROM s WHERE hebrew <> ''",
        "formula_extension": with_(SEG, s) + rf", c AS (SELECT ref, seg, {clauses} AS c FROM s), w AS (SELECT *, trim(c[1], ' ') AS t, len(string_split(trim(regexp_replace(c[1], '\s+', ' ', 'g'), ' '), ' ')) AS n FROM c WHERE len(c) > 1) SELECT ref, seg, CASE WHEN t <> '' AND n <= 8 AND (" + " OR ".join(f"starts_with(t, '{f}')" for f in FORMULAE) + " OR n <= 4 AND contains(t, 'said')) THEN 0 ELSE 1 END AS start_clause FROM w",
        "actor_scope": with_(SEG, s) + f", n AS (SELECT ref, seg, array_to_string({names}, ', ') AS names FROM s) SELECT ref, seg, names, NOT {any_of('lower(names)', SIGNALS)} AND {any_of('lower(names)', ACTORS)} AND len(list_filter(string_split_regex(lower(names), '[,;]| and '), lambda q: trim(q, ' ') <> '' AND NOT ({any_of('trim(q)', ACTORS)} OR {generic.replace('(p,', '(q,')}))) = 0 AS \"only\", {token('lower(names)', 'rav')} AS rav FROM n WHERE names <> ''",
        "accent_keys": "SELECT doc_id, length(regexp_replace(lower(strip_accents(text)), '[^a-z ]', '', 'g')) AS n FROM documents WHERE length(text) > 0",
        "marker_likelihood": with_(SEG, s, banded) + f"SELECT ref, seg, score, band, array_to_string({e['story']}, '|') AS e_story, array_to_string({h['story']}, '|') AS h_story, array_to_string({e['legal']}, '|') AS e_legal FROM b",
        "disqualified": with_(SEG, s) + "SELECT * FROM (" + " UNION ALL ".join(rules) + ") WHERE marker IS NOT NULL",
        "continuation_chain": with_(SEG, s, banded, linked) + "SELECT ref, seg, seg - 1 AS goes_on_from FROM k WHERE continues",
        "chain_groups": with_(SEG, s, banded, linked) + ", g AS (SELECT *, sum(CASE WHEN band IN ('HIGH', 'MEDIUM') AND NOT continues THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY seg) AS grp FROM k) SELECT ref, min(seg) AS lo, max(seg) AS hi, count(*) AS n FROM g WHERE band IN ('HIGH', 'MEDIUM') OR continues GROUP BY ref, grp",
        "page_hints": with_(SEG, s) + ", p AS (SELECT ref, arg_min(english, seg) AS a, arg_max(english, seg) AS z FROM s GROUP BY ref) SELECT ref, regexp_matches(a, '^(And|He|She|They) |^\\p{Ll}') AS starts_mid, regexp_matches(rtrim(z, ' '), '[,:]$') OR contains(lower(right(z, 30)), 'and then') AS ends_mid FROM p",
        "clause_boundaries": with_(SEG, s) + ", " + bounds("best AS (SELECT ref, seg, min(clause) AS first, max(clause) AS last FROM r WHERE inside GROUP BY ALL)") + final,
        "clause_longest_run": with_(SEG, s) + ", " + bounds("runs AS (SELECT ref, seg, min(clause) AS first, max(clause) AS last FROM (SELECT *, clause - row_number() OVER (PARTITION BY ref, seg ORDER BY clause) AS run FROM r WHERE inside) GROUP BY ref, seg, run), best AS (SELECT ref, seg, first, last FROM (SELECT *, row_number() OVER (PARTITION BY ref, seg ORDER BY last - first DESC, first) AS q FROM runs) WHERE q = 1)") + final,
        "speech_profile": with_(SEG, s) + f", {roles}, n AS (SELECT ref, count(*) FILTER (inside) AS inside, count(*) FILTER (inside AND speech) AS spoken FROM r GROUP BY ref) SELECT ref, inside, spoken, CASE WHEN inside > 0 THEN round(spoken / inside, 3) END AS ratio, CASE WHEN inside > 0 THEN inside = spoken END AS all_speech FROM n",
        "span_cut_audit": with_(SEG, s) + f"SELECT corpus, count(*) AS cuts, count(*) FILTER (NOT {edge}) AS mid_word FROM s GROUP BY corpus",
        "exposure_ratio": with_(SEG, s, base.STORY, base.GOOD) + ", n AS (SELECT id, sum(least(length(english), 300))::bigint AS e, sum(least(length(hebrew), 200))::bigint AS h, count(*) FILTER (length(english) > 300 OR length(hebrew) > 200) AS cut FROM (SELECT id, ref, unnest(range(lo, hi + 1))::int AS seg FROM good) JOIN s USING (ref, seg) GROUP BY id) SELECT id, e, h, cut, CASE WHEN h > 0 THEN round(e / h, 3) END AS ratio FROM n",
    }
