"""Column functions on texts, keys and small documents. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the values of Hebrew letters as numerals.
NUMERALS = dict(zip("אבגדהוזחטיכלמנסעפצקרשת", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200, 300, 400])) | dict(zip("ךםןףץ", [20, 40, 50, 80, 90]))
#: Fixed value: clauses end after one of these marks and white space.
CLAUSE_END = r"(?<=[.:?!])\s+"


def strip_html(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]+>", by)


def strip_marks(c: Column) -> Column:
    """Without Hebrew points and accents."""
    return F.regexp_replace(c, "[\\u0591-\\u05C7]", "")


def letters_only(c: Column) -> Column:
    """Hebrew letters and single blanks: tags and everything else become blanks, points vanish."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_marks(strip_html(c, " ")), "[^\\u05D0-\\u05EA]", " "), " +", " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_key(c: Column, n: int = 150) -> Column:
    """The key under which texts count as repeated: the first ``n`` characters of the collapsed text, in lower case."""
    return F.lower(F.trim(F.substring(collapse(c), 1, n)))


def truncate(c: Column, budget: int) -> Column:
    return F.when(F.length(c) > budget, F.concat(F.substring(c, 1, budget), F.lit("..."))).otherwise(c)


def clauses(c: Column) -> Column:
    """Clauses with their marks; blank ones are dropped."""
    return F.filter(F.split(c, CLAUSE_END), lambda x: F.trim(x) != "")


def clause_ranges(c: Column) -> Column:
    """``array<struct<start, end>>`` (code points, end exclusive) of the clauses over the original text."""
    parts = F.split(c, CLAUSE_END)
    seen = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.length(F.array_join(F.slice(parts, 1, i), "")))
    gaps = F.transform(F.regexp_extract_all(c, F.lit(r"[.:?!](\s+)"), 1), F.length)
    at = lambda i: F.aggregate(F.slice(gaps, 1, i), F.lit(0), lambda a, g: a + g)
    ranges = F.transform(seen, lambda end, i: F.struct((F.when(i > 0, F.get(seen, i - 1)).otherwise(0) + at(i)).alias("start"), (end + at(i)).alias("end")))
    return F.filter(ranges, lambda r: F.trim(F.substring(c, r["start"] + 1, r["end"] - r["start"])) != "")


def word_count(c: Column) -> Column:
    """White-space tokens of the text without tags."""
    bare = collapse(strip_html(c))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def reading_minutes(c: Column, words_per_minute: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(word_count(c) / words_per_minute)).cast("int")


def contains_any(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def terms_present(c: Column, words: list[str]) -> Column:
    """The sorted distinct ``words`` that the text contains, whatever its case."""
    return F.array_sort(F.filter(F.array(*(F.lit(w) for w in sorted(set(words)))), lambda w: F.contains(F.lower(c), w)))


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first (name, pattern) whose pattern the text holds."""
    out = None
    for name, pattern in rules:
        test = F.lower(c).rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def whole_word(c: Column, word: str) -> Column:
    """Whether ``word`` stands in the text, not inside another word, whatever its case."""
    return F.lower(c).rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){word.lower()}(?:[^\p{{L}}\p{{N}}_]|$)")


def numeral(c: Column) -> Column:
    """The number that Hebrew letters write: the sum of their values."""
    values = F.create_map(*(F.lit(x) for kv in NUMERALS.items() for x in kv))
    return F.aggregate(F.filter(F.transform(F.split(c, ""), lambda x: values[x]), F.isnotnull), F.lit(0), lambda a, v: a + v)


def page_order(ref: Column) -> Column:
    """Pages by number, side a before b."""
    return F.regexp_extract(ref, r"(\d+)[ab]$", 1).try_cast("int") * 2 + F.when(ref.endswith("b"), 1).otherwise(0)


def parse_span_key(key: Column) -> Column:
    """``struct<ref, start, end>`` of a key such as "Name 12b_3-7"; nulls where it isn't one."""
    part = lambda i: F.nullif(F.regexp_extract(key, r"^(.*)_(\d+)-(\d+)$", i), F.lit(""))
    return F.struct(part(1).alias("ref"), part(2).try_cast("int").alias("start"), part(3).try_cast("int").alias("end"))


def lenient_json(c: Column) -> Column:
    """The outermost object in a model's answer, without code fences and trailing commas."""
    return F.regexp_replace(F.regexp_extract(c, r"(?s)\{.*\}", 0), r",\s*([}\]])", "$1")


def fingerprint(*cols: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *cols), 256), 1, 16)


def wilson(hits: Column, n: Column, upper: bool, z: float = 1.96) -> Column:
    """The Wilson bound of a share, rounded to three places; null for no trials."""
    p, sign = hits / n, 1 if upper else -1
    return F.when(n > 0, F.round((p + z * z / (2 * n) + sign * z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 3))


def accent_fold(c: Column) -> Column:
    """Lower-case Latin letters without accents; everything but letters a-z and blanks goes."""
    import unicodedata

    marked = {chr(i): unicodedata.normalize("NFD", chr(i))[0] for i in range(0xC0, 0x250) if unicodedata.decomposition(chr(i)) and not unicodedata.decomposition(chr(i)).startswith("<")}
    return F.regexp_replace(F.lower(F.translate(c, "".join(marked), "".join(marked.values()))), "[^a-z ]", "")


def kept_offsets(c: Column, dropped: str) -> Column:
    """Places (from 0) in the original of the characters that are left when those matching ``dropped`` are gone."""
    chars = F.split(c, "")
    return F.filter(F.transform(chars, lambda x, i: F.when((x != "") & ~x.rlike(dropped), i)), F.isnotnull)


# --- boundaries, markers and names ------------------------------------------------------------------------------------


def sentences(c: Column) -> Column:
    """Sentences of the text without tags and with single blanks; blank ones are dropped."""
    return F.filter(F.split(collapse(strip_html(c)), r"(?<=[.?!])\s+"), lambda x: F.trim(x) != "")


def at_word_edge(c: Column, pos: Column) -> Column:
    """Whether a cut before character ``pos`` (from 0) falls between words: a blank or a stop on either side, or an end of the text."""
    stop = r"[\s.:?!,״׳()\[\]–—]"
    here = lambda p: F.substring(c, p, F.lit(1)).rlike(stop)
    return (pos <= 0) | (pos >= F.length(c)) | here(pos) | here(pos + 1)


LETTER = "[\\u05D0-\\u05EA]"


def letter_before(c: Column, pos: Column) -> Column:
    """Whether a Hebrew letter stands before character ``pos`` (from 0)."""
    return (pos > 0) & F.substring(c, pos, F.lit(1)).rlike(LETTER)


def letter_after(c: Column, pos: Column) -> Column:
    return (pos < F.length(c)) & F.substring(c, pos + 1, F.lit(1)).rlike(LETTER)


def _any_of(words: list[str]) -> str:
    import re

    return "|".join(re.escape(w) for w in words)


def first_marker(c: Column, markers: list[str]) -> Column:
    """Where (from 0) the first marker stands that begins a word but not the text; null if none."""
    at = F.regexp_instr(c, F.lit(f"(?<=[^\\u05D0-\\u05EA])(?:{_any_of(markers)})"))
    return F.when(at > 0, at - 1)


def last_marker(c: Column, markers: list[str], after: int = 0) -> Column:
    """Where (from 0) the last marker stands that is a word of its own beyond character ``after``; null if none."""
    before = F.regexp_extract(c, f"(?s)^(.*[^\\u05D0-\\u05EA])(?:{_any_of(markers)})(?![\\u05D0-\\u05EA])", 1)
    return F.when(F.length(before) > after, F.length(before))


def begins_with(c: Column, markers: list[str]) -> Column:
    """Whether the text, without points and leading stops, begins with a marker."""
    return F.regexp_replace(strip_marks(c), "^[ :,.!?\"\\u201c\\u201d\\u05f4\\u05f3]+", "").rlike(f"^(?:{_any_of(markers)})")


def opening_formula(c: Column, formulae: list[str], verbs: list[str]) -> Column:
    """A clause of eight words at most that begins with a formula, or of four at most that holds one of the verbs."""
    bare = F.trim(strip_marks(c))
    n = F.size(F.split(collapse(bare), " "))
    starts = reduce(lambda a, b: a | b, (bare.startswith(f) for f in formulae))
    holds = reduce(lambda a, b: a | b, (F.contains(bare, F.lit(v)) for v in verbs)) if verbs else F.lit(False)
    return (bare != "") & (n <= 8) & (starts | ((n <= 4) & holds))


def names_token(c: Column, name: str) -> Column:
    """Whether ``name`` stands in the text as a word, whatever its case; after a final stop another letter may follow."""
    import re

    name = name.strip().lower()
    return F.lower(c).rlike(r"(?<![\p{L}\p{N}_])" + re.escape(name) + (r"(?![\p{L}\p{N}_])" if name[-1].isalnum() else ""))


def only_named(c: Column, names: list[str], signals: list[str], generic: list[str]) -> Column:
    """Whether a list of actors names only people of ``names``: no signal, one name at least, every part a name or generic."""
    any_of = lambda x, words: reduce(lambda a, b: a | b, (names_token(x, w) for w in words))
    parts = F.filter(F.transform(F.split(F.lower(c), r"[,;]| and "), lambda p: F.trim(p)), lambda p: p != "")
    fits = lambda p: any_of(p, names) | reduce(lambda a, b: a | b, (F.contains(p, F.lit(g)) for g in generic))
    return F.coalesce(~any_of(c, signals) & any_of(c, names) & F.forall(parts, fits), F.lit(False))


def person_names(c: Column) -> Column:
    """Titled names in order of their patterns, each once."""
    patterns = [r"(?:Rabbi|Rav|Rabban|Mar|Elder)\s+[A-Z][a-z]+(?:\s+(?:bar|ben|son of)\s+[A-Z][a-z]+)?", r"(?:Rabbi|Rav)\s+[A-Z][a-z]+\s+[A-Z][a-z]+"]
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), 0) for p in patterns))))


def marker_categories(c: Column, categories: dict[str, list[str]]) -> Column:
    """For each category the markers that the text holds, as a struct of arrays."""
    return F.struct(*(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)).alias(k) for k, words in categories.items()))


def disqualifiers(hebrew: Column, english: Column, rules: dict[str, tuple[list[str], list[str]]]) -> Column:
    """For each rule its first Hebrew and its first English marker that is there, as ``array<struct<type, marker, language>>``."""
    def first(c: Column, words: list[str], kind: str, language: str) -> Column:
        hit = F.get(F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(c, w)), F.lit(0))
        return F.when(hit.isNotNull(), F.struct(F.lit(kind).alias("type"), hit.alias("marker"), F.lit(language).alias("language")))

    return F.array_compact(F.array(*(x for k, (h, e) in rules.items() for x in (first(hebrew, h, k, "hebrew"), first(F.lower(english), [w.lower() for w in e], k, "english")))))


def answer_list(c: Column) -> Column:
    """The objects of a model's answer, as JSON texts: of a list, of ``{"stories": [...]}``, or of that in a list; empty if it is none."""
    v = F.try_parse_json(lenient_answer(c))
    of = lambda x: F.try_variant_get(x, "$", "array<variant>")
    wrapped = F.try_variant_get(v, "$.stories", "array<variant>")
    inner = F.try_variant_get(v, "$[0].stories", "array<variant>")
    found = F.when((F.size(of(v)) == 1) & inner.isNotNull(), inner).when(of(v).isNotNull(), of(v)).otherwise(wrapped)
    return F.coalesce(F.transform(found, lambda x: F.to_json(x)), F.array().cast("array<string>"))


def lenient_answer(c: Column) -> Column:
    """The outermost object or list in a model's answer, without code fences and trailing commas."""
    return F.regexp_replace(F.regexp_extract(c, r"(?s)[\[{].*[\]}]", 0), r",\s*([}\]])", "$1")


def numbered_lines(items: Column) -> Column:
    """Items as lines ``[0] first``, ``[1] second``, as prompts show them."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x)), "\n")


def pick_summary(*fields: Column, events: Column, limit: int = 400) -> Column:
    """The first field that isn't empty, else the events joined, else a constant; cut to ``limit``."""
    own = F.coalesce(*(F.nullif(f, F.lit("")) for f in fields), F.nullif(F.array_join(events, "; "), F.lit("")), F.lit("(no summary available)"))
    return F.substring(own, 1, limit)


def needs_validation(classification: Column, weakeners: Column, events: Column) -> Column:
    """Whether a call should be looked at again: a sure one with a weakener of law or speech, two weakeners or one event at most; a
    doubtful one with one event at most or such a weakener; never one that is called none."""
    legal = F.exists(weakeners, lambda w: F.lower(w).rlike("legal|embedded|speech|verbal"))
    spoken = F.exists(weakeners, lambda w: F.lower(w).rlike("legal|speech|verbal"))
    few = F.coalesce(events, F.lit(0)) <= 1
    n = F.coalesce(F.size(weakeners), F.lit(0))
    return F.when(classification.isin("YES", "HIGH_CONFIDENCE"), F.coalesce(legal, F.lit(False)) | (n >= 2) | few).when(classification == "LOW_CONFIDENCE", few | F.coalesce(spoken, F.lit(False))).otherwise(False)
