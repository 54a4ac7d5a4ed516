"""Pages of repeated keywords or bare lists instead of sentences (problem 10).

Each page's words, by script, make a rank-frequency curve: SQL windows rank them by frequency, and a line is fitted to the
logarithms. Stuffed pages stand out by the residual of the curve's head over the usual curve of the same script at
comparable lengths, or by an extreme slope, steep as few words repeated are or flat as many repeated alike, if prose words
are few as well (honest talk that keeps coming back to one thing can be as steep); lists stand out by their divergence from
prose of the same script at comparable lengths: too few of the words that prose can't do without or, where a language has no
such words, too many separators.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import materialize

#: A word belongs to a script's prose if so large a part of the script's pages has it.
PROSE_PAGES = 0.25
#: Scripts whose pages usually have less than this share of such words count as having none: their lists are known by separators.
PROSE_USUAL = 0.15
#: Part of the usual share of prose words below which a page diverges: half prose, half list comes to a half.
PROSE_LEAST = 0.48
#: The same for pages that are cut up by separators as well.
PROSE_LEAST_CUT_UP = 0.65
#: Separators per word from which on a page diverges, for scripts without prose words; and separators that chance may add.
SEPARATORS, CHANCE_SEPARATORS = 0.27, 1.5
#: Share of the first three ranks of other words from which on a page is stuffed, if that head also lies so far, in natural
#: logarithms, above the usual curve of its length; and the words below which such a share may be chance.
HEAD, HEAD_RESIDUAL, HEAD_WORDS = 0.36, 1.0, 20
#: How far, either way, a page's slope must lie from the usual one of its length to be extreme; it flags where prose words are few too.
SLOPE = 0.4
#: Different pages that a length needs for a usual curve of its own.
POOL = 30
#: Words that a script's part of a page needs to be judged, and that a page needs in all; words that a link stands for.
LEAST_PART, LEAST_PAGE, LINK_WORDS = 8, 12, 3

#: The sign that stands for a link.
LINK = "␟"
LINKS = re.compile(r"<a\s[^>]*>|\]\([^)\s]*\)|\b(?:https?://|www\.)[^\s<>\")]+|(?<![^\s(])//[^\s<>\")]+|(?<![^\s(])[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}/[^\s<>\")]*", re.IGNORECASE)
MARKUP = re.compile(r"<[^<>]*>|&#?\w+;")
#: A word with its marks and what follows it up to the next, or a link.
TOKEN = re.compile(r"([^\W\d_][\w\u0300-\u036f\u0591-\u05c7\u064b-\u065f]*(?:[״׳'’\"\-][^\W\d_][\w\u0300-\u036f\u0591-\u05c7\u064b-\u065f]*)*)([^\w␟]*)|␟")
MARKS = re.compile("[\u0300-\u036f\u0591-\u05c7\u064b-\u065f]+")
PLAIN_WORD = re.compile(r"[a-z][a-z0-9_]*(?:['\"\-][a-z][a-z0-9_]*)*")
PLAIN_START, LINE_END = re.compile(r"[^a-z]*"), re.compile(r"[^a-z0-9_]*\n[^a-z0-9_]*")
SEPARATOR = re.compile(r"(?<![^\s\x00])-(?![^\s\x00])|[^\w\s.?!;\"'״׳’:()\[\]\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u200b-\u200f\u2060\ufeff\u00ad\x00\-]|;(?=\s|\x00|$)")
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x591, 0x5FF), ("arabic", 0x600, 0x6FF), ("hebrew", 0x2135, 0x2138), ("han", 0x4E00, 0x9FFF), ("hebrew", 0xFB1D, 0xFB4F), ("latin", 0xFF21, 0xFF5A))


def script_of(word: str) -> str:
    c = ord(word[0])
    return next((name for name, lo, hi in SCRIPTS if lo <= c <= hi), "other")


def _separators(tails: list[str]) -> int:
    """Separators in what follows words; a line that ends without a stop counts as one."""
    n = len(SEPARATOR.findall("\x00".join(tails)))
    return n + sum("\n" in t and not ("." in t or "?" in t or "!" in t) for t in tails)


def page_words(text: str, with_separators: bool = True) -> tuple[dict[str, list[str]], dict[str, int]]:
    """Of a page, by script: its words in lower case, and how many separators follow them.

    A link counts as a word of the script 'link', and as a separator of the word before it; so does a line that ends without a
    stop. Markup isn't text.
    """
    text = text.lower()
    if "/" in text or "<" in text or "&" in text:
        text = MARKUP.sub(" ", LINKS.sub(f" {LINK} ", text))
    if not text.isascii():  # accents and points don't make another word
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    if text.isascii():  # of one script and without links: words and tails need no sorting
        found = PLAIN_WORD.findall(text)
        if not found or not with_separators:
            return ({"latin": found} if found else {}), {}
        start = PLAIN_START.search(text).end()
        n = len(SEPARATOR.findall(text, start))
        if "\n" in text:
            n += sum(not ("." in t or "?" in t or "!" in t) for t in LINE_END.findall(text, start))
        return {"latin": found}, {"latin": n}
    words: dict[str, list[str]] = {}
    tails: dict[str, list[str]] = {}
    script, known = "", {}
    for word, tail in TOKEN.findall(text):
        if not word:
            words.setdefault("link", []).append(LINK)
            if script:
                tails[script].append(LINK)
            continue
        script = known.get(word) or known.setdefault(word, script_of(word))
        if script in words:
            words[script].append(word)
        else:
            words[script] = [word]
            tails[script] = []
        if tail and tail != " ":
            tails[script].append(tail)
    return words, {s: _separators(t) for s, t in tails.items()} if with_separators else {}


def _blank(text: str | None) -> bool:
    return text is None or not text.strip()


def _count_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: on how many pages each word of each script is; the word '' stands for the pages of the script."""
    counts: dict[str, Counter[str]] = {}

    def flush() -> pa.RecordBatch:
        triples = [(s, w, n) for s, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([t[i] for t in triples], type=kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["script", "word", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            if not _blank(text):
                for script, found in page_words(text, False)[0].items():
                    if script not in counts:
                        counts[script] = Counter()
                    counts[script].update({"", *found})
        if sum(map(len, counts.values())) > 500_000:
            yield flush()
    if counts:
        yield flush()


def prose_words(docs: DataFrame, text: str) -> dict[str, set[str]]:
    """The words that at least ``PROSE_PAGES`` of a script's different pages have, so that copies don't count. For each script they
    are at most as many as a page has different words on average, over ``PROSE_PAGES``: hundreds, however large the corpus."""
    counted = docs.select(text).distinct().mapInArrow(_count_pages, "script string, word string, n bigint").groupBy("script", "word").agg(F.sum("n").alias("n"))
    whole = F.max(F.when(F.col("word") == "", F.col("n"))).over(Window.partitionBy("script"))
    common = counted.where(F.col("script") != "link").withColumn("pages", whole).where((F.col("n") >= PROSE_PAGES * F.col("pages")) & (F.col("word") != ""))
    out: dict[str, set[str]] = {}
    for r in common.select("script", "word").collect():
        out.setdefault(r["script"], set()).add(r["word"])
    return out


def _spectra(prose: dict[str, set[str]], key_type: pa.DataType):
    """Each page as its frequency spectrum: how many words of a script (prose words or others) occur how often."""
    names, kinds = ["page", "copy", "script", "is_prose", "f", "m", "s"], [key_type, pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for page, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if page is None or _blank(text):
                    continue
                copy = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)
                words, separators = page_words(text)
                for script, found in words.items():
                    common, left = prose.get(script, ()), separators.get(script, 0)
                    often = Counter(found)
                    usual = Counter([often.pop(w) for w in common if w in often])
                    for is_prose, spectrum in ((True, usual), (False, Counter(often.values()))):
                        for f, m in spectrum.items():
                            out.append((page, copy, script, is_prose, f, m, left))
                            left = 0
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in out], type=kind) for i, kind in enumerate(kinds)], names)

    return run


def page_curves(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per page and script: ``n`` words, ``prose`` share, ``head`` share, ``separators`` per word, ``slope`` and ``residual``.

    Windows rank the words of a page's script by frequency, and its other words apart; ranks with one frequency lie together,
    so that a page takes a handful of rows, which are spread out to single ranks only for the fit.
    """
    kind = docs.schema[key].dataType.simpleString()
    key_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    prose = prose_words(docs, text)
    spectra = docs.select(key, text).mapInArrow(_spectra(prose, key_type), f"page {kind}, copy bigint, script string, is_prose boolean, f int, m int, s int")
    page = ["page", "copy", "script"]
    rows = spectra.repartition("page", "copy").groupBy(*page, "is_prose", "f").agg(F.max("m").alias("m"), F.max("s").alias("s"))  # rows given twice count once
    by_rank = Window.partitionBy(*page).orderBy(F.desc("f"), "is_prose")
    others = Window.partitionBy(*page).orderBy("is_prose", F.desc("f"))
    ranked = rows.withColumn("last", F.sum("m").over(by_rank)).withColumn("last_other", F.sum("m").over(others))
    in_head = F.when(~F.col("is_prose"), F.greatest(F.lit(0), F.least(F.col("m"), 3 - (F.col("last_other") - F.col("m"))))).otherwise(0)
    ranked = ranked.withColumn("h", in_head * F.col("f")).withColumn("x", F.transform(F.sequence(F.col("last") - F.col("m") + 1, "last"), lambda r: F.log(r)))
    ranked = ranked.withColumn("sx", F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).withColumn("sxx", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).withColumn("y", F.log("f"))
    sums = ranked.groupBy(*page).agg(
        F.sum(F.col("f") * F.col("m")).alias("n"),
        F.sum("s").alias("s"),
        F.sum(F.when(F.col("is_prose"), F.col("f") * F.col("m")).otherwise(0)).alias("p"),
        F.sum("h").alias("h"),
        F.sum("m").alias("v"),
        F.sum("sx").alias("sx"),
        F.sum("sxx").alias("sxx"),
        F.sum(F.col("y") * F.col("m")).alias("sy"),
        F.sum(F.col("y") * F.col("sx")).alias("sxy"),
        F.sum(F.col("y") * F.col("y") * F.col("m")).alias("syy"),
    )
    cxx, cxy, cyy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("v"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("v"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("v")
    slope = F.when(F.col("v") > 1, cxy / cxx).otherwise(0.0)
    rough = F.sqrt(F.greatest(F.lit(0.0), cyy - slope * cxy) / F.col("v"))
    return sums.select("page", "copy", "script", "n", (F.col("p") / F.col("n")).alias("prose"), (F.col("h") / F.col("n")).alias("head"), (F.col("s") / F.col("n")).alias("separators"), (-slope).alias("slope"), rough.alias("residual"))


def usual_curves(curves: DataFrame) -> DataFrame:
    """Medians per script and length (in powers of two) of different pages: the usual curve; one small row each.

    A length with fewer than ``POOL`` different pages takes in those of the lengths around it, as far as it must. Then each
    median gives way to the median of its neighbours' and its own, at the ends to that of its own, the next and the line through
    the next two: what falls or rises steadily stays as it is, and one length that is mostly junk can't set the norm.
    """
    long = curves.where(F.col("n") >= LEAST_PART).withColumn("length", length_class(F.col("n"))).drop("page").dropDuplicates(["script", "copy"])
    sizes = long.groupBy("script", "length").agg(F.count("*").alias("k"))
    around = sizes.alias("a").join(sizes.alias("b"), "script").select("script", F.col("a.length").alias("of"), F.col("b.length").alias("length"), F.col("b.k").alias("k"), F.abs(F.col("a.length") - F.col("b.length")).alias("far"))
    nearer = Window.partitionBy("script", "of").orderBy("far").rangeBetween(Window.unboundedPreceding, -1)
    pools = around.withColumn("held", F.coalesce(F.sum("k").over(nearer), F.lit(0))).where(F.col("held") < POOL).select("script", "of", "length")
    names = ("prose", "head", "slope", "residual")
    medians = long.join(F.broadcast(pools), ["script", "length"]).groupBy("script", F.col("of").alias("length")).agg(*(F.percentile_approx(c, 0.5).alias(f"m_{c}") for c in names))
    by_length = Window.partitionBy("script").orderBy("length")

    def smooth(c: str) -> Column:
        before, own, after = F.lag(c).over(by_length), F.col(c), F.lead(c).over(by_length)
        end = lambda near, far: F.greatest(F.lit(0.0), 3 * near - 2 * far)
        first = F.array(own, after, end(after, F.lead(c, 2).over(by_length)))
        last = F.array(own, before, end(before, F.lag(c, 2).over(by_length)))
        three = F.when(before.isNotNull() & after.isNotNull(), F.array(before, own, after)).when(before.isNull(), first).otherwise(last)
        return F.when(F.exists(three, F.isnull), own).otherwise(F.array_sort(three)[1])

    return medians.select("script", "length", *(smooth(f"m_{c}").alias(f"m_{c}") for c in names))


def length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n)), F.lit(12))


def judge(curves: DataFrame) -> DataFrame:
    """``curves`` with ``why``: null for a part like prose, else 'list' or 'stuffed'; too short a part is judged neither way."""
    usual = usual_curves(curves)
    most = usual.groupBy("script").agg(F.max("m_prose").alias("most_prose"))
    seen = curves.withColumn("length", length_class(F.col("n"))).join(F.broadcast(usual), ["script", "length"], "left").join(F.broadcast(most), "script", "left")
    worded, cut_up = F.col("most_prose") > PROSE_USUAL, F.col("separators") > SEPARATORS + CHANCE_SEPARATORS / F.col("n")
    thin = worded & (F.col("prose") < PROSE_LEAST * F.col("m_prose"))
    listed = cut_up & (~worded | (F.col("prose") < PROSE_LEAST_CUT_UP * F.col("m_prose")))
    residual = F.log(F.col("head")) - F.log(F.greatest("m_head", F.lit(0.001)))
    bend = F.col("slope") - F.col("m_slope")
    extreme = (F.col("n") >= HEAD_WORDS) & F.when(worded, (F.abs(bend) > SLOPE) & (F.col("prose") < PROSE_LEAST_CUT_UP * F.col("m_prose"))).otherwise(bend > SLOPE)
    steep = extreme | (F.col("head") > HEAD) & (F.col("n") >= HEAD_WORDS) & (residual > HEAD_RESIDUAL)
    why = F.when(F.col("n") < LEAST_PART, F.lit(None)).when(steep, "stuffed").when(thin | listed, "list")
    return seen.withColumn("why", F.when(F.col("script") == "link", "list").otherwise(why))


def junk_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(page, junk_words, words)`` of pages that are for the greater part stuffing or lists.

    Null, blank and near-empty texts (under ``LEAST_PAGE`` words in judged parts) are none, nor are pages with a null key. Whole
    texts are judged, copies each for itself; a key with several texts is junk if one of them is, and comes once. An empty table
    gives none.
    """
    parts = judge(materialize(page_curves(docs, key, text)))
    weight = F.when(F.col("script") == "link", F.col("n") * LINK_WORDS).when(F.col("n") >= LEAST_PART, F.col("n")).otherwise(0)
    copies = parts.groupBy("page", "copy").agg(F.sum(F.when(F.col("why").isNotNull(), weight).otherwise(0)).alias("junk_words"), F.sum(weight).alias("words"))
    junk = copies.where((F.col("words") >= LEAST_PAGE) & (F.col("junk_words") > 0.5 * F.col("words")))
    return junk.groupBy("page").agg(F.max("junk_words").alias("junk_words"), F.max("words").alias("words"))
