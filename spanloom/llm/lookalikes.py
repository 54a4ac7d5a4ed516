"""One form for text that looks the same but is stored in different characters (problem 6).

Look-alike pairs of code points and strings are closed transitively by union-find. In each class the member that the corpus
uses most becomes the representative, and every text is rewritten: single characters by a table, longer members greedily,
leftmost and longest first, by an automaton. Invisible characters vanish, blanks become one plain blank, and marks stand in canonical order.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strings that readers can't tell apart though Unicode doesn't decompose them into one another.
LOOK_ALIKES = """
A Α А ꓮ Ꭺ
B Β В ꓐ Ᏼ
C Ϲ С ꓚ Ꮯ
E Ε Е ꓰ Ꭼ
H Η Н ꓧ Ꮋ
I Ι І ꓲ
J Ј ꓙ Ꭻ
K Κ К ꓗ Ꮶ
M Μ М ꓟ Ꮇ
N Ν ꓠ
O Ο О ꓳ Օ
P Ρ Р ꓑ Ꮲ
S Ѕ ꓢ Ꮪ Տ
T Τ Т ꓔ Ꭲ
X Χ Х ꓫ
Y Υ Ү ꓬ
Z Ζ ꓜ Ꮓ
D ꓓ Ꭰ
F ꓝ
G ꓖ Ꮐ Ԍ
L ꓡ Ꮮ
Q Ԛ
R ꓣ Ꮢ
U ꓴ Ս
V ꓦ Ꮩ
W ꓪ Ꮃ Ԝ
a а
c с ϲ
e е
i і
j ј
o ο о օ
p р
s ѕ
x х
y у
v ν
d ԁ
g ɡ ց
h һ
l ӏ
n ո
q ԛ
u ս
w ԝ
- ‐ ‑ ‒ – − ﹘ ⁃ ˗
' ’ ‘ ʼ ʹ ′ ׳ ‛
" ” “ ״ ˮ ″ ׳׳ '' ’’ ‟
וו װ
וי ױ
יי ײ
ֹ ֺ
"""
#: Kinds of compatibility decomposition that keep the look (not superscripts, circles, fractions and the like).
COMPATIBLE_KINDS = ("<font>", "<wide>", "<narrow>", "<compat>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Characters of these kinds that look different all the same: the long s, alone and in ligatures, and Greek symbol variants.
UNLIKE = {0x17F, 0x1E9B, 0xFB05, *range(0x3D0, 0x400)}
#: Invisible beside those of category Cf: combining grapheme joiner, variation selectors, Hangul fillers, Mongolian separators.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10))

#: Where characters of category Cf lie.
FORMAT_BLOCKS = ((0x80, 0x2100), (0xFE00, 0x10000), (0x11000, 0x11100), (0x13430, 0x13440), (0x1BCA0, 0x1BCA4), (0x1D173, 0x1D17B), (0xE0000, 0xE0080))


def _canonical(text: str) -> str:
    return unicodedata.normalize("NFD", text)


def seed_pairs() -> Iterator[tuple[str, str]]:
    """All look-alike pairs: the fixed ones, and every character of Unicode that decomposes into ones of the same look."""
    for line in LOOK_ALIKES.split("\n"):
        first, *others = line.split() or [""]
        for x in others:
            yield first, x
    for c in set(range(sys.maxunicode + 1)) - UNLIKE:
        if (given := unicodedata.decomposition(chr(c))) and given.split(" ")[0] in COMPATIBLE_KINDS:
            plain = unicodedata.normalize("NFKD", chr(c))
            if plain != chr(c) and not plain.startswith(" "):
                yield plain, chr(c)


def classes(pairs: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Look-alike classes: the transitive closure of the pairs, by union-find over strings; two members or more each."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = find(_canonical(a)), find(_canonical(b))
        if a != b:
            parent[max(a, b)] = min(a, b)
    out: dict[str, list[str]] = {}
    for x in parent:
        out.setdefault(find(x), []).append(x)
    return sorted(sorted(v) for v in out.values() if len(v) > 1)


def automaton(patterns: Iterable[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for p in patterns:
        machine.add_word(p, p)
    if len(machine):
        machine.make_automaton()
    return machine


def greedy_matches(machine, text: str) -> Iterator[tuple[int, str]]:
    """Leftmost longest matches that don't overlap, as (start, pattern)."""
    if not len(machine):
        return
    for end, p in machine.iter_long(text):
        yield end - len(p) + 1, p


class Normalizer:
    """Rewrites text to the representatives of its look-alike classes. Idempotent; None stays None."""

    def __init__(self, representatives: dict[str, str]):
        self.to = representatives  # member -> representative, both in canonical order
        self.machine = None

    def __getstate__(self) -> dict:
        return {"to": self.to, "machine": None}

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if self.machine is None:
            # one character for another by a table; what is longer, spelt in what the table makes of it, by the automaton
            self.single = {ord(m): r for m, r in self.to.items() if len(m) == 1}
            self.longer = {w: r for m, r in self.to.items() if len(m) > 1 and (w := m.translate(self.single)) != r}
            self.machine = automaton(self.longer)
            formats = (c for lo, hi in FORMAT_BLOCKS for c in range(lo, hi) if unicodedata.category(chr(c)) == "Cf")
            self.clean = {c: " " for c in range(0x3001) if chr(c).isspace()} | dict.fromkeys([*formats, *INVISIBLE])
        visible = text
        if not text.isascii():
            visible = _canonical(text.translate(self.clean))
        visible = " ".join(visible.split()).translate(self.single)
        out, at = [], 0
        for start, p in greedy_matches(self.machine, visible):
            out += [visible[at:start], self.longer[p]]
            at = start + len(p)
        visible = "".join([*out, visible[at:]]) if out else visible
        return visible if visible.isascii() else _canonical(visible)


def representatives(counts: dict[str, int], groups: list[list[str]]) -> dict[str, str]:
    """Each member's representative: the commonest member of its class (ties: the least).

    In classes that hold strings of several lengths the representative is one of the longest, spelt in representatives of its
    own characters: rewriting then only ever takes characters apart, and gives one form whatever the mixture it starts from.
    """

    def best(members: list[str]) -> str:
        longest = max(map(len, members))
        return min((m for m in members if len(m) == longest), key=lambda m: (-counts.get(m, 0), m))

    single = {m: best(g) for g in groups if max(map(len, g)) == 1 for m in g}
    out = dict(single)
    for g in groups:
        if max(map(len, g)) > 1:
            spelt = "".join(single.get(c, c) for c in best(g))
            out |= dict.fromkeys(g, spelt)
    return {m: r for m, r in out.items() if m != r}


def member_counts(texts: DataFrame, column: str, groups: list[list[str]]) -> dict[str, int]:
    """How often the members of the classes that may stand for them occur in all texts. The result is no larger than the classes."""
    # only the longest members of a class can come to stand for it, and only where there are several is there a choice
    longest = [[m for m in g if len(m) == max(map(len, g))] for g in groups]
    single, longer = {m for g in groups for m in g if len(m) == 1}, [m for g in longest if len(g) > 1 for m in g if len(m) > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        total: Counter[str] = Counter()
        for b in batches:
            joined = unicodedata.normalize("NFD", "\n".join(t for t in b.column(0).to_pylist() if t))
            total.update({c: n for c, n in Counter(joined).items() if c in single})
            for m in longer:
                if n := joined.count(m):
                    total[m] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array(list(total.values()), type=pa.int64())], ["member", "n"])

    counted = texts.select(column).mapInArrow(run, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n"))
    return {r["member"]: r["n"] for r in counted.collect()}  # at most one row per class member


def fit(texts: DataFrame, column: str) -> Normalizer:
    """The normalizer for a corpus: classes from Unicode and the fixed pairs, representatives by frequency in all of ``texts``."""
    groups = classes(seed_pairs())
    return Normalizer(representatives(member_counts(texts, column, groups), groups))


def rewrite(df: DataFrame, column: str, out: str, normalizer: Normalizer) -> DataFrame:
    """``df`` with ``out``: the text of ``column`` in its one form. Null stays null, empty text empty, other columns as they are."""
    @F.pandas_udf("string")
    def one_form(s: pd.Series) -> pd.Series:
        return pd.Series([normalizer(t) for t in s], dtype=object)

    return df.withColumn(out, one_form(F.col(column)))


def _closed(text: str) -> Column:
    """Text with an end mark after each letter's own marks, so that containment can't tear a letter from its points."""
    return F.regexp_replace(text, r"(\P{M}\p{M}*)", "$1\u0001")


def quoted_segments(notes: DataFrame, segments: DataFrame) -> DataFrame:
    """``(note_id, marker_no, seg_idx)``: where a note's marker stands on its page to the eye, but not as stored.

    Both texts are brought to one form; the marker must then occur in the segment without its first or last letter lacking, or
    gaining, a point. Null and empty markers, and ones that are blank in their one form, never count. Rows loaded twice give
    one result; a segment loaded with several texts counts if one of them fits and none holds the marker as stored.
    """
    pages = segments.select("ref", "seg_idx", "hebrew").where("ref is not null and seg_idx is not null and hebrew is not null and hebrew <> ''")
    marks = notes.select("note_id", F.col("page_ref").alias("ref"), F.posexplode("hebrew_boundary_markers").alias("marker_no", "marker")).where("ref is not null and marker is not null and marker <> ''").distinct()
    normalizer = fit(segments.select("hebrew").unionAll(notes.select(F.explode("hebrew_boundary_markers").alias("hebrew"))), "hebrew")
    marks = rewrite(marks, "marker", "sought", normalizer).where("sought <> ''")
    asked = pages.join(marks.select("ref").distinct(), "ref", "left_semi").distinct()
    asked = rewrite(asked, "hebrew", "shown", normalizer)
    both = asked.select("ref", "seg_idx", "hebrew", _closed("shown").alias("shown")).join(marks.select("*", _closed("sought").alias("closed")), "ref").where(F.col("shown").contains(F.col("closed")))
    found = both.groupBy("note_id", "marker_no", "marker", "seg_idx").agg(F.max(F.col("hebrew").contains(F.col("marker"))).alias("stored"))
    return found.where(~F.col("stored")).select("note_id", "marker_no", "seg_idx").distinct()
