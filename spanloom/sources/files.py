"""Readers of documents, verdict files, runs and settings, and writers of reports; layouts are checked before they are trusted."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def flat_texts(value: Column) -> Column:
    """The texts of a JSON list in which a member may be a list of texts itself: one level is laid out in order."""
    lists = F.from_json(value, "array<variant>")
    one = F.transform(lists, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string"))))
    return F.filter(F.flatten(one), lambda t: t.isNotNull())


def paired_segments(pages: DataFrame, ref: str, english: str, hebrew: str) -> DataFrame:
    """``(ref, seg_idx, english, hebrew)`` of pages whose two sides are JSON lists, nested once at most, cut to the shorter side.

    Pages of which a side isn't such a list give no rows."""
    df = pages.select(F.col(ref).alias("ref"), flat_texts(F.col(english)).alias("e"), flat_texts(F.col(hebrew)).alias("h")).where("e is not null and h is not null")
    n = F.least(F.size("e"), F.size("h"))
    pairs = F.when(n > 0, F.zip_with(F.slice("e", 1, n), F.slice("h", 1, n), lambda a, b: F.struct(a.alias("e"), b.alias("h"))))
    return df.select("ref", F.posexplode(pairs).alias("seg_idx", "p")).select("ref", "seg_idx", F.col("p.e").alias("english"), F.col("p.h").alias("hebrew"))


def page_shape(counts: DataFrame, corpus: str, sizes: str) -> DataFrame:
    """``(corpus, page_seq, ref, segments)`` from an index's list of segment counts per page, without empty pages at either end.

    Pages run 1a, 1b, 2a and so on, whatever is trimmed."""
    full = F.filter(F.transform(F.col(sizes), lambda n, i: F.when(n > 0, i)), F.isnotnull)
    df = counts.select(F.col(corpus).alias("corpus"), F.col(sizes).alias("n"), F.array_min(full).alias("a"), F.array_max(full).alias("z")).where("a is not null")
    rows = df.select("corpus", "a", "z", F.posexplode("n").alias("i", "segments")).where("i between a and z")
    side = F.when(F.col("i") % 2 == 0, "a").otherwise("b")
    return rows.select("corpus", F.col("i").alias("page_seq"), F.concat("corpus", F.lit(" "), (F.floor(F.col("i") / 2) + 1).cast("string"), side).alias("ref"), F.coalesce("segments", F.lit(0)).alias("segments"))


def line_stories(lines: DataFrame, doc: str, line_no: str, text: str, header: str, citation: str, least_words: int = 8) -> DataFrame:
    """Story lines under the page header above them: lines of few words, citations and lines before any header don't count."""
    from spanloom.sources.pages import fill_headers

    n = F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))
    return fill_headers(lines, doc, line_no, text, header).where((n >= least_words) & ~F.col(text).rlike(citation))


def guard_layout(cells: DataFrame, file: str, column_no: str, role: str, first: str, then: str) -> DataFrame:
    """``cells`` unchanged; reading raises an error for a file whose column of role ``first`` doesn't come before that of ``then``."""
    at = lambda r: F.min(F.when(F.col(role) == r, F.col(column_no))).over(Window.partitionBy(file))
    wrong = at(first).isNull() | at(then).isNull() | (at(first) >= at(then))
    message = F.concat(F.lit("columns out of order in "), F.col(file))
    return cells.withColumn("_fine", F.when(wrong, F.raise_error(message)).otherwise(F.lit(True))).where("_fine").drop("_fine")


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, text)`` of the paragraphs of .docx files; a file that is none gives one row with a null text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for name, content in zip(b["file"], b["content"]):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows.append((name, None, None))
                    continue
                for i, p in enumerate(root.iter(f"{WORD}p")):
                    rows.append((name, i, "".join(t.text or "" for t in p.iter(f"{WORD}t"))))
            yield pd.DataFrame(rows, columns=["file", "line_no", "text"]).astype({"line_no": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInPandas(read, "file string, line_no int, text string")


def paired_lines(paragraphs: DataFrame, header: str, long_chars: int = 40) -> DataFrame:
    """``(file, header, text)``: each header line with the next long line after it, before another header."""
    lines = paragraphs.where("trim(text) <> ''").withColumn("_h", F.col("text").rlike(header))
    w = Window.partitionBy("file").orderBy("line_no")
    lines = lines.withColumn("header", F.last(F.when(F.col("_h"), F.col("text")), True).over(w)).withColumn("_at", F.last(F.when(F.col("_h"), F.col("line_no")), True).over(w))
    long = lines.where(~F.col("_h") & F.col("header").isNotNull() & (F.length("text") >= long_chars))
    return long.groupBy("file", "_at", "header").agg(F.min_by("text", "line_no").alias("text")).select("file", "header", "text")


def verdict_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``(file, round, key, verdict, note)`` of review files: one object of keys to verdicts, or a list of rows with a key each.

    A verdict is a text, or an object with verdict and note. Files that aren't JSON are left out; the round is the file's name."""
    raw = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    listed = F.try_variant_get("v", "$", "array<variant>")
    mapped = F.coalesce(F.try_variant_get("v", "$.reviews", "map<string,variant>"), F.try_variant_get("v", "$", "map<string,variant>"))
    text = lambda v, p: F.try_variant_get(v, p, "string")
    entry = lambda k, v: F.struct(k.alias("key"), F.coalesce(text(v, "$.verdict"), F.when(F.schema_of_variant(v) == "STRING", text(v, "$"))).alias("verdict"), text(v, "$.note").alias("note"))
    rows = F.when(listed.isNotNull(), F.transform(listed, lambda v: entry(text(v, "$.key"), v))).otherwise(F.transform(F.map_entries(mapped), lambda e: entry(e["key"], e["value"])))
    df = raw.where("v is not null").select("file", F.regexp_replace("file", r"\.json$", "").alias("round"), F.explode(rows).alias("r"))
    return df.select("file", "round", "r.*").where("key is not null and verdict is not null")


def run_indexes(spans: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """What evaluation looks up in a run, each a flat table in page order: ``units`` (segments with their word runs), ``proposals``,
    ``accepted``, ``rejected``, ``withheld`` and ``pages`` with whether they were examined.

    ``spans`` has ``ref, id, lo, hi, classification, withheld``; ``pages`` has ``ref, page_seq, seg, text, examined``."""
    from spanloom.operators.evaluation import is_story
    from spanloom.operators.passages import shingles, words

    good = spans.where("lo <= hi and ref is not null")
    open_ = good.where(~F.coalesce("withheld", F.lit(False)))
    spelt = pages.select("ref", "page_seq", "seg", words(F.coalesce("text", F.lit(""))).alias("w"))
    return {
        "units": spelt.select("ref", "page_seq", "seg", F.array_distinct(shingles(F.col("w"), 4)).alias("grams")),
        "proposals": open_,
        "accepted": open_.where(is_story(F.col("classification"))),
        "rejected": open_.where(~is_story(F.col("classification"))),
        "withheld": good.where("withheld"),
        "pages": pages.groupBy("ref").agg(F.min("page_seq").alias("page_seq"), F.bool_or("examined").alias("examined")),
    }


def read_issues(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """The newest ``most`` open issues of a JSON list, as the listing command gives them: that limit is the command's own."""
    df = spark.read.schema("number bigint, title string, body string, state string, createdAt string, labels array<struct<name:string>>").json(path, multiLine=True)
    return df.where("coalesce(upper(state), 'OPEN') = 'OPEN'").orderBy(F.desc("createdAt"), F.desc("number")).limit(most)


def script_settings(source: str, names: list[str]) -> dict[str, str | None]:
    """Settings that a script file assigns to quoted texts or numbers, by name; None where it doesn't. The file is a configuration."""
    out: dict[str, str | None] = {}
    for n in names:
        m = re.search(rf"\b{re.escape(n)}\b\s*[:=]\s*(?:\"([^\"]*)\"|'([^']*)'|(-?\d+(?:\.\d+)?))", source)
        out[n] = next((g for g in m.groups() if g is not None), None) if m else None
    return out


def current_and_open(history: DataFrame, key: str, from_round: int) -> DataFrame:
    """Rows of the current round on and all open ones, each once: two filters that reach the scan, not the whole history."""
    now = history.where(F.col("round") >= from_round)
    return now.unionByName(history.where(F.col("done_at").isNull())).dropDuplicates([key])


def write_corpora(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows as JSON lines, one folder per corpus, sorted within it; the write shows whole or not at all. A large corpus may take
    several files, each sorted and following the last."""
    rows.repartitionByRange("corpus", *order).sortWithinPartitions("corpus", *order).write.mode("overwrite").partitionBy("corpus").json(path)


def report_lines(rows: DataFrame, by: str, order: str, template: str, *columns: str) -> DataFrame:
    """``(by, body)``: one text per group, its lines filled into a template, in order; for pages that people read, short by nature."""
    line = F.format_string(template, *(F.col(c) for c in columns))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("body"))


def import_answers(batches: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers (``batch, id, answer``) that belong to an exported batch, the last of several standing, and the batches that lack any.

    ``batches`` has ``batch, id``; answers to what wasn't asked are left out."""
    known = answers.join(batches.select("batch", "id").distinct(), ["batch", "id"], "left_semi")
    kept = known.groupBy("batch", "id").agg(F.max("answer").alias("answer"))
    missing = batches.select("batch").distinct().join(known.select("batch").distinct(), "batch", "left_anti")
    return kept, missing
