import random
import re

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import passages
from spanloom.sources import pages
from spanloom.streaming import ledger


def test_clause_ranges_against_python(spark):
    rng = random.Random(6)
    samples = ["".join(rng.choice(["a", "b ", ". ", "? ", ".", "  ", ": x"]) for _ in range(rng.randint(0, 25))) for _ in range(80)] + [""]
    got = {r["t"]: [tuple(x) for x in r["r"]] for r in spark.createDataFrame([(s,) for s in samples], "t string").withColumn("r", text.clause_ranges(F.col("t"))).collect()}
    for s in samples:
        want, at = [], 0
        for m in [*re.finditer(r"(?<=[.:?!])\s+", s), None]:
            end = m.start() if m else len(s)
            if s[at:end].strip(" "):
                want.append((at, end))
            at = m.end() if m else at
        assert got[s] == want, s


def test_small_functions(spark):
    row = spark.createDataFrame([("Name 12b_3-7", "Name 12b", "<b>רַב״י</b> א", 'x ```{"a": [1,],}``` y')], "k string, p string, h string, j string").select(
        text.parse_span_key(F.col("k")).alias("k"), text.page_order(F.col("p")).alias("p"), text.letters_only(F.col("h")).alias("h"), text.numeral(F.lit("קכג")).alias("n"), text.lenient_json(F.col("j")).alias("j"), text.whole_word(F.lit("a cat sat"), "cat").alias("w"), text.wilson(F.lit(0), F.lit(0), True).alias("z")
    ).first()
    assert tuple(row["k"]) == ("Name 12b", 3, 7) and row["p"] == 25 and row["h"] == "רב י א" and row["n"] == 123 and row["j"] == '{"a": [1]}' and row["w"] and row["z"] is None


def test_pages_round_trip(spark, tmp_path):
    from spanloom.operators.publish import page_documents

    seg = spark.createDataFrame([("c", "P 1a", 0, "x", "א"), ("c", "P 1a", 1, None, "ב")], "corpus string, ref string, seg_idx int, english string, hebrew string")
    pages.write_pages(page_documents(seg), str(tmp_path / "out"))
    back = pages.read_pages(spark, str(tmp_path / "out" / "corpus=c")).orderBy("seg_idx").collect()
    assert [(r["ref"], r["seg_idx"], r["english"], r["hebrew"]) for r in back] == [("P 1a", 0, "x", "א"), ("P 1a", 1, None, "ב")]


def test_file_accounting_headers_and_embedded(spark, rows, tmp_path):
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text("{}")
    known = spark.createDataFrame([("a.json",), ("c.json",)], "file string")
    assert rows(pages.unaccounted(spark, str(tmp_path), known)) == [("b.json", "unregistered"), ("c.json", "missing")]
    lines = spark.createDataFrame([(1, 0, "lost"), (1, 1, "# A"), (1, 2, "x"), (1, 3, "# B"), (1, 4, "y")], "doc int, n int, t string")
    assert rows(pages.fill_headers(lines, "doc", "n", "t", "^# "), "t", "header") == [("x", "# A"), ("y", "# B")]
    assert spark.range(1).select(pages.embedded_json(F.lit('<script id="d">{"a":1}</script>'), "d").alias("j")).first()["j"] == '{"a":1}'


def test_locating_and_sharing(spark, rows):
    corpus = spark.createDataFrame([("g", i, f"word{i} alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(20)], "`group` string, pos int, text string")
    asked = spark.createDataFrame([("q", "g", "Alpha3 beta3 gamma3 delta3 eps3 zeta3, and more: word4 alpha4 beta4 gamma4 delta4 eps4"), ("none", "g", "too short")], "id string, `group` string, text string")
    assert rows(passages.locate(asked, corpus)) == [("q", "g", 3, 4, 2)]
    body = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a", body), (2, "b", body + " tail one two"), (3, "c", body.upper()), (4, "d", "unlike"), (5, "e", None)], "id bigint, `group` string, text string")
    assert rows(passages.shared_passages(docs), "a", "b", "overlap") == [(1, 2, 1.0)]
    assert rows(passages.text_classes(docs), "id", "class") == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_ledger_takes_each_key_once(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    for n, ids in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(i, "v") for i in ids], "k int, v string").coalesce(1).write.parquet(str(src / f"part={n}"))
        stream = spark.readStream.schema("k int, v string").option("recursiveFileLookup", "true").parquet(str(src))
        ledger.append_once(stream, "k", str(out), str(tmp_path / "cp")).awaitTermination()
    got = sorted(r["k"] for r in spark.read.parquet(str(out)).collect())
    assert got == [1, 2, 3]


def test_ledger_by_uri_holds_when_a_stream_starts_anew(spark, tmp_path):
    out = f"file://{tmp_path}/ledger"
    for n, ids in enumerate(([1, 2, None], [2, 3], [3])):
        spark.createDataFrame([(i, "v") for i in ids], "k int, v string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "src" / f"part={n}"))
    for again in range(2):  # the second stream knows nothing of the first: only the ledger keeps its keys single
        stream = spark.readStream.schema("k int, v string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        ledger.append_once(stream, "k", out, str(tmp_path / f"cp{again}")).awaitTermination()
    assert ledger.exists(spark, out) and not ledger.exists(spark, out + "-none")
    assert set(r["k"] for r in spark.read.parquet(out).collect()) == {1, 2, 3}


def test_drained_streams_are_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "src"))
    assert sorted(tuple(r) for r in ledger.drain(stream.groupBy("v").count(), "complete", str(tmp_path / "t")).collect()) == [("a", 2), ("b", 1)]
    assert ledger.drain(stream, "append").count() == 3
