import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.operators import provider
from spanloom.sources import files


def test_pages_are_flattened_and_cut_to_the_shorter_side(spark, rows):
    df = spark.createDataFrame([("p", '["a", ["b", "c"], null]', '["x", "y"]'), ("q", "broken", "[]"), ("r", "[]", '["x"]'), ("s", None, None)], "ref string, e string, h string")
    assert rows(files.paired_segments(df, "ref", "e", "h")) == [("p", 0, "a", "x"), ("p", 1, "b", "y")]


def test_shape_without_empty_ends(spark, rows):
    df = spark.createDataFrame([("C", [0, 3, 0, 2, 0]), ("E", [0, 0]), ("N", None)], "corpus string, n array<int>")
    assert rows(files.page_shape(df, "corpus", "n"), "page_seq", "ref", "segments") == [(1, "C 1b", 3), (2, "C 2a", 0), (3, "C 2b", 2)]


def test_story_lines_and_layout_guard(spark):
    lines = spark.createDataFrame([("d", 0, "lost one two three four five six seven"), ("d", 1, "Page 1"), ("d", 2, "one two three four five six seven eight"), ("d", 3, "too short"), ("d", 4, "See also one two three four five six")], "doc string, n int, t string")
    got = files.line_stories(lines, "doc", "n", "t", "^Page ", "^See ").collect()
    assert [(r["header"], r["n"]) for r in got] == [("Page 1", 2)]
    cells = spark.createDataFrame([("f", 0, "where"), ("f", 1, "text"), ("g", 1, "where"), ("g", 0, "text")], "file string, c int, role string")
    assert files.guard_layout(cells.where("file = 'f'"), "file", "c", "role", "where", "text").count() == 2
    with pytest.raises(Exception, match="out of order in g"):
        files.guard_layout(cells, "file", "c", "role", "where", "text").collect()


def test_docx_lines_pair_with_their_headers(spark, rows, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("12b", "short", "a line that is long enough to be a story of its own", "13a", "", "14a", "another line that is long enough to be a story"))
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"none")
    got = files.docx_paragraphs(spark, str(tmp_path))
    assert got.where("file = 'b.docx'").collect()[0]["text"] is None and got.where("file = 'a.docx'").count() == 7
    assert [r[1] for r in rows(files.paired_lines(got, r"^\d+[ab]$"))] == ["12b", "14a"]


def test_verdict_files_of_both_shapes(spark, rows, tmp_path):
    (tmp_path / "r1.json").write_text(json.dumps({"k1": "yes", "k2": {"verdict": "no", "note": "n"}, "k3": None}))
    (tmp_path / "r2.json").write_text(json.dumps([{"key": "k1", "verdict": "no"}, {"verdict": "yes"}]))
    (tmp_path / "r3.json").write_text("{broken")
    (tmp_path / "r4.json").write_text(json.dumps({"reviews": {"k9": "adjust"}}))
    assert rows(files.verdict_files(spark, str(tmp_path)), "round", "key", "verdict", "note") == [("r1", "k1", "yes", None), ("r1", "k2", "no", "n"), ("r2", "k1", "no", None), ("r4", "k9", "adjust", None)]


def test_issues_settings_history_and_answers(spark, rows, tmp_path):
    (tmp_path / "issues.json").write_text(json.dumps([{"number": i, "title": f"t{i}", "state": s, "createdAt": f"2024-01-0{i}"} for i, s in ((1, "OPEN"), (2, "CLOSED"), (3, None))]))
    assert [r["number"] for r in files.read_issues(spark, str(tmp_path / "issues.json")).collect()] == [3, 1]
    assert files.script_settings("const A = 'x'; B: 3.5, C = f()", ["A", "B", "C", "D"]) == {"A": "x", "B": "3.5", "C": None, "D": None}
    h = spark.createDataFrame([("a", 1, "t"), ("b", 1, None), ("c", 2, None), ("d", 2, "t")], "id string, round int, done_at string")
    assert [r[0] for r in rows(files.current_and_open(h, "id", 2))] == ["b", "c", "d"]
    kept, missing = files.import_answers(spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "batch int, id string"), spark.createDataFrame([(0, "a", "x"), (0, "a", "y"), (0, "zz", "x")], "batch int, id string, answer string"))
    assert rows(kept) == [(0, "a", "y")] and rows(missing) == [(1,)]


def test_indexes_and_writers(spark, rows, tmp_path):
    spans = spark.createDataFrame([("p", "a", 0, 1, "YES", False), ("p", "b", 2, 2, "NOT_A_STORY", None), ("p", "c", 3, 3, "YES", True), ("p", "d", 3, 2, "YES", False)], "ref string, id string, lo int, hi int, classification string, withheld boolean")
    pages = spark.createDataFrame([("p", 0, 0, "one two three four five", True), ("p", 0, 1, None, True)], "ref string, page_seq int, seg int, text string, examined boolean")
    got = files.run_indexes(spans, pages)
    ids = lambda k: [r["id"] for r in got[k].orderBy("id").collect()]
    assert (ids("proposals"), ids("accepted"), ids("rejected"), ids("withheld")) == (["a", "b"], ["a"], ["b"], ["c"])
    assert [len(r["grams"]) for r in got["units"].orderBy("seg").collect()] == [2, 0] and got["pages"].first()["examined"]
    files.write_corpora(spark.createDataFrame([("x", 2), ("x", 1), ("y", 1)], "corpus string, n int"), str(tmp_path / "out"), ["n"])
    assert sorted((r["corpus"], r["n"]) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("x", 1), ("x", 2), ("y", 1)]
    assert rows(files.report_lines(spark.createDataFrame([("a", 2, "z"), ("a", 1, "y")], "g string, o int, t string"), "g", "o", "<li>%s</li>", "t")) == [("a", "<li>y</li>\n<li>z</li>")]


def test_provider_outcomes_and_retries(spark):
    calls = {"n": 0}

    def shaky(prompt):
        if prompt == "refuse":
            raise provider.Refused
        if prompt == "fail":
            raise OSError
        return "{}" if prompt == "fine" else "no json"

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["fine", "refuse", "fail", "odd", None])], "id int, prompt string")
    got = {r["id"]: (r["outcome"], r["attempts"]) for r in provider.ask(df, "id", "prompt", shaky, waits=(0, 0), sleep=lambda s: None).collect()}
    assert got == {0: ("ok", 1), 1: ("refused", 1), 2: ("failed", 3), 3: ("invalid", 1), 4: ("skipped", 0)}
    assert calls["n"] == 0
    said = spark.createDataFrame([(0, "Once a man came to town"), (1, "This is permitted")], "id int, prompt string")
    assert [json.loads(r["answer"])["verdict"] for r in provider.ask(said, "id", "prompt").orderBy("id").collect()] == ["story", "not"]


def test_runs_of_labels(spark, rows):
    s = spark.createDataFrame([("p", i, x) for i, x in enumerate("ABBAAB")] + [("q", 0, "B")], "ref string, seg int, label string")
    assert rows(provider.runs_of(s, ["A"])) == [("p", 0, 0, 1), ("p", 3, 4, 2)]
    assert provider.runs_of(s.where(F.lit(False)), ["A"]).count() == 0
