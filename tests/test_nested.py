import json

import pytest

from spanloom.operators import nested


def found(spark, rows, *docs):
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "rec_id bigint, doc string, pre string")
    return rows(nested.found_nodes(df))


STORY = {"start_segment": 0, "criteria": {"multiple_events": {"met": True, "events": ["e0", {"text": "e1"}]}}, "weakeners_found": "alone"}


def test_all_shapes_give_the_same_rows(spark, rows):
    segs = [{"index": 0, "hebrew": "a"}, {"index": 1, "hebrew": "b"}]
    page = {"ref": "P 1a", "segments": segs, "stories": [STORY]}
    docs = [
        {"pages": [page]},
        [{"pages": page}],
        {"pages": json.dumps([page])},
        {"pages": {"P 1a": {"segments": {"0": segs[0], "1": segs[1]}, "stories": {"page_ref": "P 1a", "stories": [STORY]}}}},
        {"pages": [{**page, "stories": [{"page_ref": "P 1a", "stories": [STORY]}]}]},
        {"pages": [{**page, "stories": STORY}]},
    ]
    want = [("event", 0, 0, 0), ("event", 0, 0, 1), ("page", 0, -1, -1), ("segment", 0, 0, -1), ("segment", 0, 1, -1), ("story", 0, 0, -1), ("weakener", 0, 0, 0)]
    assert found(spark, rows, *(json.dumps(d) for d in docs)) == [(i, *w) for i in range(len(docs)) for w in want]


def test_documents_without_nodes(spark, rows):
    assert found(spark, rows, None, "", "{", "null", "{}", '{"pages": null}', '{"pages": []}', '{"pages": {}}', "[]", '{"pages": NaN}') == []


def test_optional_and_null_fields(spark, rows):
    doc = {"pages": [{"ref": "p", "segments": None, "stories": [{"start_segment": 1, "criteria": {"multiple_events": None}, "weakeners_found": None}]}, {"ref": "q"}]}
    assert found(spark, rows, json.dumps(doc)) == [(0, "page", 0, -1, -1), (0, "page", 1, -1, -1), (0, "story", 0, 0, -1)]


def test_repeated_rows_count_once_and_labels_nest(spark):
    doc = json.dumps({"pages": [{"ref": "p", "segments": [{"index": 0}], "stories": [STORY]}]})
    df = spark.createDataFrame([(1, doc), (1, doc)], "rec_id bigint, doc string")
    nodes = nested.run_record_nodes(df).collect()
    assert len({(n["pre"], n["node"]) for n in nodes}) == len(nodes) == 7
    by = {n["node"]: n for n in nodes}
    assert by["record"]["pre"] < by["page"]["pre"] < by["story"]["pre"] < by["event"]["pre"] < by["event"]["post"] < by["story"]["post"] < by["page"]["post"] < by["record"]["post"]
    assert by["event"]["story_pre"] == by["story"]["pre"] and by["segment"]["story_pre"] is None


def test_flat_tables(spark):
    doc = json.dumps({"pages": {"P 2b": {"segments": [{"index": 0, "english": {"text": "t", "version": 1}}], "stories": [{**STORY, "end_segment": 4}]}}})
    tables = nested.run_record_tables(spark.createDataFrame([(1, doc)], "rec_id bigint, doc string"))
    assert tables["pages"].first()["ref"] == "P 2b"
    assert tables["segments"].first()["english"] == "t"
    assert tables["stories"].first()["end_segment"] == 4
    assert {r["event"] for r in tables["events"].collect()} == {"e0", "e1"}
    assert tables["weakeners"].first()["weakener"] == "alone"


def test_deep_documents_keep_their_nodes(spark, rows):
    deep = "[" * 20_000 + "1" + "]" * 20_000
    objects = '{"a":' * 20_000 + "1" + "}" * 20_000
    page = '{"ref": "p", "segments": [{"index": 0}], "stories": []}'
    docs = [f'{{"extra": {deep}, "more": {objects}, "pages": [{page}]}}', '{"pages": ' + "[" * 20_000 + page + "]" * 20_000 + "}", f'{{"extra": {deep}], "pages": [{page}]}}', f'{{"extra": {deep[:-1]}, "pages": []}}']
    df = spark.createDataFrame(list(enumerate(docs)), "rec_id bigint, doc string")
    assert rows(nested.found_nodes(df), "rec_id", "node") == [(0, "page"), (0, "segment"), (1, "page"), (1, "segment")]


def test_deep_parser_is_the_parser():
    for text in ('{"a": [1, -2.5e3, {"b": null}], "a": "x\\u00e9", "c": {}, "d": []}', " [ ] ", '"x"', "[true, false , 0]"):
        assert nested._parse_deep(text) == nested.parse(text)
    for text in ("", "[1,]", "{", '{"a" 1}', "[1 2]", "01", "NaN", '{"a": 1,}', "[] x", "]", '"x'):
        with pytest.raises(ValueError):
            nested._parse_deep(text)
