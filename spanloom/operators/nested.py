"""Nested documents as flat, linked node tables (problem 5).

One depth-first walk gives every value of a JSON document two numbers: ``pre`` when the walk enters it and ``post`` when it
leaves. A node lies inside another exactly if its interval does, so tables of different node types, cut from the same
walk, are linked by interval containment and need no keys of their parents inside the documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from json.decoder import WHITESPACE, scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "doc_key bigint, copy string, node string, pre bigint, post bigint, depth int, place int, fields string"
_ARROW = pa.schema([("doc_key", pa.int64()), ("copy", pa.string()), ("node", pa.string()), ("pre", pa.int64()), ("post", pa.int64()), ("depth", pa.int32()), ("place", pa.int32()), ("fields", pa.string())])

#: Which types a type holds: child type -> path of keys from the parent's object. The document itself is the type 'record'.
Shape = dict[str, dict[str, tuple[str, ...]]]
RUN_RECORD: Shape = {"record": {"page": ("pages",)}, "page": {"segment": ("segments",), "story": ("stories",)}, "story": {"event": ("criteria", "multiple_events", "events"), "weakener": ("weakeners_found",)}}
#: Keys by which an object is known to be one node of a type, not a container that maps names or numbers to nodes.
RUN_RECORD_MARKS = {"page": {"ref", "segments", "stories"}, "segment": {"index", "english", "hebrew"}, "story": {"start_segment", "end_segment", "classification", "criteria", "weakeners_found", "one_sentence_summary", "continuation"}, "event": {"text", "order"}, "weakener": {"text", "order"}}

#: Levels down to which a value that nests too deep for the parser is taken apart at once.
DEEP = 500
SCALAR = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")


class _Object(dict):
    """A JSON object that keeps repeated keys, in their order, in ``pairs``."""

    pairs: list[tuple[str, Any]]


def _object(pairs: list[tuple[str, Any]]) -> _Object:
    out = _Object(pairs)
    out.pairs = pairs
    return out


def parse(text: str) -> Any:
    """The JSON value of ``text``; raises ValueError when it isn't valid JSON (NaN and Infinity are not).

    Of a value that nests too deep for the recursive parser, what lies more than ``DEEP`` levels down is kept as its text.
    """

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return json.loads(text, object_pairs_hook=_object, parse_constant=refuse)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> Any:
    """``parse`` with a stack of its own."""
    stack: list[tuple[int, list, str | None]] = []  # where each open container begins, what it holds, and the key it waits to fill
    key = None

    def blank(i: int) -> int:
        return WHITESPACE.match(text, i).end()

    def name(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("key")
        k, i = scanstring(text, i + 1, True)
        i = blank(i)
        if text[i : i + 1] != ":":
            raise ValueError("colon")
        return k, blank(i + 1)

    at = blank(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "[") and c:
            stack.append((at, [], key))
            at, key = blank(at + 1), None
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    key, at = name(at)
                continue
            value, closing = None, True
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
            closing = False
        elif m := SCALAR.match(text, at):
            value, at, closing = json.loads(m.group()), m.end(), False
        else:
            raise ValueError("value")
        while True:  # a value is whole, or a container is closing
            if closing:
                begin, held, outer = stack.pop()
                at += 1
                value = (_object(held) if text[begin] == "{" else held) if len(stack) < DEEP else text[begin:at]
                key = outer
            at = blank(at)
            if not stack:
                if at != len(text):
                    raise ValueError("extra")
                return value
            begin, held, _ = stack[-1]
            held.append((key, value) if text[begin] == "{" else value)
            c = text[at : at + 1]
            closing = c == ("}" if text[begin] == "{" else "]")
            if closing:
                continue
            if c != ",":
                raise ValueError("comma")
            at, key = blank(at + 1), None
            if text[begin] == "{":
                key, at = name(at)
            break


def _unwrap(value: Any) -> Any:
    """Text that holds a JSON object or list is taken as that object or list."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            inner = parse(value)
        except ValueError:
            break
        if not isinstance(inner, (dict, list, str)):
            break
        value = inner
    return value


class Walk:
    """The depth-first walk over one document."""

    def __init__(self, shape: Shape, marks: dict[str, set[str]], emit: Callable[..., None]):
        self.shape, self.marks, self.emit, self.clock = shape, marks, emit, 0

    def tick(self) -> int:
        self.clock += 1
        return self.clock - 1

    def members(self, kind: str, value: Any, listed: bool = False) -> Iterator[Any]:
        """The nodes of type ``kind`` that ``value`` holds in any shape: a list, a map, a group of further nodes, text, or one alone."""
        todo: list[tuple[Any, bool, str | None]] = [(value, listed, None)]  # what holds it by name, if a map does
        while todo:
            value, listed, name = todo.pop()
            value = _unwrap(value)
            if value is None or value == {} and not listed:
                continue
            if isinstance(value, list):
                todo += [(x, True, name) for x in reversed(value)]
                continue
            if isinstance(value, _Object):
                own = self.marks.get(kind, set()) & value.keys()
                # an object without a mark of the type's own holds its nodes: those under the type's key, else all its values
                inner = [v for k, v in value.pairs if k in self._containers(kind)]
                if inner and not own:
                    todo += [(v, False, name) for v in reversed(inner)]
                    continue
                if not own and value and all(isinstance(_unwrap(v), (dict, list)) or v is None for v in value.values()):
                    todo += [(v, True, k) for k, v in reversed(value.pairs)]
                    continue
            yield value if name is None else _named(value, name)

    def _containers(self, kind: str) -> set[str]:
        return {path[-1] for held in self.shape.values() for child, path in held.items() if child == kind}

    def node(self, kind: str, value: Any, place: int, depth: int) -> None:
        pre, fields = self.tick(), {}
        held = self.shape.get(kind, {})
        if isinstance(value, _Object):
            by_path = {path: child for child, path in held.items()}
            counts = dict.fromkeys(held, 0)
            self.children(value, (), by_path, counts, depth, fields)
        else:
            fields["value"] = value
        self.emit(kind, pre, self.tick(), depth, place, fields)

    def children(self, value: _Object, path: tuple[str, ...], by_path: dict, counts: dict[str, int], depth: int, fields: dict) -> None:
        for k, v in value.pairs:
            here = (*path, k)
            if here in by_path:
                child = by_path[here]
                pre = self.tick()  # the container is a node of the walk too
                for x in self.members(child, v):
                    self.node(child, x, counts[child], depth + 1)
                    counts[child] += 1
                self.tick()
                assert pre < self.clock
            elif any(p[: len(here)] == here for p in by_path) and isinstance(inner := _unwrap(v), _Object):
                self.tick()
                self.children(inner, here, by_path, counts, depth, fields)
                self.tick()
            else:
                self.tick()
                fields[".".join(here)] = v

    def document(self, value: Any) -> None:
        for i, x in enumerate(_records(_unwrap(value))):
            self.node("record", x, i, 0)


def _records(value: Any) -> Iterator[Any]:
    todo = [value]
    while todo:
        value = _unwrap(todo.pop())
        if isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, _Object):
            yield value


def _named(node: Any, name: str) -> Any:
    """A node that a map holds by name keeps that name, unless it says its own ref."""
    if isinstance(node, _Object) and "ref" not in node and "_name" not in node:
        return _object([("_name", name), *node.pairs])
    return node


def label_nodes(df: DataFrame, key: str, doc: str, shape: Shape, marks: dict[str, set[str]]) -> DataFrame:
    """The node table of all documents: ``(doc_key, copy, node, pre, post, depth, place, fields)``.

    ``place`` counts the nodes of a type within their parent, from 0 in order of appearance; ``fields`` holds, as JSON, what
    of the node's own values isn't a node itself. ``copy`` tells documents apart that share a key. A document that is null,
    empty or not valid JSON gives no rows; nulls in a list are no nodes; text that holds JSON counts as what it holds; a lone
    value counts as a list of one. Rows that repeat a key and document give the same rows again, see ``distinct_nodes``.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows.clear()
            return out

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = parse(text) if text else None
                except ValueError:
                    continue
                if value is None:
                    continue
                copy = hashlib.md5(text.encode()).hexdigest()[:16]
                own: list[tuple] = []
                Walk(shape, marks, lambda kind, pre, post, depth, place, fields: own.append((k, copy, kind, pre, post, depth, place, json.dumps(fields, ensure_ascii=False)))).document(value)
                rows += own
                if len(rows) >= 20_000:
                    yield flush()
        if rows:
            yield flush()

    return df.select(F.col(key).cast("bigint"), F.col(doc)).mapInArrow(run, NODE_SCHEMA)


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """Each document's nodes once, however often the document was delivered under the same key."""
    return nodes.dropDuplicates(["doc_key", "copy", "pre"])


def link(nodes: DataFrame, ancestors: list[str]) -> DataFrame:
    """``nodes`` with, for each type in ``ancestors``, ``<type>_pre`` and ``<type>_place`` of the node of it that contains them.

    Containment is read off the order of ``pre``: the candidate is the last node of the type that began before, and it
    contains the node if it ends after it. Types in ``ancestors`` mustn't nest in themselves. One sort per document.
    """
    within = Window.partitionBy("doc_key", "copy").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    out = nodes
    for a in ancestors:
        out = out.withColumn(f"_{a}", F.last(F.when(F.col("node") == a, F.struct("pre", "post", "place")), ignorenulls=True).over(within))
    for a in ancestors:
        inside = F.col(f"_{a}.post") > F.col("post")
        out = out.withColumn(f"{a}_pre", F.when(inside, F.col(f"_{a}.pre"))).withColumn(f"{a}_place", F.when(inside, F.col(f"_{a}.place"))).drop(f"_{a}")
    return out


def run_record_nodes(records: DataFrame) -> DataFrame:
    """Linked nodes of raw detector runs: pages, segments, stories, events and weakeners."""
    once = records.where("doc is not null").select("rec_id", "doc").dropDuplicates()  # a document delivered again is walked once
    return link(label_nodes(once, "rec_id", "doc", RUN_RECORD, RUN_RECORD_MARKS), ["record", "page", "story"])


def run_record_tables(records: DataFrame) -> dict[str, DataFrame]:
    """One flat table per type, each row naming its record, page and story by ``pre`` and by place."""
    nodes = run_record_nodes(records)
    text = lambda path: F.get_json_object("fields", path)
    own = ["doc_key", "copy", "pre", "post", "place"]
    return {
        "pages": nodes.where("node = 'page'").select(*own, "record_pre", F.coalesce(text("$.ref"), text("$._name")).alias("ref")),
        "segments": nodes.where("node = 'segment'").select(*own, "page_pre", "page_place", F.coalesce(text("$.english.text"), text("$.english")).alias("english"), text("$.hebrew").alias("hebrew")),
        "stories": nodes.where("node = 'story'").select(
            *own, "page_pre", "page_place", text("$.start_segment").cast("int").alias("start_segment"), text("$.end_segment").cast("int").alias("end_segment"), text("$.classification").alias("classification"), text("$.one_sentence_summary").alias("one_sentence_summary"), "fields"
        ),
        "events": nodes.where("node = 'event'").select(*own, "page_pre", "page_place", "story_pre", "story_place", F.coalesce(text("$.text"), text("$.value")).alias("event")),
        "weakeners": nodes.where("node = 'weakener'").select(*own, "page_pre", "page_place", "story_pre", "story_place", F.coalesce(text("$.text"), text("$.value")).alias("weakener")),
    }


def found_nodes(records: DataFrame) -> DataFrame:
    """``(rec_id, node, page_no, item_no, sub_no)`` as problem 5 lays down; pages are counted through the whole document."""
    nodes = run_record_nodes(records).where("node <> 'record'")
    return nodes.select(
        F.col("doc_key").alias("rec_id"),
        "node",
        F.when(F.col("node") == "page", F.col("place")).otherwise(F.col("page_place")).alias("page_no"),
        F.when(F.col("node") == "page", -1).when(F.col("node").isin("segment", "story"), F.col("place")).otherwise(F.col("story_place")).alias("item_no"),
        F.when(F.col("node").isin("event", "weakener"), F.col("place")).otherwise(-1).alias("sub_no"),
    )
