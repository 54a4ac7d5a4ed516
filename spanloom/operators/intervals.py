"""Continuous periods and gaps of overlapping, nested and gapped intervals (problem 2).

A mergeable aggregate holds, per entity, the sorted list of disjoint periods seen so far. Partial lists are built where
the rows lie, combined by linear merges in a reduction tree (partial, then 64 buckets per entity, then one), and at the
root both the list and its complement between neighbours are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of partial lists that an entity's middle level of the tree has.
FAN = 64


def coalesce_runs(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, adjacent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint periods by entity code. Presorted inputs laid end to end are merged in linear time by the stable sort."""
    if not len(code):
        return code, lo, hi
    order = np.lexsort((lo, code))
    code, lo, hi = code[order], lo[order], hi[order]
    # running maximum of hi within each code: by ranks, which can't overflow
    values, rank = np.unique(hi, return_inverse=True)
    group = np.cumsum(np.r_[0, code[1:] != code[:-1]])
    reach = values[np.maximum.accumulate(group * len(values) + rank) - group * len(values)]
    first = np.r_[True, (code[1:] != code[:-1]) | ((lo[1:] > reach[:-1]) & (lo[1:] - reach[:-1] > adjacent))]
    starts = np.flatnonzero(first)
    return code[starts], lo[starts], reach[np.r_[starts[1:] - 1, len(code) - 1]]


class PeriodState:
    """The aggregate's state in one task: runs of sorted disjoint periods whose sizes fall geometrically."""

    def __init__(self, adjacent: int):
        self.adjacent, self.codes, self.keys, self.runs = adjacent, {}, [], []

    def update(self, key: pa.Array, lo: np.ndarray, hi: np.ndarray) -> None:
        if not len(lo):
            return
        coded = key.dictionary_encode()
        known = np.array([self._code(k) for k in coded.dictionary.to_pylist()], dtype=np.int64)
        self.runs.append(coalesce_runs(known[coded.indices.to_numpy(zero_copy_only=False)], lo, hi, self.adjacent))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) >= len(self.runs[-2][0]):
            self._merge_top()

    def _code(self, key: object) -> int:
        code = self.codes.setdefault(key, len(self.keys))
        if code == len(self.keys):
            self.keys.append(key)
        return code

    def _merge_top(self) -> None:
        b, a = self.runs.pop(), self.runs.pop()
        self.runs.append(coalesce_runs(*(np.concatenate(x) for x in zip(a, b)), self.adjacent))

    def result(self) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        while len(self.runs) > 1:
            self._merge_top()
        empty = np.array([], dtype=np.int64)
        return self.keys, *(self.runs[0] if self.runs else (empty, empty, empty))


def _combine(adjacent: int, root: bool, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = PeriodState(adjacent)
        for b in batches:
            state.update(b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))
        keys, code, lo, hi = state.result()
        names = pa.array(keys, type=key_type)
        task = TaskContext.get().partitionId() % FAN

        def rows(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: str | int) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(code), 50_000):
                j = slice(i, i + 50_000)
                tag = pa.array([kind] * len(code[j]), type=pa.string() if root else pa.int32())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(code[j])), pa.array(lo[j]), pa.array(hi[j]), tag], ["key", "lo", "hi", "tag"])

        yield from rows(code, lo, hi, "period" if root else task)
        if root and len(code) > 1:
            pair = np.flatnonzero(code[1:] == code[:-1])
            yield from rows(code[pair], hi[pair] + adjacent, lo[pair + 1] - adjacent, "gap")

    return run


def periods_and_gaps(df: DataFrame, key: str, lo: str, hi: str, adjacent: int = 1) -> DataFrame:
    """Rows ``(key, kind, lo, hi)``: each entity's continuous periods and the gaps between neighbouring ones.

    ``lo`` and ``hi`` are inclusive integers (within +-2**62). With ``adjacent=1`` a period goes on when the next one starts
    right after its end, and a gap runs from the place after the one period to the place before the next; with ``adjacent=0``
    (points on a continuous scale, such as microseconds) only touching or overlapping intervals join and a gap has the ends of
    its neighbours. Rows with a null key or bound, or with ``hi < lo``, cover nothing. Repeated rows change nothing; an empty
    table gives an empty result; other columns are ignored.
    """
    kind = df.schema[key].dataType
    key_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind.simpleString()]
    rows = df.select(F.col(key).alias("key"), F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi")).where("key is not null and lo is not null and hi is not null and lo <= hi")
    base = [T.StructField("key", kind), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]
    partial, final = (T.StructType([*base, T.StructField("tag", t)]) for t in (T.IntegerType(), T.StringType()))
    leaves = rows.mapInArrow(_combine(adjacent, False, key_type), partial)
    middle = leaves.repartition("key", "tag").mapInArrow(_combine(adjacent, False, key_type), partial)
    root = middle.repartition("key").mapInArrow(_combine(adjacent, True, key_type), final)
    return root.select(F.col("key").alias(key), F.col("tag").alias("kind"), "lo", "hi")


def entry_ranges(entries: DataFrame) -> DataFrame:
    """``(ref, first_seg, last_seg)`` of all detector ranges (page 2's on ``next_ref``) and expert cells of ruler entries."""
    spans = entries.select(F.explode("detector_span").alias("s"))
    ranges = spans.select(
        F.explode(
            F.array(
                F.struct(F.col("s.ref").alias("ref"), F.col("s.start_segment").alias("first_seg"), F.col("s.end_segment").alias("last_seg")),
                F.struct(F.col("s.next_ref").alias("ref"), F.col("s.start_segment_page2").alias("first_seg"), F.col("s.end_segment_page2").alias("last_seg")),
            )
        ).alias("r")
    ).select("r.*")
    cells = entries.select(F.explode("expert_segments").alias("c")).select(F.col("c.ref").alias("ref"), F.col("c.seg").alias("first_seg"), F.col("c.seg").alias("last_seg"))
    return ranges.unionByName(cells).where("ref is not null and trim(ref) <> ''")
