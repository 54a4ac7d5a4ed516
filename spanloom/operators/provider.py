"""Asking an outside model about rows: a pluggable provider, its outcomes, retries, and detection of spans by one.

A provider is any function from a prompt to an answer's text. The one given here is lexical and deterministic, so that queries and tests
need no network; another is handed in as an argument.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[str], str]
#: Seconds to wait before each further attempt.
WAITS = (30, 60, 120, 120)


class Refused(Exception):
    """The provider won't answer this; asking again is no use."""


def lexical(prompt: str) -> str:
    """A provider without a model: says story where the prompt's text tells of an event, else not."""
    low = prompt.lower()
    told = any(w in low for w in ("once ", " came to", "they sent", "came back", " went home", "wept"))
    return json.dumps({"verdict": "story" if told else "not", "reason": "lexical"})


def ask(rows: DataFrame, key: str, prompt: str, provider: Provider = lexical, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``(key, outcome, answer, attempts)`` for each row: ok, refused, failed (every attempt raised) or invalid (no JSON object).

    Rows with a null prompt aren't asked (outcome 'skipped'). Answers come in Arrow batches; the caller stores the result once, as
    asking again may give another answer."""
    kind = rows.schema[key].dataType
    out = f"{key} {kind.simpleString()}, outcome string, answer string, attempts int"

    def one(text: str) -> tuple[str, str | None, int]:
        for n in range(len(waits) + 1):
            try:
                answer = provider(text)
            except Refused:
                return "refused", None, n + 1
            except Exception:  # whatever a provider raises is a failed attempt
                if n < len(waits):
                    sleep(waits[n])
                continue
            try:
                fine = isinstance(json.loads(answer), dict)
            except (ValueError, TypeError):
                fine = False
            return ("ok" if fine else "invalid"), answer, n + 1
        return "failed", None, len(waits) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(t) if t is not None else ("skipped", None, 0) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], type=t) for i, t in enumerate((pa.string(), pa.string(), pa.int32())))], [key, "outcome", "answer", "attempts"])

    return rows.select(key, prompt).mapInArrow(run, out)


def runs_of(segments: DataFrame, inside: list[str]) -> DataFrame:
    """``(ref, lo, hi, n)``: unbroken runs of segments (``ref, seg, label``) with one of the labels: a first pass over kept pages."""
    from pyspark.sql import Window

    ins = segments.where(F.col("label").isin(*inside))
    run = F.col("seg") - F.row_number().over(Window.partitionBy("ref").orderBy("seg"))
    return ins.withColumn("_run", run).groupBy("ref", "_run").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi"), F.count("*").alias("n")).drop("_run")
