"""Schemas that drift between files (problem 7).

Ingestion enforces a target schema and keeps whatever doesn't fit, unknown fields and values of another type, as JSON in a
rescue column. The change report compares each file of the ingested table with the one before it in its stream: typed columns
and rescued fields together show which fields a file has and of what type. Fields that the report leads to the target's are
promoted: their rescued values are replayed into typed columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import materialize, store

#: The names of JSON value types, as problem 7 gives them, and the SQL type that a column of each has.
SQL_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "list of integers": "array<bigint>", "list of strings": "array<string>", "list of objects": "array<variant>", "object": "variant"}
#: A removed and an added field are one renamed field from this likeness of their contents on.
RENAME_LIKENESS = 0.5
#: What ``schema_of_variant`` says of a value that is of a type exactly.
EXACT = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "list of integers": "ARRAY<BIGINT>", "list of strings": "ARRAY<STRING>"}


def json_type(value: Column) -> Column:
    """The type name of a variant; null for JSON null and for an empty list, which fits every list type."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "STRING", "string")
        .when(t == "BIGINT", "integer")
        .when(t.startswith("DECIMAL") | (t == "DOUBLE") | (t == "FLOAT"), "number")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "ARRAY<BIGINT>", "list of integers")
        .when(t == "ARRAY<STRING>", "list of strings")
        .when(t.startswith("ARRAY<OBJECT"), "list of objects")
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY<") & (t != "ARRAY<VOID>"), "list of strings")
    )


def parse_lines(lines: DataFrame, raw: str) -> DataFrame:
    """``lines`` with ``_fields``, the map of the object's fields; null where ``raw`` isn't a JSON object."""
    return lines.withColumn("_fields", F.from_json(raw, "map<string,variant>"))


def _cast(value: Column, kind: str) -> Column:
    """``value`` as the column type of ``kind``, or null where that would lose or bend it.

    Truth values may be written yes and no or 1 and 0; lists as text with commas or semicolons between, as a lone value, integers
    also as a range such as 3-7 or as objects that hold one integer each and nothing else but true.
    """
    got = F.try_variant_get(value, "$", SQL_TYPES[kind])
    own = json_type(value)
    text = F.try_variant_get(value, "$", "string")
    if kind == "integer":
        return F.when(own.isin("integer", "number", "string") & (F.try_variant_get(value, "$", "double") == got), got)
    if kind == "number":
        return F.when(own.isin("integer", "number", "string"), got)
    if kind == "boolean":
        word = F.lower(F.trim(text))
        return F.when(own == "boolean", got).when(own.isin("string", "integer") & word.isin("yes", "true", "1"), True).when(own.isin("string", "integer") & word.isin("no", "false", "0"), False)
    if kind == "string":
        return F.when(own.isin("string", "integer", "number", "boolean"), got)
    if kind in ("list of integers", "list of strings"):
        whole = F.when(own.isin("list of integers", "list of strings") & ~F.exists(got, F.isnull) | (F.schema_of_variant(value) == "ARRAY<VOID>"), got)
        bare = F.regexp_replace(text, r"^\s*\[|\]\s*$|['\"]", "")
        parts = F.filter(F.transform(F.split(bare, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
        if kind == "list of strings":
            return F.when(own == "string", parts).when(own == "integer", F.array(text)).otherwise(whole)
        numbers = F.transform(parts, lambda x: x.try_cast("bigint"))
        ends = F.transform(F.split(bare, "-"), lambda x: F.trim(x).try_cast("bigint"))
        span = F.when(bare.rlike(r"^\s*\d{1,9}\s*-\s*\d{1,9}\s*$") & (F.get(ends, F.lit(0)) <= F.get(ends, F.lit(1))) & (F.get(ends, F.lit(1)) - F.get(ends, F.lit(0)) < 100_000), F.sequence(F.get(ends, F.lit(0)), F.get(ends, F.lit(1))))
        listed = F.when(own == "list of objects", F.to_json(value))
        kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(listed, r'"\w+":true', ""), r'"\w+":', ""), r",+(?=[,}])|(?<=\{),+", "")
        objects = F.when(kept.rlike(r"^\[\{-?\d{1,18}\}(,\{-?\d{1,18}\})*\]$"), F.transform(F.regexp_extract_all(kept, F.lit(r"-?\d+"), 0), lambda x: x.cast("bigint")))
        return F.when((own == "string") & ~F.exists(numbers, F.isnull), numbers).when(own == "string", span).when(own == "integer", F.array(text.try_cast("bigint"))).when(own == "list of objects", objects).otherwise(whole)
    return F.when(own == kind, got)


def _exact(value: Column, kind: str) -> Column:
    """``value`` as the column type of ``kind`` if it is of that type as it stands, else null."""
    if kind not in EXACT:
        return F.when(json_type(value) == kind, F.try_variant_get(value, "$", SQL_TYPES[kind]))
    shape = F.schema_of_variant(value)
    fits = shape == EXACT[kind]
    if not kind.startswith("list"):
        return F.when(fits, F.try_variant_get(value, "$", SQL_TYPES[kind]))
    got = F.try_variant_get(value, "$", SQL_TYPES[kind])
    return F.when((shape == "ARRAY<VOID>") & ~F.exists(got, F.isnull) | fits & ~F.exists(got, F.isnull), got)


def _json_object(fields: Column) -> Column:
    """A map of variants as JSON text in which a number, alone or in a list, that was written with a decimal point has one still."""
    point = lambda text, shape: F.when(shape.startswith("DECIMAL") & shape.endswith(",0)"), F.concat(text, F.lit(".0"))).otherwise(text)
    item = lambda v: point(F.to_json(v), F.schema_of_variant(v))
    listed = lambda v: F.concat(F.lit("["), F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), item), ","), F.lit("]"))
    name = lambda k: F.when(k.rlike(r"^[\w ]*$"), F.concat(F.lit('"'), k, F.lit('":'))).otherwise(F.concat(F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1), F.lit(":")))
    spelt = F.transform(F.map_entries(fields), lambda e: F.struct(name(e["key"]).alias("k"), e["value"].alias("v"), F.schema_of_variant(e["value"]).alias("s")))
    pairs = F.transform(spelt, lambda e: F.concat(e["k"], F.when(e["s"].startswith("ARRAY<DECIMAL"), listed(e["v"])).otherwise(point(F.to_json(e["v"]), e["s"]))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def ingest(lines: DataFrame, raw: str, target: dict[str, str], renames: dict[str, str] | None = None, exact: bool = False) -> DataFrame:
    """All lines as one table: the columns of ``lines`` but ``raw``, those of ``target`` (field -> type name), and ``_rescued``.

    ``renames`` maps names used in the files to names in ``target``; where both occur, the target's own name wins. ``_rescued``
    holds, as a JSON object, every field that isn't in ``target`` and every value that doesn't fit its type; a line that is no
    JSON object has null fields and the line itself under ``_line``. Null and absent values both give null; numbers inside rescued
    objects may lose a final ".0". A value fits if it
    can be cast without loss, or, with ``exact``, only if it is of the type as written: then the table still shows how each value
    came, and ``promote`` may cast it later. Columns of ``lines`` whose names clash with the target's are kept under ``line_<name>``.
    """
    renames = {k: v for k, v in (renames or {}).items() if v in target}
    df = parse_lines(lines, raw)
    kept = [F.col(c).alias(f"line_{c}" if c in target or c == "_rescued" else c) for c in lines.columns if c != raw]

    def source(name: str) -> Column:
        return F.coalesce(*(F.when(~F.is_variant_null(F.col("_fields")[n]), F.col("_fields")[n]) for n in [name, *(k for k, v in renames.items() if v == name)]))

    places = {name: f"_f{i}" for i, name in enumerate(target)}
    df = df.withColumns({p: source(n) for n, p in places.items()}) if target else df
    df = df.withColumns({f"{p}t": (_exact if exact else _cast)(F.col(p), target[n]) for n, p in places.items()}) if target else df
    bad = F.array_compact(F.array(*(F.when(F.isnull(f"{p}t") & F.isnotnull(p), F.lit(n)) for n, p in places.items()))) if target else F.array().cast("array<string>")
    known = F.lit([*target, *renames])
    to_target = F.create_map(*(F.lit(x) for kv in renames.items() for x in kv)) if renames else None
    df = df.withColumn("_bad", bad)
    own_name = lambda k: F.coalesce(to_target[k], k) if renames else k
    rest = F.map_filter("_fields", lambda k, v: ~F.is_variant_null(v) & (~F.array_contains(known, k) | F.array_contains(F.col("_bad"), own_name(k))))
    df = df.withColumn("_rest", rest)
    rescued = F.when(F.col("_fields").isNull() & F.col(raw).isNotNull(), F.to_json(F.struct(F.col(raw).alias("_line")))).when(F.size("_rest") > 0, _json_object(F.col("_rest")))
    return df.select(*kept, *(F.col(f"{p}t").alias(n) for n, p in places.items()), rescued.alias("_rescued"))


def promote(table: DataFrame, approved: dict[str, str], names: str | None = None) -> DataFrame:
    """Replay rescued values of the approved fields (field -> type name) into columns; what still doesn't fit stays rescued.

    ``names`` is a column of maps from names used in the row's file to approved fields (see ``approved_names``); it is dropped.
    A value under another name is placed only where the field has none under its own; of several the first that fits is.
    """
    fields = F.from_json("_rescued", "map<string,variant>")
    df = table.withColumn("_map", fields)
    typed = {n: _cast(F.col("_map")[n], k) for n, k in approved.items()}
    has = lambda n: n in table.columns and n != "_rescued"
    own = {n: F.coalesce(F.col(n), c) if has(n) else c for n, c in typed.items()}
    placed = [F.when(c.isNotNull(), F.lit(n)) for n, c in typed.items()]
    if names:
        def renamed(n: str, kind: str) -> Column:
            fits = F.filter(F.map_entries("_map"), lambda e: (F.col(names)[e["key"]] == n) & (e["key"] != n) & _cast(e["value"], kind).isNotNull())
            return F.when(own[n].isNull() & F.col("_map")[n].isNull(), F.get(fits, F.lit(0)))

        df = df.withColumns({f"_as_{n}": renamed(n, k) for n, k in approved.items()})
        own = {n: F.coalesce(c, _cast(F.col(f"_as_{n}")["value"], approved[n])) for n, c in own.items()}
        placed += [F.col(f"_as_{n}")["key"] for n in approved]
    columns = [c.alias(n) for n, c in own.items()]
    rest = F.map_filter("_map", lambda k, v: ~F.array_contains(F.col("_placed"), k))
    df = df.withColumn("_placed", F.array_compact(F.array(*placed)))
    return df.select(*(c for c in table.columns if c not in approved and c not in ("_rescued", names)), *columns, F.when(F.size(rest) > 0, _json_object(rest)).alias("_rescued"))


def approved_names(files: DataFrame, report: DataFrame, stream: str, file: str, target: list[str]) -> DataFrame:
    """``(stream, file, names)``: for each file, the names in use there that the report's renames lead to a field of the target.

    ``files`` has ``stream`` and ``file``; ``report`` is a ``change_report`` of them. A name is followed both ways through its
    stream: from the target's name on, and back from it. A name that a stream says nothing of goes by what all other streams
    agree on. Names that lead to two fields lead nowhere (``names`` has null for them): their values stay rescued. Streams are
    folded file by file, one small row each.
    """
    steps = report.where("change_kind = 'renamed'").groupBy("file_seq").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "new_name"))).alias("renames"))
    rows = files.where(F.col(stream).isNotNull() & F.col(file).isNotNull()).select(F.col(stream).alias("stream"), F.col(file).alias("file")).distinct()
    rows = rows.join(steps.withColumnRenamed("file_seq", "file"), "file", "left").select("stream", "file", F.to_json("renames").alias("renames"))
    kind = dict(files.dtypes)[file]
    fields = set(target)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("file")
        renames = [json.loads(r) if isinstance(r, str) else {} for r in rows.renames]
        onward: list[dict[str, str]] = []
        now: dict[str, str] = {}
        for step in renames:
            led = {new: old if old in fields else now.get(old) for old, new in step.items() if new not in fields}
            now = now | {k: v for k, v in led.items() if v}
            onward.append(now)
        back: list[dict[str, str]] = []
        now = {}
        for step in reversed(renames):
            back.append(now)
            led = {old: new if new in fields else now.get(new) for old, new in step.items() if old not in fields}
            now = now | {k: v for k, v in led.items() if v}
        both = [json.dumps({k: f.get(k, b.get(k)) if f.get(k, b.get(k)) == b.get(k, f.get(k)) else None for k in {**f, **b}}) for f, b in zip(onward, reversed(back))]
        return pd.DataFrame({"stream": rows.stream, "file": rows.file, "names": both})

    names = F.from_json("names", "map<string,string>")
    led = materialize(rows.groupBy("stream").applyInPandas(fold, f"stream string, file {kind}, names string").withColumn("names", names))
    said = led.select(F.explode("names").alias("name", "field")).groupBy("name").agg(F.count_distinct("field").alias("n"), F.max("field").alias("field"), F.max(F.isnull("field")).alias("torn"))
    agreed = {r["name"]: r["field"] for r in said.where("n = 1 and not torn").select("name", "field").collect()}  # names of fields only
    if agreed:
        general = F.create_map(*(F.lit(x) for kv in sorted(agreed.items()) for x in kv))
        led = led.withColumn("names", F.map_concat("names", F.map_filter(general, lambda k, v: ~F.array_contains(F.map_keys("names"), k))))
    return led.select(F.col("stream").alias(stream), F.col("file").alias(file), "names")


# --- the change report ------------------------------------------------------------------------------------------------


def _rescued_fields() -> Column:
    return F.map_entries(F.map_filter(F.from_json("_rescued", "map<string,variant>"), lambda k, v: ~F.is_variant_null(v) & (k != "_line")))


def _seen(target: dict[str, str]) -> Column:
    """What a row of an ingested table had non-null, ``array<struct<field, text>>``, from typed columns and the rescue column: each
    value's JSON, strings as they are between quotes."""

    def text(name: str, kind: str) -> Column:
        return F.concat(F.lit('"'), F.col(name), F.lit('"')) if kind == "string" else F.to_json(name) if kind.startswith("list") or kind == "object" else F.col(name).cast("string")

    typed = [F.when(F.isnotnull(n), F.struct(F.lit(n).alias("field"), text(n, k).alias("text"))) for n, k in target.items()]
    as_text = lambda v: F.coalesce(F.concat(F.lit('"'), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit('"')), F.to_json(v))
    other = F.transform(_rescued_fields(), lambda e: F.struct(e["key"].alias("field"), as_text(e["value"]).alias("text")))
    nothing = F.array().cast("array<struct<field:string,text:string>>")
    return F.concat(F.array_compact(F.array(*typed)) if typed else nothing, F.coalesce(other, nothing))


def field_types(df: DataFrame, target: dict[str, str]) -> DataFrame:
    """``(stream, file, field, type)`` of the fields that some row of an ingested table has non-null; a file without any has one row
    with a null field. Of mixed types the commonest counts (of integer and number, number); a field with empty lists only is a
    list of strings. Typed columns are counted where they stand, rescued fields are spread out first."""
    names = list(SQL_TYPES)
    counted = df.groupBy("stream", "file").agg(F.count("*").alias("_all"), *(c for i, (n, k) in enumerate(target.items()) for c in (F.count(n).alias(f"_a{i}"), (F.count_if(F.size(n) > 0) if k.startswith("list") else F.count(n)).alias(f"_n{i}"))))
    rows = [F.when(F.col(f"_a{i}") > 0, F.struct(F.lit(n).alias("field"), F.lit(k).alias("type"), F.col(f"_n{i}").alias("n"))) for i, (n, k) in enumerate(target.items())]
    nobody = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("type"), F.lit(0).cast("bigint").alias("n"))
    typed = counted.select("stream", "file", F.explode(F.array_compact(F.array(*rows, nobody))).alias("f")).select("stream", "file", "f.*")
    kinds = F.transform(_rescued_fields(), lambda e: F.struct(e["key"].alias("field"), json_type(e["value"]).alias("type")))
    kept = df.where("_rescued is not null").select("stream", "file", F.explode(kinds).alias("f")).groupBy("stream", "file", "f.field", "f.type").agg(F.count("*").alias("n"))
    each = typed.unionByName(kept).groupBy("stream", "file", "field").agg(*(F.sum(F.when(F.col("type") == t, F.col("n")).otherwise(0)).alias(f"_{i}") for i, t in enumerate(names)))
    integer, number = f"_{names.index('integer')}", f"_{names.index('number')}"
    counts = [F.struct((F.col(f"_{i}") + (F.when(F.col(number) > 0, F.col(integer)).otherwise(0) if t == "number" else F.lit(0))).alias("n"), F.lit(-i).alias("order"), F.lit(t).alias("type")) for i, t in enumerate(names)]
    best = F.greatest(*counts)
    return each.select("stream", "file", "field", F.when(best["n"] > 0, best["type"]).otherwise("list of strings").alias("type"))


def _atoms(text: Column) -> Column:
    """What a value is made of, whatever its type: small numbers, magnitudes of large ones, words in 64 classes, mixed codes.

    Fractions up to one count as hundredths, so that 0.42 and 42 are alike; truth values count as words.
    """
    bare = F.regexp_replace(text, r'"[A-Za-z_]+":', "")
    bare = F.when(text.startswith("["), F.regexp_replace(bare, r"\b(true|false|null)\b", "")).otherwise(bare)  # a flag that all list items carry says nothing
    words = F.regexp_extract_all(bare, F.lit(r"[\p{L}_]*\d+\.\d+|[\p{L}\p{N}_]+"), 0)

    def atom(w: Column) -> Column:
        number = w.cast("double")
        whole = F.when((number < 1) & w.contains("."), F.round(number * 100)).otherwise(F.floor(number)).cast("bigint")
        return (
            F.when(w.rlike(r"^\d{1,15}(\.\d+)?$"), F.when(whole < 1000, F.concat(F.lit("n"), whole.cast("string"))).otherwise(F.concat(F.lit("m"), F.length(whole.cast("string")).cast("string"))))
            .when(w.rlike(r"^(?=.*\p{L})(?=.*\p{N})[\p{L}\p{N}]{4,}$"), F.concat(F.lit("id"), F.length(w).cast("string")))
            .otherwise(F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lower(F.when(w == "true", "yes").when(w == "false", "no").otherwise(w))), F.lit(64)).cast("string")))
        )

    return F.transform(words, atom)


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}.\-])\d{1,12}(\.\d+)?(?![\p{L}\p{N}])"), 0), lambda w: w.cast("double"))


#: A row of evidence: of a field of one side of a step, an atom or another field (``what`` 'atom', 'order'; 'gone' names a field that
#: is asked about, 'value' counts its values) with its number and, of fields, how often this one's numbers are below, the same, above.
EVIDENCE = ["side", "field", "other", "what", "n", "below", "same", "above"]


def _evidence(seen: Column, asked: Column) -> Column:
    """The evidence that one row gives on the ``asked`` fields: their atoms, and their order towards the row's other numbers."""
    row = lambda field, other, what, *n: F.struct(field.alias("field"), other.alias("other"), F.lit(what).alias("what"), *(x.cast("double").alias(c) for x, c in zip([*n, *[F.lit(0)] * (4 - len(n))], EVIDENCE[4:])))
    own = F.filter(seen, lambda e: F.array_contains(asked, e["field"]))
    one = F.lit(1)
    atoms = F.flatten(F.transform(own, lambda e: F.concat(F.array(row(e["field"], F.lit(""), "value", one)), F.transform(F.coalesce(F.nullif(_atoms(e["text"]), F.array().cast("array<string>")), F.array(F.lit("")).cast("array<string>")), lambda a: row(e["field"], a, "atom", one)))))
    at = F.filter(F.transform(seen, lambda e: F.struct(e["field"].alias("field"), _numbers(e["text"]).alias("at"))), lambda e: F.size(e["at"]) > 0)
    spots = F.transform(at, lambda e: F.struct(e["field"].alias("field"), F.array_min(e["at"]).alias("lo"), F.array_max(e["at"]).alias("hi")))
    same = lambda f, g: (f["lo"] == g["lo"]).cast("int") + (f["hi"] == g["hi"]).cast("int")
    order = lambda f, g: row(f["field"], g["field"], "order", one, (f["lo"] <= g["lo"]).cast("int"), same(f, g), (f["hi"] >= g["hi"]).cast("int"))
    orders = F.flatten(F.transform(F.filter(spots, lambda f: F.array_contains(asked, f["field"])), lambda f: F.transform(F.filter(spots, lambda g: f["field"] != g["field"]), lambda g: order(f, g))))
    return F.concat(atoms, orders)


def best_pairs(value: dict[tuple[str, str], float], left: list[str], right: list[str]) -> dict[str, str]:
    """The pairs of ``left`` and ``right``, each in one at most, whose values (those that aren't given are none) sum to the most.

    An assignment by shortest augmenting paths, in cubic time; each of ``left`` may stay alone at no cost.
    """
    n, m = len(left), len(right) + len(left)
    cost = [[-value.get((f, g), 0.0) for g in right] + [0.0] * n for f in left]
    u, v, holder = [0.0] * n, [0.0] * m, [-1] * m
    for i in range(n):
        least, before, done = [float("inf")] * m, [-1] * m, [False] * m
        row, at = i, -1
        while True:
            delta, step = float("inf"), -1
            for j in range(m):
                if not done[j]:
                    if (c := cost[row][j] - u[row] - v[j]) < least[j]:
                        least[j], before[j] = c, at
                    if least[j] < delta:
                        delta, step = least[j], j
            u[i] += delta
            for j in range(m):
                if done[j]:
                    u[holder[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            done[step], at = True, step
            if holder[step] < 0:
                break
            row = holder[step]
        while at >= 0:
            holder[at] = holder[before[at]] if before[at] >= 0 else i
            at = before[at]
    return {left[i]: right[j] for j, i in enumerate(holder[: len(right)]) if i >= 0 and (left[i], right[j]) in value}


def match_fields(rows: Iterable[tuple], yes_no: set[str], likeness: float) -> dict[str, str]:
    """The renamed fields of one step, from its rows of ``EVIDENCE``: removed fields with added ones, chosen together for the most likeness.

    First the assignment with the most likeness of contents; then, as long as the whole gets likelier, pairs swap partners, take
    a free one, part or come in, so that fields keep their order towards each other as well.
    """
    sides: dict[str, tuple[list, dict, dict, dict]] = {s: ([], {}, {}, {}) for s in ("old", "new")}
    for side, field, other, what, n, below, same, above in rows:
        fields, bags, counts, relations = sides[side]
        if what == "gone":
            fields.append(field)
        elif what == "value":
            counts[field] = n
        elif what == "atom":
            bags.setdefault(field, {})[other] = n
        elif n >= 3:
            relations[field, other] = (below / n, same / n, above / n)
    (removed, a_bags, a_counts, a_rel), (added, z_bags, z_counts, z_rel) = sides["old"], sides["new"]
    removed, added = sorted(set(removed)), sorted(set(added))
    # how many atoms a value has, on average; a value without any counts as one, and leaves no mark in the bag
    a_many, z_many = ({f: sum(bags.get(f, {}).values()) / n for f, n in counts.items()} for bags, counts in ((a_bags, a_counts), (z_bags, z_counts)))
    for bags in (a_bags, z_bags):
        for bag in bags.values():
            bag.pop("", None)

    def size_of(atom: str) -> float | None:
        """The number that an atom stands for, if any."""
        return float(atom[1:]) if atom[0] == "n" else 10.0 ** int(atom[1:]) if atom[0] == "m" and atom[1:].isdigit() else None

    def alike(f: str, g: str) -> float:
        """The share of content in common: words and codes by their frequencies, numbers by their distributions, less the
        largest distance that chance alone often makes between distributions of so few values."""
        p, q = a_bags.get(f), z_bags.get(g)
        if not p or not q:
            return 0.0
        if set(p) <= yes_no and set(q) <= yes_no:
            return 1.0
        totals = sum(p.values()), sum(q.values())
        words = sum(min(v / totals[0], q[k] / totals[1]) for k, v in p.items() if k in q and size_of(k) is None)
        numbers = [{x: n for k, n in bag.items() if (x := size_of(k)) is not None} for bag in (p, q)]
        counts = [sum(x.values()) for x in numbers]
        if not all(counts):
            return words
        below, apart = [0.0, 0.0], 0.0
        for x in sorted({*numbers[0], *numbers[1]}):
            below = [b + side.get(x, 0.0) / n for b, side, n in zip(below, numbers, counts)]
            apart = max(apart, abs(below[0] - below[1]))
        rows = [n / max(1.0, m.get(x, 1.0)) for n, m, x in zip(counts, (a_many, z_many), (f, g))]
        chance = 0.8 * (1 / rows[0] + 1 / rows[1]) ** 0.5
        return words + min(counts[0] / totals[0], counts[1] / totals[1]) * (1 - max(0.0, apart - chance))

    def kin(f: str, g: str) -> float:
        grams = [{w[i : i + 3] for i in range(max(1, len(w) - 2))} for w in (f.lower(), g.lower())]
        return len(grams[0] & grams[1]) / max(1, min(map(len, grams)))

    def bearing(f: str, g: str, with_: Iterable[tuple[str, str]]) -> float:
        """How far the orders of ``f`` and ``g`` towards other fields (stable ones, or ones paired already) differ, 0 to 1."""
        off = [max(abs(x - y) for x, y in zip(a_rel[f, s], z_rel[g, t])) for s, t in with_ if (f, s) in a_rel and (g, t) in z_rel]
        return sum(off) / len(off) if off else 0.0

    def unlike_size(f: str, g: str) -> float:
        """A list of several items isn't the same content as a lone value."""
        a, z = a_many.get(f, 1.0), z_many.get(g, 1.0)
        return 1.0 if min(a, z) < 1.3 and max(a, z) > 1.7 else 0.0

    stable = [(s, s) for s in sorted({f for _, f in a_rel} & {f for _, f in z_rel} - set(removed) - set(added))]
    own: dict[tuple[str, str], float] = {}
    for f in removed:
        for g in added:
            if (share := alike(f, g)) >= likeness and (v := share + 0.1 * kin(f, g) - 0.5 * bearing(f, g, stable) - unlike_size(f, g)) > 0:
                own[f, g] = v

    def worth(pairs: dict[str, str]) -> float:
        return sum(own[p] for p in pairs.items()) - sum(0.5 * bearing(f, g, (p for p in pairs.items() if p != (f, g))) for f, g in pairs.items())

    def moves(pairs: dict[str, str]) -> Iterator[dict[str, str]]:
        taken = set(pairs.values())
        for f, g in own:
            if f in pairs and pairs[f] != g:
                other = next((x for x, y in pairs.items() if y == g), None)
                if other is None:
                    yield pairs | {f: g}
                elif (other, pairs[f]) in own:
                    yield pairs | {f: g, other: pairs[f]}
            elif f not in pairs:
                yield {x: y for x, y in pairs.items() if y != g} | {f: g} if g in taken else pairs | {f: g}
        for f in pairs:
            yield {x: y for x, y in pairs.items() if x != f}

    best = best_pairs(own, removed, added)
    top, better = worth(best), bool(best)
    while better:
        better = False
        for pairs in moves(best):
            if (w := worth(pairs)) > top + 1e-9:
                best, top, better = pairs, w, True
                break
    return best


def _match(kind: pa.DataType, yes_no: set[str], likeness: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evidence comes sorted by step; a step's rows are few, as atoms come in classes."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    out: list[tuple] = []
    for (stream, step), own in groupby(rows(), key=lambda r: r[:2]):
        if names := match_fields((r[2:] for r in own), yes_no, likeness):
            out.append((stream, step, list(names.items())))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], type=pa.string()), pa.array([r[1] for r in out], type=kind), pa.array([r[2] for r in out], type=pa.map_(pa.string(), pa.string()))], ["stream", "file", "names"])


def change_report(table: DataFrame, stream: str, file: str, target: dict[str, str], likeness: float = RENAME_LIKENESS) -> DataFrame:
    """Rows ``(file_seq, change_kind, field_name, new_name)`` of every change of every file against the one before it.

    ``table`` is ingested with ``exact``, so that typed columns and rescued fields show every value as it was written.
    Kinds are added, removed, renamed (old name, new name) and retyped (name in the new file). A removed and an added field
    count as renamed if their contents are alike whatever their types: the same values, words or kinds of code, and the same
    order towards the row's other numbers; pairs are chosen together, each field in one at most. Lines that are no JSON
    object (or have a field ``_line``) and null streams or files are passed over; lines delivered twice change nothing. An empty
    table gives none.
    """
    df = table.select(F.col(stream).cast("string").alias("stream"), F.col(file).alias("file"), *(F.col(n) for n in target), "_rescued").where("stream is not null and file is not null").where(F.coalesce(~F.col("_rescued").startswith('{"_line":'), F.lit(True)))
    types = field_types(df, target)
    now = F.map_from_entries(F.array_compact(F.collect_list(F.when(F.isnotnull("field"), F.struct("field", "type")))))  # a file may have no field at all
    per_file = types.groupBy("stream", "file").agg(now.alias("now"))
    line_up = Window.partitionBy("stream").orderBy("file")
    steps = per_file.withColumn("prior", F.lag("file").over(line_up)).withColumn("before", F.lag("now").over(line_up)).where("prior is not null")
    gone, new = F.array_except(F.map_keys("before"), F.map_keys("now")), F.array_except(F.map_keys("now"), F.map_keys("before"))
    steps = materialize(steps.withColumn("gone", gone).withColumn("new", new))

    # only files in which something went and something came are looked at for renames
    open_ = steps.where((F.size("gone") > 0) & (F.size("new") > 0))
    sides = open_.select(F.col("prior").alias("file"), "stream", F.col("file").alias("step"), F.lit("old").alias("side"), F.col("gone").alias("asked")).unionByName(open_.select("file", "stream", F.col("file").alias("step"), F.lit("new").alias("side"), F.col("new").alias("asked")))
    given = df.join(sides, ["stream", "file"]).select("stream", "step", "side", "asked", _seen(target).alias("seen")).select("stream", "step", "side", F.explode(_evidence(F.col("seen"), F.col("asked"))).alias("e")).select("stream", "step", "side", "e.*")
    counted = given.groupBy("stream", "step", "side", "field", "other", "what").agg(*(F.sum(c).alias(c) for c in EVIDENCE[4:]))
    asked = sides.select("stream", "step", "side", F.explode("asked").alias("field"), F.lit("").alias("other"), F.lit("gone").alias("what"), *(F.lit(0.0).alias(c) for c in EVIDENCE[4:]))
    truth = table.sparkSession.range(1).select(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(64)) for w in ("yes", "no"))).first()
    yes_no = {f"w{x}" for x in truth} | {"n0", "n1"}
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    evidence = counted.unionByName(asked).select("stream", "step", *EVIDENCE).repartition(parts, "stream", "step").sortWithinPartitions("stream", "step", "side", "what", "field", "other")
    kind = dict(df.dtypes)["file"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    renamed = evidence.mapInArrow(partial(_match, arrow, yes_no, likeness), f"stream string, file {kind}, names map<string,string>")
    none = F.create_map().cast("map<string,string>")
    steps = steps.join(renamed, ["stream", "file"], "left").withColumn("names", F.coalesce("names", none))

    def change(name: str, of: Column, to: Column) -> Column:
        return F.struct(F.lit(name).alias("change_kind"), of.alias("field_name"), to.alias("new_name"))

    blank_name = F.lit("")
    changes = F.concat(
        F.transform(F.array_except("gone", F.map_keys("names")), lambda f: change("removed", f, blank_name)),
        F.transform(F.array_except("new", F.map_values("names")), lambda f: change("added", f, blank_name)),
        F.transform(F.map_entries("names"), lambda e: change("renamed", e["key"], e["value"])),
        F.transform(F.filter(F.map_entries("names"), lambda e: F.col("before")[e["key"]] != F.col("now")[e["value"]]), lambda e: change("retyped", e["value"], blank_name)),
        F.transform(F.filter(F.map_keys("now"), lambda f: F.col("before")[f] != F.col("now")[f]), lambda f: change("retyped", f, blank_name)),
    )
    return steps.select(F.col("file").alias("file_seq"), F.explode(changes).alias("c")).select("file_seq", "c.*")


def consistent_table(lines: DataFrame, stream: str, file: str, raw: str, target: dict[str, str], approved: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """All lines under the target schema, and the report of every change (see ``change_report``), from one ingestion.

    Lines are ingested as written and stored; the report is read off that table; its renames lead names, file by file, to fields of
    the target and to ``approved`` ones that the rescue column has kept so far. Rescued values under these names are replayed into
    typed columns, as are values of other types that can be cast without loss.
    """
    whole = target | approved
    table = store(ingest(lines, raw, target, exact=True))
    report = change_report(table, stream, file, target)
    names = approved_names(table, report, stream, file, list(whole))
    return promote(table.join(names, [stream, file], "left"), whole, "names"), report
