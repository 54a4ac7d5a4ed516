"""Finding passages in a corpus, and passages that texts share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from spanloom.runtime import materialize, store


def spaced(c: Column) -> Column:
    """Lower-case words of a text without tags, joined by blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, "<[^>]+>", " ")), r"[^\p{L}\p{M}\p{N}]+", " "))


def words(c: Column) -> Column:
    """Lower-case words of a text without tags."""
    bare = spaced(c)
    return F.when(bare == "", F.expr("array()").cast("array<string>")).otherwise(F.split(bare, " "))


def shingles(w: Column, n: int) -> Column:
    """All runs of ``n`` words, in order; none when there are fewer words. ``w`` must be a plain column: it is read once per run."""
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.expr("array()").cast("array<string>"))


def containment(needle: Column, hay: Column, n: int = 4) -> Column:
    """The share of the needle's runs of ``n`` words that the other text has; null when the needle is too short. Plain columns of words."""
    a = F.array_distinct(shingles(needle, n))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, shingles(hay, n))) / F.size(a))


def locate(queries: DataFrame, corpus: DataFrame, n: int = 6, gap: int = 5) -> DataFrame:
    """``(id, group, first_pos, last_pos, anchors)``: where in its group's running text each query stands.

    ``queries`` has ``id, group, text``; ``corpus`` has ``group, pos, text``, one row per segment in order of ``pos``. Anchors are
    runs of ``n`` words that a group's corpus has in just one segment; a query's anchors are cut into runs wherever they lie
    more than ``gap`` segments apart, and the run with the most anchors counts (ties: the earliest). Queries without anchors
    don't come. Both sides meet by hashed shingles; repeated rows change nothing. Runs over the end of a segment aren't seen:
    ``locate_exact`` takes the running text.
    """
    spelt = corpus.where("pos is not null").select("group", "pos", words(F.col("text")).alias("w"))
    where = spelt.select("group", "pos", F.explode(F.array_distinct(shingles(F.col("w"), n))).alias("s")).select("group", "pos", F.xxhash64("s").alias("h"), "s").distinct()
    unique = where.groupBy("group", "h", "s").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).where("n = 1").select("group", "h", "s", "pos")
    asked = queries.select("id", "group", words(F.col("text")).alias("w")).select("id", "group", F.explode(F.array_distinct(shingles(F.col("w"), n))).alias("s")).select("id", "group", F.xxhash64("s").alias("h"), "s").distinct()
    hits = asked.join(unique, ["group", "h", "s"]).groupBy("id", "group", "pos").agg(F.count("*").alias("k"))
    order = Window.partitionBy("id", "group").orderBy("pos")
    runs = hits.withColumn("_new", F.coalesce((F.col("pos") - F.lag("pos").over(order) > gap).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(order))
    each = runs.groupBy("id", "group", "run").agg(F.sum("k").alias("anchors"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    best = each.groupBy("id", "group").agg(F.max(F.struct(F.col("anchors"), (-F.col("first_pos")).alias("o"), F.col("first_pos"), F.col("last_pos"))).alias("b"))
    return best.select("id", "group", "b.first_pos", "b.last_pos", "b.anchors")


def _run_key(s: Column) -> Column:
    """A hash of a group's run of words, wide enough to stand for it."""
    return F.struct(F.xxhash64("group", s).alias("a"), F.hash("group", F.reverse(s)).alias("b"))


def running_shingles(corpus: DataFrame, n: int) -> DataFrame:
    """``(h, p, pos, end_pos)``: each run of ``n`` words of each group's running text, over the ends of segments too.

    ``h`` is the key of group and run, ``p`` the place of its first word in the running text, ``pos`` and ``end_pos`` the segments of
    its first and last word. Only the lengths and first words of segments are brought into order, not their texts; different
    texts of one segment follow one another.
    """
    whole = corpus.where("pos is not null and text is not null").groupBy("group", "pos").agg(F.concat_ws(" ", F.array_sort(F.collect_set("text"))).alias("text"))
    spelt = whole.select("group", "pos", words(F.col("text")).alias("w")).where("size(w) > 0")
    in_order = Window.partitionBy("group").orderBy("pos")
    brief = spelt.select("group", "pos", F.size("w").cast("bigint").alias("k"), F.array_join(F.slice("w", 1, n - 1), " ").alias("head"))
    brief = brief.withColumn("start", F.sum("k").over(in_order) - F.col("k")).withColumn("next", F.collect_list(F.struct("head", "pos")).over(in_order.rowsBetween(1, n - 1))).drop("head")
    spread = F.flatten(F.transform("next", lambda x: F.transform(F.split(x["head"], " "), lambda w: F.struct(w.alias("w"), x["pos"].alias("pos")))))
    full = spelt.join(brief, ["group", "pos"]).withColumn("next", F.slice(spread, 1, n - 1))
    full = full.select("group", "pos", "start", "k", "next", F.concat("w", F.transform("next", lambda x: x["w"])).alias("w"))
    runs = full.select("group", "pos", "start", "k", "next", F.posexplode(shingles(F.col("w"), n)).alias("i", "s"))
    over = (F.col("i") + n - 1 - F.col("k")).cast("int")
    return runs.select(_run_key(F.col("s")).alias("h"), (F.col("start") + F.col("i")).alias("p"), "pos", F.when(over < 0, F.col("pos")).otherwise(F.get("next", over)["pos"]).alias("end_pos"))


def locate_exact(queries: DataFrame, corpus: DataFrame, n: int = 6, gap: int = 500, slack_floor: int = 25, slack_part: float = 0.25) -> DataFrame:
    """``(id, group, first_pos, last_pos, anchors, coverage)``: where in its group's running text each query stands, by exact runs.

    Inputs are those of ``locate``. Anchors are runs of ``n`` words that occur once in the running text. In the query's order they are
    cut wherever the text jumps on by more than ``gap`` words, and the largest part counts (ties: the first); then once more in
    the text's order. The upper median of text place less query place says where the query lies; every run of the query, unique or
    not, that stands within max(``slack_floor``, ``slack_part`` of the query's words) of where it should is placed and
    widens the extent. ``coverage`` is the share of placed runs. Queries without anchors don't come.
    """
    asked = queries.where("id is not null and text is not null").groupBy("id", "group").agg(F.min("text").alias("text")).select("id", "group", words(F.col("text")).alias("w")).where(F.size("w") >= n)
    asked = asked.select("id", "group", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), n)).alias("i", "s"))
    asked = store(asked.select("id", "group", "size", "i", _run_key(F.col("s")).alias("h")))
    known = store(running_shingles(corpus, n).join(asked.select("h").distinct(), "h", "left_semi"))
    unique = known.groupBy("h").agg(F.count("*").alias("k"), F.min(F.struct("p", "pos", "end_pos")).alias("at")).where("k = 1").select("h", "at")

    def largest(anchors: DataFrame, *order: str) -> DataFrame:
        by = Window.partitionBy("id", "group").orderBy(*order)
        cut = anchors.withColumn("_new", F.coalesce((F.col("at.p") - F.lag("at.p").over(by) > gap).cast("int"), F.lit(0))).withColumn("_run", F.sum("_new").over(by))
        sized = cut.withColumn("anchors", F.count("*").over(Window.partitionBy("id", "group", "_run")))
        top = F.max(F.struct("anchors", -F.col("_run"))).over(Window.partitionBy("id", "group"))
        return sized.withColumn("_top", top).where(F.struct("anchors", -F.col("_run")) == F.col("_top")).drop("_new", "_run", "_top")

    cluster = largest(largest(asked.join(unique, "h").select("id", "group", "size", "i", "at"), "i").drop("anchors"), "at.p", "i")
    offsets = F.array_sort(F.collect_list(F.col("at.p") - F.col("i")))
    found = cluster.groupBy("id", "group", "size").agg(F.max("anchors").alias("anchors"), F.min("at").alias("first"), offsets.alias("o"))
    slack = F.greatest(F.lit(slack_floor), F.floor(slack_part * F.col("size")))
    found = materialize(found.select("id", "group", "size", "anchors", "first", F.get("o", (F.size("o") / 2).cast("int")).alias("offset"), slack.cast("bigint").alias("slack")))
    # runs meet by where they should stand, too, so that a formula isn't paired with all its places
    wide = 256
    due = asked.select("id", "group", "i", "h").join(found.select("id", "group", "offset", "slack"), ["id", "group"]).withColumn("due", F.col("i") + F.col("offset"))
    due = due.withColumn("part", F.explode(F.sequence(F.floor((F.col("due") - F.col("slack")) / wide), F.floor((F.col("due") + F.col("slack")) / wide))))
    near = due.join(known.withColumn("part", F.floor(F.col("p") / wide)), ["h", "part"]).where(F.abs(F.col("p") - F.col("due")) <= F.col("slack"))
    placed = near.groupBy("id", "group").agg(F.count_distinct("i").alias("placed"), F.min(F.struct("p", "pos")).alias("lo"), F.max(F.struct("p", "end_pos")).alias("hi"))
    both = found.join(placed, ["id", "group"], "left")
    lo = F.least(F.struct(F.col("first.p").alias("p"), F.col("first.pos").alias("pos")), "lo")
    hi = F.greatest(F.struct(F.col("first.p").alias("p"), F.col("first.end_pos").alias("end_pos")), "hi")
    return both.select("id", "group", lo["pos"].alias("first_pos"), hi["end_pos"].alias("last_pos"), "anchors", F.round(F.coalesce("placed", F.lit(0)) / (F.col("size") - n + 1), 6).alias("coverage"))


def shared_passages(docs: DataFrame, n: int = 5, common: int = 4, least: int = 8, share: float = 0.3) -> DataFrame:
    """``(a, b, shared, overlap)``: pairs of different texts that share passages, a < b by class id.

    ``docs`` has ``id, group, text``. Texts with the same words form a class, named by its least id, and only classes are
    compared, so copies are never paired. A passage is a run of ``n`` words; one that more than ``common`` classes have is a
    formula and says nothing, whatever the size of the corpus. Classes need ``least`` telling passages; ``overlap`` is the number
    shared over the smaller number, at least ``share``. Classes that are of the same group only aren't compared.
    """
    classes = text_classes(docs)
    one = classes.where("id = class").select("class", "group", F.split("words", " ").alias("w"))
    runs = materialize(one.select("class", "group", F.explode(F.array_distinct(shingles(F.col("w"), n))).alias("s")).select("class", "group", F.xxhash64("s", F.reverse("s")).alias("h")))
    telling = materialize(_few(runs, common))
    size = telling.select(F.explode("in").alias("c")).groupBy(F.col("c.class").alias("class")).agg(F.count("*").alias("size")).where(F.col("size") >= least)
    pairs = telling.where(F.size("in") > 1).select(F.explode("in").alias("x"), "in").select("x", F.explode("in").alias("y")).where("x.class < y.class and not (x.group <=> y.group)")
    both = pairs.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    sized = both.join(size.select(F.col("class").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("class").alias("b"), F.col("size").alias("nb")), "b")
    return sized.select("a", "b", "shared", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap")).where(F.col("overlap") >= share)


def _few(runs: DataFrame, common: int) -> DataFrame:
    """Shingles of at most ``common`` classes, with those classes: lists are only collected where they are known to be short."""
    counted = runs.groupBy("h").agg(F.count("*").alias("_n")).where(F.col("_n") <= common).select("h")
    return runs.join(counted, "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_list(F.struct("class", "group"))).alias("in"))


def text_classes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``words`` (joined by blanks) and ``class``: the least id that has the same words. Texts without words have none."""
    w = docs.where("id is not null").withColumn("words", F.array_join(words(F.coalesce("text", F.lit(""))), " ")).where("words <> ''")
    first = w.groupBy("words").agg(F.min("id").alias("class"))
    return w.join(first, "words")


def locate_fuzzy(queries: DataFrame, corpus: DataFrame, n: int = 4, seeds: int = 12, back: int = 6, width: int = 14, enough: float = 0.97, part: int = 1 << 20) -> DataFrame:
    """``(id, group, first_pos, last_pos, coverage)``: the stretch of a group's segments that holds most of a query's word runs.

    Each segment gets a vote for every run of ``n`` words it shares with the query; stretches start up to ``back`` segments before
    one of the ``seeds`` segments with most votes and are up to ``width`` long. The best coverage wins, of equal ones the
    shortest, then the earliest stretch; a stretch isn't widened past ``enough``. For every start the coverage of all lengths
    comes from one running count over where each run first occurs.

    Queries and segments that share a run are far more than either, and grow with both: those pairs are never rows. A group's
    segments are cut by ``pos`` into parts of ``part`` characters (up to 16 times that where there are many), its queries by id into
    blocks, and each block meets each part as texts; what leaves is the ``seeds`` best segments of the part for each query, with the best
    stretch from each, of which the best of all parts are then taken. Parts overlap by what stretches need; they are as even as positions are.
    """
    text = store(corpus.where("pos is not null and text is not null").select("group", "pos", spaced(F.col("text")).alias("text"))).where("text <> ''")
    asked = store(queries.where("id is not null and text is not null").select("id", "group", spaced(F.col("text")).alias("text"))).where("text <> ''")
    held = text.groupBy("group").agg(F.sum(F.length("text")).alias("_size"), F.min("pos").cast("bigint").alias("_lo"), F.max("pos").cast("bigint").alias("_hi"))
    sought = asked.groupBy("group").agg(F.ceil(F.sum(F.length("text")) / (8 * part)).alias("_blocks"))
    parts = F.ceil(F.col("_size") / F.least(F.greatest(F.col("_size") / 16, F.lit(part)), F.lit(16 * part)))
    wide = F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) / parts), F.lit(back + width).cast("bigint"))
    grid = store(held.join(sought, "group").select("group", "_lo", wide.alias("_wide"), "_blocks", F.expr("_hi - _lo").alias("_span")).withColumn("_last", F.expr("_span div _wide")).drop("_span"))
    reach = F.sequence(F.expr(f"greatest((pos - _lo - {width - 1}) div _wide, 0L)"), F.expr(f"least((pos - _lo + {back}) div _wide, _last)"))
    near = text.join(grid, "group").select("group", "pos", "text", "_blocks", F.expr("(pos - _lo) div _wide").alias("_own"), F.explode(reach).alias("_part"))
    near = near.select("group", F.explode(F.expr("sequence(0L, _blocks - 1)")).alias("_block"), "_part", F.col("pos").cast("bigint").alias("pos"), (F.col("_own") == F.col("_part")).alias("own"), "text")
    ask = asked.join(grid, "group").select("group", F.expr("pmod(xxhash64(id), _blocks)").alias("_block"), F.explode(F.expr("sequence(0L, _last)")).alias("_part"), "id", "text")
    keys = ("group", "_block", "_part")
    best = ArrayType(StructType.fromDDL("fewer bigint, pos bigint, coverage double, short bigint, early bigint"))
    schema = StructType([StructField("id", queries.schema["id"].dataType), StructField("group", queries.schema["group"].dataType), StructField("best", best)])
    met = ask.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(lambda a, b: _stretches(a, b, n, seeds, back, width, enough), schema)
    top = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, seeds)
    pick = met.groupBy("id", "group").agg(F.array_max(F.transform(top, lambda x: F.struct(x["coverage"].alias("coverage"), x["short"].alias("short"), x["early"].alias("early")))).alias("p"))
    kind = corpus.schema["pos"].dataType
    return pick.select("id", "group", (-F.col("p.early")).cast(kind).alias("first_pos"), (-F.col("p.early") - F.col("p.short")).cast(kind).alias("last_pos"), "p.coverage")


def _numbered_runs(asked, held, n: int):
    """``((row, number), (row, number))`` of all runs of ``n`` words of two columns of spaced texts; equal runs have equal numbers, and
    those of the second column that the first lacks are left out. Numbers are exact: longer runs are pairs of a shorter one and a word."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = [pc.split_pattern(c, " ") for c in (asked, held)]
    flat = pa.chunked_array([x.flatten() for c in lists for x in c.chunks]).dictionary_encode()
    word = np.concatenate([x.indices.to_numpy() for x in flat.chunks]).astype(np.int64)
    row = [np.repeat(np.arange(len(c)), pc.list_value_length(c).to_numpy()) for c in lists]
    word = np.split(word, [len(row[0])])
    many = int(word[0].max()) + 1  # the first column's words have the first numbers
    at = [np.arange(len(word[0])), np.flatnonzero(word[1] < many)]
    run = [word[0], word[1][at[1]]]
    for k in range(1, n):
        for i in (0, 1):
            end = at[i] + k
            inside = end < len(row[i])
            inside[inside] = row[i][end[inside]] == row[i][at[i][inside]]
            inside[inside] = word[i][end[inside]] < many
            at[i] = at[i][inside]
            run[i] = run[i][inside] * many + word[i][at[i] + k]
        known, run[0] = np.unique(run[0], return_inverse=True)
        found = np.searchsorted(known, run[1])
        same = found < len(known)
        same[same] = known[found[same]] == run[1][same]
        at[1], run[1] = at[1][same], found[same]
    return tuple((row[i][at[i]], run[i]) for i in (0, 1))


def _stretches(asked, held, n: int, seeds: int, back: int, width: int, enough: float, batch: int = 1 << 18):
    """For ``locate_fuzzy``: ``(id, group, best)`` for the queries of a block and the segments of a part, which are Arrow tables.

    Work goes in batches of queries with ``batch`` hits, one hit for each run of a query and each place that has it. Of the possible starts
    only those at hits count: from a place between two hits a stretch ends sooner and holds no more."""
    import numpy as np
    import pyarrow as pa

    out = pa.schema([("id", asked.schema.field("id").type), ("group", asked.schema.field("group").type), ("best", pa.list_(pa.struct([("fewer", pa.int64()), ("pos", pa.int64()), ("coverage", pa.float64()), ("short", pa.int64()), ("early", pa.int64())])))])
    if not asked.num_rows or not held.num_rows:
        return out.empty_table()

    def starts_of(a):
        return np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])

    def spread(first, count):
        """The places from each of ``first`` on, ``count`` of each."""
        return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)

    (a_row, a_run), (b_row, b_run) = _numbered_runs(asked["text"], held["text"], n)
    names = asked["id"].combine_chunks().dictionary_encode()
    place, at = np.unique(held["pos"].to_numpy(), return_inverse=True)
    own = np.zeros(len(place), bool)
    own[at] = held["own"].to_numpy()
    places, runs = len(place), int(a_run.max(initial=-1)) + 1
    posted = np.unique(b_run * places + at[b_row])
    where, posted = posted % places, posted // places
    begin = np.searchsorted(posted, np.arange(runs + 1))
    query, run = np.divmod(np.unique(names.indices.to_numpy().astype(np.int64)[a_row] * max(runs, 1) + a_run), max(runs, 1))
    size = np.bincount(query, minlength=len(names.dictionary))
    bits = int(size.max(initial=1)).bit_length()
    nth = np.arange(len(query)) - (np.cumsum(size) - size)[query]
    count = np.diff(begin)[run]
    hit_so_far = np.r_[0, np.cumsum(count)]
    first_of = np.r_[0, np.cumsum(size)]
    cuts = first_of[np.r_[starts_of(hit_so_far[first_of[:-1]] // batch), len(size)]]
    done = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if not count[lo:hi].sum():
            continue
        c, q0 = count[lo:hi], query[lo]
        hits = np.repeat((((query[lo:hi] - q0) * places) << bits) + nth[lo:hi], c) + (where[spread(begin[run[lo:hi]], c)] << bits)
        hits.sort()
        at_spot = hits >> bits
        first = starts_of(at_spot)  # spots: places of a query with hits, in order
        spot, first = at_spot[first], np.r_[first, len(hits)]
        votes = np.diff(first)
        q, p = np.divmod(spot, places)
        # seeds
        mine = own[p]
        sated = np.bincount(q[mine & (votes > 1)], minlength=q[-1] + 1) >= seeds
        mine &= (votes > 1) | ~sated[q]  # where enough places have more, those with one vote are no seeds
        top = int(votes.max())
        key = (q[mine] * (top + 1) + top - votes[mine]) * places + p[mine]
        if not len(key):
            continue
        key.sort()
        by = starts_of(key // ((top + 1) * places))
        key = key[spread(by, np.minimum(np.diff(np.r_[by, len(key)]), seeds))]
        seed = np.searchsorted(spot, key // ((top + 1) * places) * places + key % places)
        # starts: spots up to ``back`` before a seed
        pos = place[p]
        before = np.maximum(seed[:, None] - np.arange(back + 1), 0)  # the first spot again does no harm
        ok = (q[before] == q[seed][:, None]) & (pos[before] >= pos[seed][:, None] - back)
        of, start = np.nonzero(ok)[0], before[ok]
        start, e = np.unique(start, return_inverse=True)
        after = np.minimum(start[:, None] + np.arange(width), len(spot) - 1)
        spots = ((start[:, None] + np.arange(width) < len(spot)) & (q[after] == q[start][:, None]) & (pos[after] < pos[start][:, None] + width)).sum(1)
        # where each run first occurs from there on
        c = first[start + spots] - first[start]
        i = spread(first[start], c)
        stretch = np.repeat(np.arange(len(start)), c)
        step = np.repeat(np.arange(len(spot)), votes)[i] - start[stretch]
        key = ((stretch << bits) + (hits[i] & ((1 << bits) - 1))) * width + step
        key.sort()
        key = key[starts_of(key // width)]
        new = np.bincount(((key // width) >> bits) * width + key % width, minlength=len(start) * width).reshape(-1, width)
        total = size[q[start] + q0][:, None]
        coverage = (2_000_000 * new.cumsum(1) + total) // (2 * total) / 1e6  # rounded half up, as Spark rounds
        full = coverage >= enough
        end = np.where(full.any(1), full.argmax(1), coverage.argmax(1))
        got, begun, ended = coverage[np.arange(len(start)), end], pos[start], pos[start + end]
        # of each seed the best start
        order = np.lexsort((begun[e], (ended - begun)[e], -got[e], of))
        x = e[order[starts_of(of[order])]]
        done.append((q[seed] + q0, -votes[seed], pos[seed], got[x], begun[x] - ended[x], -begun[x]))
    if not done:
        return out.empty_table()
    q, *fields = (np.concatenate(x) for x in zip(*done))
    by = starts_of(q)
    best = pa.ListArray.from_arrays(pa.array(np.r_[by, len(q)], pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in fields], [f.name for f in out.field("best").type.value_type]))
    return pa.Table.from_arrays([names.dictionary.take(pa.array(q[by])), asked["group"].combine_chunks().take(pa.array(np.zeros(len(by), np.int64))), best], schema=out)


def locate_any(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(id, group, first_pos, last_pos, coverage, how)``: where each query stands, by exact runs, or by ``locate_fuzzy`` where it has none.

    ``coverage`` means one thing however a query was found: the share of its runs of four words within the stretch. Inputs are those
    of ``locate``; ``how`` names what found it, so fallbacks can be counted.
    """
    exact = materialize(locate_exact(queries, corpus).select("id", "group", "first_pos", "last_pos"))
    rest = queries.join(exact.select("id"), "id", "left_anti")
    fuzzy = locate_fuzzy(rest, corpus).select("id", "group", "first_pos", "last_pos", "coverage", F.lit("fuzzy").alias("how"))
    grams = queries.join(exact.select("id"), "id", "left_semi").select("id", "group", words(F.col("text")).alias("w")).select("id", "group", F.explode(F.array_distinct(shingles(F.col("w"), 4))).alias("s")).distinct()
    size = grams.groupBy("id", "group").agg(F.count("*").alias("size"))
    spelt = corpus.where("pos is not null and text is not null").select("group", "pos", words(F.col("text")).alias("w")).select("group", "pos", F.explode(F.array_distinct(shingles(F.col("w"), 4))).alias("s"))
    inside = grams.join(exact, ["id", "group"]).join(spelt, ["group", "s"]).where("pos between first_pos and last_pos").groupBy("id", "group").agg(F.count_distinct("s").alias("held"))
    found = exact.join(size, ["id", "group"]).join(inside, ["id", "group"], "left").select("id", "group", "first_pos", "last_pos", F.round(F.coalesce("held", F.lit(0)) / F.col("size"), 6).alias("coverage"), F.lit("exact").alias("how"))
    return found.unionByName(fuzzy)


def find_marker(texts: DataFrame, text: str, marker: str, threshold: float = 0.6) -> DataFrame:
    """``texts`` with ``found_at``: where the marker's first five, four or three words stand in the text with single blanks, whatever
    their case; else the start of the window most like the marker, if at least ``threshold``; -1 if none. Null texts give null.

    Windows are as long as the marker, 50 at least, and a quarter of it apart. Likeness has no built-in expression: Arrow batches."""

    @F.pandas_udf("int")
    def at(text_: pd.Series, marker_: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(t, m):
            if t is None or m is None:
                return None
            t, m = " ".join(t.split()), " ".join(m.split())
            low, parts = t.lower(), m.split(" ")
            for n in (5, 4, 3):
                if len(parts) >= n and (i := low.find(" ".join(parts[:n]).lower())) >= 0:
                    return i
            wide, step = max(len(m), 50), max(10, len(m) // 4)
            best = max(((SequenceMatcher(None, m, t[i : i + wide]).ratio(), -i) for i in range(0, len(t) - wide + 1, step)), default=(0.0, 0))
            return -best[1] if m and best[0] >= threshold else -1

        return pd.Series([one(t, m) for t, m in zip(text_, marker_)], dtype="Int32")

    return texts.withColumn("found_at", at(F.col(text), F.col(marker)))


def align(pairs: DataFrame, least_block: int = 5, least_share: float = 0.0, most_bracket: float = float("inf")) -> DataFrame:
    """``(id, matched, start, end)`` for pairs (``id, needle, hay``): the share of the needle's words in common blocks of
    ``least_block`` words or more, and the words of the other text between which they lie (end exclusive); nulls without a block, and
    where the share is below ``least_share`` or the stretch longer than ``most_bracket`` times the needle (0.85 and 1.6 where an
    alignment must be trusted).

    Sequence alignment has no built-in expression: it runs on Arrow batches, one pair at a time.
    """

    def run(batches):
        from difflib import SequenceMatcher

        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                a, z = (r["needle"] or []), (r["hay"] or [])
                blocks = [m for m in SequenceMatcher(None, a, z, autojunk=False).get_matching_blocks() if m.size >= least_block]
                share = sum(m.size for m in blocks) / len(a) if a else 0.0
                found = bool(blocks) and share >= least_share and blocks[-1].b + blocks[-1].size - blocks[0].b <= most_bracket * len(a)
                out.append((r["id"], round(share, 6), blocks[0].b if found else None, blocks[-1].b + blocks[-1].size if found else None))
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in out], type=k) for i, k in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32()))], ["id", "matched", "start", "end"])

    spelt = pairs.select(F.col("id").cast("string"), words(F.col("needle")).alias("needle"), words(F.col("hay")).alias("hay"))
    return spelt.mapInArrow(run, "id string, matched double, start int, end int")
