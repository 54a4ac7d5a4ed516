"""Groups of all records that pairwise matches link, directly or not (problem 1).

Randomised contraction: in every round each vertex hooks to the neighbour, or itself, that comes first in a fresh random
order; edges are relabelled to the hooks and deduplicated, until none is left. The rounds' mappings are then expanded
backwards into one label per vertex. A round shrinks the graph by a constant factor whatever its shape, so chains of any
length take a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import counted, find_heavy, lookup, store


def star_edges(groups: DataFrame, members: str) -> DataFrame:
    """``(a, b)``: each group of mutually matching members as edges from its least to every other one.

    Null members, null or empty groups, and groups whose members are all the same give no edge: k members need k - 1 edges,
    not all pairs.
    """
    ids = groups.select(F.array_distinct(F.array_compact(F.col(members))).alias("ids"))
    return ids.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b").distinct()


def _codes(edges: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """``(card, v)``: a 64-bit code of its own for each vertex.

    A card's code is its hash, made even. Cards that share theirs with others, a handful even among billions, are numbered in order
    and take the odd numbers from 1 on, so no two codes are ever equal.
    """
    cards = store(edges.select(F.explode(F.array("a", "b")).alias("card")).distinct())
    coded = cards.select("card", (hashed("card").bitwiseAND(F.lit(-2))).alias("v"))
    shared = store(coded.groupBy("v").count().where("count > 1").select("v"))
    if shared.isEmpty():
        return coded
    again = store(coded.join(shared, "v", "left_semi"))
    numbered = again.select("card", (F.row_number().over(Window.orderBy("card")).cast("bigint") * 2 - 1).alias("v"))
    return coded.join(shared, "v", "left_anti").select("card", "v").unionByName(numbered)


def contract(edges: DataFrame, seed: int = 0) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges`` (bigint ``a``, ``b``; no loops): vertices of one component share a root.

    All state between rounds lies in the checkpoint folder, and is counted as it is written. A hub with a large part of all edges is hooked by an aggregate
    with partial results on the map side and relabelled by a broadcast of at most ``1 / HEAVY_SHARE`` rows.
    """
    edges, left = counted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mappings: list[DataFrame] = []
    sizes: list[int] = []
    while left:
        order = lambda c: F.xxhash64(F.lit(seed + len(mappings)), F.col(c))
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("e")).select("e.*")
        hooks = ends.groupBy("v").agg(F.min(F.struct(order("n").alias("h"), "n")).alias("best"))
        own = F.struct(order("v").alias("h"), F.col("v").alias("n"))
        hooks, n = counted(hooks.select("v", F.least("best", own)["n"].alias("root")))
        mappings.append(hooks)
        sizes.append(n)
        once = lookup(edges, hooks.withColumnsRenamed({"v": "a", "root": "ra"}), "a", find_heavy(edges, "a", left), "inner").select("ra", "b")
        if left >= 20_000:  # read twice if some vertex is heavy
            once = store(once)
        both = lookup(once, hooks.withColumnsRenamed({"v": "b", "root": "rb"}), "b", find_heavy(once, "b", left), "inner").select("ra", "rb").where("ra <> rb")
        edges, left = counted(both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not mappings:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    whole = mappings[-1]
    for step, n in zip(mappings[-2::-1], sizes[-2::-1]):
        nxt = whole.select(F.col("v").alias("root"), F.col("root").alias("further"))
        whole = store(lookup(step, nxt, "root", find_heavy(step, "root", n)).select("v", F.coalesce("further", "root").alias("root")))
    return whole


def group_ids(groups: DataFrame, members: str) -> DataFrame:
    """``(card_id, group_id)``: every member of a linked group of two or more, with the group's least member as its identifier.

    ``groups`` holds arrays of members that match each other. Nulls, empty arrays, repeated rows and matches of a member with
    itself link nothing; an empty table gives an empty result.
    """
    edges, n = counted(star_edges(groups, members))
    codes = store(_codes(edges))
    coded = lookup(edges, codes.withColumnsRenamed({"card": "a", "v": "va"}), "a", find_heavy(edges, "a", n), "inner").select("b", "va")
    if n >= 20_000:
        coded = store(coded)
    coded = lookup(coded, codes.withColumnsRenamed({"card": "b", "v": "vb"}), "b", find_heavy(coded, "b", n), "inner").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    roots = contract(coded)
    labelled, m = counted(codes.join(roots, "v").select("card", "root"))
    names = labelled.groupBy("root").agg(F.min("card").alias("group_id"))
    return lookup(labelled, names, "root", find_heavy(labelled, "root", m), "inner").select(F.col("card").alias("card_id"), "group_id")


def merge_matches(decisions: DataFrame) -> DataFrame:
    """``(members)``: the sets of cards that merge decisions match: each ``ids`` list, and each element of ``groups``."""
    merges = decisions.where("kind = 'merge'")
    lists = merges.select(F.col("ids").alias("members")).where("members is not null")
    parts = merges.select(F.explode("groups").alias("g")).select(F.transform("g.members", lambda m: m["card"]).alias("members")).where("members is not null")
    return lists.unionByName(parts)
