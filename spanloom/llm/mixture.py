"""Mixing sources to target shares of the total tokens (problem 9).

Each source's documents, in a pseudorandom order, are packed end to end into blocks of a fixed number of tokens. Output
shards draw how many blocks they take from each source; slots are numbered per source, and a pseudorandom permutation per
source and repetition maps slot numbers to block numbers, by which slots and blocks are joined. The draws are multinomial given
that all shards together take each source's quota: they run down a seeded binary tree over the shards, so that every task works
out its own shards' counts and slot numbers from the quotas alone, and the driver holds nothing that grows with the shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import encoding
from spanloom.runtime import materialize, store

#: Tokens of a block, blocks of an output shard, and the random seed.
BLOCK_TOKENS, SHARD_BLOCKS, SEED = 256, 512, 20240501
#: Ranges of the pseudorandom order over which a source's running token count is taken in parallel.
BUCKETS = 256
#: Blocks from which on a node's draw is replaced by its mean: the generator's own limit, at which a draw strays by under 0.01 %.
EXACT_DRAW = 1_000_000_000


def _ordered(packed: DataFrame, seed: int) -> DataFrame:
    """Documents with their place in the pseudorandom order ``_o``, its range ``_b`` and their number of tokens ``_n``."""
    docs = packed.where("source is not null and length(ids) > 0")
    docs = docs.withColumn("_o", F.xxhash64(F.lit(seed), "doc_id", "ids")).withColumn("_n", (F.length("ids") / encoding.PACKED_BYTES).cast("bigint"))
    return docs.withColumn("_b", F.shiftrightunsigned("_o", 64 - int(math.log2(BUCKETS))))


def range_totals(packed: DataFrame, seed: int = SEED) -> DataFrame:
    """``(source, _b, docs, tokens)``: what each range of the order holds, at most ``BUCKETS`` rows per source."""
    return _ordered(packed, seed).groupBy("source", "_b").agg(F.count("*").alias("docs"), F.sum("_n").alias("tokens"))


def pack(packed: DataFrame, totals: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """Pieces ``(source, block_no, at, doc_id, n, ids)`` of documents (``doc_id``, ``source``, packed ``ids``) in their source's blocks.

    ``at`` is the piece's place in its block. Every token of every document is in exactly one piece; only a source's last
    block may be shorter. Running counts are taken within hashed ranges of each source and shifted by the ranges' ``totals``,
    so no source is ever in one task. The documents' tokens are shuffled once.
    """
    shift = totals.select("source", "_b", (F.sum("tokens").over(Window.partitionBy("source").orderBy("_b")) - F.col("tokens")).alias("_shift"))
    within = Window.partitionBy("source", "_b").orderBy("_o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = _ordered(packed, seed).withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(F.broadcast(shift), ["source", "_b"])
    start = F.col("_shift") + F.col("_before")
    blocks = F.sequence(F.floor(start / block_tokens), F.floor((start + F.col("_n") - 1) / block_tokens))
    pieces = placed.select("source", "doc_id", "ids", "_n", start.alias("_start"), F.explode(blocks).alias("block_no"))
    first = F.greatest(F.lit(0), F.col("block_no") * block_tokens - F.col("_start")).cast("int")
    last = F.least(F.col("_n"), (F.col("block_no") + 1) * block_tokens - F.col("_start")).cast("int")
    cut = pieces.select("source", "block_no", "doc_id", first.alias("_f"), (last - first).alias("n"), "ids", "_start")
    at = (F.col("_start") + F.col("_f") - F.col("block_no") * block_tokens).cast("int")
    return cut.select("source", "block_no", at.alias("at"), "doc_id", "n", F.substring("ids", F.col("_f") * encoding.PACKED_BYTES + 1, F.col("n") * encoding.PACKED_BYTES).alias("ids"))


def plan_quotas(sources: pd.DataFrame, total_tokens: int, block_tokens: int = BLOCK_TOKENS) -> pd.DataFrame:
    """How many blocks each source gives: its share of ``total_tokens``, or all it may give if that is less.

    ``sources`` has one row per source: source, tokens, blocks, target_share, max_repeats. What a source can't give isn't
    made up by others, which keeps the others' shares in proportion; the report shows the shortfall.
    """
    wanted = np.rint(sources.target_share.fillna(0).to_numpy() * total_tokens / block_tokens).astype(np.int64)
    most = sources.blocks.to_numpy(dtype=np.int64) * np.maximum(sources.max_repeats.fillna(0).to_numpy(dtype=np.int64), 0)
    return sources.assign(quota=np.minimum(wanted, most))


def _halve(quotas: np.ndarray, take: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of ``take`` blocks drawn without replacement are of each source. Beyond ``EXACT_DRAW`` blocks they are the quotas'
    shares, from which a draw of that size hardly strays, by largest remainders."""
    whole = int(quotas.sum())
    if take >= whole:
        return quotas.copy()
    if whole < EXACT_DRAW:
        return np.random.default_rng(seed).multivariate_hypergeometric(quotas, take, method="marginals")
    exact = [divmod(int(q) * take, whole) for q in quotas]
    out = np.array([n for n, _ in exact], dtype=np.int64)
    out[sorted(range(len(exact)), key=lambda i: (-exact[i][1], i))[: take - int(out.sum())]] += 1
    return out


def shard_counts(lo: int, hi: int, quotas: np.ndarray, shard_blocks: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, counts, first)`` of the shards from ``lo`` to before ``hi``: blocks of each source, and the source's number of its first.

    Shards hold ``shard_blocks`` blocks, but for the last. A node of the tree draws, from a seed of its own, what its left half takes of
    its blocks; the right half has the rest. Whatever range is asked for, a shard's counts are the same.
    """
    shards = -(-int(quotas.sum()) // shard_blocks)
    todo = [(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), dtype=np.int64))]
    while todo:
        start, end, held, first = todo.pop()
        if end <= lo or start >= hi or start >= end:
            continue
        if end - start == 1:
            yield start, held, first
            continue
        middle = (start + end) // 2
        left = _halve(held, (middle - start) * shard_blocks, (seed, start, end))
        todo += [(middle, end, held - left, first + left), (start, middle, left, first)]


def draw_shards(spark: SparkSession, quotas: np.ndarray, shard_blocks: int, seed: int) -> DataFrame:
    """``(shard, source_no, first, n)`` of all shards, for sources that a shard takes blocks of."""
    shards = -(-int(quotas.sum()) // shard_blocks)
    names, kinds = ["shard", "source_no", "first", "n"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:  # ids of a partition's batch follow one another
                ids, out = b.column(0).to_numpy(), [[], [], [], []]
                for shard, counts, first in shard_counts(int(ids[0]), int(ids[-1]) + 1, quotas, shard_blocks, seed):
                    of = np.nonzero(counts)[0]
                    for column, values in zip(out, (np.full(len(of), shard), of, first[of], counts[of])):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=k) for c, k in zip(out, kinds)], names)

    return spark.range(shards).mapInArrow(run, "shard bigint, source_no int, first bigint, n bigint")


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of ``range(size)`` for each key: a four-round Feistel network, walked until in range."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out = index.astype(np.uint64), np.full(len(index), -1, dtype=np.int64)
    todo = np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        a, b = x[todo] >> h, x[todo] & m
        for r in range(4):
            with np.errstate(over="ignore"):
                z = b * np.uint64(0x9E3779B97F4A7C15) + k * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(r + 1) * np.uint64(0x94D049BB133111EB)
                z = (z ^ (z >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                z ^= z >> np.uint64(32)
            a, b = b, (a ^ z) & m
        x[todo] = (a << h) | b
        done = x[todo] < size[todo].astype(np.uint64)
        out[todo[done]] = x[todo[done]].astype(np.int64)
        todo = todo[~done]
    return out


def _block_of(slot: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(slot.to_numpy(np.int64) % blocks.to_numpy(np.int64), blocks.to_numpy(np.int64), key.to_numpy(np.int64)))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, vocabulary: str = encoding.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix and its report, from documents (``doc_id``, ``source``, ``text``) and targets (``source``, ``target_share``, ``max_repeats``).

    The mix has one row per block ``(shard, slot, source, repeat, block_no, n_tokens, n_docs, ids)``, ``slot`` in random order
    within its shard. The report has one row per source of either table ``(source, docs, tokens, target_share, max_repeats,
    mixed_tokens, share_of_total, actual_share, most_uses, shortfall, most_total)``: shares of the tokens aimed at and of those mixed,
    the tokens that lack to the target share of the aim, and the total up to which the source can give its share (null if it has
    no share); the least of these is the largest mix in which all shares hold. ``total_tokens`` is the size to aim at: all
    tokens of the documents if None. A
    source's blocks are all used once before any is used again, and never more than ``max_repeats`` times. Documents without
    a source or without tokens take no part; sources without a target, with a zero share or without documents give
    nothing. Of several targets for one source the first in order counts. Sources are taken to be few (as many as fit a
    configuration); documents may be any number.
    """
    spark = docs.sparkSession
    coded = store(encoding.encode(docs.where("source is not null"), "text", ["doc_id", "source"], vocabulary, packed=True))
    totals = materialize(range_totals(coded, seed))
    pieces = pack(coded, totals, block_tokens, seed)
    targets = targets.where("source is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    sizes = totals.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    plan = sizes.join(targets, "source", "full_outer").select("source", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "target_share", "max_repeats").orderBy("source").toPandas()  # one row per source
    plan["blocks"] = -(-plan.tokens // block_tokens)
    aim = int(plan.tokens.sum()) if total_tokens is None else total_tokens
    plan = plan_quotas(plan, aim, block_tokens)
    sources = [(i, *map(_plain, r)) for i, r in enumerate(plan[["source", "blocks"]].itertuples(index=False))]
    known_blocks = spark.createDataFrame(sources, "source_no int, source string, blocks bigint")  # one row per source
    draws = draw_shards(spark, plan.quota.to_numpy(dtype=np.int64), shard_blocks, seed).join(F.broadcast(known_blocks), "source_no")
    slots = draws.select("shard", "source", "blocks", "source_no", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at_source"))
    slots = slots.withColumn("repeat", F.floor(F.col("at_source") / F.col("blocks")))
    slots = slots.withColumn("block_no", F.pandas_udf(_block_of, "bigint")("at_source", "blocks", F.col("source_no") * 1_000_003 + F.col("repeat") + seed))
    in_shard = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "source", "at_source"), "source", "at_source")
    slots = slots.withColumn("slot", F.row_number().over(in_shard) - 1)
    uses = slots.groupBy("source", "block_no").agg(F.collect_list(F.struct("shard", "slot", "repeat")).alias("uses"))  # at most max_repeats each
    whole = F.array_sort(F.collect_list(F.struct("at", "ids")))  # at most block_tokens pieces
    blocks = pieces.groupBy("source", "block_no").agg(F.sum("n").cast("int").alias("n_tokens"), F.count("*").alias("n_docs"), whole.alias("parts"))
    mixed = blocks.join(uses, ["source", "block_no"]).select("source", "block_no", "n_tokens", "n_docs", "parts", F.explode("uses").alias("u"))
    mixed = mixed.select("u.shard", "u.slot", "source", "u.repeat", "block_no", "n_tokens", "n_docs", F.transform("parts", lambda p: p["ids"]).alias("ids"))
    mixed = mixed.mapInArrow(_unpack, "shard bigint, slot int, source string, repeat bigint, block_no bigint, n_tokens int, n_docs bigint, ids array<int>")
    last_block = F.when(F.col("block_no") == F.col("blocks") - 1, F.col("tokens") - F.col("block_no") * block_tokens).otherwise(F.lit(block_tokens))
    given = slots.join(F.broadcast(sizes.select("source", "tokens")), "source").groupBy("source").agg(F.sum(last_block).cast("bigint").alias("mixed_tokens"), (F.max("repeat") + 1).alias("most_uses"))
    known = spark.createDataFrame([tuple(map(_plain, r)) for r in plan[["source", "docs", "tokens", "target_share", "max_repeats"]].itertuples(index=False)], "source string, docs bigint, tokens bigint, target_share double, max_repeats int")
    all_given = given.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = known.join(given, "source", "left").crossJoin(F.broadcast(all_given))
    report = report.select("source", "docs", "tokens", "target_share", "max_repeats", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce(F.round(F.col("mixed_tokens") / F.lit(aim), 6), F.lit(0.0)).alias("share_of_total"), F.coalesce(F.round(F.col("mixed_tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    wanted = F.coalesce("target_share", F.lit(0.0)) * F.lit(aim)
    most = F.col("tokens") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)) / F.col("target_share")
    report = report.withColumn("shortfall", F.greatest(F.lit(0), F.round(wanted - F.col("mixed_tokens"))).cast("bigint")).withColumn("most_total", F.when(F.col("target_share") > 0, F.floor(most)).cast("bigint"))
    return mixed, report


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        joined = pa.array([b"".join(x) for x in b.column("ids").to_pylist()], type=pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], encoding.unpack_ids(joined)], b.schema.names)


def _plain(x):
    x = x.item() if isinstance(x, np.generic) else x
    return None if x is None or isinstance(x, float) and math.isnan(x) else int(x) if isinstance(x, float) and x.is_integer() and abs(x) > 1 else x
