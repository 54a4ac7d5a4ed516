"""Encoding whole texts with a public byte-level BPE tokenizer (problem 8).

Texts up to ``LONG_CHARS`` are encoded where they lie. Longer ones are cut blindly into blocks that are encoded in parallel
and put together by a tree of joins. At a join, the end of the left part and the start of the right part are split into
pieces again in a window that grows until its splits and the right part's agree; where one piece runs on across the join,
tokens are re-encoded in a window around it that grows until it begins and ends with tokens of the two parts. From there on
both encodings must be the same: a split depends on nothing before its start, and a sequence of tokens is the encoding of
its text exactly if every two neighbours are the encoding of theirs.
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import materialize, store

#: Where the public vocabularies lie, and the split pattern that belongs to them (a fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points from which on a text is cut, and those of a block.
LONG_CHARS, BLOCK_CHARS = 4096, 2048
#: Bytes of a packed token: three serve vocabularies of up to 16 million, and compress to about two.
PACKED_BYTES = 3
#: How far, in code points, the pattern looks from a split's start before it decides for one kind of piece.
REACH = 3
#: A piece that runs across a join is re-encoded whole up to so many bytes, and by a growing window of tokens beyond.
WHOLE_PIECE = 64

STATE = "row_key string, block bigint, blocks bigint, text string, starts array<int>, counts array<int>, ids array<int>"
_STATE = pa.schema([("row_key", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()), ("text", pa.string()), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])


class Vocabulary:
    """A vocabulary file's content as it travels to the executors (under 1 MB); the encoder is built once per worker process."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.content = spark.sparkContext.broadcast(f.read())
        self.path = path

    def encoder(self):
        cache = sys.modules.setdefault("_spanloom_encoders", types.ModuleType("_spanloom_encoders"))
        if self.path not in vars(cache):
            vars(cache)[self.path] = build_encoder(self.content.value)
        return vars(cache)[self.path]


def build_encoder(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- one text, in parts -----------------------------------------------------------------------------------------------


class Part:
    """An encoded stretch of text: where its pieces start, how many tokens each has, and all tokens."""

    def __init__(self, text: str, starts: list[int], counts: list[int], ids: list[int]):
        self.text, self.starts, self.counts, self.ids = text, starts, counts, ids

    def piece(self, i: int) -> str:
        return self.text[self.starts[i] : self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)]


def encode_piece(encoder, text: str) -> list[int]:
    return list(encoder._core_bpe.encode_single_piece(text.encode()))


def encode_part(encoder, text: str) -> Part:
    spans = [(m.start(), m.group()) for m in regex.finditer(PATTERN, text)]
    each = [encode_piece(encoder, p) for _, p in spans]
    return Part(text, [s for s, _ in spans], [len(e) for e in each], [t for e in each for t in e])


def join_tokens(encoder, left: list[int], right: list[int]) -> list[int]:
    """The encoding of one piece from the encodings of its two halves."""
    bpe, k = encoder._core_bpe, 4
    if not left or not right:
        return left or right
    while True:
        window = list(bpe.encode_single_piece(b"".join(map(bpe.decode_single_token_bytes, left[-k:] + right[:k]))))
        if (k >= len(left) or window[0] == left[-k]) and (k >= len(right) or window[-1] == right[k - 1]):
            return left[: max(0, len(left) - k)] + window + right[k:]
        k *= 2


def join_parts(encoder, a: Part, b: Part) -> Part:
    """The encoding of the text of ``a`` followed by that of ``b``."""
    if not a.text or not b.text:
        return b if not a.text else a
    cut, first = len(a.text), len(a.starts) - 1
    while first and a.starts[first - 1] >= cut - REACH:  # a contraction may have been cut: its splits are not final
        first -= 1
    offset, lone = a.starts[first], first == len(a.starts) - 1
    last = a.text[offset:]
    own = {s: i for i, s in enumerate(b.starts)}
    width = 4
    while True:  # split the window anew, until a split falls on one of the right part's
        end = b.starts[width] if width < len(b.starts) else len(b.text)
        window, whole = last + b.text[:end], width >= len(b.starts)
        sure = [(m.start(), m.end()) for m in regex.finditer(PATTERN, window)]
        if not whole:  # splits that the text beyond the window may yet change
            sure = [(s, e) for s, e in sure if e < len(window) and s + REACH <= len(window)]
        agreed = next((own[s - len(last)] for s, _ in sure if s >= len(last) and s - len(last) in own), None)
        if agreed is not None:
            sure = [(s, e) for s, e in sure if s - len(last) < b.starts[agreed]]
            break
        if whole:
            agreed = len(b.starts)
            break
        width *= 2
    keep = sum(a.counts[:first])
    left_tail = a.ids[keep:]
    used = sum(b.counts[:agreed])
    starts, counts, ids = a.starts[:first], a.counts[:first], a.ids[:keep]
    for s, e in sure:
        text = window[s:e]
        if len(text) <= WHOLE_PIECE or s > 0 or e <= len(last) or not lone:
            tokens = left_tail if lone and s == 0 and e == len(last) else encode_piece(encoder, text)
        elif e - len(last) == (b.starts[1] if len(b.starts) > 1 else len(b.text)):  # both parts' pieces run on into each other
            tokens = join_tokens(encoder, left_tail, b.ids[: b.counts[0]])
        else:
            tokens = join_tokens(encoder, left_tail, encode_piece(encoder, text[len(last) :]))
        starts, counts, ids = starts + [offset + s], counts + [len(tokens)], ids + tokens
    return Part(a.text + b.text, starts + [cut + s for s in b.starts[agreed:]], counts + b.counts[agreed:], ids + b.ids[used:])


# --- tables -----------------------------------------------------------------------------------------------------------


def pack_ids(ids: list[list[int] | np.ndarray]) -> pa.Array:
    """Token lists as little-endian 32-bit numbers less a byte or two: ``PACKED_BYTES`` each, the form in which they are shuffled."""
    return pa.array([np.asarray(x, dtype="<u4").view("u1").reshape(-1, 4)[:, :PACKED_BYTES].tobytes() for x in ids], type=pa.binary())


def unpack_ids(packed: pa.Array) -> pa.Array:
    values, ends = [], [0]
    for x in packed.to_pylist():
        wide = np.zeros((len(x) // PACKED_BYTES, 4), dtype="u1")
        wide[:, :PACKED_BYTES] = np.frombuffer(x, dtype="u1").reshape(-1, PACKED_BYTES)
        values.append(wide.view("<i4").ravel())
        ends.append(ends[-1] + len(wide))
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate(values) if values else np.array([], dtype="<i4"), type=pa.int32()))


def _encode_short(vocabulary: Vocabulary, packed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = partial(vocabulary.encoder().encode_to_numpy, disallowed_special=())
    none = np.array([], dtype="u4")
    for b in batches:
        lists = [encode(t) if t else none for t in b.column("_text").to_pylist()]
        if packed:
            ids = pack_ids(lists)
        else:
            ends = np.cumsum([0, *map(len, lists)], dtype="i4")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*lists, none]).astype("i4")))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), ids], [*b.schema.names[:-1], "ids"])


def _cut(block_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    n, task = 0, TaskContext.get().partitionId()
    for b in batches:
        for i, text in enumerate(b.column("_text").to_pylist()):
            parts = [text[k : k + block_chars] for k in range(0, len(text), block_chars)]
            row = b.slice(i, 1)
            for k, p in enumerate(parts):
                # the row's own columns travel with its first block only
                own = [c if k == 0 else pa.nulls(1, c.type) for c in row.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array([f"{task}-{n}"]), pa.array([k]), pa.array([len(parts)]), pa.array([p])], [*b.schema.names[:-1], "row_key", "block", "blocks", "text"])
            n += 1


def _rows(states: list[tuple[str, int, int, Part]]) -> pa.RecordBatch:
    columns = zip(*((k, i, n, p.text, p.starts, p.counts, p.ids) for k, i, n, p in states))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _STATE)], schema=_STATE)


def _encode_blocks(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = vocabulary.encoder()
    for b in batches:
        if b.num_rows:
            yield _rows([(r["row_key"], r["block"], r["blocks"], encode_part(encoder, r["text"])) for r in b.to_pylist()])


def _join_level(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by text and block; neighbours that are the halves of one larger block are joined."""
    encoder, waiting = vocabulary.encoder(), None
    for b in batches:
        out = []
        for r in b.to_pylist():
            now = (r["row_key"], r["block"], r["blocks"], Part(r["text"], r["starts"], r["counts"], r["ids"]))
            if waiting and waiting[0] == now[0] and waiting[1] // 2 == now[1] // 2:
                out.append((now[0], now[1] // 2, (now[2] + 1) // 2, join_parts(encoder, waiting[3], now[3])))
                waiting = None
            else:
                if waiting:
                    out.append((waiting[0], waiting[1] // 2, (waiting[2] + 1) // 2, waiting[3]))
                waiting = now
        if out:
            yield _rows(out)
    if waiting:
        yield _rows([(waiting[0], waiting[1] // 2, (waiting[2] + 1) // 2, waiting[3])])


def _repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pack_ids(b.column("ids").to_pylist())], b.schema.names)


def encode(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, long_chars: int = LONG_CHARS, block_chars: int = BLOCK_CHARS, packed: bool = False) -> DataFrame:
    """One row ``(*keep, ids)`` per row of ``df``: the tokens of its text, without special tokens.

    Null and empty texts have an empty list. Texts are encoded whole, whatever their length; strings that look like special
    tokens are ordinary text. Rows that repeat a key stay separate rows. An empty table gives an empty result. A column called
    ``ids`` can't be kept. With ``packed``, ``ids`` is binary, see ``pack_ids``.
    """
    vocab = Vocabulary(df.sparkSession, vocabulary)
    rows = df.select(F.struct(*keep).alias("_own"), F.col(text).alias("_text"))  # in a struct, no name can clash
    schema = f"_own {rows.schema['_own'].dataType.simpleString()}"
    is_long = F.coalesce(F.length("_text") > long_chars, F.lit(False))
    kind = "binary" if packed else "array<int>"
    short = rows.where(~is_long).mapInArrow(partial(_encode_short, vocab, packed), f"{schema}, ids {kind}")
    blocks = materialize(rows.where(is_long).mapInArrow(partial(_cut, block_chars), f"{schema}, row_key string, block bigint, blocks bigint, text string"))
    most = blocks.agg(F.max("blocks")).first()[0]
    if most is None:
        return short.select("_own.*", "ids")
    own = blocks.where("block = 0").select("_own", "row_key")
    parts = blocks.select("row_key", "block", "blocks", "text").repartition("row_key", "block").mapInArrow(partial(_encode_blocks, vocab), STATE)
    whole: DataFrame | None = None
    while most > 1:  # a level shuffles the texts that aren't whole yet, and leaves out those that have become so
        halves = parts.repartition("row_key", F.floor(F.col("block") / 2)).sortWithinPartitions("row_key", "block")
        joined, most = store(halves.mapInArrow(partial(_join_level, vocab), STATE)), (most + 1) // 2
        done = joined.where("blocks = 1").select("row_key", "ids")
        whole = done if whole is None else whole.unionByName(done)
        parts = joined.where("blocks > 1")
    parts = whole if whole is not None else parts
    long = own.join(parts, "row_key").select("_own", "ids")
    return short.unionByName(long.mapInArrow(_repack, f"{schema}, ids binary") if packed else long).select("_own.*", "ids")
