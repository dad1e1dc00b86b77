"""Best-fit packing in bounded space: a fixed number of open bins in a bitset keyed by free space; the fullest closes first."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, stored, tasks_for
from .text import texts

LENGTH = 2048
END_ID = 0
#: Bins a task holds open at once, and pieces of a run, which come longest first. A run opens no more bins than it has pieces, so none of its own closes early.
OPEN_BINS, RUN = 4096, 4096
#: Pieces that one stream of bins takes.
STREAM = 1 << 17

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
PLACES = "row long, bin long, offset long, fill long"

# ---- tokens

#: The pre-tokeniser's pattern of this kind of vocabulary (a fixed value of the format), and the mark of a word's end in it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: A byte that no UTF-8 text holds stands for the end of a word.
_END = b"\xff"
#: Below this character, lower-casing is all that the normaliser does.
_PLAIN = "ɐ"


#: Little-endian packing of few ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def encoding(path: str):
    """(encoder of one lower-case piece with its end, id of each of the encoder's ranks, whole tokenizer, added tokens) of a tokenizers file of words with ends."""
    import tiktoken
    from tokenizers import Tokenizer

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = [t["content"] for t in spec["added_tokens"]]
    if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")) or any(c.isspace() for t in added for c in t):
        raise ValueError("added tokens that look at what stands around them are not supported")

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token.removesuffix(WORD_END)) + (_END if token.endswith(WORD_END) else b"")

    ranks = {bytes([b]) + _END: b for b in range(256)}  # a word's last byte takes its end before any merge
    ranks |= {bytes([b]): 256 + b for b in range(256)}
    for merge in spec["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        ranks.setdefault(raw(a) + raw(b), len(ranks))
    ids = {ranks[raw(t)]: i for t, i in spec["model"]["vocab"].items() if t not in added}
    bpe = tiktoken.Encoding("word_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe._core_bpe.encode_single_piece, ids, Tokenizer.from_file(path), added


class Tokens(dict):
    """Ids of the stretches between blanks, as little-endian bytes, and texts to ids.

    No token spans white space, so stretches are encoded once each: those of Latin letters, figures and signs by the merge
    ranks, all others, and those with an added token, by the tokenizer itself.
    """

    MOST = 1_000_000

    def __init__(self, path: str):
        super().__init__()
        self.piece, self.of_rank, self.whole, self.added = encoding(path)
        self.split, self.mark = regex.compile(PATTERN), commonprefix(self.added) if self.added else "\uffff"

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        if (stretch.isascii() or max(stretch, default="") < _PLAIN) and self.mark not in stretch:  # no added token, as its start is missing
            low, of = stretch.lower(), self.of_rank
            if low.isalpha():
                ids = [of[r] for r in self.piece(low.encode() + _END)]
            else:
                ids = [of[r] for p in self.split.findall(low) for r in self.piece(p.encode() + _END)]
        else:
            ids = self.whole.encode(stretch, add_special_tokens=False).ids
        out = self[stretch] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)
        return out

    def ids(self, text: str) -> bytes:
        return b"".join([*map(self.__getitem__, text.replace("\n", " ").split(" ")), struct.pack("<I", END_ID)])


def tokenized_pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """PIECES of docs. row is a number of the piece's own, from its task and place; it holds once the table is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, step, row = Tokens(path), 4 * length, TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = memoryview(tokens.ids(text.decode("utf-8", "replace")))
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), row))
                    row += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


# ---- bins


class OpenBins:
    """At most `most` open bins of `length`. Bit f of mask says that bins with f free stand in by_free[f]; a bin that is full closes at once."""

    def __init__(self, length: int, most: int, first_id: int = 0):
        self.length, self.most, self.next, self.mask, self.n = length, most, first_id, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        return out

    def add(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece: the open bin with least room that takes it, else a new one, for which the fullest closes where all are open."""
        fitting = self.mask >> size
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + size
            bin_ = self._take(free)
        else:
            if self.n == self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.n -= 1
            bin_, free = self.next, self.length
            self.next += 1
            self.n += 1
        left = free - size
        if left:
            self.by_free[left].append(bin_)
            self.mask |= 1 << left
        else:
            self.n -= 1
        return bin_, self.length - free

    def open(self) -> list[tuple[int, int]]:
        """(bin, tokens in it) of the bins still open."""
        return [(b, self.length - f) for f, bins in enumerate(self.by_free) for b in bins]


def _streams(length: int, most: int):
    """Batches of (stream, size, row), ordered by stream, to PLACES; at a stream's end a row without `row` for each bin still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, now = None, None

        def out(rows, places, fills):
            bin_, offset = zip(*places, strict=True) if places else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, bin_, offset, fills)], names=["row", "bin", "offset", "fill"])

        def ended():
            left = bins.open()
            return out([None] * len(left), [(b, 0) for b, _ in left], [f for _, f in left])

        for batch in batches:
            stream, size, row = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = [0, *(np.nonzero(np.diff(stream))[0] + 1).tolist(), len(stream)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if stream[a] != now:
                    if bins:
                        yield ended()
                    now = stream[a]
                    bins = OpenBins(length, most, int(now) << 36)
                yield out(row[a:b], [bins.add(s) for s in size[a:b].tolist()], [None] * (b - a))
        if bins:
            yield ended()

    return run


def _fill(items: DataFrame, n: int, length: int, most: int, run: int, stream: int, level: int) -> DataFrame:
    """PLACES of items(row, size), n in number: streams of about `stream` items, dealt by a hash of the row, each a sequence of runs whose items come longest first. Stored."""
    streams = tasks_for(n, stream)
    dealt = items.select((F.pmod(F.xxhash64(F.lit(level), "row"), F.lit(streams)) + (level << 20)).alias("stream"), "size", "row")
    runs = F.pmod(F.xxhash64(F.lit(level), F.lit("run"), "row"), F.lit(max(1, -(-n // (streams * run)))))
    ordered = dealt.withColumn("_run", runs).repartition(streams, "stream").sortWithinPartitions("stream", "_run", F.desc("size"), "row").select("stream", "size", "row")
    return stored(ordered.mapInArrow(_streams(length, most), PLACES), "bins")


def pack_best_fit(docs: DataFrame, path: str | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS, run: int = RUN, stream: int = STREAM) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids (null or empty text: none) and END_ID. Longer documents than length are cut into full pieces, each a
    sequence of its own, and a rest; all others are one piece. Pieces are dealt over streams by a hash of a number of their own, so
    neither repeated rows nor null ids meet in one stream. A stream holds open_bins open bins, whatever its length, and takes its
    pieces in runs, longest first in each. Bins that are open at the end of the streams are items of fewer streams in the
    next round, whole, until one stream is left: with s streams, log s to the base of stream / open_bins rounds.

    Rows that repeat a doc_id are packed as separate documents, null doc_ids too. Empty table: no rows. sequence_ids are unique, not consecutive.
    """
    if stream <= 2 * open_bins:
        raise ValueError("a stream must take more than twice as many pieces as it has open bins")
    pieces = stored(tokenized_pieces(docs, path or vocabulary_path(), length), "pieces", "zstd")
    whole = F.col("length") == length
    n = pieces.where(~whole).count()
    places = _fill(pieces.where(~whole).select(F.col("length").alias("size"), "row"), n, length, open_bins, run, stream, 0)
    streams, moved, level = tasks_for(n, stream), None, 0
    while streams > 1:
        level += 1
        left = places.where(F.col("row").isNull()).select(F.col("bin").alias("row"), F.col("fill").alias("size"))
        bins = left.count()
        streams = tasks_for(bins, stream)
        places_before, places = places, _fill(left, bins, length, open_bins, run, stream, level)
        step = places.where(F.col("row").isNotNull()).select(F.col("row").alias("_from"), F.col("bin").alias("_to"), F.col("offset").alias("_shift"))
        if moved is None:
            first, moved = places_before, step
        else:  # a bin moved before goes on with its new bin
            again = step.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"), F.col("_shift").alias("_more"))
            moved = moved.join(again, "_to", "left").select("_from", F.coalesce("_next", "_to").alias("_to"), (F.col("_shift") + F.coalesce("_more", F.lit(0))).alias("_shift"))
        moved = stored(moved, "moved")
    if moved is None:
        placed = places.where(F.col("row").isNotNull()).select("row", (F.col("bin") * 2).alias("sequence_id"), "offset")
    else:
        small = moved.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        joined = first.where(F.col("row").isNotNull()).join(F.broadcast(moved) if small else moved.hint("merge"), F.col("bin") == F.col("_from"), "left")
        placed = joined.select("row", (F.coalesce("_to", "bin") * 2).alias("sequence_id"), (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(whole).select(*columns, (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(pieces.where(~whole).join(placed, "row").select(*columns, "sequence_id", "offset"))
