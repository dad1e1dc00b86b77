"""Packing token sequences: cutting-stock column generation over the histogram of piece lengths."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .text import texts

LENGTH = 2048
END_ID = 1
#: The pre-tokeniser's pattern of byte-level BPE vocabularies (a fixed value of the format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one length that are ranked in one group, on average.
RANKED = 8192
#: The linear program ends where its bound shows so small a gap, or after so many pivots (its basis is feasible at any time; the bound
#: closes slowly). So many columns enter for each pricing, at most.
GAP, MOST_PIVOTS, EACH_PRICING = 0.01, 1000, 48
#: Pieces that are filled one sequence at a time in one pass; of more, every so many stand for as many alike.
FILLED = 10_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoding(path: str):
    """(the byte-level BPE of a tokenizers file, its added tokens with their ids). Its ids are its merge ranks, which lets tiktoken apply them faster."""
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that look at what stands around them are not supported")
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added


class _Known(dict):
    """Ids of words seen, as little-endian bytes."""

    MOST = 500_000

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        ids = self.encode(self.before + word)
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out


_UNSAFE, _BREAK = re.compile(r" (?=\s|\Z)"), re.compile(r" (?=\S)")


class Tokens:
    """Texts to ids. Added tokens of the file stand for themselves and part the text, the leftmost and longest first. A pre-token never spans
    a blank that a visible character follows, so the parts between are encoded once each."""

    def __init__(self, path: str):
        bpe, self.added = encoding(path)
        self.first, self.later = _Known(bpe.encode_ordinary, ""), _Known(bpe.encode_ordinary, " ")
        self.split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")

    def plain(self, text: str) -> list[bytes]:
        parts = _BREAK.split(text) if _UNSAFE.search(text) else text.split(" ")
        later = self.later
        return [self.first[parts[0]], *[later[p] for p in parts[1:]]]

    def ids(self, text: str) -> bytes:
        out, at = [], 0
        for found in self.split.finditer(text):
            out += [*self.plain(text[at : found.start()]), struct.pack("<I", self.added[found[0]])]
            at = found.end()
        return b"".join([*out, *self.plain(text[at:]), struct.pack("<I", END_ID)])


def tokenized_pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """PIECES of docs: full ones of length ids, then the rest; ids are read once and only their checksums go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, step = Tokens(path), 4 * length
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = memoryview(tokens.ids(text.decode("utf-8", "replace")))
                n = len(ids) // 4
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), n))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def padded(total: int, length: int) -> int:
    """Tokens a sequence takes up: a power of two stands as it is."""
    return total if total & (total - 1) == 0 else length


def knapsack(sizes: np.ndarray, values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each total up to length: the most value of items (any number of each) that fill it exactly, and the item added last."""
    best, last = np.full(length + 1, -np.inf), np.full(length + 1, -1)
    best[0] = 0
    upto = np.searchsorted(sizes, np.arange(length + 1), side="right")
    for w in range(1, length + 1):
        if k := upto[w]:
            v = best[w - sizes[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > -np.inf:
                best[w], last[w] = v[i], i
    return best, last


def filled(last: np.ndarray, sizes: np.ndarray, w: int) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    while w > 0:
        out[int(last[w])] += 1
        w -= int(sizes[last[w]])
    return dict(out)


def column_generation(sizes: np.ndarray, demand: np.ndarray, length: int, gap: float = GAP, most_pivots: int = MOST_PIVOTS) -> list[tuple[dict[int, int], float]]:
    """Patterns (item -> copies) with how often each is used in the linear program that covers demand with least padded tokens.

    Revised simplex with the basis's inverse. A knapsack under the duals prices columns: for each item the best column that
    holds it and fills a sequence, and the best for each total that needs no padding. Those of most value enter one
    after the other while they still have negative reduced cost. It ends when Farley's bound shows gap, no column is worth its price, or
    after most_pivots.
    """
    m = len(sizes)
    costs = np.array([padded(w, length) if w else 0 for w in range(length + 1)], float)
    columns: list[dict[int, int]] = [{i: length // int(s)} for i, s in enumerate(sizes)]
    copies = length // sizes
    inverse, cost = np.diag(1 / copies), costs[copies * sizes]
    x = demand / copies
    pivots, small = 0, 1e-7 * length
    while pivots < most_pivots:
        duals = cost @ inverse
        best, last = knapsack(sizes, duals, length)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(best[1:] > 0, costs[1:] / best[1:], np.inf).min()
        if 1 - min(1.0, ratio) <= gap:
            break
        found = {}
        holding = best[length - sizes] + duals
        for i in np.argsort(-holding)[:EACH_PRICING]:
            if holding[i] > length + small:
                col = filled(last, sizes, length - int(sizes[i]))
                col[int(i)] = col.get(int(i), 0) + 1
                found[tuple(sorted(col.items()))] = float(length)
        for w in np.nonzero(costs - best < -small)[0]:
            if costs[w] == w and w < length:
                found[tuple(sorted(filled(last, sizes, int(w)).items()))] = float(w)
        if not found:  # only padded sequences are left to improve
            w = int((costs - best).argmin())
            if costs[w] - best[w] >= -small:
                break
            found[tuple(sorted(filled(last, sizes, w).items()))] = float(costs[w])
        entered = 0
        for col, price in found.items():
            idx, k = np.array([i for i, _ in col]), np.array([k for _, k in col], float)
            reduced = price - duals[idx] @ k
            if reduced >= -small or pivots >= most_pivots:
                continue
            y = inverse[:, idx] @ k
            up = y > 1e-9
            if not up.any():
                continue
            r = int(np.where(up, x / np.where(up, y, 1), np.inf).argmin())
            theta = max(0.0, x[r] / y[r])
            x -= theta * y
            x[r] = theta
            row = inverse[r] / y[r]
            hit, cols = np.nonzero(np.abs(y) > 1e-12)[0], np.nonzero(row)[0]
            inverse[np.ix_(hit, cols)] -= np.outer(y[hit], row[cols])
            inverse[r] = row
            duals = duals + reduced * row
            cost[r], columns[r] = price, dict(col)
            pivots, entered = pivots + 1, entered + 1
        if not entered:
            break
    return [(c, float(v)) for c, v in zip(columns, x, strict=True) if v > 1e-9]


def exact_fill(items: dict[int, int], length: int) -> list[list[int]]:
    """Sequences for the few pieces that rounding leaves: the longest piece first, then whatever fills it exactly, or else most.

    The totals that pieces can reach are the bits of an integer; pieces are added, longest first, until the whole length is reached.
    """
    left = {s: n for s, n in sorted(items.items(), reverse=True) if n}
    out = []
    while left:
        first = next(iter(left))
        left[first] -= 1
        room, reached, steps = length - first, 1, []
        mask = (1 << (room + 1)) - 1
        for s, n in left.items():
            if s > room:
                continue
            for _ in range(min(n, room // s)):
                steps.append((s, reached))
                reached |= (reached << s) & mask
                if reached >> room & 1:
                    break
            if reached >> room & 1:
                break
        total, row = reached.bit_length() - 1, [first]
        if padded(first, length) == first and total < room:
            total = 0  # better alone than padded
        for s, before in reversed(steps):
            if not before >> total & 1:
                row.append(s)
                left[s] -= 1
                total -= s
        left = {s: n for s, n in left.items() if n}
        out.append(row)
    return out


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, copies in a sequence, offset): pieces of that length ranked lo to hi - 1 go there.

    Full pieces and pairs of lengths that fill a sequence need no program. Of the rest, the linear program's patterns with GAP
    padding at most are rounded down, those without any then up while demand lasts. What is left is filled exactly one sequence at a
    time, in passes: where it is more than FILLED pieces, a thinned histogram of about as many is filled and each of its
    sequences stands for many, until all are placed. So the work does not depend on the number of pieces.
    """
    left = {s: n for s, n in histogram.items() if n}
    patterns: list[tuple[dict[int, int], int]] = []

    def take(col: dict[int, int], most: int) -> None:
        n = min([most, *(left[s] // k for s, k in col.items())])
        if n > 0:
            patterns.append((col, n))
            for s, k in col.items():
                left[s] -= n * k

    for s in sorted(left, reverse=True):
        if s == length:
            take({s: 1}, left[s])
        elif 2 * s > length and length - s in left:
            take({s: 1, length - s: 1}, left[s])
        elif 2 * s == length:
            take({s: 2}, left[s])
    sizes = np.array(sorted(s for s, n in left.items() if n))
    if len(sizes):
        solved = column_generation(sizes, np.array([left[int(s)] for s in sizes], float), length)
        solved = [({int(sizes[i]): k for i, k in col.items()}, v) for col, v in solved]
        total = {i: sum(s * k for s, k in col.items()) for i, (col, _) in enumerate(solved)}
        tight = [i for i in total if padded(total[i], length) == total[i]]
        for i in tight:
            take(solved[i][0], int(solved[i][1] + 1e-6))
        for i in sorted(tight, key=lambda i: -(solved[i][1] % 1)):
            take(solved[i][0], 1)
        for i, (col, v) in enumerate(solved):
            if padded(total[i], length) - total[i] <= GAP * length:
                take(col, int(v + 1e-6))
        while pieces := sum(left.values()):
            each = -(-pieces // FILLED)
            thin = {s: n // each for s, n in left.items()}
            if not any(thin.values()):  # fewer of each length than stand for one
                each, thin = 1, left
            for row in exact_fill(thin, length):
                counted: dict[int, int] = defaultdict(int)
                for s in row:
                    counted[s] += 1
                take(dict(counted), each)
    rows, used, sequence = [], defaultdict(int), 0
    for col, n in patterns:
        offset = 0
        for s, k in sorted(col.items(), reverse=True):
            rows.append((s, used[s], used[s] + n * k, sequence, k, offset))
            used[s] += n * k
            offset += s * k
        sequence += n
    return rows


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (null or empty text: none; those of added tokens in a text included) and END_ID are cut into full pieces, each a sequence of its own, and one rest.
    The histogram of lengths (length rows at most, whatever the corpus) goes to the driver, where a linear program over
    patterns of lengths, columns priced by a knapsack, is solved and rounded (plan). Pieces are ranked
    within their length: a length's pieces are split by hash into groups of about RANKED rows, whose counts give each group's
    first rank, so a length that a third of all pieces share is ranked by many tasks. A rank is looked up in the plan,
    a broadcast of a few rows for each pattern, which the number of lengths bounds.

    Rows that repeat a doc_id are packed as separate documents. Empty table: no rows. Sequences have at most length ids; one whose ids
    are no power of two is padded to length.
    """
    spark = docs.sparkSession
    pieces = stored(tokenized_pieces(docs, path or vocabulary_path(), length), "pieces", "zstd")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = spark.createDataFrame([(s, -(-n // RANKED)) for s, n in histogram.items()], "_length long, _groups long")
    places = spark.createDataFrame(plan(histogram, length), "_length long, _lo long, _hi long, _first long, _copies long, _offset long")
    dealt = pieces.join(F.broadcast(groups), F.col("length") == F.col("_length")).withColumn("_group", F.pmod(F.xxhash64("doc_id", "start"), "_groups")).drop("_length", "_groups")
    counts = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(counts.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "ranks")
    ranked = dealt.join(firsts, ["length", "_group"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32")) - 1)
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    k = F.col("_rank") - F.col("_lo")
    sequence, offset = F.col("_first") + F.floor(k / F.col("_copies")), F.col("_offset") + k % F.col("_copies") * F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
