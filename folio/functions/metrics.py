"""Error rates, confidence and reward of recognised text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

#: White space as Python splits at it: Unicode's and \x1c to \x1f.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def sequence_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences, bit-parallel (Hyyrö 2003): a whole column of the table is two integers."""
    if not a or not b:
        return len(a) or len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        at = places.get(x, 0)
        diagonal = (((at & up) + up) ^ up) | at | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
    return score


#: Pairs from which on columns of all of them are worked at once, and code points compared in one step.
TOGETHER, CELLS = 48, 1 << 20


def bounds(a: Sequence, b: Sequence) -> tuple[int, int]:
    """A lower and an upper bound of the distance of two sequences: what one holds more often than the other, and what differs place by place."""
    more = Counter(a)
    more.subtract(b)
    over = sum(n for n in more.values() if n > 0)
    return max(over, over + len(b) - len(a)), sum(map(ne, a, b)) + abs(len(a) - len(b))


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without the start and the end that they share."""

    def shared(same, most: int) -> int:
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(mid) else (low, mid - 1)
        return low

    n = shared(lambda k: a[:k] == b[:k], min(len(a), len(b)))
    a, b = a[n:], b[n:]
    n = shared(lambda k: a[len(a) - k :] == b[len(b) - k :], min(len(a), len(b)))
    return (a[: len(a) - n], b[: len(b) - n]) if n else (a, b)


def _columns(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Distances of pairs whose first texts all take as many words of 64 bits: the blocks of the bit-parallel table (Myers 1999) of all pairs advance together, column by column."""
    m, n = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    blocks = -(-int(m.max()) // 64)
    first = np.full((len(pairs), 64 * blocks), 0xFFFFFFFF, np.uint32)
    second = np.full((len(pairs), int(n.max())), 0xFFFFFFFE, np.uint32)
    for i, (x, y) in enumerate(pairs):
        first[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        second[i, : len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)
    one, last = np.uint64(1), ((m - 1) % 64).astype(np.uint64)
    up, down, score = [np.full(len(pairs), ~np.uint64(0)) for _ in range(blocks)], [np.zeros(len(pairs), np.uint64) for _ in range(blocks)], m.copy()
    for j in range(second.shape[1]):
        same = np.packbits(first == second[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)
        rises, falls = np.ones(len(pairs), np.uint64), np.zeros(len(pairs), np.uint64)  # the row above the first grows by one
        for k in range(blocks):
            eq, pv, mv = same[:, k], up[k], down[k]
            xv = eq | mv
            eq = eq | falls
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if k == blocks - 1:
                score += np.where(j < n, ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64), 0)
            out = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = ph << one | rises, mh << one | falls
            up[k], down[k] = mh | ~(xv | ph), ph & xv
            rises, falls = out
    return score


#: Pairs and characters of a slab that is compared place by place, classes of characters that are counted, and pairs whose bands advance together.
_PAIRS, _CHARS, _CLASSES, _BANDS = 4096, 1 << 22, 256, 512


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _slabs(rows: list[int], sizes: list[int]) -> Iterator[list[int]]:
    part, n = [], 0
    for i in rows:
        part.append(i)
        n += sizes[i]
        if len(part) >= _PAIRS or n >= _CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _more(rows_a: np.ndarray, a: np.ndarray, rows_b: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n pairs what one holds more often than the other, by classes of characters: at most the distance, as characters of one class pass for equal."""
    count = lambda rows, codes: np.bincount(rows * _CLASSES + codes % _CLASSES, minlength=n * _CLASSES).reshape(n, _CLASSES)
    net = count(rows_a, a) - count(rows_b, b)
    over = np.maximum(net, 0).sum(axis=1)
    return np.maximum(over, over - net.sum(axis=1))


def _place_by_place(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distances of pairs whose texts are as long as each other: where places are equal they cancel out."""
    a, b, ends = _codes([p[0] for p in pairs]), _codes([p[1] for p in pairs]), np.cumsum([len(p[0]) for p in pairs])
    at = np.flatnonzero(a != b)
    rows = np.searchsorted(ends, at, "right")
    return _more(rows, a[at], rows, b[at], len(pairs)), np.bincount(rows, minlength=len(pairs))


def _band(pairs: list[tuple[str, str]], limits: np.ndarray) -> np.ndarray:
    """Distances of pairs, or more than its limit where a distance is beyond that: of the table only the diagonals that so few edits can reach (Ukkonen 1985), all pairs' antidiagonals together."""
    m, n = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    wide, tall = int(n.max()), int(m.max())
    room = (limits - np.abs(n - m)) // 2
    low, high = int((np.minimum(0, n - m) - room).min()), int((np.maximum(0, n - m) + room).max())
    high = max(high, low + 1)
    first, second = np.full((len(pairs), tall), 0xFFFFFFFF, np.uint32), np.full((len(pairs), wide), 0xFFFFFFFE, np.uint32)
    short = wide + tall < 10_000
    for i, (x, y) in enumerate(pairs):
        first[i, : len(x)], second[i, : len(y)] = _codes([x]), _codes([y])
        short &= max(max(x), max(y)) < "\ufffe"
    kind, code, far = (np.int16, np.uint16, 20_000) if short else (np.int32, np.uint32, 1 << 30)
    first, second = np.ascontiguousarray(first.T.astype(code)), np.ascontiguousarray(second.T[::-1].astype(code))  # fillers stay apart
    ones = np.ones((min(tall, (high - low) // 2 + 1), len(pairs)), code)
    before, last, now = (np.full((tall + 3, len(pairs)), far, kind) for _ in range(3))  # row i of the table stands at i + 1
    ending: dict[int, list[int]] = {}
    for i, s in enumerate((m + n).tolist()):
        ending.setdefault(s, []).append(i)
    out = np.zeros(len(pairs), np.int64)
    now[1] = 0
    for s in range(1, max(ending) + 1):
        before, last, now = last, now, before
        i, k = max(0, s - wide, -((high - s) // 2)), min(tall, s, (s - low) // 2)
        cells = now[i + 1 : k + 2]
        np.minimum(last[i : k + 1], last[i + 1 : k + 2], out=cells)
        cells += 1
        p, q = max(i, 1), min(k, s - 1)
        if p <= q:
            across = first[p - 1 : q] ^ second[wide - s + p : wide - s + q + 1]
            across = np.minimum(across, ones[: q - p + 1], out=across).view(kind)  # 0 where they are equal
            across += before[p : q + 1]
            np.minimum(now[p + 1 : q + 2], across, out=now[p + 1 : q + 2])
        now[i], now[k + 2] = far, far
        for pair in ending.get(s, ()):
            out[pair] = now[m[pair] + 1, pair]
    return out


def _banded(cut: dict[int, tuple[str, str]], out: list[int | None]) -> list[int]:
    """Fills out for pairs whose distance lies within a narrow band; returns the others."""
    rest, limits = [], {}
    for part in _slabs(list(cut), {i: len(a) + len(b) for i, (a, b) in cut.items()}):
        rows = [np.repeat(np.arange(len(part)), [len(cut[i][k]) for i in part]) for k in (0, 1)]
        low = _more(rows[0], _codes([cut[i][0] for i in part]), rows[1], _codes([cut[i][1] for i in part]), len(part))
        limits |= zip(part, (2 * low + 16).tolist(), strict=True)
    while limits:
        narrow = [i for i, most in limits.items() if 2 * most < min(map(len, cut[i]))]
        rest += limits.keys() - set(narrow)
        classes: dict[int, list[int]] = {}
        for i in narrow:
            classes.setdefault((limits[i] ** 2).bit_length(), []).append(i)
        again = {}
        for rows in classes.values():
            rows.sort(key=lambda i: len(cut[i][0]))
            for at in range(0, len(rows), _BANDS):
                part = rows[at : at + _BANDS]
                if len(part) < TOGETHER:
                    rest += part
                    continue
                for i, d in zip(part, _band([cut[i] for i in part], np.array([limits[i] for i in part])).tolist(), strict=True):
                    if d <= limits[i]:
                        out[i] = d
                    else:
                        again[i] = 2 * limits[i]
        limits = again
    return rest


def text_distances(pairs: list[tuple[str, str] | None]) -> list[int | None]:
    """Levenshtein distances of many pairs of texts, in code points.

    Pairs of equal lengths are compared place by place, all together: where the bounds meet, as where a reader put single characters for
    others, they are the distance. Other pairs lose the start and the end they share, then go through a band of the table or, where
    that would be wide, through the whole table, together with pairs of like lengths; few or very long ones one by one.
    """
    out: list[int | None] = [None if p is None else 0 for p in pairs]
    apart = [i for i, p in enumerate(pairs) if p is not None and p[0] != p[1]]
    sizes = {i: len(pairs[i][0]) for i in apart}
    left = [i for i in apart if sizes[i] != len(pairs[i][1])]
    for part in _slabs([i for i in apart if sizes[i] == len(pairs[i][1])], sizes):
        low, high = _place_by_place([pairs[i] for i in part])
        for i, x, y in zip(part, low.tolist(), high.tolist(), strict=True):
            if x == y:
                out[i] = x
            else:
                left.append(i)
    cut = {}
    for i in left:
        a, b = _trimmed(*pairs[i])
        if not a or not b:
            out[i] = len(a) or len(b)
        else:
            cut[i] = (a, b)
    hard: dict[int, list[int]] = {}
    for i in _banded(cut, out):
        hard.setdefault(-(-len(cut[i][0]) // 64), []).append(i)
    for blocks, rows in hard.items():
        rows.sort(key=lambda i: len(cut[i][1]))
        most = max(1, CELLS // (64 * blocks))
        for at in range(0, len(rows), most):
            part = rows[at : at + most]
            if len(part) < TOGETHER:
                for i in part:
                    out[i] = sequence_distance(*cut[i])
            else:
                for i, d in zip(part, _columns([cut[i] for i in part]).tolist(), strict=True):
                    out[i] = d
    return out


def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(text_distances([None if x is None or y is None else (x, y) for x, y in zip(a, b, strict=True)]), dtype="Int64")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points, in Arrow batches; the built-in function's whole table, and its band beyond a few per cent of the length, cost more than the batches do."""
    return F.pandas_udf(_distance, LongType())(a, b)


def _rate(distance: Column, predicted: Column, true: Column) -> Column:
    return F.when((true == 0) & (predicted == 0), 0.0).when(true == 0, 1.0).otherwise(distance / true)


def cer(pred: Column, truth: Column) -> Column:
    """Character error rate: distance over length of the truth; 0 for two empty texts, 1 where only the truth is empty; may exceed 1."""
    return _rate(edit_distance(pred, truth).cast("double"), F.length(pred), F.length(truth))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


#: Which characters part words; none beyond these does.
_BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])
_ODD = np.random.default_rng(0).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_bounds(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the second texts, and bounds of the distances in words, of pairs whose texts are as long as each other; -1 words where blanks stand in other places.

    Words that differ are counted by hashes: those that meet pass for equal, so the lower bound stays one.
    """
    a, b, sizes = _codes([p[0] for p in pairs]), _codes([p[1] for p in pairs]), np.array([len(p[0]) for p in pairs])
    count, ends = len(pairs), np.cumsum(sizes)
    blank = _BLANK[np.minimum(b, 0x3001)]
    moved = np.searchsorted(ends, np.flatnonzero(_BLANK[np.minimum(a, 0x3001)] != blank), "right")
    edge = np.zeros(len(b) + 1, bool)
    edge[ends] = edge[0] = True  # where texts start and end
    first = np.flatnonzero(~blank & (edge[:-1] | np.r_[True, blank[:-1]]))
    after = np.flatnonzero(~blank & (edge[1:] | np.r_[blank[1:], True])) + 1
    rows = np.searchsorted(ends, first, "right")
    words = np.bincount(rows, minlength=count)
    at = np.flatnonzero((a != b) & ~blank)
    other = np.unique(np.searchsorted(first, at, "right") - 1)
    high = np.bincount(rows[other], minlength=count)
    low = np.zeros(count, np.int64)
    if len(other):
        long = after[other] - first[other]
        begin = np.cumsum(long) - long
        inside = np.arange(long.sum()) - np.repeat(begin, long)
        place = np.repeat(first[other], long) + inside
        keys = []
        for codes in (a, b):
            h = np.add.reduceat((codes[place].astype(np.uint64) + np.uint64(1)) * _ODD[inside % 256], begin)
            keys.append(rows[other] << 40 | (h >> np.uint64(24)).astype(np.int64))
        kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
        net = np.bincount(which, np.repeat([1, -1], len(other)), minlength=len(kinds))
        low = np.bincount(kinds >> 40, np.maximum(net, 0), minlength=count).astype(np.int64)
    words[moved] = -1
    return words, low, high


def _word_rate(p: str, t: str) -> float:
    p, t = p.split(), t.split()
    low, high = bounds(p, t)
    return (1.0 if p else 0.0) if not t else (low if low == high else sequence_distance(p, t)) / len(t)


def word_rates(pairs: list[tuple[str, str] | None]) -> list[float | None]:
    """Word error rates of many pairs (read, true): those whose words stand in the same places are compared together, the others one by one."""
    out: list[float | None] = [None if p is None else 0.0 for p in pairs]
    apart = [i for i, p in enumerate(pairs) if p is not None and p[0] != p[1]]
    sizes = {i: len(pairs[i][0]) for i in apart}
    left = [i for i in apart if sizes[i] != len(pairs[i][1])]
    for part in _slabs([i for i in apart if sizes[i] == len(pairs[i][1])], sizes):
        for i, n, low, high in zip(part, *(x.tolist() for x in _word_bounds([pairs[i] for i in part])), strict=True):
            if n < 0 or low != high:
                left.append(i)
            elif n:
                out[i] = low / n
    for i in left:
        out[i] = _word_rate(*pairs[i])
    return out


def _wer(pred: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series(word_rates([None if p is None or t is None else (p, t) for p, t in zip(pred, truth, strict=True)]), dtype="float64")


def wer(pred: Column, truth: Column) -> Column:
    """Word error rate, with the same rules for empty texts on word counts; words are parted at Unicode's white space.

    In Arrow batches: built-in functions would look every word up in the line's vocabulary, which costs words times vocabulary.
    """
    return F.pandas_udf(_wer, DoubleType())(pred, truth)


def car(cer_: Column) -> Column:
    """Character accuracy: 1 - cer, at least 0."""
    return 1 - F.least(cer_, F.lit(1.0))


def mean_confidence(scores: Column) -> Column:
    """Mean of an array; 0 for an empty or null one."""
    return F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, 0.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))


def reward(car_: Column, confidence: Column, similarity: Column) -> Column:
    """0.5 accuracy + 0.3 confidence + 0.2 (1 - similarity of degraded and clean)."""
    return 0.5 * car_ + 0.3 * confidence + 0.2 * (1 - similarity)


def text_similarity(a: Column, b: Column) -> Column:
    """1 - distance over length of b, at least 0."""
    return 1 - F.least(F.lit(1.0), edit_distance(a, b) / F.greatest(F.lit(1), F.length(b)))
