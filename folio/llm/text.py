"""Helpers of the operators that read texts in Arrow batches."""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
import xxhash


def texts(column: pa.Array) -> list[bytes]:
    """The texts of a column in UTF-8; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, for arrays of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive entries of h; empty where h is shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, (seed * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ h[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(35)
    return mixed(out)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width entries of h the place of its leftmost least entry, from doubling spans."""
    n = len(h) - width + 1
    best, at, span = h.copy(), np.arange(len(h)), 1
    while span * 2 <= width:
        left, right = best[:-span], best[span:]
        later = right < left
        at = np.where(later, at[span:], at[:-span])
        best = np.minimum(left, right)
        span *= 2
    rest = width - span
    later = best[rest : rest + n] < best[:n]
    return np.where(later, at[rest : rest + n], at[:n])


def portions(column: pa.Array, most_bytes: int = 1 << 19):
    """(first row, texts) of a column, about most_bytes of text at a time, in one piece each text."""
    part, first, size = [], 0, 0
    for i in range(len(column)):
        t = column[i].as_buffer()
        part.append(t.to_pybytes() if t is not None else b"")
        size += len(part[-1])
        if size >= most_bytes:
            yield first, part
            part, first, size = [], i + 1, 0
    if part:
        yield first, part


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Words longer than this are hashed one by one.
LONG_WORD = 64
#: The bytes that count of a group of eight of which so many belong to a word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


def new_key() -> int:
    """A secret of one run: whoever wrote the texts cannot have looked for words that it hashes alike."""
    return secrets.randbits(64)


#: Bytes that are worked at once.
PART = 1 << 19


def _hashed_words(raw: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of raw, which neither begins nor ends within one: eight bytes after the other are mixed into a state that begins with key and length."""
    edge = np.diff(np.concatenate([[True], _IS_SPACE[raw], [True]]).view(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(raw) + 1,), (1,))
    length = ends - starts
    with np.errstate(over="ignore"):
        h = mixed(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    at, left, open_ = starts, length, np.arange(len(starts))
    for _ in range(LONG_WORD // 8):
        h[open_] = mixed(h[open_] ^ (eights[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        if not more.any():
            break
        at, left, open_ = at[more] + 8, left[more] - 8, open_[more]
    for i in np.nonzero(length > LONG_WORD)[0]:
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), key)
    return starts, h


def word_hashes(texts_: list[bytes], key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes under key of the words [^\\x20\\x09-\\x0D]+ of all texts in order, number of words of each text), PART bytes at a time (longer words as they are)."""
    data = b"\n".join(texts_)
    raw, at, starts, hashes = np.frombuffer(data, np.uint8), 0, [], []
    while at < len(raw) or not starts:
        end = at + PART
        while end < len(raw) and not len(gap := np.nonzero(_IS_SPACE[raw[end : end + 4096]])[0]):
            end += 4096
        end = min(len(raw), end + (int(gap[0]) if end < len(raw) else 0))
        s, h = _hashed_words(raw[at:end], key)
        starts.append(s + at)
        hashes.append(h)
        at = max(end, at + 1)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts_])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), bounds))
