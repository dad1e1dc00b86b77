"""Repeatable draws that depend on their keys alone, never on partitions or order."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def draw(*keys) -> Column:
    """A whole number from 0 to 2**32 - 1: the first eight hex digits of md5 of the keys joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint")


def fraction(*keys) -> Column:
    """A draw from [0, 1)."""
    return draw(*keys) / F.lit(4294967296.0)


def between(low, high, *keys) -> Column:
    """A whole number from low to high, both included."""
    return (col(low) + draw(*keys) % (col(high) - col(low) + 1)).cast("bigint")


def gauss(*keys) -> Column:
    """A standard normal draw (Box-Muller)."""
    u = (draw(*keys, "u") + 1) / F.lit(4294967297.0)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * fraction(*keys, "v"))


def pick(values: list[str], *keys) -> Column:
    """One of a short list of strings."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(*keys) % len(values) + 1).cast("int"))


# ---- the same draws in Arrow batches

#: Messages of md5 that are worked together, and the bytes of a block that a message may fill.
_TOGETHER, _ROOM = 16_384, 55
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _first_words(blocks: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of messages that are padded to one block of 64 bytes each."""
    out = np.empty(len(blocks), np.uint32)
    for at in range(0, len(blocks), _TOGETHER):
        words = np.ascontiguousarray(blocks[at : at + _TOGETHER].view("<u4").T)
        filled = words.any(axis=1)
        a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
        for i in range(64):
            turn = i // 16
            g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16
            f = d ^ (b & (c ^ d)) if turn == 0 else c ^ (d & (b ^ c)) if turn == 1 else b ^ c ^ d if turn == 2 else c ^ (b | ~d)
            f += a
            f += _SINES[i]
            if filled[g]:
                f += words[g]
            left = np.uint32(_SHIFTS[turn][i % 4])
            new = f << left
            f >>= np.uint32(32) - left
            new |= f
            new += b
            a, d, c, b = d, c, b, new
        out[at : at + _TOGETHER] = (a + _START[0]).byteswap()
    return out


def batch_draws(prefixes: list[bytes], row: np.ndarray, j: np.ndarray):
    """A function (some, k) that gives draw(prefix, j, k), as numbers, for the places `some` of row and j: rows of prefixes, and a number."""
    digits = len(str(int(j.max(initial=0))))
    sizes = np.array([len(p) for p in prefixes])
    if sizes.max(initial=0) + digits + 12 > _ROOM:  # too long for one block
        stems = [prefixes[r] + b":%d:" % n for r, n in zip(row.tolist(), j.tolist(), strict=True)]
        return lambda some, k: np.array([int.from_bytes(md5(stems[i] + b"%d" % k).digest()[:4], "big") for i in some.tolist()], np.uint32)
    starts = np.frombuffer(b"".join(p.ljust(64, b"\0") for p in prefixes), np.uint8).reshape(-1, 64)
    blocks, end = starts[row], sizes[row]
    flat, base = blocks.reshape(-1), np.arange(len(row)) * 64
    flat[base + end] = ord(":")
    n = np.ones(len(row), np.int64)
    for d in range(1, digits):
        n += j >= 10**d
    for d in range(digits):
        has = n > d
        flat[(base + end + n - d)[has]] = 48 + (j[has] // 10**d) % 10
    end = end + n + 2
    flat[base + end - 1] = ord(":")

    def numbers(some: np.ndarray, k: int) -> np.ndarray:
        own, last = blocks[some], end[some].copy()
        cells, at = own.reshape(-1), np.arange(len(some)) * 64
        for x in b"%d\x80" % k:
            cells[at + last] = x
            last += 1
        bits = (last - 1) * 8
        own[:, 56], own[:, 57] = bits & 255, bits >> 8
        return _first_words(own)

    return numbers
