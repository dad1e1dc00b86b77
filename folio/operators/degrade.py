"""Degradation of clean text: noisy copies paired with their source.

Rules, one for each effect of the presets. A character's chance is 0.1 x / x_max, x drawn from the effect's range and x_max the upper
end of the heaviest preset (for Brightness x = |1 - b|, for Jpeg x = 100 - quality); without a range it is 0.02.
"""

from __future__ import annotations

from hashlib import md5
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draw import batch_draws, col, fraction
from ..sources.effects import DISABLED, INK, PAPER, POST, phase_of, preset

#: Effects with a rule for text.
RULES = ["InkBleed", "LowLightNoise", "Markup", "NoiseTexturize", "ColorShift", "Brightness", "Gamma", "Dithering", "Jpeg"]
_MAX = {"InkBleed": 0.8, "NoiseTexturize": 20.0, "ColorShift": 40.0, "Brightness": 0.4, "Jpeg": 60.0}
_ACCENTS, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def rate(effect: str, low: float | None, high: float | None, *keys) -> Column:
    if low is None or effect not in _MAX:
        return F.lit(0.02)
    x = low + (high - low) * fraction(*keys, effect, "x")
    x = F.abs(1 - x) if effect == "Brightness" else 100 - x if effect == "Jpeg" else x
    return F.least(F.lit(1.0), 0.1 * x / _MAX[effect])


#: Characters that are searched for hits together: the gaps between hits have no memory, so each stretch may begin anew.
STRETCH = 64


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


#: Characters of a batch that are worked together.
_TOGETHER = 1 << 20

#: Effects on single characters: how often the chance counts, and the characters that can change (all, if none are named).
_AMONG = {"LowLightNoise": ".,':", "ColorShift": _ACCENTS, "Gamma": "O0l1", "Jpeg": "ecao"}
_TIMES = {"LowLightNoise": 5, "NoiseTexturize": 1, "ColorShift": 10, "Brightness": 1, "Gamma": 5, "Dithering": 1, "Jpeg": 2}
_SWAPS = {"ColorShift": dict(zip(_ACCENTS, _PLAIN, strict=True)), "Gamma": {"O": "0", "0": "O", "l": "1", "1": "l"}, "Jpeg": {"e": "c", "c": "e", "a": "o", "o": "a"}}
_WORD = np.array([chr(i).isalnum() or chr(i) == "_" for i in range(128)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _hits(codes: np.ndarray, lengths: np.ndarray, chances: np.ndarray, prefixes: list[bytes], among: str) -> np.ndarray:
    """Places in codes, texts of lengths one after the other, of the characters that are hit, in order.

    What is drawn is not every character's fate but the gaps between hits, which are geometric: a stretch of STRETCH characters
    takes one draw more than it has hits. The k-th draws of all stretches are made together.
    """
    pieces = -(-lengths // STRETCH)
    row = np.repeat(np.arange(len(lengths)), pieces)
    j = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(lengths) - lengths, pieces) + j * STRETCH
    size = np.minimum(STRETCH, np.repeat(lengths, pieces) - j * STRETCH)
    if among:
        some = np.logical_or.reduceat(np.isin(codes, _codes(among)), start) if len(start) else np.zeros(0, bool)
        row, j, start, size = row[some], j[some], start[some], size[some]
    draws, chance = batch_draws(prefixes, row, j), chances[row]
    with np.errstate(divide="ignore"):
        scale = np.log(1 - np.minimum(chance, 1))
    scale[scale == 0] = -1e-300
    live, at, found = np.arange(len(row)), np.zeros(len(row), np.int64), []
    for k in range(STRETCH):
        u = (draws(live, k) + 1.0) / 4294967296.0
        at = at + np.minimum(STRETCH, np.floor(np.log(u) / scale[live])).astype(np.int64)  # a chance of 1 has no gaps: its scale is endless
        inside = at < size[live]
        live, at = live[inside], at[inside]
        found.append(start[live] + at)
        at = at + 1
        more = at < size[live]
        live, at = live[more], at[more]
        if not len(live):
            break
    return np.sort(np.concatenate(found))


def _specks(prefixes: list[bytes], rows: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """For each hit character the speck that its row draws for that character."""
    pairs, back = np.unique(rows << 21 | hit, return_inverse=True)
    dots = [md5(prefixes[p >> 21] + b":" + chr(p & 0x1FFFFF).encode()).digest()[0] < 128 for p in pairs.tolist()]
    return np.where(np.array(dots, bool), ord("."), ord("~"))[back]


def _apply(effect: str, codes: np.ndarray, lengths: np.ndarray, chances: np.ndarray, prefixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """codes and lengths of texts after an effect on single characters."""
    places = _hits(codes, lengths, chances, prefixes, _AMONG.get(effect, ""))
    rows = np.repeat(np.arange(len(lengths)), lengths)[places]
    hit = codes[places].astype(np.int64)
    if effect in _SWAPS:
        out = codes.copy()
        for a, b in _SWAPS[effect].items():
            out[places[hit == ord(a)]] = ord(b)
        return out, lengths
    if effect in ("LowLightNoise", "Brightness"):
        gone = np.isin(hit, _codes(_AMONG[effect])) if effect in _AMONG else np.ones(len(hit), bool)
        return np.delete(codes, places[gone]), lengths - np.bincount(rows[gone], minlength=len(lengths))
    more = (hit < 128) & _WORD[np.minimum(hit, 127)] if effect == "Dithering" else np.ones(len(hit), bool)
    new = ord(" ") if effect == "Dithering" else _specks(prefixes, rows, hit)
    return np.insert(codes, places[more] + 1, new), lengths + np.bincount(rows[more], minlength=len(lengths))


def _after(effects: list[str], texts: list[str], chances: list[np.ndarray], prefixes: list[list[str]]) -> list[str]:
    """texts after effects on single characters, one after the other; texts whose chance is not above 0 pass an effect by."""
    codes, lengths = _codes("".join(texts)), np.array([len(t) for t in texts])
    for effect, chance, prefix in zip(effects, chances, prefixes, strict=True):
        struck = (chance > 0) & (lengths > 0)
        if struck.all():
            codes, lengths = _apply(effect, codes, lengths, chance, [p.encode() for p in prefix])
        elif struck.any():
            own = np.repeat(struck, lengths)
            some, sizes = _apply(effect, codes[own], lengths[struck], chance[struck], [prefix[i].encode() for i in np.flatnonzero(struck).tolist()])
            new = lengths.copy()
            new[struck] = sizes
            rest, own = codes[~own], np.repeat(struck, new)
            codes, lengths = np.empty(len(own), np.uint32), new
            codes[own], codes[~own] = some, rest
    whole, ends = codes.tobytes().decode("utf-32-le"), np.cumsum(lengths).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _characters(text: Column, steps: list[tuple[str, Column, tuple]]) -> Column:
    """text after effects (name, chance, keys) on single characters, in order, in one pass of Arrow batches; a null chance leaves it as it is."""
    effects = [s[0] for s in steps]

    def batch(texts: pd.Series, *given: pd.Series) -> pd.Series:
        out, rows, size = [None] * len(texts), [], 0
        chances = [c.to_numpy(np.float64, na_value=0.0) for c in given[::2]]
        texts, prefixes = texts.tolist(), [p.tolist() for p in given[1::2]]

        def work() -> None:
            done = _after(effects, [texts[i] for i in rows], [c[rows] for c in chances], [[p[i] for i in rows] for p in prefixes])
            for i, t in zip(rows, done, strict=True):
                out[i] = t

        for i, t in enumerate(texts):
            if t is not None:
                rows.append(i)
                size += len(t)
            if rows and size >= _TOGETHER:
                work()
                rows, size = [], 0
        if rows:
            work()
        return pd.Series(out, dtype=object)

    given = []
    for effect, chance, keys in steps:
        given += [F.when(chance.isNotNull(), F.least(F.lit(1.0), chance * _TIMES[effect])), F.concat_ws(":", *[col(k).cast("string") for k in keys])]
    return F.pandas_udf(batch, "string")(text, *given)


def rule(effect: str, text: Column, chance: Column, *keys) -> Column:
    """One effect on a text."""
    k = (*keys, effect)
    if effect in _TIMES:
        return _characters(text, [(effect, chance, k)])
    if effect == "InkBleed":  # look-alike pairs run together
        joined = F.replace(F.replace(F.replace(text, F.lit("rn"), F.lit("m")), F.lit("cl"), F.lit("d")), F.lit("vv"), F.lit("w"))
        per_word = F.transform(F.split(text, " "), lambda w, i: F.when(w.rlike("rn|cl|vv") & (fraction(*k, i) < F.least(F.lit(1.0), chance * 5)), F.replace(F.replace(F.replace(w, F.lit("rn"), F.lit("m")), F.lit("cl"), F.lit("d")), F.lit("vv"), F.lit("w"))).otherwise(w))
        return F.when(chance >= 1, joined).otherwise(F.array_join(per_word, " "))
    if effect == "Markup":  # a run of words is struck out
        def struck(x: Column) -> Column:
            words, first, n = x["words"], x["first"], F.ceil(chance * F.size(x["words"])).cast("int")
            run = F.transform(F.slice(words, first + 1, n), lambda w: F.repeat(F.lit("_"), F.length(w)))
            return F.array_join(F.concat(F.slice(words, F.lit(1), first), run, F.slice(words, first + n + 1, F.size(words))), " ")

        chosen = lambda words: F.struct(words.alias("words"), F.floor(fraction(*k, "first") * F.size(words)).cast("int").alias("first"))
        return _let(_let(F.split(text, " "), chosen), struck)
    return text


def in_turn(df: DataFrame, steps: list[tuple[str, Column, Column, tuple]]) -> DataFrame:
    """df with degraded after effects (name, whether drawn, chance, keys) in order: a projection for each, so that it reads the text once; those on single characters that follow one another share a pass."""
    out = df
    for single, run in groupby(steps, lambda s: s[0] in _TIMES):
        if single:
            out = out.withColumn("degraded", _characters(F.col("degraded"), [(effect, F.when(drawn, chance), (*keys, effect)) for effect, drawn, chance, keys in run]))
        else:
            for effect, drawn, chance, keys in run:
                out = out.withColumn("degraded", F.coalesce(F.when(drawn, rule(effect, F.col("degraded"), chance, *keys)), F.col("degraded")))
    return out


def _chain(df: DataFrame, effects: list[tuple[str, float, float | None, float | None]], seed: int, key: str, text: str) -> DataFrame:
    """Effects in order; applied lists those that ran."""
    steps, applied = [], []
    for at, (effect, p, low, high) in enumerate(effects):
        keys = (seed, F.col(key), at, effect)
        drawn = fraction(*keys, "p") < p
        steps.append((effect, drawn, rate(effect, low, high, *keys), keys))
        applied.append(F.when(drawn & F.col(text).isNotNull(), F.lit(effect)))
    listed = F.array_compact(F.array(*applied)) if applied else F.array().cast("array<string>")
    return in_turn(df.withColumn("degraded", F.col(text)).withColumn("applied", listed), steps)


def degrade(df: DataFrame, name: str, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with degraded and applied: a preset's effects in order, ink, paper, post, each with its probability."""
    return _chain(df, preset(name), seed, key, text)


def degrade_custom(df: DataFrame, effects: list[tuple[str, float, float | None, float | None]], seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Given effects sorted into phases (unknown ones come last); none: a copy."""
    order = {"ink": 0, "paper": 1, "post": 2}
    return _chain(df, sorted(effects, key=lambda e: order[phase_of(e[0])]), seed, key, text)


def degrade_chain(df: DataFrame, names: list[str], seed: int, params: dict[str, tuple[float, float]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Effects in the given order, each applied; unknown names are refused, one that gives no text is skipped."""
    unknown = [n for n in names if n not in INK + PAPER + POST]
    if unknown:
        raise ValueError(f"unknown effects: {unknown}")
    chosen = [(n, 1.0, *(params or {}).get(n, (None, None))) for n in names if n not in DISABLED]
    return _chain(df, chosen, seed, key, text)


def degrade_one(df: DataFrame, name: str, seed: int, low: float | None = None, high: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A single effect, always applied; a disabled one is refused."""
    if name in DISABLED:
        raise ValueError(f"{name} is disabled")
    if name not in INK + PAPER + POST:
        raise KeyError(name)
    return _chain(df, [(name, 1.0, low, high)], seed, key, text)
