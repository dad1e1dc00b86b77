"""Effects on single characters in batches, beside a plain loop over characters and draws by hashlib."""

import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions.draw import batch_draws, draw
from folio.operators import degrade

TEXT = "Été 2024: l'œuvre, «O0l1» 𝔘nicode\nrn cl vv ecao. " * 7 + "end"


def number(*keys) -> int:
    return int(md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16)


def plain(effect, text, chance, prefix):
    """One stretch after the other, one gap after the other."""
    chance, among = min(1.0, chance * degrade._TIMES[effect]), degrade._AMONG.get(effect, "")
    out = ""
    for j in range(math.ceil(len(text) / 64)):
        s, at, k = text[64 * j : 64 * j + 64], 0, 0
        while at < len(s) and (not among or set(s) & set(among)):
            gap = 0 if chance >= 1 else min(64, math.floor(math.log((number(prefix, j, k) + 1) / 2**32) / math.log(1 - chance)))
            out, at, k = out + s[at : at + gap], at + gap, k + 1
            if at < len(s):
                c = s[at]
                out += {"LowLightNoise": "" if c in among else c, "Brightness": "", "Dithering": c + " " * (c.isascii() and (c.isalnum() or c == "_")), "NoiseTexturize": c + ("." if number(prefix, c) < 2**31 else "~")}.get(effect, degrade._SWAPS.get(effect, {}).get(c, c))
                at += 1
        out += s[at:]
    return out


@pytest.mark.parametrize("prefix", ["5:17:2:Jpeg", "5:" + "long key é " * 9])
def test_batch_draws(spark, prefix):
    row, j = np.array([0, 0, 1, 1]), np.array([0, 123, 9, 10])
    got = batch_draws([prefix.encode(), b"1"], row, j)
    for k in (0, 9, 10, 64):
        assert got(np.arange(4), k).tolist() == [number(p, n, k) for p, n in ((prefix, 0), (prefix, 123), ("1", 9), ("1", 10))]
    assert got(np.array([1]), 7).tolist() == [spark.range(1).select(draw(prefix, 123, 7)).first()[0]]


def test_all_effects_share_a_pass(spark):
    rows = [(1, TEXT), (2, ""), (3, None), (4, TEXT[5:70]), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chances = {"LowLightNoise": 0.03, "NoiseTexturize": 0.2, "ColorShift": 0.2, "Brightness": 0.05, "Gamma": 0.04, "Dithering": 0.3, "Jpeg": 0.1}
    steps = [(e, F.col("doc_id") != 5 if e == "Jpeg" else F.lit(True), F.lit(c), (7, F.col("doc_id"), e)) for e, c in chances.items()]
    out = degrade.in_turn(df.withColumn("degraded", F.col("text")), steps)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in out.collect():
        want = r["text"]
        for e, c in chances.items():
            if want and not (e == "Jpeg" and r["doc_id"] == 5):
                want = plain(e, want, c, f"7:{r['doc_id']}:{e}:{e}")
        assert r["degraded"] == want
    sure = df.select(degrade.rule("Brightness", F.col("text"), F.lit(1.0), 1).alias("t"), degrade.rule("Jpeg", F.col("text"), F.lit(0.0), 1).alias("u"), "text").collect()
    assert all(r["t"] == (None if r["text"] is None else "") and r["u"] == r["text"] for r in sure)
