"""Documents by candidate parameters, scored in one job."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draw import fraction
from ..functions.metrics import car, cer, reward
from ..functions.params import action_to_params
from .degrade import in_turn


#: Effects in their order, with the parameter that is their probability, and their chance per character.
STEPS = [
    ("InkBleed", "ink_bleed_p", lambda p: p("intensity_high") * 0.1),
    ("LowLightNoise", "fading_p", lambda p: F.lit(0.02)),
    ("Markup", "markup_p", lambda p: F.lit(0.02)),
    ("NoiseTexturize", "noise_p", lambda p: p("sigma_high") * 0.005),
    ("ColorShift", "color_shift_p", lambda p: F.lit(0.02)),
    ("Brightness", "brightness_p", lambda p: (p("brightness_high") - 1) * 0.25),
    ("Gamma", "gamma_p", lambda p: F.lit(0.02)),
    ("Jpeg", "jpeg_p", lambda p: F.lit(0.05)),
]
#: Candidate vectors that are broadcast at a time.
TOGETHER = 10_000


def sweep(docs: DataFrame, actions: DataFrame, seed: int = 0, together: int = TOGETHER) -> DataFrame:
    """(doc_id, action_id, degraded, reward) of docs(doc_id, text) under each of actions(action_id, action), candidate vectors that are broadcast about `together` at a time.

    Fading, markup, specks, vanishing characters and look-alikes take their chances from the vector; confidence is the share of
    characters that stay. Draws depend on seed, doc_id and action_id.
    """
    named = actions.select("action_id", action_to_params(F.col("action")).alias("params"))
    blocks, out = max(1, -(-named.count() // together)), None
    for block in range(blocks):
        part = named if blocks == 1 else named.where(F.pmod(F.xxhash64("action_id"), F.lit(blocks)) == block)
        one = _scored(docs.select("doc_id", "text").crossJoin(F.broadcast(part)), seed)
        out = one if out is None else out.unionByName(one)
    return out


def _scored(pairs: DataFrame, seed: int) -> DataFrame:
    named = lambda n: F.col(f"params.{n}")
    steps = []
    for effect, p, chance in STEPS:
        keys = (seed, F.col("doc_id"), F.col("action_id"), effect)
        steps.append((effect, fraction(*keys, "p") < named(p), chance(named), keys))
    out = in_turn(pairs.withColumn("degraded", F.col("text")), steps)
    kept = F.least(F.lit(1.0), F.length("degraded") / F.greatest(F.lit(1), F.length("text")))
    out = out.withColumn("_cer", cer(F.col("degraded"), F.col("text")))
    # the distance over the text's length is the error rate, so similarity needs no second distance
    alike = 1 - F.least(F.lit(1.0), F.when(F.length("text") == 0, F.length("degraded").cast("double")).otherwise(F.col("_cer")))
    return out.select("doc_id", "action_id", "degraded", reward(car(F.col("_cer")), kept, alike).alias("reward"))


def race(docs: DataFrame, actions: DataFrame, seed: int = 0, first: int = 256, delta: float = 0.01) -> DataFrame:
    """(action_id, n, mean, low, high, round) of each candidate: those of the highest mean reward over all docs, found without scoring all docs for all of them.

    Rounds take a share of the docs by a hash, about `first` of them at the start and twice as many each time, and score the new ones for the candidates that are
    left. Rewards lie in [0, 1], so with probability 1 - delta every mean over all docs lies between low and high in every round (the narrower of
    Hoeffding's bound and the empirical Bernstein bound, shared over candidates and rounds); who lies below another's low leaves. The last round takes all docs: those that reach it have their exact mean. The winner is the one of
    highest mean there, ties to the smaller action_id. The driver holds a row for each candidate.
    """
    total, candidates = docs.count(), actions.count()
    rounds = max(1, math.ceil(math.log2(max(1, total) / first)) + 1)
    state = {r["action_id"]: [0, 0.0, 0.0, 1.0, 0, 0.0] for r in actions.select("action_id").collect()}
    left, before = set(state), 0.0
    for k in range(1, rounds + 1):
        share = 1.0 if k == rounds else first * 2 ** (k - 1) / total
        place = fraction(seed, F.col("doc_id"), "race")
        some = docs.where((place >= before) & (place < share))
        sums = sweep(some, actions.where(F.col("action_id").isin(sorted(left))), seed).groupBy("action_id").agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("sum"), F.sum(F.col("reward") * F.col("reward")).alias("squares"))
        for r in sums.collect():
            own = state[r["action_id"]]
            own[0], own[1], own[4], own[5] = own[0] + r["n"], own[1] + r["sum"], k, own[5] + r["squares"]
            n, mean, odds = own[0], own[1] / own[0], math.log(6 * candidates * rounds / delta)
            spread = max(0.0, own[5] / n - mean * mean)
            radius = 0.0 if k == rounds else min(math.sqrt(odds / (2 * n)), math.sqrt(2 * spread * odds / n) + 3 * odds / n)
            own[2], own[3] = max(0.0, mean - radius), min(1.0, mean + radius)
        bar = max((state[a][2] for a in left), default=0.0)
        left, before = {a for a in left if state[a][3] >= bar}, share
    rows = [(a, n, s / n if n else None, low, high, k) for a, (n, s, low, high, k, _) in state.items()]
    return docs.sparkSession.createDataFrame(rows, "action_id long, n long, mean double, low double, high double, round int")


def winner(raced: DataFrame) -> DataFrame:
    """(action_id, mean) of race's winner."""
    return raced.orderBy(F.desc("round"), F.desc("mean"), "action_id").limit(1).select("action_id", "mean")
