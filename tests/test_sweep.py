"""Races against full sweeps."""

import math

from pyspark.sql import functions as F

from folio.operators import evaluate, sweep


def grid(spark):
    vectors = [[a * (j % 3 != 1) + b * (j % 3 == 1) for j in range(12)] for a in (0.0, 0.3, 0.9) for b in (0.0, 0.6)]
    return spark.createDataFrame(list(enumerate(vectors)), "action_id long, action array<double>")


def test_race_has_the_winner_of_the_full_sweep(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("clear modern corn, old vvine: "), F.repeat(F.lit("été "), (F.col("id") % 9).cast("int"))).alias("text")).repartition(4)
    full = {r["action_id"]: r["m"] for r in sweep.sweep(docs, grid(spark)).groupBy("action_id").agg(F.avg("reward").alias("m")).collect()}
    raced = {r["action_id"]: r for r in sweep.race(docs, grid(spark), first=100).collect()}
    best = max(full, key=lambda a: (full[a], -a))
    assert raced.keys() == full.keys()
    won = sweep.winner(sweep.race(docs, grid(spark), first=100)).first()
    assert won["action_id"] == best and math.isclose(won["mean"], full[best])
    last = max(r["round"] for r in raced.values())
    for a, r in raced.items():
        assert r["low"] - 1e-9 <= full[a] <= r["high"] + 1e-9
        assert (r["n"] == 3000) == (r["round"] == last)
    assert sum(r["n"] for r in raced.values()) < 0.9 * 3000 * len(full)  # some left early


def test_sweep_in_blocks(spark):
    docs = spark.createDataFrame([(1, "corn, clear"), (2, ""), (3, None)], "doc_id long, text string")
    whole = sorted((r["doc_id"], r["action_id"], r["degraded"] or "", r["reward"] or 0) for r in sweep.sweep(docs, grid(spark)).collect())
    parts = sorted((r["doc_id"], r["action_id"], r["degraded"] or "", r["reward"] or 0) for r in sweep.sweep(docs, grid(spark), together=2).collect())
    assert whole == parts and len(whole) == 18
    best = evaluate.best_params(sweep.sweep(docs, grid(spark)), "doc_id").where("doc_id = 2").first()
    assert best["action_id"] == 0
