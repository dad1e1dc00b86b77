"""Quantiles within their stated error and exact ones, names of outputs and splits without a sort, against plain lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions.draw import draw
from folio.operators import evaluate, expand


def values(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.normal(size=6000)] + [("ties", float(x)) for x in rng.integers(0, 3, 900)] + [(None, float(x)) for x in rng.random(7)] + [("one", 4.0), ("one", None), ("none", None)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(6)


@pytest.mark.parametrize(("size", "error"), [(2048, 0.002), (8, 1e-3), (8, 1.0)])
def test_exact_quantiles(spark, size, error):
    """With a sketch so small that brackets without width miss their ranks, too."""
    rows, df = values(spark)
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r["g"]: r for r in evaluate.exact_quantiles(df, "v", shares, "g", size=size, error=error).collect()}
    assert got.keys() == {"hot", "ties", None, "one"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert r["n"] == len(own) and r["low"] == min(own) and r["high"] == max(own)
        assert r["quantiles"] == pytest.approx(np.quantile(own, shares).tolist(), abs=1e-12)
    whole = evaluate.exact_quantiles(df, "v", [0.5]).collect()
    assert whole[0]["quantiles"] == pytest.approx([np.median([v for _, v in rows if v is not None])], abs=1e-12)


def test_sketch_keeps_its_rank_error(spark):
    rows, df = values(spark)
    own = np.sort([v for k, v in rows if k == "hot"])
    big = df.where("g = 'hot'").withColumn("v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("v") + i * 1e-9)))
    for size, error in ((200, 0.02), (evaluate.SKETCH, evaluate.RANK_ERROR)):
        sketch = evaluate.quantile_sketch(big, "v", "g", size=size)
        for share in (0.01, 0.25, 0.5, 0.9):
            q = sketch.select(F.kll_sketch_get_quantile_double("sketch", F.lit(share))).first()[0]
            assert abs(np.searchsorted(own, q) / len(own) - share) <= error


def test_names_of_a_hot_stem(spark):
    rows = [("hot", i) for i in range(0, 3000, 3)] + [(f"s{i % 40}", i) for i in range(1, 3000, 3)] + [(None, i) for i in range(2, 60, 3)]
    df = spark.createDataFrame(rows, "stem string, out_idx long").repartition(5)
    want, seen = {}, {}
    for stem, i in sorted(rows, key=lambda r: r[1]):
        want[i] = f"{stem or 'null'}_{seen.get(stem, 0):03d}"
        seen[stem] = seen.get(stem, 0) + 1
    got = expand.name_outputs(df)
    assert got.columns == ["stem", "out_idx", "name"]
    assert {r["out_idx"]: r["name"] for r in got.collect()} == want
    assert expand.name_outputs(df.limit(0)).count() == 0
    assert [r["out_idx"] for r in expand.in_input_order(df).collect()] == sorted(i for _, i in rows)


@pytest.mark.parametrize("bits", [3, 11, 16])
def test_split_by_counting(spark, monkeypatch, bits):
    monkeypatch.setattr(expand, "BITS", bits)
    df = spark.range(-30, 700).withColumn("k", F.when(F.col("id") == 3, None).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))).repartition(4)
    order = [r["id"] for r in df.withColumn("d", draw(9, F.col("k"))).orderBy("d", "k").collect()]
    train, val, test = ([r["id"] for r in p.collect()] for p in expand.split(df, 0.1, 0.2, 9, "k"))
    assert (sorted(test), sorted(val), sorted(train)) == (sorted(order[:146]), sorted(order[146:219]), sorted(order[219:]))


def test_split_of_repeated_keys(spark):
    """The thresholds fall among rows that cannot be told apart: the sizes stay exact."""
    df = spark.range(300).select((F.col("id") % 2).alias("k"), "id")
    parts = expand.split(df, 0.1, 0.2, 4, "k")
    assert [p.count() for p in parts] == [210, 30, 60]
    assert {k for k, n in expand.check_split(*parts, df).items() if n} == set()
