"""Rows that are alike: equal scores in the neighbour search, equal documents in the mix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import mixing, neighbours


def test_equal_scores_go_to_the_smaller_ids(spark):
    """All vectors but the query's have the same inner product with it, to the last bit."""
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, *rng.normal(size=2).tolist()]) for i in range(1, 1000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(vectors, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 1.0) for i in range(1, 21)]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_equal_documents_are_spread_over_blocks(spark, doc_id):
    rows = spark.range(0, 20_000, 1, 4).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("hot").alias("source"), F.lit("one two three").alias("text"))
    rows = rows.unionByName(spark.range(5_000).select("id", F.lit("rare").alias("source"), F.lit("four five").alias("text")).toDF("doc_id", "source", "text"))
    out = mixing.mix(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.countDistinct("copies").alias("kinds")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 3 and r["kinds"] <= 2 for r in out) and len(out) == 2
    assert sum(r["target"] for r in out) == pytest.approx(70_000)
