import random

import pytest
from pyspark.sql import functions as F

from folio.functions import metrics
from folio.functions.metrics import car, cer, mean_confidence, reward, wer


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("pred", "truth", "expected"),
    [("hello world", "hello world", 0.0), ("helo world!", "hello world", 2 / 11), ("abc", "xyz", 1.0), ("x", "", 1.0), ("", "", 0.0), ("", "abc", 1.0), ("ABC", "abc", 1.0), ("aaaaaa", "a", 5.0), ("été", "ete", 2 / 3)],
)
def test_cer(spark, pred, truth, expected):
    assert one(spark, cer(F.col("p"), F.col("t")), p=pred, t=truth) == pytest.approx(expected)


@pytest.mark.parametrize(("pred", "truth", "expected"), [("the cat sat", "the cat sat", 0.0), ("the dog sat", "the cat sat", 1 / 3), ("a b c d", "a c d", 1 / 3), ("x", "", 1.0), ("", "", 0.0), (" a\x1cb ", "a b", 0.0), ("a b", "a b", 0.0)])
def test_wer(spark, pred, truth, expected):
    assert one(spark, wer(F.col("p"), F.col("t")), p=pred, t=truth) == pytest.approx(expected)


def test_long_texts_agree_with_plain_levenshtein(spark):
    rows = [("ab" * 300, "ab" * 250 + "xy" * 50), ("a" * 400, "b" * 400), ("q" * 100, "q" * 97 + "zzz")]
    df = spark.createDataFrame(rows, ["p", "t"])
    got = df.select(cer(F.col("p"), F.col("t")).alias("c"), (F.levenshtein("p", "t") / F.length("t")).alias("d")).collect()
    assert all(r["c"] == r["d"] for r in got)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("together", [1, 10**9])
def test_distances_of_many_pairs(monkeypatch, together):
    """Substitutions, insertions, unlike texts, one, two and several words of bits: together and one by one, against the whole table."""
    monkeypatch.setattr(metrics, "TOGETHER", together)
    rng, pairs = random.Random(3), [None, ("", ""), ("a", ""), ("", "ab"), ("x" * 64, "y" * 64), ("x" * 65, "y" * 63), ("aé😀", "é😀b")]
    for k in range(160):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.choice([3, 20, 63, 64, 65, 129, 200])))
        b = list(a)
        for _ in range(rng.randint(0, 25)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "ab"])
        pairs.append((a, "".join(b) if k % 4 else "".join(rng.choice("abz") for _ in range(rng.randint(1, 140)))))
    assert metrics.text_distances(pairs) == [None if p is None else plain(*p) for p in pairs]


def test_bounds():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(0, 9)) for _ in range(2))
        low, high = metrics.bounds(a, b)
        assert low <= plain(a, b) == metrics.sequence_distance(a, b) <= high


def test_confidence_and_reward(spark):
    assert one(spark, mean_confidence(F.col("s")), s=[0.5, 1.0]) == 0.75
    assert spark.range(1).select(mean_confidence(F.array().cast("array<double>"))).first()[0] == 0.0
    assert spark.range(1).select(mean_confidence(F.lit(None).cast("array<double>"))).first()[0] == 0.0
    assert one(spark, car(F.col("c")), c=1.7) == 0.0
    assert one(spark, reward(F.col("a"), F.col("b"), F.col("c")), a=1.0, b=0.5, c=0.25) == pytest.approx(0.5 + 0.15 + 0.15)
