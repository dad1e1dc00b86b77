"""Aggregates over scored samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Groups and quantiles up to this number are broadcast; more are joined after a shuffle.
MOST_BROADCAST = 500_000

METRICS = [f"{version}_{metric}" for version in ("original", "augmented") for metric in ("cer", "wer", "confidence")]


def evaluate_by(df: DataFrame, *keys: str) -> DataFrame:
    """n_samples, mean and population standard deviation of the six metrics, by keys; without rows or keys: n_samples 0 and nulls."""
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for m in METRICS:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def evaluate(df: DataFrame) -> DataFrame:
    return evaluate_by(df)


def summary_table(agg: DataFrame, *keys: str) -> DataFrame:
    """Three rows (CER, WER, Confidence) of means, deviations and the difference augmented - original."""
    parts = []
    for label, m in (("CER", "cer"), ("WER", "wer"), ("Confidence", "confidence")):
        parts.append(f"'{label}', mean_original_{m}, std_original_{m}, mean_augmented_{m}, std_augmented_{m}, mean_augmented_{m} - mean_original_{m}")
    return agg.select(*keys, F.expr(f"stack(3, {', '.join(parts)}) as (metric, original_mean, original_std, augmented_mean, augmented_std, delta)"))


def error_ceiling(agg: DataFrame) -> Column:
    """Where an axis of error rates ends: 1.05, or a tenth above the largest mean."""
    means = [F.when(~F.isnan(f"mean_{v}_{m}"), F.col(f"mean_{v}_{m}")) for v in ("original", "augmented") for m in ("cer", "wer")]
    return F.greatest(F.lit(1.05), 1.1 * F.greatest(*means))


#: Items that a sketch of quantiles keeps a level, and the share of ranks by which its answers may be off; a bracket is twice as wide to either side.
SKETCH, RANK_ERROR = 2048, 0.002


def quantile_sketch(rows: DataFrame, value: str, *keys: str, size: int = SKETCH) -> DataFrame:
    """(keys, n, low, high, mean, std, sketch) of rows: a mergeable sketch (KLL) of a few kilobytes for each group, whatever its rows; nulls don't count."""
    x = F.col(value).cast("double")
    return rows.where(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.kll_sketch_agg_double(x, size).alias("sketch"))


def exact_quantiles(rows: DataFrame, value: str, shares: list[float], *keys: str, size: int = SKETCH, error: float = RANK_ERROR) -> DataFrame:
    """(keys, n, low, high, mean, std, quantiles) of rows: exact quantiles, interpolated between ranks, without sorting a group.

    A sketch brackets each quantile; one more pass counts what lies below the brackets, and the values within them (some 4 * error of the rows), equal ones
    once, are ordered. A bracket that the counts show to miss its rank, which the sketch's error makes unlikely, is opened to all of its group's values.
    """
    x = F.col(value).cast("double")
    sketched = kept(quantile_sketch(rows, value, *keys, size=size), "sketches")
    few = F.col("n") * error < 4  # a small group is ordered whole
    edge = lambda share, else_: F.when(few, F.lit(else_)).otherwise(F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, share)))))
    place = lambda i: (F.col("n") - 1) * F.lit(shares[i])
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(place(i)).alias("first"), F.ceil(place(i)).alias("last"), edge(s - 2 * error, float("-inf")).alias("lo"), edge(s + 2 * error, float("inf")).alias("hi")) for i, s in enumerate(shares)])
    brackets = kept(sketched.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(asked).alias("_q")).select(*[f"_{k}" for k in keys], "_q.*"), "brackets")
    found = _within(rows.where(x.isNotNull()), x, brackets, keys)
    missed = found.where("values is null").select(*[f"_{k}" for k in keys], "i", "first", "last", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    good = found.where("values is not null")
    if not missed.isEmpty():
        good = good.unionByName(_within(rows.where(x.isNotNull()), x, kept(missed, "missed"), keys))
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("i") + 1)
    n = sketched.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.col("n").alias("_n"))
    same = lambda a, b: F.lit(True) if not keys else _all(F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys)
    part = good.join(n, same("_", "_n_")).withColumn("_part", (F.col("_n") - 1) * share - F.col("first"))
    value_ = F.col("values")[0] + (F.col("values")[1] - F.col("values")[0]) * F.col("_part")
    listed = part.groupBy(*[f"_{k}" for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value_.alias("v")))), lambda r: r["v"]).alias("quantiles"))
    return sketched.join(listed, same("", "_")).select(*keys, "n", "low", "high", "mean", "std", "quantiles")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _within(rows: DataFrame, x: Column, brackets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """brackets(_keys, i, first, last, lo, hi) with values, those of ranks first and last, or null where a rank lies outside. brackets is written: a row for each group and quantile, broadcast where they are few."""
    same = _all(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)
    few = brackets.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    met = rows.select(*keys, x.alias("_x")).join(F.broadcast(brackets) if few else brackets.hint("merge"), same)
    names = [f"_{k}" for k in keys] + ["i", "first", "last"]
    inside = (F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi"))
    counted = met.where(F.col("_x") <= F.col("hi")).groupBy(*names, F.when(inside, F.col("_x")).alias("_x")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy(F.asc_nulls_first("_x")))
    ordered = counted.select(*names, "_x", upto.alias("_upto"), (upto - F.col("n")).alias("_from")).where("_x is not null")
    at = lambda rank: F.max(F.when((F.col("_from") <= F.col(rank)) & (F.col("_upto") > F.col(rank)), F.col("_x")))
    got = ordered.groupBy(*names).agg(at("first").alias("_a"), at("last").alias("_b"))
    back = brackets.join(got.select(*[F.col(c).alias(f"_g{c}") for c in names], "_a", "_b"), _all(F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in names), "left")
    return back.select(*names, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.array("_a", "_b")).alias("values"))


def confidence_box(df: DataFrame, *keys: str) -> DataFrame:
    """Five quantiles, mean and deviation of both confidences; the quantiles are exact (exact_quantiles)."""
    rows = df.select(*keys, F.expr("stack(2, 'original', original_confidence, 'augmented', augmented_confidence) as (version, confidence)"))
    out = exact_quantiles(rows, "confidence", [0.25, 0.5, 0.75], *keys, "version")
    return out.select(*keys, "version", "low", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "high", "mean", "std")


def coverage_flags(agg: DataFrame) -> DataFrame:
    """agg with a flag where a mean CER above 1 tells that the truth holds only part of the visible text."""
    return agg.withColumn("partial_truth", (F.col("mean_original_cer") > 1.0) | (F.col("mean_augmented_cer") > 1.0))


def reward_curve(log: DataFrame, every: int, total: int | None = None) -> DataFrame:
    """Mean reward of each every steps of log(step, reward): bucket, mean_reward, n, last_step, progress."""
    out = log.groupBy(F.floor(F.col("step") / every).alias("bucket")).agg(F.avg("reward").alias("mean_reward"), F.count(F.lit(1)).alias("n"), F.max("step").alias("last_step"))
    return out.withColumn("progress", F.least(F.col("last_step") / F.lit(float(total)), F.lit(1.0))) if total else out


def run_stats(log: DataFrame, *keys: str, ts: str = "ts") -> DataFrame:
    """n_items, elapsed seconds and items a second (null where no time passed)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    out = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), ((F.max(at) - F.min(at)) / 1e6).alias("elapsed"))
    return out.withColumn("per_second", F.try_divide("n_items", "elapsed"))


def best_params(scored: DataFrame, *keys: str) -> DataFrame:
    """The action_id of highest mean reward of scored(keys, action_id, reward), ties to the smaller id, with that reward."""
    means = scored.groupBy(*keys, "action_id").agg(F.avg("reward").alias("reward"))
    return means.groupBy(*keys).agg(F.max_by("action_id", F.struct("reward", -F.col("action_id"))).alias("action_id"), F.max("reward").alias("reward"))
