"""Images with their annotations, truths with their predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import cer, mean_confidence, wer


def best_annotations(annotations: DataFrame) -> DataFrame:
    """(dir, stem, gt_path) of annotations(dir, stem, ext, path): .json before .xml, suffixes in small letters only."""
    kinds = annotations.where(F.col("ext").isin(".json", ".xml"))
    return kinds.groupBy("dir", "stem").agg(F.min_by("path", F.when(F.col("ext") == ".json", 0).otherwise(1)).alias("gt_path"))


def pair_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """images(dir, stem, path, …) that have an annotation in the same folder under the same stem, with gt_path. Two images of one stem share it."""
    return images.join(best_annotations(annotations), ["dir", "stem"])


def unpaired_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(best_annotations(annotations), ["dir", "stem"], "left_anti")


def join_predictions(truth: DataFrame, original: DataFrame, augmented: DataFrame, key: str = "doc_id") -> DataFrame:
    """truth(key, text, …) with error rates and confidence of both predictions(key, text, scores). One that is missing or null counts as all wrong: cer 1, wer 1, confidence 0."""
    out = truth
    for name, pred in (("original", original), ("augmented", augmented)):
        out = out.join(pred.select(key, F.col("text").alias(f"_{name}"), F.col("scores").alias(f"_{name}_scores")), key, "left")
    return with_metrics(out, truth.columns)


def with_metrics(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the six metrics of df(text, _original, _original_scores, _augmented, _augmented_scores)."""
    cols = []
    for name in ("original", "augmented"):
        p = F.col(f"_{name}")
        cols += [
            F.when(p.isNull(), 1.0).otherwise(cer(p, F.col("text"))).alias(f"{name}_cer"),
            F.when(p.isNull(), 1.0).otherwise(wer(p, F.col("text"))).alias(f"{name}_wer"),
            F.when(p.isNull(), 0.0).otherwise(mean_confidence(F.col(f"_{name}_scores"))).alias(f"{name}_confidence"),
        ]
    return df.select(*keep, *cols)
