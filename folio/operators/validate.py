"""Checks that divide rows into good ones and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def region_fault(box, confidence):
    """Why a region is invalid, or null: the box has four points of two numbers, confidence lies in [0, 1]."""
    shaped = (F.size(box) == 4) & F.forall(box, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull()))
    return F.when(~F.coalesce(shaped, F.lit(False)), "box is not four points").when(~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence is not in [0, 1]")


def validate_regions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with reason) of a table of regions(box, confidence, …)."""
    judged = df.withColumn("reason", region_fault(F.col("box"), F.col("confidence")))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def validate_preset(presets: DataFrame) -> DataFrame:
    """Rows whose p lies outside [0, 1], with a message that names preset, phase and effect."""
    return presets.where(~F.col("p").between(0, 1)).withColumn("reason", F.format_string("preset %s, %s: %s has p = %s", "preset", "phase", "effect", F.col("p").cast("string")))


def zones_on_page(zones: DataFrame, page: int) -> DataFrame:
    return zones.where(F.col("page") == page)


def effects_in_phase(effects: DataFrame, phase: str) -> DataFrame:
    return effects.where(F.col("phase") == phase)


def enabled_effects(effects: DataFrame) -> DataFrame:
    return effects.where(~F.col("disabled"))


def missing_styles(zones: DataFrame, field_types: DataFrame) -> DataFrame:
    """Zones whose respondent and field type have no style."""
    return zones.join(field_types, ["respondent_id", "field_type_id"], "left_anti")
