"""Tables of text regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def full_text(regions: Column, text: Column) -> Column:
    """Texts of the regions, a line each; without regions the document's own text."""
    return F.when(F.size(regions) > 0, F.array_join(F.transform(regions, lambda r: F.coalesce(r["text"], F.lit(""))), "\n")).otherwise(text)


def region_table(pred: DataFrame, *keys: str) -> DataFrame:
    """One row per score and box of pred(keys, text, scores, boxes), as far as both go: number from 1, the line of that number or "", confidence to four places, whole x and y of the first corner."""
    n = F.least(F.size("scores"), F.size("boxes"))
    rows = pred.where(n > 0).select(*keys, F.split("text", "\n").alias("_lines"), F.posexplode(F.arrays_zip(F.slice("scores", 1, n).alias("score"), F.slice("boxes", 1, n).alias("box"))).alias("_at", "_r"))
    corner = F.get(F.col("_r.box"), F.lit(0))
    return rows.select(*keys, (F.col("_at") + 1).alias("number"), F.coalesce(F.get("_lines", F.col("_at")), F.lit("")).alias("text"), F.round("_r.score", 4).alias("confidence"), F.get(corner, F.lit(0)).cast("int").alias("x"), F.get(corner, F.lit(1)).cast("int").alias("y"))


def normalize_prediction(texts: Column, scores: Column, polys: Column) -> Column:
    """struct(text, boxes, scores); without texts all are empty."""
    some = F.coalesce(F.size(texts), F.lit(0)) > 0
    boxes_type, scores_type = "array<array<array<double>>>", "array<double>"
    empty = lambda kind: F.array().cast(kind)
    return F.struct(
        F.when(some, F.array_join(texts, "\n")).otherwise("").alias("text"),
        F.when(some, F.coalesce(polys.cast(boxes_type), empty(boxes_type))).otherwise(empty(boxes_type)).alias("boxes"),
        F.when(some, F.coalesce(scores.cast(scores_type), empty(scores_type))).otherwise(empty(scores_type)).alias("scores"),
    )


def expand_pages(df: DataFrame, name: str = "name", pages: str = "pages") -> DataFrame:
    """One row per page: label "name — page i"; an item of one page keeps its name."""
    rest = [c for c in df.columns if c != pages]
    many = F.size(pages) > 1
    rows = df.select(*rest, many.alias("_many"), F.posexplode(pages).alias("page_index", "page"))
    return rows.withColumn("label", F.when(F.col("_many"), F.concat(F.col(name), F.lit(" — page "), (F.col("page_index") + 1).cast("string"))).otherwise(F.col(name))).drop("_many")
