"""Synthetic filled forms with exact annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draw import draw
from ..functions.geometry import display_text, place
from ..functions.providers import ANCHOR, IDENTITY_FIELDS, identity, zone_text


def resolve_styles(docs_zones: DataFrame, field_types: DataFrame) -> DataFrame:
    """docs_zones(seed, respondent_id, field_type_id, …) with its field type's style and a font size from its range: one per
    seed, respondent and field type, whatever the zone. field_types is a form's few rows."""
    out = docs_zones.join(F.broadcast(field_types), ["respondent_id", "field_type_id"])
    low, high = F.col("font_size_range")[0], F.col("font_size_range")[1]
    return out.withColumn("font_size", (low + draw(F.col("seed"), F.col("respondent_id"), F.col("field_type_id")) % (high - low + 1)).cast("int"))


def identities(docs: DataFrame, respondents: DataFrame) -> DataFrame:
    """(seed, respondent_id, who): each document's identity of each respondent."""
    return docs.select("seed").crossJoin(F.broadcast(respondents.select("respondent_id").distinct())).withColumn("who", identity(F.col("seed"), F.col("respondent_id")))


def attach_identity(zones: DataFrame, known: DataFrame, use_default: bool = True) -> DataFrame:
    """zones(seed, respondent_id, …) with who: the respondent's identity, else (use_default) that of "default", else nulls."""
    out = zones.join(known.select("seed", "respondent_id", F.col("who").alias("_own")), ["seed", "respondent_id"], "left")
    if not use_default:
        return out.withColumnRenamed("_own", "who")
    default = known.where("respondent_id = 'default'").select("seed", F.col("who").alias("_default"))
    return out.join(default, "seed", "left").withColumn("who", F.coalesce("_own", "_default")).drop("_own", "_default")


def filled_zones(docs_zones: DataFrame, field_types: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    """Styled zones with their text, what the page shows, and where it starts. Identities are drawn in place, so no join is needed."""
    styled = resolve_styles(docs_zones, field_types).withColumn("who", identity(F.col("seed"), F.col("respondent_id")))
    texts = styled.withColumn("text", zone_text(F.col("provider"), F.col("custom_values"), F.col("who"), F.col("seed"), F.col("zone_id"), anchor))
    at = place(F.col("box"), F.col("jitter_x"), F.col("jitter_y"), F.col("alignment"), F.col("text"), F.col("font_size"), F.col("seed"), F.col("zone_id"))
    return texts.withColumn("shown", display_text(F.col("text"), F.col("fill_style"))).withColumn("at", at).drop("who")


def build_annotations(regions: DataFrame, pages: DataFrame | None = None, timestamp: str | None = None) -> DataFrame:
    """One document per seed: regions in zone order (with pages: of the pages that exist, page by page), its text their lines, synthetic."""
    paged = pages is not None
    if paged:
        regions = regions.join(F.broadcast(pages.select("page").distinct()), "page", "left_semi")
    order = ["page", "zone_ord"] if paged else ["zone_ord"]
    rest = ["zone_id", "box", "text", "respondent_id", "field_type_id", *([] if paged else ["page"])]
    rows = regions.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_r"))
    region = lambda r: F.struct(r["box"].alias("box"), r["text"].alias("text"), F.lit(1.0).alias("confidence"), r["page"].alias("page"), r["zone_id"].alias("label"), r["respondent_id"].alias("respondent_id"), r["field_type_id"].alias("field_type_id"))
    return rows.select("seed", F.array_join(F.transform("_r", lambda r: F.coalesce(r["text"], F.lit(""))), "\n").alias("text"), F.transform("_r", region).alias("regions"), F.lit(True).alias("synthetic"), F.lit(timestamp).cast("string").alias("generation_timestamp"))


__all__ = ["IDENTITY_FIELDS", "attach_identity", "build_annotations", "filled_zones", "identities", "resolve_styles"]
