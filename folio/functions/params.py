"""Names and parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image suffixes that an upload may have; a dataset scan takes .pdf too but not .tif.
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "bmp", "tiff", "tif"]

#: The twelve figures of an action vector, in order (fixed names).
ACTION = ["ink_bleed_p", "ink_bleed_intensity_max", "fading_p", "fading_value_max", "markup_p", "noise_p", "noise_sigma_max", "color_shift_p", "brightness_p", "brightness_spread", "gamma_p", "jpeg_p"]


def is_image_name(name: Column, with_pdf: bool = False) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(IMAGE_SUFFIXES + ["pdf"] * with_pdf) + ")$")


def output_stem(name: Column) -> Column:
    """A name without its last extension, path separators as underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^./\\]*$", ""), r"[/\\]", "_")


def template_stem(i: Column) -> Column:
    return F.format_string("template_%03d", i)


def action_to_params(action: Column) -> Column:
    """struct of named parameters: sigma is scaled by 20, the spread of brightness by 0.4; then the limits that keep effects valid."""
    scale = {"noise_sigma_max": 20.0, "brightness_spread": 0.4}
    named = {n: F.element_at(action, i + 1) * scale.get(n, 1.0) for i, n in enumerate(ACTION)}
    spread = named["brightness_spread"]
    return F.struct(
        *[c.alias(n) for n, c in named.items()],
        F.greatest(F.lit(0.01), named["ink_bleed_intensity_max"]).alias("intensity_high"),
        F.greatest(F.lit(2), named["noise_sigma_max"].cast("int")).alias("sigma_high"),
        F.greatest(F.lit(0.5), 1.0 - spread).alias("brightness_low"),
        F.least(F.lit(1.5), 1.0 + spread).alias("brightness_high"),
    )


def merge_params(default: Column, override: Column) -> Column:
    """default overridden by override, p always 1.0."""
    over = F.map_filter(override, lambda k, v: k != "p")
    rest = F.map_filter(default, lambda k, v: (k != "p") & ~F.map_contains_key(override, k))
    return F.map_concat(rest, over, F.create_map(F.lit("p"), F.lit("1.0")))


def parse_params(json: Column) -> Column:
    """map<string,string> of a JSON object; bad JSON is empty."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def as_range(value: Column) -> Column:
    """struct(lo, hi) of a list of two numbers, else null."""
    pair = F.from_json(value, "array<double>")
    return F.when(value.rlike(r"^\s*\[\s*-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+\s*\]\s*$"), F.struct(pair[0].alias("lo"), pair[1].alias("hi")))
