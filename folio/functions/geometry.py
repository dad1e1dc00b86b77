"""Boxes, placement on pages, sizes and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draw import gauss


def box_geometry(box: Column) -> Column:
    """struct(x1, y1, x2, y2, w, h) from corners 0 and 2; width and height are 1 at least."""
    x1, y1, x2, y2 = box[0][0], box[0][1], box[2][0], box[2][1]
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.greatest(F.lit(1.0), x2 - x1).alias("w"), F.greatest(F.lit(1.0), y2 - y1).alias("h"))


def rgb(hex_color: Column) -> Column:
    """array of red, green, blue in 0..1; black unless six hex digits follow an optional #."""
    digits = F.regexp_replace(hex_color, "^#+", "")
    part = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("double") / 255
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def to_page_points(box: Column, font_size: Column, hex_color: Column, dpi: float, text: Column) -> Column:
    """struct(x, baseline, size, color) in points of 1/72 inch, the baseline 0.8 of the font size below the top; null for blank text."""
    scale = 72.0 / dpi
    at = F.struct((box[0][0] * scale).alias("x"), ((box[0][1] + 0.80 * font_size) * scale).alias("baseline"), (font_size * scale).alias("size"), rgb(hex_color).alias("color"))
    return F.when(F.trim(text) != "", at)


def _inside(mean: Column, sd: Column, low: Column, high: Column, fallback: Column, *keys) -> Column:
    tries = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: mean + sd * gauss(*keys, i))
    return F.coalesce(F.get(F.filter(tries, lambda x: (x >= low) & (x <= high)), F.lit(0)), fallback)


def place(box: Column, jitter_x: Column, jitter_y: Column, alignment: Column, text: Column, font_size: Column, *keys) -> Column:
    """struct(x, y) where a text starts in its box.

    Without jitter 5 % of the width and 10 % of the height in; else normal draws around 12 % and the middle, the first of
    twenty that lies in the box. A text is as wide as 0.55 font sizes a character; centred and right-aligned (4 pixels
    from the edge) texts are placed by that.
    """
    g = box_geometry(box)
    x1, y1, w, h = g["x1"], g["y1"], g["w"], g["h"]
    mean = x1 + 0.12 * w
    x = F.when(jitter_x <= 0, x1 + 0.05 * w).otherwise(_inside(mean, jitter_x * w, x1, g["x2"], mean, *keys, "x"))
    top = y1 + 0.1 * h
    y = F.when(jitter_y <= 0, top).otherwise(_inside(y1 + 0.5 * h, jitter_y * h, y1, g["y2"], top, *keys, "y"))
    width = 0.55 * font_size * F.length(text)
    x = F.when(alignment == "center", x1 + (w - width) / 2).when(alignment == "right", g["x2"] - width - 4).otherwise(x)
    return F.struct(x.alias("x"), y.alias("y"))


def display_text(text: Column, fill_style: Column) -> Column:
    """What the page shows: capitals for a stamp; the annotation keeps the text."""
    return F.when(fill_style == "stamp", F.upper(text)).otherwise(text)


def confidence_color(score: Column) -> Column:
    """struct(r, g, b) from red (0) to green (1)."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.struct(((1 - s) * 255).cast("int").alias("r"), (s * 255).cast("int").alias("g"), F.lit(0).alias("b"))


def preview_size(w: Column, h: Column, longest: int) -> Column:
    """struct(w, h) with no side beyond longest; smaller ones stay."""
    scale = F.lit(float(longest)) / F.greatest(w, h)
    small = F.greatest(w, h) <= longest
    return F.struct(F.when(small, w).otherwise((w * scale).cast("int")).alias("w"), F.when(small, h).otherwise((h * scale).cast("int")).alias("h"))
