"""The catalogue of effects and the presets, as small tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# The effects by phase.
INK = ["InkBleed", "LowLightNoise", "Markup", "BleedThrough", "BadPhotoCopy", "InkColorSwap", "InkShifter", "Letterpress", "ShadowCast", "InkMottling", "LowInkPeriodicLines", "LowInkRandomLines", "Hollow", "Scribbles", "LinesDegradation", "BindingsAndFasteners"]
PAPER = ["NoiseTexturize", "ColorShift", "DirtyDrum", "DirtyRollers", "SubtleNoise", "WaterMark", "BrightnessTexturize", "ColorPaper", "DirtyScreen", "Stains", "NoisyLines", "PatternGenerator", "DelaunayTessellation", "VoronoiTessellation", "PageBorder"]
POST = ["Jpeg", "Brightness", "Gamma", "Dithering", "GlitchEffect", "Geometric", "Folding", "BookBinding", "DepthSimulatedBlur", "DoubleExposure", "Faxify", "LCDScreenPattern", "LensFlare", "LightingGradient", "Moire", "ReflectedLight", "DotMatrix", "Rescale", "SectionShift", "Squish"]
SLOW = ["Scribbles", "BindingsAndFasteners", "DelaunayTessellation", "VoronoiTessellation", "PageBorder", "LensFlare"]
DISABLED = ["LensFlare"]
# Names that are not the identifier's own words.
NAMES = {"LowLightNoise": "Low Light / Fading", "BadPhotoCopy": "Bad Photocopy", "BindingsAndFasteners": "Bindings and Fasteners", "WaterMark": "Watermark", "Jpeg": "JPEG Compression", "Geometric": "Geometric Distortion", "LCDScreenPattern": "LCD Screen Pattern", "Moire": "Moire Pattern"}

# What the effects that this library applies start from; every effect has p = 0.9 beside them.
RANGES = {
    "InkBleed": {"intensity_range": [0.1, 0.3]},
    "Markup": {"num_lines_range": [2, 4], "markup_type": "strikethrough"},
    "NoiseTexturize": {"sigma_range": [3, 10], "turbulence_range": [2, 5]},
    "ColorShift": {"color_shift_offset_x_range": [5, 15], "color_shift_offset_y_range": [5, 15], "color_shift_iterations": [2, 3]},
    "Jpeg": {"quality_range": [40, 80]},
    "Brightness": {"brightness_range": [0.7, 1.3]},
    "Gamma": {"gamma_range": [0.5, 2.0]},
}

# Presets as (effect, p, low, high) in the order of application; no range: None.
PRESETS = {
    "light": [("InkBleed", 0.2, 0.1, 0.3), ("LowLightNoise", 0.2, None, None), ("NoiseTexturize", 0.3, 3.0, 5.0), ("ColorShift", 0.2, 5.0, 10.0), ("Brightness", 0.3, 0.9, 1.1), ("Jpeg", 0.2, 85.0, 95.0)],
    "medium": [("InkBleed", 0.5, 0.2, 0.5), ("LowLightNoise", 0.4, None, None), ("Markup", 0.3, None, None), ("NoiseTexturize", 0.5, 5.0, 10.0), ("ColorShift", 0.4, 10.0, 20.0), ("Brightness", 0.5, 0.8, 1.2), ("Gamma", 0.3, None, None), ("Jpeg", 0.4, 70.0, 85.0)],
    "heavy": [("InkBleed", 0.8, 0.4, 0.8), ("LowLightNoise", 0.6, None, None), ("Markup", 0.5, None, None), ("NoiseTexturize", 0.8, 10.0, 20.0), ("ColorShift", 0.7, 20.0, 40.0), ("Brightness", 0.7, 0.6, 1.4), ("Gamma", 0.5, None, None), ("Dithering", 0.4, None, None), ("Jpeg", 0.7, 40.0, 70.0)],
}
PRESETS["default"] = PRESETS["medium"]


def phase_of(effect: str) -> str:
    """Phase of an effect; unknown ones come last."""
    return "ink" if effect in INK else "paper" if effect in PAPER else "post"


def display_name(effect: str) -> str:
    """An effect's name for people: its own, or the words of its identifier."""
    return NAMES.get(effect) or "".join(" " + c if c.isupper() and i and not effect[i - 1].isupper() else c for i, c in enumerate(effect))


def effects_table(spark: SparkSession) -> DataFrame:
    """(effect, display_name, phase, ord, slow, disabled, default_params map of JSON values)."""
    rows = []
    for phase, names in (("ink", INK), ("paper", PAPER), ("post", POST)):
        for i, n in enumerate(names):
            params = {"p": "0.9"} | {k: json.dumps(v, separators=(",", ":")) for k, v in RANGES.get(n, {}).items()}
            rows.append((n, display_name(n), phase, i, n in SLOW, n in DISABLED, params))
    return spark.createDataFrame(rows, "effect string, display_name string, phase string, ord int, slow boolean, disabled boolean, default_params map<string,string>")


def preset(name: str) -> list[tuple[str, float, float | None, float | None]]:
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]


def presets_table(spark: SparkSession) -> DataFrame:
    """(preset, phase, ord, effect, p, lo, hi)."""
    rows = [(name, phase_of(e), i, e, p, lo, hi) for name, effects in PRESETS.items() for i, (e, p, lo, hi) in enumerate(effects)]
    return spark.createDataFrame(rows, "preset string, phase string, ord int, effect string, p double, lo double, hi double")
