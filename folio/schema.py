"""Schemas of annotations and predictions."""

from pyspark.sql import types as T

BOX = T.ArrayType(T.ArrayType(T.DoubleType()))

#: A text region; what a file leaves out takes the value in REGION_DEFAULTS.
REGION = T.StructType(
    [
        T.StructField("box", BOX),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("faker_provider", T.StringType()),
        T.StructField("respondent_id", T.StringType()),
        T.StructField("field_type_id", T.StringType()),
        T.StructField("font_family", T.StringType()),
        T.StructField("font_size", T.IntegerType()),
        T.StructField("font_color", T.StringType()),
        T.StructField("alignment", T.StringType()),
        T.StructField("fill_style", T.StringType()),
    ]
)
REGION_DEFAULTS = {"confidence": 1.0, "page": 0, "label": "", "faker_provider": "", "respondent_id": "", "field_type_id": "", "font_family": "", "font_size": 0, "font_color": "", "alignment": "left", "fill_style": "typed"}

GROUND_TRUTH = T.StructType(
    [
        T.StructField("image_path", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("regions", T.ArrayType(REGION)),
        T.StructField("synthetic", T.BooleanType()),
        T.StructField("seed", T.LongType()),
        T.StructField("generation_timestamp", T.StringType()),
    ]
)

PREDICTION = T.StructType([T.StructField("text", T.StringType()), T.StructField("boxes", T.ArrayType(BOX)), T.StructField("scores", T.ArrayType(T.DoubleType()))])

FIELD_TYPE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("font_family", T.StringType()),
        T.StructField("font_size_range", T.ArrayType(T.IntegerType())),
        T.StructField("font_color", T.StringType()),
        T.StructField("bold", T.BooleanType()),
        T.StructField("italic", T.BooleanType()),
        T.StructField("fill_style", T.StringType()),
        T.StructField("jitter_x", T.DoubleType()),
        T.StructField("jitter_y", T.DoubleType()),
    ]
)
RESPONDENT = T.StructType([T.StructField("respondent_id", T.StringType()), T.StructField("display_name", T.StringType()), T.StructField("field_types", T.ArrayType(FIELD_TYPE))])
ZONE = T.StructType(
    [
        T.StructField("zone_id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("box", BOX),
        T.StructField("respondent_id", T.StringType()),
        T.StructField("field_type_id", T.StringType()),
        T.StructField("faker_provider", T.StringType()),
        T.StructField("custom_values", T.ArrayType(T.StringType())),
        T.StructField("alignment", T.StringType()),
        T.StructField("page", T.IntegerType()),
    ]
)
CONFIG = T.StructType([T.StructField("respondents", T.ArrayType(RESPONDENT)), T.StructField("zones", T.ArrayType(ZONE))])
