"""Reading and writing annotation files and configurations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CONFIG, GROUND_TRUTH, REGION_DEFAULTS
from .files import contents, listed

#: Suffixes of a dataset scan.
DATASET_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "tiff", "pdf"]


def name_parts(path: Column) -> dict[str, Column]:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return {"dir": F.regexp_replace(path, r"/[^/]*$", ""), "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "ext": F.regexp_extract(name, r".(\.[^.]*)$", 1)}


def scan_files(spark: SparkSession, folder: str, suffixes: list[str] = DATASET_SUFFIXES) -> DataFrame:
    """(path, dir, stem, ext, length, modificationTime) of the folder's own files (and of its parts, key=value) with a suffix (any case), by path; contents are not read. In schemes that tasks can't open empty files are missing."""
    # local paths as Spark's binaryFile source has them
    files = listed(spark, folder).withColumn("path", F.regexp_replace("path", "^(file://)?/(?!/)", "file:/"))
    named = files.select("path", *[c.alias(n) for n, c in name_parts(F.col("path")).items()], "length", "modificationTime")
    return named.where(F.lower(F.substring("ext", 2, 99)).isin(suffixes)).orderBy("path")


def with_defaults(region: Column) -> Column:
    fields = [f.name for f in GROUND_TRUTH["regions"].dataType.elementType.fields]
    return F.struct(*[(F.coalesce(region[n], F.lit(REGION_DEFAULTS[n])) if n in REGION_DEFAULTS else region[n]).alias(n) for n in fields])


def json_columns(of: Callable[[str], Column]) -> dict[str, Column]:
    """What a JSON file gives, from its fields: a reason where it isn't an annotation, and what is missing at its default."""
    reason = F.when(of("_corrupt_record").isNotNull(), "unreadable").when(of("image_path").isNull(), "image_path missing").when(of("text").isNull(), "text missing")
    regions = F.coalesce(F.transform(of("regions"), with_defaults), F.array().cast(GROUND_TRUTH["regions"].dataType))
    return {"reason": reason, "image_path": of("image_path"), "text": of("text"), "regions": regions, "synthetic": F.coalesce(of("synthetic"), F.lit(True)), "seed": of("seed"), "generation_timestamp": of("generation_timestamp")}


def judged(raw: DataFrame, columns: Callable[[Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    return raw.select("path", *[c.alias(n) for n, c in columns(F.col).items()])


def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("path", "reason")


def read_gt_json(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(annotations, rejects): one JSON object a file (or a line); what is missing takes its default, except image_path and text, whose lack rejects the file."""
    schema = T.StructType([*GROUND_TRUTH.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return halves(judged(raw.withColumn("path", F.col("_metadata.file_path")), json_columns))


XML_DOCUMENT = """_image string, text_region array<struct<_confidence:double,text:string,coords:struct<_x1:double,_y1:double,_x2:double,_y2:double,_x3:double,_y3:double,_x4:double,_y4:double>>>, _corrupt_record string"""
#: Texts and names are kept with the spaces around them.
XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}


def xml_columns(of: Callable[[str], Column]) -> dict[str, Column]:
    """What an XML file gives, from the fields of XML_DOCUMENT, with a reason where it cannot be read."""
    none = F.array().cast("array<struct<_confidence:double,text:string,coords:struct<_x1:double,_y1:double,_x2:double,_y2:double,_x3:double,_y3:double,_x4:double,_y4:double>>>")
    kept = F.filter(F.coalesce(of("text_region"), none), lambda r: r["coords"].isNotNull() & r["text"].isNotNull())

    def region(r: Column) -> Column:
        box = F.array(*[F.array(*[F.coalesce(r["coords"][f"_{axis}{i}"], F.lit(0.0)) for axis in "xy"]) for i in range(1, 5)])
        rest = [F.lit(v).alias(n) for n, v in REGION_DEFAULTS.items() if n != "confidence"]
        return F.struct(box.alias("box"), r["text"].alias("text"), F.coalesce(r["_confidence"], F.lit(1.0)).alias("confidence"), *rest)

    # the reader wants another column beside that of corrupt records
    broken = of("_corrupt_record").isNotNull() | (F.size(of("text_region")) < -1)
    text = F.array_join(F.transform(kept, lambda r: r["text"]), "\n")
    regions = F.transform(kept, region).cast(GROUND_TRUTH["regions"].dataType)
    return {"reason": F.when(broken, "unreadable"), "image_path": F.coalesce(of("_image"), F.lit("")), "text": text, "regions": regions, "synthetic": F.lit(True), "seed": F.lit(None).cast("long"), "generation_timestamp": F.lit(None).cast("string")}


def read_gt_xml(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(annotations, rejects) of <document image> files (or of large files with many, which are then split): regions lacking coords or text are left out, a coordinate defaults to 0,
    confidence to 1; the document's text is that of its regions, a line each."""
    raw = spark.read.format("xml").options(**XML_OPTIONS).option("rowTag", "document").option("multiLine", multi_line).schema(XML_DOCUMENT).load(path)
    return halves(judged(raw.withColumn("path", F.col("_metadata.file_path")), xml_columns))


def judged_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder in one pass, each read whole and parsed by its suffix (.json or .xml, any case): path, reason, and the annotation where reason is null. Files of other kinds are rejects, and so are empty ones."""
    return judged_files(contents(spark, folder).select("path", F.col("content").cast("string").alias("value")))


def judged_files(files: DataFrame) -> DataFrame:
    """judged_ground_truth of whole files (path, value), from a table or a stream."""
    schema = T.StructType([*GROUND_TRUTH.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}
    kind = F.lower(name_parts(F.col("path"))["ext"])
    parsed = files.select("path", kind.alias("kind"), F.when(kind == ".json", F.from_json("value", schema, options)).alias("j"), F.when(kind == ".xml", F.from_xml("value", XML_DOCUMENT, options | XML_OPTIONS)).alias("x"))
    json, xml = json_columns(lambda n: F.col("j")[n]), xml_columns(lambda n: F.col("x")[n])
    # nothing comes of a blank file, not even a corrupt record
    json["reason"], xml["reason"] = (F.when(F.col(n).isNull(), "unreadable").otherwise(c["reason"]) for n, c in (("j", json), ("x", xml)))
    either = {n: F.when(F.col("kind") == ".json", json[n]).when(F.col("kind") == ".xml", xml[n]) for n in json}
    reason = F.when(F.col("kind").isin(".json", ".xml"), either.pop("reason")).otherwise("not an annotation")
    rows = parsed.select("path", reason.alias("reason"), *[c.alias(n) for n, c in either.items()])
    return rows.select("path", "reason", *[F.when(F.col("reason").isNull(), F.col(n)).alias(n) for n in either])


def read_ground_truth(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(annotations, rejects) of judged_ground_truth."""
    return halves(judged_ground_truth(spark, folder))


def scan_all(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.select("path", *[c.alias(n) for n, c in name_parts(F.col("path")).items()])


def write_annotations(df: DataFrame, path: str, config_json: str | None = None) -> None:
    """Documents as JSON lines in path/documents, the configuration beside them in path/config."""
    df.write.json(f"{path}/documents")
    if config_json is not None:
        df.sparkSession.createDataFrame([(config_json,)], "value string").coalesce(1).write.text(f"{path}/config")


def read_config(spark: SparkSession, configs: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(respondents, field_types, zones) of a table with a nested JSON column.

    Positions in lists are kept (…_ord). No respondents: one named "default" with a "standard" field type. A configuration none of
    whose keys is known raises when it is read.
    """
    known = F.coalesce(F.array_size(F.array_intersect(F.json_object_keys(json), F.array(*[F.lit(k) for k in ("respondents", "zones", "generator")]))), F.lit(0)) > 0
    checked = configs.select(F.when(known | (F.json_object_keys(json) == F.array().cast("array<string>")), F.from_json(json, CONFIG)).otherwise(F.raise_error(F.lit("no known key in configuration"))).alias("c"))
    standard = "struct('standard' as id, 'Standard' as name, '' as font_family, array(10,14) as font_size_range, '#000000' as font_color, false as bold, false as italic, 'typed' as fill_style, 0.0D as jitter_x, 0.0D as jitter_y)"
    default = F.expr(f"array(struct('default' as respondent_id, 'Default' as display_name, array({standard}) as field_types))").cast(CONFIG["respondents"].dataType)
    people = F.when(F.coalesce(F.size("c.respondents"), F.lit(0)) > 0, F.col("c.respondents")).otherwise(default)
    respondents = checked.select(F.posexplode(people).alias("respondent_ord", "r")).select("respondent_ord", "r.respondent_id", "r.display_name", "r.field_types")
    field_types = respondents.select("respondent_id", F.posexplode("field_types").alias("field_ord", "f")).select("respondent_id", "field_ord", F.col("f.id").alias("field_type_id"), "f.*").drop("id")
    zones = checked.select(F.posexplode("c.zones").alias("zone_ord", "z")).select(
        "zone_ord", "z.zone_id", "z.label", "z.box",
        F.coalesce("z.respondent_id", F.lit("default")).alias("respondent_id"), F.coalesce("z.field_type_id", F.lit("standard")).alias("field_type_id"),
        F.coalesce("z.faker_provider", F.lit("name")).alias("provider"), F.coalesce("z.custom_values", F.array().cast("array<string>")).alias("custom_values"),
        F.coalesce("z.alignment", F.lit("left")).alias("alignment"), F.coalesce("z.page", F.lit(0)).alias("page"),
    )
    return respondents.drop("field_types"), field_types, zones
