import json

import pytest
from pyspark.sql import functions as F

from folio.operators import pairing, regions, validate
from folio.sources import annotations

BOX = [[0.0, 0.0], [100.0, 0.0], [100.0, 20.0], [0.0, 20.0]]


def test_json_defaults_and_rejects(spark, tmp_path):
    page = {"image_path": "scans/till-roll.tif", "text": "Bread 2.10\nMilk 0.95", "regions": [{"box": BOX, "text": "Bread 2.10"}, {"box": BOX, "text": "Milk 0.95", "confidence": 0.4, "page": 3}]}
    (tmp_path / "roll.json").write_text(json.dumps(page))
    (tmp_path / "untold.json").write_text(json.dumps({"image_path": "scans/blank.tif"}))
    (tmp_path / "nameless.json").write_text(json.dumps({"text": "who knows"}))
    (tmp_path / "torn.json").write_text('{"image_path": "scans/to')
    good, bad = annotations.read_gt_json(spark, str(tmp_path))
    (row,) = good.collect()
    first, second = row["regions"]
    assert (first["confidence"], first["page"], first["alignment"], first["fill_style"]) == (1.0, 0, "left", "typed") and row["synthetic"]
    assert (second["confidence"], second["page"]) == (0.4, 3)
    assert {r["path"].rpartition("/")[2]: r["reason"] for r in bad.collect()} == {"untold.json": "text missing", "nameless.json": "image_path missing", "torn.json": "unreadable"}


LEDGER = """<?xml version="1.0"?>
<document image="ledger/p7.bmp">
  <text_region confidence="0.25"><coords x1="3" y1="4" x2="60" y2="4" x3="60" y3="18" x4="3" y4="18"/><text>Carried forward</text></text_region>
  <text_region><text>without a place</text></text_region>
  <text_region><coords x2="9.5"/><text>118 &amp; 6d</text></text_region>
  <text_region><coords x1="1"/></text_region>
</document>"""


def test_folder_of_many_kinds(spark, tmp_path):
    files = {
        "ledger.xml": LEDGER,
        "blank.XmL": '<document image="ledger/p8.bmp"/>',
        "torn.xml": "<document image='x'><text_region>",
        "slip.JSON": json.dumps({"image_path": "slip.bmp", "text": "paid", "regions": None, "synthetic": False}),
        "torn.json": "[1, 2",
        "notes.md": "no annotation",
        "bare": "neither",
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    good, bad = annotations.read_ground_truth(spark, str(tmp_path))
    by = {r["image_path"]: r for r in good.collect()}
    assert set(by) == {"ledger/p7.bmp", "ledger/p8.bmp", "slip.bmp"}
    ledger = by["ledger/p7.bmp"]
    assert ledger["text"] == "Carried forward\n118 & 6d" and [r["confidence"] for r in ledger["regions"]] == [0.25, 1.0]
    assert ledger["regions"][1]["box"] == [[0.0, 0.0], [9.5, 0.0], [0.0, 0.0], [0.0, 0.0]]
    assert by["ledger/p8.bmp"]["regions"] == [] and by["ledger/p8.bmp"]["text"] == ""
    assert not by["slip.bmp"]["synthetic"] and by["slip.bmp"]["regions"] == []
    reasons = {r["path"].rpartition("/")[2]: r["reason"] for r in bad.collect()}
    assert reasons == {"torn.xml": "unreadable", "torn.json": "unreadable", "notes.md": "not an annotation", "bare": "not an annotation"}


def test_scan_and_pair(spark, tmp_path):
    for name in ("till.tiff", "till.xml", "till.json", "stub.BMP", "stub.xml", "ledger.pdf", "ledger.Json", "spare.jpeg", "readme.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "older").mkdir()
    (tmp_path / "older" / "gone.png").write_text("x")
    images = annotations.scan_files(spark, str(tmp_path))
    assert [r["stem"] for r in images.collect()] == ["ledger", "spare", "stub", "till"]
    assert [r["stem"] for r in annotations.scan_files(spark, str(tmp_path), ["png", "bmp"]).collect()] == ["stub"]
    notes = annotations.scan_all(spark, str(tmp_path))
    pairs = {r["stem"]: r["gt_path"].rpartition(".")[2] for r in pairing.pair_annotations(images, notes).collect()}
    assert pairs == {"till": "json", "stub": "xml"}
    assert {r["stem"] for r in pairing.unpaired_images(images, notes).collect()} == {"ledger", "spare"}


def test_region_checks(spark):
    df = spark.createDataFrame([(1, BOX, 0.98), (2, BOX[:2], 1.0), (3, BOX, 1.5), (4, [[0.0]] * 4, 1.0), (5, None, 1.0), (6, BOX, None)], "id int, box array<array<double>>, confidence double")
    good, bad = validate.validate_regions(df)
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"] for r in bad.collect()} == {2, 3, 4, 5, 6}


def test_region_table_and_text(spark):
    df = spark.createDataFrame([(1, "a\nb", [0.12345, 0.9, 0.8], [[[1.9, 2.9]], [[3.0, 4.0]], [[5.0, 6.0]]]), (2, "", [], [])], "id int, text string, scores array<double>, boxes array<array<array<double>>>")
    rows = regions.region_table(df, "id").orderBy("number").collect()
    assert [(r["number"], r["text"], r["x"], r["y"]) for r in rows] == [(1, "a", 1, 2), (2, "b", 3, 4), (3, "", 5, 6)]
    p = spark.range(1).select(regions.normalize_prediction(F.lit(None).cast("array<string>"), F.array(F.lit(0.5)), F.lit(None).cast("array<array<array<double>>>")).alias("p")).first()["p"]
    assert (p["text"], p["boxes"], p["scores"]) == ("", [], [])


def test_config(spark):
    ok = spark.createDataFrame([('{"zones": [{"zone_id": "z", "box": [[0,0],[1,0],[1,1],[0,1]]}]}',)], "json string")
    people, types, zones = annotations.read_config(spark, ok)
    assert people.first()["respondent_id"] == "default" and types.first()["field_type_id"] == "standard"
    z = zones.first()
    assert (z["provider"], z["respondent_id"], z["zone_ord"]) == ("name", "default", 0)
    with pytest.raises(Exception, match="no known key"):
        annotations.read_config(spark, spark.createDataFrame([('{"what": 1}',)], "json string"))[2].collect()
