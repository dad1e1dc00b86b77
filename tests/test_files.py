"""Files read by tasks: parts, other readers' images, filters of PNG files, rows of a table that lie in one split."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from folio.operators import images
from folio.plans import catalog
from folio.sources import annotations, files, pictures
from folio.streaming import jobs

RNG = np.random.default_rng(3)


def filtered(x, color):
    """A PNG file whose rows take the five filters in turn, by the definition."""
    h, w, c = x.shape
    v = (x if c == 1 else x[:, :, [2, 1, 0, 3][:c]]).astype(int)
    raw = b""
    for r in range(h):
        line = [r % 5]
        for j in range(w):
            for k in range(c):
                left, up, corner = v[r, j - 1, k] if j else 0, v[r - 1, j, k] if r else 0, v[r - 1, j - 1, k] if r and j else 0
                p = left + up - corner
                paeth = min((left, up, corner), key=lambda q: abs(p - q))
                line.append((v[r, j, k] - [0, left, up, (left + up) // 2, paeth][r % 5]) % 256)
        raw += bytes(line)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_of_parts_in_one_pass(spark, tmp_path):
    arrays = {n: RNG.integers(0, 256, (11, 6, c), np.uint8) for n, c in (("g.png", 1), ("c.png", 3), ("o.png", 4))}
    bmp = b"BM" + struct.pack("<IHHI", 62, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0) + bytes([1, 2, 3, 4, 5, 6, 0, 0])
    rows = [(f"part={i}/{n}", bytearray(filtered(x, {1: 0, 3: 2, 4: 6}[x.shape[2]]))) for i, (n, x) in enumerate(arrays.items())]
    rows += [("b.bmp", bytearray(bmp)), ("part=1/t.png", bytearray(b"text")), ("below/d.png", rows[0][1]), ("part=2/_h.png", rows[0][1]), ("part=2/e.png", None)]
    folder = f"file://{tmp_path}/in"
    pictures.write_files(spark.createDataFrame(rows, "name string, content binary"), folder)
    found = {r["name"]: r for r in pictures.judged_images(spark, folder).collect()}
    assert found.keys() == {*arrays, "b.bmp", "t.png"} and found["t.png"]["reason"] == "undecodable"
    assert all((pictures.pixels(found[n].asDict()) == x).all() for n, x in arrays.items())
    assert pictures.pixels(found["b.bmp"].asDict()).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    by_spark = {r["image"]["origin"].rpartition("/")[2]: bytes(r["image"]["data"]) for r in spark.read.format("image").option("recursiveFileLookup", True).load(f"{folder}/part=1").collect() if r["image"]["height"] > 0}
    assert by_spark == {"c.png": bytes(found["c.png"]["data"])}


def test_measures_without_images(spark):
    x = RNG.integers(0, 256, (30, 9, 3), np.uint8)
    table = spark.createDataFrame([("a", *x.shape, bytearray(x.tobytes()))], pictures.IMAGE)
    effects = [("Brightness", 1.3), ("Gamma", 0.5), ("ColorShift", 2.0), ("InkBleed", 0.5)]
    assert sorted(images.augment_images(table, effects, 4, measure=True).collect()) == sorted(images.measured(images.augment_images(table, effects, 4)).collect())


def test_rows_of_one_split_are_dealt_out(spark, tmp_path):
    """A file of many splits, all of its rows in one row group."""
    pq.write_table(pa.table({"doc_id": range(1 << 19), "text": [f"{i * 7919:x}" for i in range(1 << 19)]}), f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        docs = catalog.table(spark, str(tmp_path), "documents")
        assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        most = catalog.spread(docs, "doc_id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < (1 << 19) / 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_contents_are_read_by_few_tasks(spark, tmp_path):
    (tmp_path / "part=0").mkdir()
    for i in range(300):
        (tmp_path / "part=0" / f"{i}.txt").write_text(str(i))
    read = files.contents(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and {int(r["content"]) for r in read.collect()} == set(range(300))


def test_files_of_parts_are_listed_by_few_tasks(spark, tmp_path):
    for name in ("part=0/a.png", "part=1/b.JPG", "part=1/below/c.png", "below/d.png", "e.pdf", "part=0/f.txt", "part=0/_g.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("12")
    found = annotations.scan_files(spark, f"file://{tmp_path}")
    assert sorted((r["stem"], r["ext"], r["length"]) for r in found.collect()) == [("a", ".png", 2), ("b", ".JPG", 2), ("e", ".pdf", 2)]
    assert found.where("modificationTime > current_timestamp() - interval 1 hour").count() == 3
    assert "Scan binaryFile" not in found._jdf.queryExecution().toString()
    truth = annotations.judged_ground_truth(spark, str(tmp_path))
    assert sorted(r["path"].rpartition("/")[2] for r in truth.collect()) == ["a.png", "b.JPG", "e.pdf", "f.txt"]
    assert "Scan text" not in truth._jdf.queryExecution().toString()


def test_few_micro_batches(spark, tmp_path):
    (tmp_path / "in" / "part=0").mkdir(parents=True)
    for i in range(1100):
        (tmp_path / "in" / "part=0" / f"{i}.json").write_text(f'{{"image_path": "{i}.png", "text": "t"}}' if i % 2 else "{")
    good, bad = jobs.halves_to_end(jobs.stream_ground_truth(spark, str(tmp_path / "in")), f"file://{tmp_path}/out")
    assert (good.count(), bad.count()) == (550, 550)
    assert len(list((tmp_path / "out" / "out").glob("epoch=*"))) == 1
    assert len(list((tmp_path / "out" / "out").glob("epoch=0/*/part-*"))) <= 8 * spark.sparkContext.defaultParallelism


def test_names_of_a_stream_are_in_its_state(spark, tmp_path):
    """Tasks list the folder and read its files; the driver's log of the source has no names, and a further run reads what is new."""
    folder, out = tmp_path / "in", tmp_path / "out"
    for i in range(40):
        (folder / f"part={i % 3}").mkdir(parents=True, exist_ok=True)
        (folder / f"part={i % 3}" / f"page{i}.json").write_text(f'{{"image_path": "{i}.png", "text": "t"}}' if i % 4 else "")
    good, bad = jobs.halves_to_end(jobs.stream_ground_truth(spark, f"file://{folder}"), f"file://{out}")
    assert (good.count(), bad.count()) == (30, 10)
    assert not any("page" in x.read_text() for x in (out / "checkpoint" / "sources").rglob("*") if x.is_file() and x.suffix != ".crc")
    (folder / "part=7").mkdir()
    (folder / "part=7" / "page7.txt").write_text("new")
    good, bad = jobs.halves_to_end(jobs.stream_ground_truth(spark, f"file://{folder}"), f"file://{out}")
    assert (good.count(), bad.count()) == (30, 11) and bad.where("path like '%part=7%'").first()["reason"] == "not an annotation"


def test_customers_are_dealt_out(spark, tmp_path):
    pq.write_table(pa.table({"c_custkey": range(3000)}), f"{tmp_path}/customer.parquet")
    for name in ("placement", "provider_values"):
        rows = catalog.queries()[name](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("at")).count().collect()
        assert len(rows) > spark.sparkContext.defaultParallelism
