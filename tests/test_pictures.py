"""Files and images: what is written comes back, effects against plain loops, similarity against its definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import images
from folio.sources import pictures

RNG = np.random.default_rng(6)
ARRAYS = {"grey.png": RNG.integers(0, 256, (9, 13, 1), np.uint8), "colour.png": RNG.integers(0, 256, (20, 7, 3), np.uint8), "clear.png": RNG.integers(0, 256, (8, 8, 4), np.uint8)}


def table(spark, arrays):
    return spark.createDataFrame([(n, *x.shape, bytearray(x.tobytes())) for n, x in arrays.items()], pictures.IMAGE)


def test_png_files_come_back(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    files = pictures.as_png(table(spark, ARRAYS)).unionByName(spark.createDataFrame([("broken.png", bytearray(b"no image")), ("cut.png", bytearray(pictures.png(ARRAYS["grey.png"])[:40])), ("empty.png", None)], "name string, content binary"))
    assert pictures.write_files(files, folder) == 6
    assert pictures.write_files(files, folder) == 6  # an attempt that repeats
    good, bad = pictures.read_images(spark, folder)
    got = {r["name"]: pictures.pixels(r.asDict()) for r in good.collect()}
    assert got.keys() == ARRAYS.keys() and all((got[n] == x).all() for n, x in ARRAYS.items())
    assert sorted(r["path"].rpartition("/")[2] for r in bad.collect()) == ["broken.png", "cut.png"]  # Spark passes over empty files
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        pictures.read_images(spark, f"{folder}/none")[0].collect()


def test_effects_in_one_pass(spark):
    amounts = [("Brightness", 1.3), ("Gamma", 0.5), ("ColorShift", 2.0), ("Dithering", 0.0), ("InkBleed", 1.0), ("LowLightNoise", 5.0), ("NoiseTexturize", 8.0)]
    out = images.augment_images(table(spark, ARRAYS), amounts, 4)
    got = {(r["name"], r["effect"]): pictures.pixels(r.asDict()) for r in out.collect()}
    assert len(got) == 21
    again = {(r["name"], r["effect"]): bytes(r["data"]) for r in images.augment_images(table(spark, ARRAYS).repartition(3), amounts, 4).collect()}
    assert all(again[k] == x.tobytes() for k, x in got.items())
    for name, x in ARRAYS.items():
        h, w, c = x.shape
        for i in range(h):
            for j in range(w):
                for k in range(c):
                    v = float(x[i, j, k])
                    assert got[name, "Brightness"][i, j, k] == min(255, round(np.float32(v) * np.float32(1.3)))
                    assert abs(int(got[name, "Gamma"][i, j, k]) - 255 * (v / 255) ** 0.5) <= 0.51
                    assert got[name, "ColorShift"][i, j, k] == (x[i, (j - 2 * (k - 1)) % w, k] if 1 < c and k < 3 else v)
                    assert got[name, "Dithering"][i, j, k] == (255 if v > [[32, 160], [224, 96]][i % 2][j % 2] else 0)
                    near = [x[i, j, k], x[(i - 1) % h, j, k], x[(i + 1) % h, j, k], x[i, (j - 1) % w, k], x[i, (j + 1) % w, k]]
                    assert got[name, "InkBleed"][i, j, k] == min(near)
    flat = np.full((200, 200, 3), 100, np.uint8)
    noisy = {r["effect"]: pictures.pixels(r.asDict()).astype(float) for r in images.augment_images(table(spark, {"f": flat}), [("LowLightNoise", 5.0), ("NoiseTexturize", 8.0)]).collect()}
    assert abs(noisy["LowLightNoise"].mean() - 60) < 0.2 and abs(noisy["LowLightNoise"].std() - 5) < 0.1
    assert abs(noisy["NoiseTexturize"].mean() - 100) < 0.3 and abs(noisy["NoiseTexturize"].std() - 8) < 0.2 and np.ptp(noisy["NoiseTexturize"], axis=2).max() == 0
    with pytest.raises(ValueError, match="Stains"):
        images.augment_images(table(spark, ARRAYS), [("Stains", 1.0)])


def windows(a, b):
    out = []
    for i in range(a.shape[0] - 6):
        for j in range(a.shape[1] - 6):
            x, y = a[i : i + 7, j : j + 7].ravel(), b[i : i + 7, j : j + 7].ravel()
            cov = np.cov(x, y)
            out.append((2 * x.mean() * y.mean() + 6.5025) * (2 * cov[0, 1] + 58.5225) / ((x.mean() ** 2 + y.mean() ** 2 + 6.5025) * (cov[0, 0] + cov[1, 1] + 58.5225)))
    return min(1, max(0, np.mean(out)))


def test_similarity(spark):
    other = {"grey.png": np.roll(ARRAYS["grey.png"], 1, 0), "colour.png": ARRAYS["colour.png"] // 2, "clear.png": ARRAYS["clear.png"][:7], "alone.png": ARRAYS["grey.png"]}
    got = {r["name"]: r["ssim"] for r in images.ssim(table(spark, ARRAYS), table(spark, other).withColumn("effect", F.lit("e"))).collect()}
    assert got.keys() == ARRAYS.keys() and got["clear.png"] == 0.5
    for name in ("grey.png", "colour.png"):
        assert got[name] == pytest.approx(windows(ARRAYS[name].mean(2), other[name].mean(2)), abs=1e-9)
    assert images.ssim(table(spark, ARRAYS), table(spark, ARRAYS)).where("ssim < 0.999999").count() == 0


def test_pages_and_charts():
    page = pictures.page_picture("ab c\n" + "x" * 81)[:, :, 0]
    assert page.shape == (12, 160)
    assert [(page[r] == 40).sum() for r in (0, 1, 2, 4, 5, 8, 9, 11)] == [6, 6, 0, 160, 160, 2, 2, 0]
    assert page[0, :9].tolist() == [40] * 4 + [230] * 2 + [40] * 2 + [230]
    chart = pictures.chart_picture("aa b")
    assert chart.shape == (16, 16, 3) and (chart[:, 0, 0] == 40).sum() == 2 and (chart[:, 1, 1] == 80).sum() == 1 and (chart[:, 2] == 230).all()
    assert pictures.page_picture("").shape == (4, 160, 1)
