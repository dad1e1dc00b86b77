"""Effects on images that are array arithmetic, and structural similarity; rows of (name, height, width, n_channels, data) with bytes, as read_images gives them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.pictures import FLUSH, IMAGE

EFFECTS = ["Brightness", "Gamma", "LowLightNoise", "NoiseTexturize", "ColorShift", "Dithering", "InkBleed"]


def apply_effect(x: np.ndarray, effect: str, amount: float, seed: int) -> np.ndarray:
    """One effect on a height x width x channels array of bytes."""
    f, rng = x.astype(np.float32), np.random.default_rng(seed)
    if effect == "Brightness":
        f = f * amount
    elif effect == "Gamma":
        f = 255 * (f / 255) ** amount
    elif effect == "LowLightNoise":
        f = f * 0.6 + rng.normal(0, max(amount, 0), x.shape)
    elif effect == "NoiseTexturize":
        f = f + rng.normal(0, max(amount, 0), x.shape[:2])[..., None]
    elif effect == "ColorShift":
        f = f if f.shape[2] == 1 else np.stack([np.roll(f[..., c], int(amount) * (c - 1), axis=1) if c < 3 else f[..., c] for c in range(f.shape[2])], axis=2)
    elif effect == "Dithering":
        bayer = (np.array([[0, 2], [3, 1]], np.float32) + 0.5) * 64
        f = 255.0 * (f > np.tile(bayer, (x.shape[0] // 2 + 1, x.shape[1] // 2 + 1))[: x.shape[0], : x.shape[1], None])
    elif effect == "InkBleed":
        dark = f.copy()
        for axis in (0, 1):
            for step in (-1, 1):
                dark = np.minimum(dark, np.roll(f, step, axis))
        f = (1 - amount) * f + amount * dark
    else:
        raise ValueError(effect)
    return np.clip(np.rint(f), 0, 255).astype(np.uint8)


def augment_images(images: DataFrame, effects: list[tuple[str, float]], seed: int = 0, measure: bool = False) -> DataFrame:
    """A row (name, effect, height, width, n_channels, data) for each image and each of the effects (name, amount), in one pass: an image is read once for all of them.

    Draws depend on seed, name and effect, never on partitions. Images without points come back as they are. With measure, rows are those of measured(): the changed images don't leave the task.
    """
    unknown = [e for e, _ in effects if e not in EFFECTS]
    if unknown:
        raise ValueError(f"no such effects on images: {unknown}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *([pa.int64(), pa.int64()] if measure else [pa.binary()])]
        columns = ["name", "effect", "height", "width", "n_channels", *(["total", "dark"] if measure else ["data"])]
        # what becomes of a value alone is looked up
        tables = {at: apply_effect(np.arange(256, dtype=np.uint8).reshape(16, 16, 1), effect, amount, 0).ravel() for at, (effect, amount) in enumerate(effects) if effect in ("Brightness", "Gamma")}

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

        rows, size = [], 0
        for batch in batches:
            for name, *shape, data in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4), strict=True):
                x = np.frombuffer(data.as_buffer(), np.uint8).reshape(shape)
                for at, (effect, amount) in enumerate(effects):
                    y = x if not x.size else tables[at][x] if at in tables else apply_effect(x, effect, amount, zlib.crc32(f"{seed}:{name}:{effect}".encode()))
                    rows.append((name, effect, *shape, *(_measures(y) if measure else [y.tobytes()])))
                    size += 100 if measure else y.nbytes
                    if size > FLUSH:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)

    schema = IMAGE.replace("name string", "name string, effect string")
    return images.select("name", "height", "width", "n_channels", "data").mapInArrow(run, schema.replace("data binary", "total long, dark long") if measure else schema)


def _measures(x: np.ndarray) -> tuple[int, int]:
    return int(x.sum(dtype=np.int64)), int(np.count_nonzero(x < 128))


def measured(images: DataFrame) -> DataFrame:
    """images without their data, but with total, the sum of their values, and dark, how many are below 128."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(batch.num_columns - 1)
            values = [_measures(np.frombuffer(data[i].as_buffer(), np.uint8)) for i in range(len(data))]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.int64()) for c in ([m[0] for m in values], [m[1] for m in values])]], names=[*batch.schema.names[:-1], "total", "dark"])

    kept = images.drop("data")
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return images.select(*kept.columns, "data").mapInArrow(run, f"{schema}, total long, dark long")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity of two grey arrays over uniform windows of 7 x 7, clipped to [0, 1]; unlike or too small shapes: 0.5."""
    if a.shape != b.shape or min(a.shape) < 7:
        return 0.5

    def mean(x: np.ndarray) -> np.ndarray:
        c = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return (c[7:, 7:] - c[:-7, 7:] - c[7:, :-7] + c[:-7, :-7]) / 49

    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb = mean(a), mean(b)
    n = 49 / 48
    va, vb, cov = n * (mean(a * a) - ma * ma), n * (mean(b * b) - mb * mb), n * (mean(a * b) - ma * mb)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    s = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return float(np.clip(s.mean(), 0, 1))


def ssim(original: DataFrame, degraded: DataFrame) -> DataFrame:
    """(name, ssim) of images that both tables hold; a name's rows in degraded are each compared, with the columns of degraded other than the image's kept (say, effect)."""
    image = ["height", "width", "n_channels", "data"]
    other = degraded.select(*[F.col(c).alias(f"_{c}") if c in image else F.col(c) for c in degraded.columns])
    pairs = original.select("name", *image).join(other, "name")
    kept = [c for c in degraded.columns if c not in image]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            shapes = [list(zip(*[batch.column(f"{p}{c}").to_pylist() for c in image[:3]], strict=True)) for p in ("", "_")]
            for i, (first, second) in enumerate(zip(*shapes, strict=True)):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8).reshape(shape) for c, shape in (("data", first), ("_data", second)))
                found.append(similarity(a.mean(2), b.mean(2)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.float64())], names=[*kept, "ssim"])

    schema = ", ".join(f"`{c}` {t}" for c, t in degraded.dtypes if c in kept)
    return pairs.select(*kept, *image, *[f"_{c}" for c in image]).mapInArrow(run, f"{schema}, ssim double")
