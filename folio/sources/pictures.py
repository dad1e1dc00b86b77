"""Files with given contents, PNG images among them, written by tasks and decoded again: plain PNG files by tasks, others by Spark's image source."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import FLUSH, by_tasks, listed, mapped

IMAGE = "name string, height int, width int, n_channels int, data binary"


def png(x: np.ndarray) -> bytes:
    """A PNG file of a height x width x channels array of bytes: grey, blue-green-red, or those with opacity (the order of Spark's image source)."""
    height, width, channels = x.shape
    rows = x if channels == 1 else x[:, :, [2, 1, 0, 3][:channels]]
    raw = np.zeros((height, 1 + width * channels), np.uint8)
    raw[:, 1:] = rows.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def pixels(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["n_channels"])


def as_png(images: DataFrame) -> DataFrame:
    """(name, content) of images(name, height, width, n_channels, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(files, pa.binary())], names=["name", "content"])

        names, files, size = [], [], 0
        for batch in batches:
            for name, *shape, data in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4), strict=True):
                names.append(name)
                files.append(png(np.frombuffer(data.as_buffer(), np.uint8).reshape(shape)))
                size += len(files[-1])
                if size > FLUSH:
                    yield out()
                    names, files, size = [], [], 0
        if names:
            yield out()

    return images.select("name", "height", "width", "n_channels", "data").mapInArrow(run, "name string, content binary")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes each row of files(name, content) as folder/name, with folders in names; null contents are empty files. Returns their number.

    A file gets its name when it is whole, so that a lost or repeated attempt leaves at most one that begins with an underscore,
    which Spark's readers pass over. folder must be reachable by all executors (any scheme that pyarrow.fs opens).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place = f"{root}/{name}".rpartition("/")[0]
                if place not in made:
                    store.create_dir(place, recursive=True)
                    made.add(place)
                part = f"{place}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# ---- reading

#: Bytes at a file's start that tell how it is read.
HEAD = 512
_PLAIN_CHUNKS = (b"IHDR", b"sRGB", b"gAMA", b"cHRM", b"pHYs", b"tEXt", b"tIME")
_OTHERS = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF8", b"BM", b"II*\0", b"MM\0*", b"\0\0")


def kind_of(head: bytes) -> str:
    """"plain": a PNG file of 8 bits a value, grey or in colour, without tables or interlacing, which tasks decode; "other": what may be an image, which is left to Spark's image source; "none": no image."""
    if head[:16] == b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" and len(head) >= 33 and head[24] == 8 and head[25] in (0, 2, 6) and head[26:29] == b"\0\0\0":
        at = 33
        while at + 8 <= len(head):
            size, chunk = struct.unpack(">I4s", head[at : at + 8])
            if chunk == b"IDAT":
                return "plain"
            if chunk not in _PLAIN_CHUNKS:
                return "other"
            at += 12 + size
        return "other" if len(head) >= HEAD else "none"
    return "other" if head.startswith(_OTHERS) and not (head.startswith(_OTHERS[0]) and len(head) < 33) else "none"


def decoded(data: bytes) -> np.ndarray | None:
    """The height x width x channels array of a plain PNG file (blue first); None where it is cut or broken."""
    width, height, _, color = struct.unpack(">IIBB", data[16:26])
    channels = {0: 1, 2: 3, 6: 4}[color]
    at, body, size = 33, [], height * (1 + width * channels)
    while at + 12 <= len(data):
        n, chunk = struct.unpack(">I4s", data[at : at + 8])
        if chunk == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        if chunk == b"IEND":
            break
        at += 12 + n
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), size)
    except zlib.error:
        return None
    if not size or len(raw) < size:
        return None
    rows = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * channels)
    filters, x = rows[:, 0], rows[:, 1:].reshape(height, width, channels)
    if filters.max() > 4:
        return None
    x = _unfiltered(filters, x) if filters.any() else x
    return x if channels == 1 else np.ascontiguousarray(x[:, :, [2, 1, 0, 3][:channels]])


def _unfiltered(filters: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of filtered rows; what a point is predicted from lies on the two diagonals before its own, so a diagonal is worked at once."""
    height, width, channels = x.shape
    out = np.zeros((height + 1, width + 1, channels), np.int16)
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        c, f = d - r, filters[r][:, None]
        left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        a, b, e = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((a <= b) & (a <= e), left, np.where(b <= e, up, corner))
        guess = np.select([f == 0, f == 1, f == 2, f == 3], [0, left, up, (left + up) // 2], paeth)
        out[r + 1, c + 1] = (x[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def judged_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, height, width, n_channels, data, reason) of a folder's files in one pass, data by rows, blue first; what isn't an image or is broken has a reason instead.

    Tasks list the folder, read its files and decode plain PNG files; files that may be images of other kinds, if there are any, are decoded by Spark's image source.
    Empty files are passed over, as by Spark; a missing path raises.
    """
    names = [f.split()[0] for f in JUDGED.split(", ")]
    if not by_tasks(path):
        return _by_source(spark, path)
    files = listed(spark, path).where("length > 0")

    def other(place: str, stream) -> tuple | None:
        return (place,) if kind_of(stream.read(HEAD)) == "other" else None

    def image(place: str, stream) -> tuple | None:
        data = stream.read()
        kind = kind_of(data[:HEAD])
        if kind == "other":
            return None
        x = decoded(data) if kind == "plain" else None
        name = place.rpartition("/")[2]
        return (place, name, None, None, None, None, "undecodable") if x is None else (place, name, *x.shape, x.tobytes(), None)

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    plain = mapped(files, image, JUDGED, names, kinds)
    others = [r["path"] for r in mapped(files, other, "path string", ["path"], [pa.string()]).collect()]
    return plain.unionByName(_by_source(spark, others)) if others else plain


JUDGED = "path string, name string, height int, width int, n_channels int, data binary, reason string"


def _by_source(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = spark.read.format("image").option("dropInvalid", False).load(path)
    good = F.col("image.height") > 0
    values = {"height": "height", "width": "width", "n_channels": "nChannels", "data": "data"}
    name = F.regexp_extract("image.origin", r"([^/]*)$", 1)
    return raw.select(F.col("image.origin").alias("path"), name.alias("name"), *[F.when(good, F.col(f"image.{v}")).alias(n) for n, v in values.items()], F.when(~good, F.lit("undecodable")).alias("reason"))


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, rejects) of judged_images: images are (name, height, width, n_channels, data), rejects (path, reason)."""
    rows = judged_images(spark, path)
    return rows.where("reason is null").select("name", "height", "width", "n_channels", "data"), rows.where("reason is not null").select("path", "reason")


# ---- pictures of texts

PAPER, INK, COLUMNS = 230, 40, 80
_BLANK = np.array([ord(c) for c in " \t\r\x0b\x0c\0"], np.uint32)


def page_picture(text: str) -> np.ndarray:
    """A page at a size where letters are marks: each character that isn't blank is two points wide and high, lines are four points apart and go on below after COLUMNS characters."""
    lines = [x.ljust(max(1, -(-len(x) // COLUMNS)) * COLUMNS) for x in text.split("\n")]
    marks = ~np.isin(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), _BLANK).reshape(-1, COLUMNS)
    out = np.full((4 * len(marks), 2 * COLUMNS), PAPER, np.uint8)
    for row in (0, 1):
        for column in (0, 1):
            out[row::4, column::2][marks] = INK
    return out[:, :, None]


def chart_picture(text: str, side: int = 16) -> np.ndarray:
    """A bar chart, in colour, of the lengths of a text's first words parted by single blanks, each modulo side + 1."""
    bars = np.zeros(side, int)
    for i, w in enumerate(text.split(" ")[:side]):
        bars[i] = len(w) % (side + 1)
    filled = (np.arange(side)[:, None] >= side - bars)[:, :, None]
    return np.where(filled, np.array([INK, 2 * INK, 3 * INK]), PAPER).astype(np.uint8)


def drawn(texts: DataFrame, picture) -> DataFrame:
    """Images of texts(name, text); null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = picture(text or "")
                rows.append((name, *x.shape, x.tobytes()))
                size += x.nbytes
                if size > FLUSH:
                    yield _images(rows)
                    rows, size = [], 0
            if rows:
                yield _images(rows)

    return texts.select("name", "text").mapInArrow(run, IMAGE)


def _images(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["name", "height", "width", "n_channels", "data"])


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")
