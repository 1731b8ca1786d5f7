"""Files: photographs, archives of models, result tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship, stored
from ..functions.names import accepted
from ..operators.resize import work_frame
from ..operators.tiles import sized
from .named import found

MOST_BYTES, ROWS_AT_ONCE = 4 * 1024 * 1024, 1 << 18


def uploads(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, length, content, error) of a folder's files; error: null for a file that can be taken. Files that are too large aren't read; empty ones, which Spark's own sources pass over, have a row."""
    name, size = F.substring_index("name", "/", -1), F.col("bytes")
    error = F.when(~accepted(name), "unsupported extension").when(size == 0, "empty file").when(size > most, "file too large")
    return found(spark, path, most).select(F.concat(F.lit(f"{path}/"), "name").alias("path"), size.alias("length"), "content", F.coalesce("error", error).alias("error"))


def photographs(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Spark's image rows, of a folder's files whose names fit a pattern if there is one: the folder is then listed at once, not file by file. Those that can't be decoded have height -1."""
    reader = spark.read.format("image")
    return (reader if pattern is None else reader.option("pathGlobFilter", pattern)).load(path).select("image.*")


def pixels(images: DataFrame, key: str = "origin") -> DataFrame:
    """Pixel table (image_id, y, x, height, width, b, g, r) of decoded images of one, three or four channels (stored by rows, blue first; grey counts for all three). One Arrow pass unpacks an image's bytes, some rows at a time."""
    ship(images.sparkSession)
    kind = images.schema[key].dataType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w, n = (batch.column(k)[i].as_py() for k in (1, 2, 3))
                data = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(h, w, n)
                step = max(1, ROWS_AT_ONCE // w)
                for y in range(0, h, step):
                    part = data[y : y + step].reshape(-1, n)
                    place = np.arange(y * w, y * w + len(part))
                    size = [pa.array(np.full(len(part), v, np.int32)) for v in (h, w)]
                    planes = [pa.array(part[:, min(k, n - 1) if n < 3 else k].astype(np.int32)) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(part), batch.schema.field(0).type), pa.array((place // w).astype(np.int32)), pa.array((place % w).astype(np.int32)), *size, *planes], names=["image_id", "y", "x", "height", "width", "b", "g", "r"])

    good = images.filter("nChannels IN (1, 3, 4) AND height > 0 AND width > 0").select(key, "height", "width", "nChannels", "data")
    return good.mapInArrow(unpack, f"image_id {kind}, y int, x int, height int, width int, b int, g int, r int")


def decoded(spark: SparkSession, path: str, most: int = 1600, pattern: str | None = None) -> DataFrame:
    """Pixels of all images of a folder, none with a side above `most` (made smaller by areas). Images are decoded once, into the shared folder; those that are small enough stay as they are, without a shuffle."""
    images, large = stored(photographs(spark, path, pattern)), (F.col("height") > most) | (F.col("width") > most)
    small = pixels(images.filter(~large)).withColumns({k: F.col(k).cast("double") for k in "bgr"})
    return small.unionByName(work_frame(pixels(images.filter(large)), ["b", "g", "r"], most))


def png(pixels: DataFrame) -> DataFrame:
    """(image_id, content): each image as a PNG of 8-bit red, green and blue. An image is one row, as a file is."""
    ship(pixels.sparkSession)
    rows = sized(pixels).groupBy("image_id").agg(F.max("height").cast("int").alias("height"), F.max("width").cast("int").alias("width"), F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("y", "x", "r", "g", "b")))).alias("cells"))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                h, w = (batch.column(k)[i].as_py() for k in (1, 2))
                cells = batch.column(3)[i].values
                y, x, *planes = (cells.field(k).to_numpy() for k in ("y", "x", "r", "g", "b"))
                image = np.zeros((h, 1 + 3 * w), np.uint8)  # each row begins with the number of its filter, none
                for k, v in enumerate(planes):
                    image[y, 1 + 3 * x + k] = v
                out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(image.tobytes())) + chunk(b"IEND", b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["image_id", "content"])

    return rows.mapInArrow(encode, f"image_id {dict(rows.dtypes)['image_id']}, content binary")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and sha256 of every file under path but a manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).filter("file <> 'manifest.json'")


def plain_csv(spark: SparkSession, path: str, columns: int = 9) -> DataFrame:
    """Lines split at commas, without quoting: an array of the first `columns` cells."""
    return spark.read.text(path).filter("value <> ''").select(F.slice(F.split("value", ",", -1), 1, columns).alias("cells"))
