"""Photos brought to a work frame by areas: an overlap join of two grids that needs no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import sized


def work_frame(pixels: DataFrame, planes: list[str], most: int = 384) -> DataFrame:
    """(image_id, y, x, height, width, planes) of images whose longer side has at most `most` pixels: others keep their size, none grows. A new pixel is the mean of the old ones by the area it shares with each.

    A pixel knows which new pixels it overlaps, at most two each way, and by how much: in units of 1 / (old size * new size) all of that is whole numbers, so means are
    exact and sums are kept. Pixels are added up by task before the one shuffle."""
    old, long = sized(pixels), F.greatest("height", "width")
    scale = F.when(long > most, F.lit(float(most)) / long).otherwise(1.0)
    new = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) * scale).cast("int"))
    rows = old.select("image_id", *(F.col(c).cast("long").alias(c) for c in ("y", "x", "height", "width")), new("height").alias("h"), new("width").alias("w"), *planes)

    def place(at: str, size: str, to: str, far: str) -> tuple[Column, Column]:
        """The first new place that place `at` overlaps (or the one after), and the overlap in units of 1 / to, 0 at most where there is none."""
        a, s, t = F.col(at), F.col(size), F.col(to)
        j = F.expr(f"{at} * {to} div {size}") + F.col(far)
        return j, F.least((a + 1) * t, (j + 1) * s) - F.greatest(a * t, j * s)

    rows = rows.withColumn("_k", F.explode(F.array(*map(F.lit, range(4))))).withColumns({"_down": F.shiftright("_k", 1), "_right": F.col("_k").bitwiseAND(1)})
    (ny, high), (nx, broad) = place("y", "height", "h", "_down"), place("x", "width", "w", "_right")
    rows = rows.select("image_id", "h", "w", *planes, ny.alias("_y"), nx.alias("_x"), high.alias("_high"), broad.alias("_broad")).filter((F.col("_high") > 0) & (F.col("_broad") > 0))
    part = F.col("_high") * F.col("_broad")
    out = rows.groupBy("image_id", F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), "h", "w").agg(*((F.sum(F.col(p) * part) / F.sum(part)).alias(p) for p in planes))
    return out.select("image_id", "y", "x", F.col("h").alias("height"), F.col("w").alias("width"), *planes)


def letterboxed(pixels: DataFrame, planes: list[str], side: int, pad: float = 0.0) -> DataFrame:
    """(image_id, y, x, planes) of a frame of side x side: the image by areas to fit, its place in the middle, the rest `pad`. Images smaller than the frame aren't grown."""
    small = work_frame(pixels, planes, side).select("image_id", (F.col("y") + F.floor((side - F.col("height")) / 2)).cast("int").alias("y"), (F.col("x") + F.floor((side - F.col("width")) / 2)).cast("int").alias("x"), *planes)
    frame = pixels.select("image_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))).select("image_id", F.floor(F.col("i") / side).cast("int").alias("y"), (F.col("i") % side).alias("x"), *(F.lit(float(pad)).alias(p) for p in planes))
    every = frame.withColumn("_inside", F.lit(0)).unionByName(small.withColumn("_inside", F.lit(1)))
    return every.groupBy("image_id", "y", "x").agg(*(F.max_by(p, "_inside").alias(p) for p in planes))
