"""Lesions at a leaf's margin: which coloured patches beside the leaf belong to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import stored
from . import raster, shape, tiles

#: Sizes of the ellipses that open candidates, make their rings, the leaf's surroundings and the patches' surroundings, and the fewest pixels of these.
OPEN, RING, NEAR, AROUND, LEAST_AROUND = 3, 5, 5, 31, 20


def _merged(spans: DataFrame) -> DataFrame:
    """(image_id, label, y, a, b): spans of a row from a to b, put together where they touch."""
    row = Window.partitionBy("image_id", "label", "y").orderBy("a")
    before = F.max("b").over(row.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("a") > before + 1, F.lit(True)).cast("int")
    parts = spans.withColumn("_new", begins).withColumn("_part", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("image_id", "label", "y", "_part").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_part")


def _widened(labelled: DataFrame, size: int) -> DataFrame:
    """(image_id, label, y, x): the places within an ellipse of a patch's pixels, each once. Patches overlap, so each is widened by itself: runs of pixels grow and merge, single places come last."""
    runs = _merged(labelled.select("image_id", "label", "y", F.col("x").alias("a"), F.col("x").alias("b")))
    grown = F.array(*(F.struct(F.lit(i - size // 2).alias("dy"), F.lit(reach).alias("dx")) for i, reach in enumerate(tiles.ellipse(size))))
    wide = runs.select("image_id", "label", "y", "a", "b", F.explode(grown).alias("d")).select("image_id", "label", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("a") - F.col("d.dx")).alias("a"), (F.col("b") + F.col("d.dx")).alias("b"))
    return _merged(wide).select("image_id", "label", "y", F.explode(F.sequence("a", "b")).alias("x"))


def candidates(pixels: DataFrame, filled: str, lesion: str, tile: int = tiles.TILE, keep: tuple[str, ...] | None = None) -> DataFrame:
    """pixels with `candidate`: coloured like lesions, within the hull of the leaf's largest component, beside the filled leaf, opened by a small ellipse; and `near`: within an ellipse of the leaf. keep: the columns that stay, all if none are given."""
    largest = raster.components(pixels.select("image_id", "y", "x", filled, "width"), filled, eight=True, tile=tile)
    hull = shape.spans(largest).select("image_id", "top", "spans").hint("shuffle_hash")
    found = pixels.join(hull, "image_id", "left").withColumn("_c", (F.col(lesion) & ~F.col(filled) & shape.inside("top", "spans", "x", "y")).cast("int")).drop("top", "spans")
    keep = tuple(c for c in pixels.columns if c not in ("image_id", "y", "x")) if keep is None else keep
    opened = lambda c, leaf: {"candidate": c.round(OPEN, most=False).round(OPEN), "near": leaf.round(NEAR)}
    return tiles.filtered(found.withColumn("_l", F.col(filled).cast("int")), ["_c", "_l"], opened, {"candidate": "boolean", "near": "boolean"}, OPEN // 2 * 2 + NEAR // 2, keep, tile)


def marginal(pixels: DataFrame, filled: str, lesion: str, a: str = "lab_a", b: str = "lab_b", tile: int = tiles.TILE) -> DataFrame:
    """(image_id, label, pixels, border, around, distance, keeps) of each candidate patch (4-connected) beside the leaf. pixels: with height and width.

    border: the leaf's share of the ring around the patch. A patch whose ring is mostly leaf stays; one with enough of it stays if fewer than 20 pixels lie around it that are
    neither near the leaf nor candidates, or if its mean colour is far from their medians. The leaf is `filled`: without holes."""
    found = stored(candidates(pixels, filled, lesion, tile, ("width", filled, a, b)))
    patches = stored(raster.components(found, "candidate", keep=(a, b), tile=tile))
    # files of few values are far smaller than their rows, so no side is sent through the driver for its size
    own = patches.select("image_id", "label", "y", "x")
    ring = _widened(own, RING).join(own.hint("merge"), ["image_id", "label", "y", "x"], "left_anti").join(found.select("image_id", "y", "x", F.col(filled).alias("_on")).hint("merge"), ["image_id", "y", "x"])
    border = ring.groupBy("image_id", "label").agg(F.avg(F.col("_on").cast("double")).alias("border"))
    each = patches.groupBy("image_id", "label").agg(F.count("*").alias("pixels"), F.avg(a).alias("_a"), F.avg(b).alias("_b"))
    free = found.filter(~F.col("near") & ~F.col("candidate")).select("image_id", "y", "x", F.col(a).alias("_fa"), F.col(b).alias("_fb"))
    around = _widened(own, AROUND).join(free.hint("merge"), ["image_id", "y", "x"]).groupBy("image_id", "label").agg(F.count("*").alias("around"), F.median("_fa").alias("_ma"), F.median("_fb").alias("_mb"))
    out = each.join(border.hint("merge"), ["image_id", "label"], "left").join(around.hint("merge"), ["image_id", "label"], "left").withColumn("around", F.coalesce("around", F.lit(0).cast("long")))
    away = F.sqrt((F.col("_a") - F.col("_ma")) * (F.col("_a") - F.col("_ma")) + (F.col("_b") - F.col("_mb")) * (F.col("_b") - F.col("_mb")))
    out = out.withColumn("distance", away)
    keeps = F.coalesce(raster.keeps_marginal(F.col("border"), F.col("around"), F.coalesce("distance", F.lit(0.0))), F.lit(False))
    return out.select("image_id", "label", "pixels", "border", "around", "distance", keeps.alias("keeps"))
