"""Photos by a rule: soil with noise and an elliptic leaf, for tests and for queries on tables that hold no photographs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels that a task makes, about.
PART = 1 << 19

#: Soil and leaf (blue, green, red), and the leaf's half axes as shares of the frame.
SOIL, LEAF, HALF_WIDTH, HALF_HEIGHT = {"b": 120, "g": 85, "r": 55}, {"b": 60, "g": 140, "r": 50}, 150 / 512, 110 / 384


def dealt(specs: DataFrame, key: str, pixels: Column | int) -> DataFrame:
    """specs by the hash of their key, in as many parts as their pixels ask for: few specs make many pixels. Sums, tiles and joins by image then find them in place."""
    session = specs.sparkSession
    total = specs.agg(F.sum(F.lit(pixels).cast("long"))).first()[0] or 0
    return specs.repartition(max(-(-total // PART), session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), key)


def photos(specs: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, height, width, b, g, r, leaf) of specs (image_id, height, width, noise, light, has_leaf): soil has whole noise below `noise`, all is `light` per cent bright, cut at 255.
    Noise is a multiplicative hash of image, place and channel, so every run gives the same photos."""
    i, w, h = F.col("i"), F.col("width"), F.col("height")
    spread = dealt(specs, "image_id", h.cast("long") * w)
    rows = spread.select("*", F.explode(F.sequence(F.lit(0).cast("long"), h.cast("long") * w - 1)).alias("i"))
    rows = rows.withColumns({"y": F.floor(i / w).cast("int"), "x": (i % w).cast("int")})
    across, down = (F.col("x") - w / F.lit(2.0)) / (w * F.lit(HALF_WIDTH)), (F.col("y") - h / F.lit(2.0)) / (h * F.lit(HALF_HEIGHT))
    rows = rows.withColumn("leaf", F.col("has_leaf") & (across * across + down * down < 1))
    noise = lambda c: F.shiftright((F.col("image_id") * 31 + i * 17 + c * 7) * F.lit(2654435761) % F.lit(4294967296), 16) % F.greatest("noise", F.lit(1))
    value = lambda k, c: F.least(F.lit(255), F.floor((F.when(F.col("leaf"), LEAF[k]).otherwise(SOIL[k] + noise(c))) * F.col("light") / 100)).cast("int")
    return rows.select("image_id", "y", "x", "height", "width", *(value(k, c).alias(k) for c, k in enumerate("bgr")), "leaf")
