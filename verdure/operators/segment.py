"""Where a segmentation starts from, for all images at once: thresholds by between-class variance, and clusters of colour and texture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared_folder
from .tiles import sized

LEVELS = 256


def away_from_border(pixels: DataFrame, planes: tuple[str, ...] = ("lab_l", "lab_a", "lab_b")) -> DataFrame:
    """pixels with `away`: the distance of a pixel's colour from the medians of its image's edge pixels (a corner counts for both its edges), stretched to whole levels 0 .. 255
    between the image's least and most; 0 all over for an image of one colour. The edge is a sliver of an image; its medians, one row an image, are joined back."""
    pixels = sized(pixels)
    edges = F.array(F.col("y") == 0, F.col("y") == F.col("height") - 1, F.col("x") == 0, F.col("x") == F.col("width") - 1)
    border = pixels.filter(F.exists(edges, lambda e: e)).select("image_id", *planes, F.explode(F.filter(edges, lambda e: e))).groupBy("image_id").agg(*(F.median(p).alias(f"_m{i}") for i, p in enumerate(planes)))
    apart = F.sqrt(sum(((F.col(p) - F.col(f"_m{i}")) * (F.col(p) - F.col(f"_m{i}")) for i, p in enumerate(planes)), F.lit(0.0)))
    out = pixels.join(border.hint("shuffle_hash"), "image_id").withColumn("_d", apart)
    span = out.groupBy("image_id").agg(F.min("_d").alias("_low"), F.max("_d").alias("_high"))
    level = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_d") - F.col("_low")) * 255 / (F.col("_high") - F.col("_low")))).otherwise(0)
    return out.join(span.hint("shuffle_hash"), "image_id").withColumn("away", level.cast("int")).drop("_d", "_low", "_high", *(f"_m{i}" for i in range(len(planes))))


def thresholds(pixels: DataFrame, level: str) -> DataFrame:
    """(image_id, threshold, between, above): the level that parts an image's pixels best in those up to it and those above: the one with the most variance between the two, of equal ones the lowest;
    null for an image of one level. above: how many pixels foreground() takes.

    Partial histograms go into the shuffle, at most 256 rows an image; the moments below each level are running sums over them."""
    histogram = pixels.groupBy("image_id", F.col(level).cast("int").alias("v")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("image_id")
    mass = F.col("v") * F.col("n")
    out = histogram.withColumns({"n0": F.sum("n").over(upto), "m0": F.sum(mass).over(upto), "all_n": F.sum("n").over(every), "all_m": F.sum(mass).over(every)})
    n1 = F.col("all_n") - F.col("n0")
    apart = F.col("m0") / F.col("n0") - (F.col("all_m") - F.col("m0")) / n1
    between = F.when(n1 > 0, (F.col("n0") / F.col("all_n")) * (n1 / F.col("all_n")) * apart * apart)
    best = F.max_by(F.struct("v", "b", n1.alias("n1")), F.struct(F.round("b", 9), -F.col("v")))
    return out.withColumn("b", between).groupBy("image_id").agg(F.max("b").alias("_any"), F.when(F.max("b").isNotNull(), best).alias("t")).select("image_id", F.col("t.v").alias("threshold"), F.col("t.b").alias("between"), F.coalesce("t.n1", F.lit(0).cast("long")).alias("above"))


def foreground(pixels: DataFrame, level: str, name: str = "seed") -> DataFrame:
    """pixels with `name`: whether the level is above its image's threshold; false without one."""
    cut = thresholds(pixels, level).select("image_id", F.col("threshold").alias("_t"))
    return pixels.join(cut.hint("shuffle_hash"), "image_id").withColumn(name, F.coalesce(F.col(level) > F.col("_t"), F.lit(False))).drop("_t")


def _nearest(features: list[str], centres: list[list[Column]]) -> Column:
    """The index of the centre nearest to a row's features, the first of equals."""
    far = lambda c: F.rint(sum(((F.col(f) - x) * (F.col(f) - x) for f, x in zip(features, c, strict=True)), F.lit(0.0)) * 1e9)  # noqa: E731  whole billionths: a decimal rounding costs more than all else
    every = F.array(*map(far, centres))
    return F.coalesce(F.array_position(every, F.array_min(every)) - 1, F.lit(0)).cast("int")


def clusters(pixels: DataFrame, features: list[str], sizes: tuple[int, ...] = (2, 3, 4), rounds: int = 10) -> DataFrame:
    """(image_id, k, centres): means of k clusters of each image's pixels, for all images and all k of `sizes` at once.

    The start is fixed: the middles of k slices of equal width of the first feature's range, with the means of the other features, so runs agree. Each round assigns every pixel to its
    nearest centre of each k and adds up a row for each cluster of an image; a cluster without pixels keeps its centre. An image's centres are one small row, joined to pixels by image,
    so nothing goes through the driver; pixels that lie by image stay where they are. Pixels alike are one row with their number. Rounds' centres are written to the shared folder, pixels are read anew by each round."""
    shared_folder(pixels.sparkSession)
    own = [f"_f{i}" for i in range(len(features))]
    rows = pixels.select("image_id", *(F.col(f).cast("double").alias(n) for f, n in zip(features, own, strict=True))).groupBy("image_id", *own).agg(F.count("*").alias("_n"))
    cell = lambda k, j, i: f"_c{k}_{j}_{i}"
    every = [(k, j) for k in sizes for j in range(k)]
    span = rows.groupBy("image_id").agg(F.min("_f0").alias("_low"), F.max("_f0").alias("_high"), *((F.sum(F.col(f) * F.col("_n")) / F.sum(F.when(F.col(f).isNotNull(), F.col("_n")))).alias(f"_mean{i}") for i, f in enumerate(own)))
    first = lambda k, j: F.col("_low") + (F.col("_high") - F.col("_low")) * (F.lit(j) + 0.5) / F.lit(k)
    centres = span.select("image_id", *((F.col(f"_mean{i}") if i else first(k, j)).alias(cell(k, j, i)) for k, j in every for i in range(len(own))))
    for _ in range(rounds):
        near = {f"_n{k}": _nearest(own, [[F.col(cell(k, j, i)) for i in range(len(own))] for j in range(k)]) for k in sizes}
        each = rows.join(centres.hint("shuffle_hash"), "image_id").select("image_id", "_n", *own, *(x.alias(n) for n, x in near.items()))
        at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_n{k}").alias("j")) for k in sizes))).alias("_at")
        mean = lambda f: F.sum(F.col(f) * F.col("_n")) / F.sum(F.when(F.col(f).isNotNull(), F.col("_n")))
        sums = each.select("image_id", "_n", *own, at).groupBy("image_id", F.col("_at.k").alias("_k"), F.col("_at.j").alias("_j")).agg(*(mean(f).alias(f"_m{i}") for i, f in enumerate(own)))
        sums = sums.groupBy("image_id").agg(*(F.max(F.when((F.col("_k") == k) & (F.col("_j") == j), F.col(f"_m{i}"))).alias(f"_m{k}_{j}_{i}") for k, j in every for i in range(len(own))))
        centres = centres.hint("shuffle_hash").join(sums, "image_id").select("image_id", *(F.coalesce(f"_m{k}_{j}_{i}", cell(k, j, i)).alias(cell(k, j, i)) for k, j in every for i in range(len(own)))).checkpoint()
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.array(*(F.array(*(F.col(cell(k, j, i)) for i in range(len(own)))) for j in range(k))).alias("centres")) for k in sizes))
    return centres.select("image_id", F.explode(each).alias("x")).select("image_id", "x.k", "x.centres")


def assigned(pixels: DataFrame, features: list[str], centres: DataFrame, k: int) -> DataFrame:
    """pixels with `cluster`, of the k clusters of clusters()."""
    of = centres.filter(F.col("k") == k).select("image_id", F.col("centres").alias("_centres"))
    near = _nearest(features, [[F.col("_centres")[j][i] for i in range(len(features))] for j in range(k)])
    return pixels.join(of.hint("shuffle_hash"), "image_id").withColumn("cluster", near).drop("_centres")
