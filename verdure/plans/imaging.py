"""Queries on pixel tables beyond masks and regions: the Lab plane, frames, overlays, sums and choices of components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster
from .catalogue import _CC, _EIGHT, _HSV, _PX, SIDE, _pixels, _sized, query

_COMPONENTS = f"on_ AS (SELECT image_id, y, x FROM px WHERE leaf), {_CC.format(name='cc', of='on_', near=_EIGHT)}, l AS (SELECT image_id, y, x, min(label) AS label FROM cc GROUP BY ALL)"


@query(f"WITH {_HSV}, a AS (SELECT *, leaf AND greatest(0.45::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, (CASE WHEN h < 35 THEN 35 - h WHEN h > 85 THEN h - 85 ELSE 0 END) / 20)) * (s > 45)::INT + 0.30::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, lab_a / 25)) + 0.25::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, (lab_b - 25) / 25)), greatest(0::DOUBLE, least(1::DOUBLE, (70 - v) / 40)) * 0.8::DOUBLE) >= 0.35::DOUBLE AS ill FROM m) SELECT image_id, sum(lab_l)::BIGINT AS l, sum(lab_a)::BIGINT AS a, sum(lab_b)::BIGINT AS b, sum(skin::INT)::BIGINT AS skin, sum(ill::INT)::BIGINT AS ill FROM a GROUP BY image_id")
def lab_masks(spark, d):
    """Sums of the Lab plane, skin-like pixels, and abnormal colours on the leaf."""
    m = raster.with_masks(_pixels(spark, d)).withColumn("ill", raster.abnormal("leaf"))
    total = lambda c: F.sum(F.col(c).cast("long"))
    return m.groupBy("image_id").agg(total("lab_l").alias("l"), total("lab_a").alias("a"), total("lab_b").alias("b"), total("skin").alias("skin"), total("ill").alias("ill"))


@query(f"WITH {_HSV}, a AS (SELECT *, min((leaf AND heat > 0.2)::INT) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n1 FROM m), b AS (SELECT *, min(n1) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM a), c AS (SELECT *, max(n) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS w1 FROM b), e AS (SELECT *, max(w1) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS w FROM c) SELECT image_id, sum(n)::BIGINT AS narrowed, sum(w)::BIGINT AS opened FROM e GROUP BY image_id")
def opened_masks(spark, d):
    """An opening by 3 x 3: narrowed, then widened, by tiles."""
    px = _sized(_pixels(spark, d)).withColumn("m", F.col("leaf") & (F.col("heat") > 0.2))
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return raster.opened(px, "m", 1).groupBy("image_id").agg(total("narrowed"), total("opened"))


@query(f"WITH {_HSV} SELECT image_id, round(avg(green::INT) FILTER (WHERE leaf), 6) AS green, round(avg((green OR lesion)::INT) FILTER (WHERE leaf), 6) AS leafcolor, round(avg(skin::INT) FILTER (WHERE leaf), 6) AS skin, round(avg(lab_a) FILTER (WHERE NOT leaf), 6) AS ring_a, median(lab_a) FILTER (WHERE NOT leaf) AS around_a, median(lab_b) FILTER (WHERE NOT leaf) AS around_b FROM m GROUP BY image_id")
def masked_statistics(spark, d):
    """Means under the leaf's mask, and means and medians beside it."""
    m, leaf = raster.with_masks(_pixels(spark, d)), F.col("leaf")
    mean = lambda c, where: F.round(F.avg(F.when(where, c.cast("double"))), 6)
    middle = lambda c: F.median(F.when(~leaf, F.col(c)))
    return m.groupBy("image_id").agg(
        mean(F.col("green"), leaf).alias("green"), mean(F.col("green") | F.col("lesion"), leaf).alias("leafcolor"), mean(F.col("skin"), leaf).alias("skin"),
        mean(F.col("lab_a"), ~leaf).alias("ring_a"), middle("lab_a").alias("around_a"), middle("lab_b").alias("around_b"),
    )


_RAMP = "round_even(greatest(0::DOUBLE, least(1::DOUBLE, 1.5::DOUBLE - abs(floor(heat * 255) / 255 * 4 - 4 * {0}::DOUBLE))) * 255, 0)"
_BLEND = "floor((1 - al) * {0} + al * {1})"


@query(f"WITH {_PX}, a AS (SELECT *, 0.45::DOUBLE AS al, {_RAMP.format(0.75)} AS jr, {_RAMP.format(0.25)} AS jb FROM px), f AS (SELECT *, 0.7::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, (heat - 0.15::DOUBLE) / 0.85::DOUBLE)) AS fa FROM a) SELECT image_id, sum({_BLEND.format('r', 'jr')})::BIGINT AS red, sum({_BLEND.format('b', 'jb')})::BIGINT AS blue, sum({_BLEND.format('r', 'jr').replace('al', 'fa')})::BIGINT AS focus_red FROM f GROUP BY image_id")
def heat_overlay(spark, d):
    """Channel sums of the heat map laid over the photo: with one strength, and with strength by heat."""
    px = _pixels(spark, d)
    both = raster.overlaid(raster.overlaid(px, "heat", raster.focus_alpha("heat"), "focus_"), "heat", F.lit(0.45))
    total = lambda c: F.sum(F.col(c).cast("long"))
    return both.groupBy("image_id").agg(total("r").alias("red"), total("b").alias("blue"), total("focus_r").alias("focus_red"))


@query(f"WITH RECURSIVE {_PX}, {_COMPONENTS}, s AS (SELECT image_id, label, sum(heat) AS total FROM l JOIN px USING (image_id, y, x) GROUP BY ALL), i AS (SELECT p_partkey AS image_id, k AS label FROM part, (VALUES (1), (2), (3), (20)) t(k)) SELECT image_id, label, round(coalesce(total, 0), 6) AS total FROM i LEFT JOIN s USING (image_id, label)")
def label_sums(spark, d):
    """Sums for asked labels; those without pixels are 0.0."""
    px = _pixels(spark, d)
    labelled = raster.components(px, "leaf", eight=True, keep=("heat",), frame=SIDE)
    index = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("image_id"), F.explode(F.array(*map(F.lit, (1, 2, 3, 20)))).alias("label"))
    return raster.label_sums(labelled, index, "heat").withColumn("total", F.round("total", 6))


@query(f"WITH RECURSIVE {_PX}, {_COMPONENTS}, g AS (SELECT image_id, label, count(*) AS area, avg(y) / {SIDE} - 0.5::DOUBLE AS dy, avg(x) / {SIDE} - 0.5::DOUBLE AS dx, sum((y IN (0, {SIDE - 1}) OR x IN (0, {SIDE - 1}))::INT) AS edge FROM l GROUP BY ALL), s AS (SELECT *, CASE WHEN area / {SIDE * SIDE} < 0.004 THEN 0 ELSE area / {SIDE * SIDE} * exp(-(dy * dy + dx * dx) / 0.18::DOUBLE) * (1 - least(1, edge / greatest(sqrt(area) * 4, 1)) * 0.5::DOUBLE) END AS score FROM g), b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 12) DESC, label) AS n FROM s) SELECT image_id, label, round(score, 9) AS score FROM b WHERE n = 1 AND score > 0")
def seed_choice(spark, d):
    """The component that a segmentation starts from."""
    return raster.seeds(raster.components(_pixels(spark, d), "leaf", eight=True, frame=SIDE), SIDE, SIDE).withColumn("score", F.round("score", 9))


@query(f"WITH RECURSIVE {_PX}, {_COMPONENTS}, k AS (SELECT DISTINCT image_id, label FROM l JOIN px USING (image_id, y, x) WHERE heat > 0.97), c AS (SELECT image_id, count(*) AS pixels, count(DISTINCT label) AS components FROM l SEMI JOIN k USING (image_id, label) GROUP BY 1), h AS (SELECT image_id, avg((leaf AND heat > 0.5)::INT) AS border, sum((NOT leaf)::INT) AS around, abs(avg(r) - avg(g)) AS distance FROM px GROUP BY 1) SELECT image_id, pixels, components, border >= 0.62 OR (border >= 0.40 AND (around < 20 OR distance >= 9)) AS keeps FROM c JOIN h USING (image_id)")
def kept_components(spark, d):
    """Components that overlap the hot core, and the rule that keeps a candidate beside the leaf."""
    px = _pixels(spark, d)
    labelled = raster.components(px.withColumn("hot", F.col("heat") > 0.97), "leaf", eight=True, keep=("hot",), frame=SIDE, spread=True)
    kept = labelled.filter("hot").groupBy("image_id").agg(F.count("*").alias("pixels"), F.countDistinct("label").alias("components"))
    rule = px.groupBy("image_id").agg(F.avg((F.col("leaf") & (F.col("heat") > 0.5)).cast("int")).alias("border"), F.sum((~F.col("leaf")).cast("int")).alias("around"), F.abs(F.avg("r") - F.avg("g")).alias("distance"))
    return kept.join(rule.hint("shuffle_hash"), "image_id").select("image_id", "pixels", "components", raster.keeps_marginal(F.col("border"), F.col("around"), F.col("distance")).alias("keeps"))
