"""Pixels lie by image in as many parts as they ask for, and no pixel goes through the driver."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from verdure.operators import raster, segment
from verdure.plans import catalogue
from verdure.sources import synthetic


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_pixels(spark, monkeypatch):
    monkeypatch.setattr(synthetic, "PART", 1000)
    specs = spark.range(100).withColumn("n", F.lit(256))
    assert synthetic.dealt(specs, "id", F.col("n")).rdd.getNumPartitions() == 26
    assert catalogue._pixels(spark, DATA).rdd.getNumPartitions() >= 51


@pytest.mark.parametrize("name", ["focus_metrics", "fill_holes", "photo_threshold", "photo_clusters", "tiled_labels"])
def test_nothing_is_sent_through_the_driver(spark, name):
    assert "BroadcastExchange" not in plan(catalogue.queries()[name](spark, DATA))


@pytest.mark.parametrize("name", ["kept_components", "label_sums"])
def test_no_pixels_or_sums_are_broadcast(spark, name):
    """The rows of a rule's files are few, but what is made of them isn't."""
    assert "BroadcastExchange" not in plan(catalogue.queries()[name](spark, DATA))


def test_touching_is_what_flags_tell(spark):
    px = spark.range(3 * 64).select(F.floor(F.col("id") / 64).alias("image_id"), F.floor(F.col("id") % 64 / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), (F.col("id") * 37 % 11 < 5).alias("m"), (F.col("id") * 29 % 17 < 3).alias("f"))
    place = lambda rows: sorted((r.image_id, r.y, r.x, r.label) for r in rows)
    want = place(raster.components(px, "m", frame=8, keep=("f",), spread=True).filter("f").collect())
    found = raster.touching(raster.components(px, "m", frame=8), px.filter("f"))
    assert "BroadcastExchange" not in plan(found)
    assert place(found.collect()) == want and 0 < len(want) < px.filter("m").count()


@pytest.mark.parametrize("name", ["lab_masks", "photo_blur", "focus_metrics"])
def test_pixels_are_not_shuffled(spark, name):
    """The specs are, and the sums of tiles that come out of Arrow."""
    assert plan(catalogue.queries()[name](spark, DATA)).count("Exchange hashpartitioning") - plan(catalogue._pixels(spark, DATA)).count("Exchange hashpartitioning") <= 1


def test_flags_spread_over_components(spark):
    rows = [(0, y, x, v != ".", v == "o") for y, line in enumerate(["##.o", "#..#", "..#.", "o..."]) for x, v in enumerate(line)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, m boolean, f boolean")
    got = {(r.y, r.x) for r in raster.components(px, "m", keep=("f",), frame=4, spread=True).collect() if r.f}
    assert got == {(0, 3), (1, 3), (3, 0)}


def test_above_is_what_foreground_takes(spark):
    px = spark.range(400).select((F.col("id") % 4).alias("image_id"), F.when(F.col("id") % 4 == 3, 7).otherwise(F.col("id") * F.col("id") % 50).cast("int").alias("v"))
    want = {r.image_id: r.n for r in segment.foreground(px, "v").groupBy("image_id").agg(F.count_if("seed").alias("n")).collect()}
    got = {r.image_id: r.above for r in segment.thresholds(px, "v").collect()}
    assert got == want and got[3] == 0 and got[0] > 0
