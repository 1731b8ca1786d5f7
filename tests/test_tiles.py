"""Filters over tiles against the whole plane; edges, small images, holes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import gate, tiles
from verdure.sources import synthetic


def conv(plane, kernel, axis):
    r = len(kernel) // 2
    padded = np.pad(plane, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="reflect") if plane.shape[axis] > r else None
    if padded is None:
        at = lambda k: np.take(plane, tiles.mirrored(np.arange(plane.shape[axis]) + k, plane.shape[axis]), axis)
        return sum(w * at(k - r) for k, w in enumerate(kernel))
    n = plane.shape[axis]
    return sum(w * np.take(padded, np.arange(n) + k, axis) for k, w in enumerate(kernel))


def frame(spark, planes):
    rows = [(i, y, x, float(v)) for i, p in planes.items() for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, "image_id string, y int, x int, v double")


def back(df, column, planes):
    out = {i: np.full(p.shape, np.nan) for i, p in planes.items()}
    for r in df.select("image_id", "y", "x", column).collect():
        out[r[0]][r.y, r.x] = np.nan if r[3] is None else r[3]
    return out


@pytest.fixture(scope="module")
def planes():
    rng = np.random.default_rng(5)
    return {"a": rng.integers(0, 256, (23, 31)), "dot": np.array([[7]]), "row": rng.integers(0, 9, (1, 12)), "b": rng.integers(0, 256, (40, 17))}


def test_gaussian_sizes():
    assert [len(tiles.gaussian(s)) for s in (0.8, 1.2, 2.0, 3.0, 4.0)] == [7, 11, 17, 25, 33]
    assert tiles.gaussian(3.0).sum() == pytest.approx(1)


@pytest.mark.parametrize("tile", [8, 16, 64])
def test_blur_equals_the_whole_plane(spark, planes, tile):
    got = back(tiles.blurred(frame(spark, planes), "v", 0.8, tile=tile), "blurred", planes)
    k = tiles.gaussian(0.8)
    for i, p in planes.items():
        np.testing.assert_allclose(got[i], conv(conv(p.astype(float), k, 0), k, 1), atol=1e-9)


def test_filters_in_a_row_mirror_anew(spark, planes):
    def function(p):
        gx, gy = p.weighted(tiles.SMOOTH, tiles.SLOPE), p.weighted(tiles.SLOPE, tiles.SMOOTH)
        return {"j": tiles.combined(lambda a, b: a * b, gx, gy).blurred(0.8), "m": p.framed(2), "n": p.framed(2, most=False)}

    out = tiles.filtered(frame(spark, planes), ["v"], function, {"j": "double", "m": "double", "n": "double"}, 4, tile=8).cache()
    k = tiles.gaussian(0.8)
    for i, p in planes.items():
        p = p.astype(float)
        gx, gy = conv(conv(p, tiles.SMOOTH, 0), tiles.SLOPE, 1), conv(conv(p, tiles.SLOPE, 0), tiles.SMOOTH, 1)
        np.testing.assert_allclose(back(out, "j", planes)[i], conv(conv(gx * gy, k, 0), k, 1), atol=1e-6)
        for name, f in (("m", np.max), ("n", np.min)):
            want = [[f(p[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]) for x in range(p.shape[1])] for y in range(p.shape[0])]
            np.testing.assert_array_equal(back(out, name, planes)[i], want)


def test_missing_pixels_give_null_around_them(spark):
    p = {"a": np.arange(25.0).reshape(5, 5)}
    df = frame(spark, p).filter("NOT (y = 2 AND x = 2)")
    got = back(tiles.laplacian(df, "v", tile=4), "laplacian", p)["a"]
    assert np.isnan(got[[1, 2, 3, 2], [2, 1, 2, 3]]).all() and np.isfinite(got[[0, 4], [0, 4]]).all()


def test_kept_columns_and_no_pixels(spark, planes):
    df = frame(spark, planes).withColumn("name", F.concat_ws("/", "image_id", "y", "x"))
    out = tiles.laplacian(df, "v", ("name", "v"), tile=8)
    assert out.filter(F.col("name") != F.concat_ws("/", "image_id", "y", "x")).count() == 0 and out.count() == df.count()
    assert tiles.laplacian(df.limit(0), "v").count() == 0
    with pytest.raises(ValueError):
        tiles.blurred(df, "v", 4.0, tile=8)


def test_quality_of_made_photos(spark):
    spec = [(1, 64, 80, 25, 100, True), (2, 64, 80, 1, 100, False), (3, 64, 80, 1, 40, True), (4, 64, 80, 400, 5, True), (5, 64, 80, 100, 300, False), (6, 40, 80, 25, 100, True)]
    px = synthetic.photos(spark.createDataFrame(spec, "image_id long, height int, width int, noise int, light int, has_leaf boolean"))
    got = {r.image_id: r.reason for r in tiles.quality_metrics(px, tile=32).select("image_id", gate.quality_reason().alias("reason")).collect()}
    assert got == {1: None, 2: "blank_or_solid_colour", 3: "too_blurry", 4: "too_dark", 5: "overexposed", 6: "resolution_too_low"}
