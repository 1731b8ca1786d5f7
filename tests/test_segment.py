"""Thresholds, clusters, shapes and frames against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import raster, resize, segment, shape


def pixel_rows(spark, planes, name="v"):
    return spark.createDataFrame([(i, y, x, float(v)) for i, p in planes.items() for (y, x), v in np.ndenumerate(p)], f"image_id string, y int, x int, {name} double")


def test_threshold_has_most_variance_between(spark):
    rng = np.random.default_rng(0)
    planes = {"two": np.where(rng.random((30, 30)) < 0.4, rng.integers(20, 90, (30, 30)), rng.integers(150, 255, (30, 30))), "flat": np.full((4, 4), 9), "pair": np.array([[0, 255]]), "any": rng.integers(0, 256, (25, 25))}
    got = {r.image_id: (r.threshold, r.between) for r in segment.thresholds(pixel_rows(spark, planes), "v").collect()}
    for i, p in planes.items():
        best = None
        for t in range(256):
            low, high = p[p <= t], p[p > t]
            if len(low) and len(high):
                b = len(low) * len(high) / p.size**2 * (low.mean() - high.mean()) ** 2
                best = (t, b) if best is None or round(b, 9) > round(best[1], 9) else best
        assert got[i] == ((None, None) if best is None else (best[0], pytest.approx(best[1])))
    seed = segment.foreground(pixel_rows(spark, planes), "v").groupBy("image_id").agg(F.count_if("seed").alias("n")).collect()
    assert {r.image_id: r.n for r in seed} == {i: int((p > (got[i][0] if got[i][0] is not None else 999)).sum()) for i, p in planes.items()}


def test_away_from_border(spark):
    plane = np.full((9, 11), 30.0)
    plane[3:6, 3:8] = 130
    plane[4, 4] = 80
    px = pixel_rows(spark, {"a": plane, "flat": np.ones((3, 3))}).withColumns({"l": F.col("v"), "a": F.lit(1), "b": F.lit(2)})
    got = {(r.image_id, r.y, r.x): r.away for r in segment.away_from_border(px, ("l", "a", "b")).collect()}
    assert got["a", 0, 0] == 0 and got["a", 3, 3] == 255 and got["a", 4, 4] == 127 and got["flat", 1, 1] == 0 and len(got) == 99 + 9


def test_clusters_are_lloyds(spark):
    rng = np.random.default_rng(3)
    images = {"a": np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in (0, 5, 9)]), "b": rng.random((40, 2)), "one": np.ones((5, 2))}
    px = spark.createDataFrame([(i, float(a), float(b)) for i, p in images.items() for a, b in p], "image_id string, f double, g double")
    got = {(r.image_id, r.k): np.array(r.centres) for r in segment.clusters(px, ["f", "g"], (2, 3), 6).collect()}
    for (i, k), centres in got.items():
        x = images[i]
        low, high = x[:, 0].min(), x[:, 0].max()
        c = np.stack([[low + (high - low) * (j + 0.5) / k, x[:, 1].mean()] for j in range(k)])
        for _ in range(6):
            near = np.round(((x[:, None] - c[None]) ** 2).sum(2), 9).argmin(1)
            c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        np.testing.assert_allclose(centres, c)
    assert len(got) == 6
    near = segment.assigned(px, ["f", "g"], segment.clusters(px, ["f", "g"], (3,), 6), 3)
    assert sorted(r["count"] for r in near.filter("image_id = 'a'").groupBy("cluster").count().collect()) == [60, 60, 60]


def outline(mask):
    """Area and length of the outline through pixel centres, traced by its squares in plain loops."""
    p = np.pad(mask, 1).astype(int)
    area = length = 0.0
    for y in range(p.shape[0] - 1):
        for x in range(p.shape[1] - 1):
            s = p[y : y + 2, x : x + 2]
            n = s.sum()
            area += {4: 1, 3: 0.5}.get(n, 0)
            length += 2**0.5 if n == 3 else 0 if n != 2 else 1 if s[0].sum() != 1 or s[:, 0].sum() != 1 else 2 * 2**0.5
    return area, length


def test_known_shapes(spark):
    square, line, dot, cross = np.zeros((12, 12), bool), np.zeros((12, 12), bool), np.zeros((12, 12), bool), np.zeros((12, 12), bool)
    square[2:9, 3:8] = True
    line[5, 2:10] = True
    dot[4, 4] = True
    cross[5, 1:10] = cross[1:10, 5] = True
    masks = {"square": square, "line": line, "dot": dot, "cross": cross, "turned": np.add.outer(abs(np.arange(15) - 7), abs(np.arange(15) - 7)) <= 6}
    px = spark.createDataFrame([(i, y, x, bool(v)) for i, m in masks.items() for (y, x), v in np.ndenumerate(m)], "image_id string, y int, x int, on boolean")
    got = {r.image_id: r for r in shape.shapes(raster.components(px, "on", True)).collect()}
    assert (got["square"].area, got["square"].perimeter, got["square"].hull_area, got["square"].long_side, got["square"].short_side) == (24, 20, 24, 6, 4)
    assert (got["line"].area, got["line"].perimeter, got["line"].hull_perimeter, got["line"].long_side, got["line"].short_side) == (0, 14, 14, 7, 0)
    assert (got["dot"].area, got["dot"].perimeter, got["dot"].long_side) == (0, 0, 0)
    assert got["turned"].area == got["turned"].hull_area == 72 and got["turned"].elongation == pytest.approx(1) and got["turned"].long_side == pytest.approx(72**0.5)
    assert got["cross"].hull_area == 32 and got["cross"].solidity < 0.15 and got["cross"].convexity_ratio > 1


def test_shapes_of_random_regions(spark):
    rng = np.random.default_rng(8)
    masks = {str(k): rng.random((14, 14)) < 0.62 for k in range(4)}
    px = spark.createDataFrame([(i, y, x, bool(v)) for i, m in masks.items() for (y, x), v in np.ndenumerate(m)], "image_id string, y int, x int, on boolean")
    labelled = raster.components(px, "on", True)
    pixels = {}
    for r in labelled.collect():
        pixels.setdefault((r.image_id, r.label), []).append((r.x, r.y))
    for r in shape.shapes(labelled).collect():
        points = pixels[r.image_id, r.label]
        mask = np.zeros((14, 14), bool)
        for x, y in points:
            mask[y, x] = True
        assert (r.area, r.perimeter) == (pytest.approx(outline(mask)[0]), pytest.approx(outline(mask)[1]))
        best = min((np.prod(np.ptp(np.array(points) @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]), axis=0)) for t in np.linspace(0, np.pi / 2, 2000)), default=0)
        assert r.long_side * r.short_side <= best + 1e-6 and r.long_side * r.short_side >= r.hull_area - 1e-6
        assert r.hull_area >= r.area - 1e-9 and r.hull_perimeter <= r.perimeter + 1e-6


@pytest.mark.parametrize("most", [5, 8, 100])
def test_areas_keep_sums(spark, most):
    rng = np.random.default_rng(1)
    planes = {"a": rng.integers(0, 256, (13, 20)), "tall": rng.integers(0, 256, (17, 3)), "dot": np.array([[5]])}
    rows = resize.work_frame(pixel_rows(spark, planes), ["v"], most).collect()
    for i, p in planes.items():
        s = min(1.0, most / max(p.shape))
        h, w = (max(1, round(n * s)) for n in p.shape)
        weights = lambda old, new: np.array([[max(0.0, min((a + 1) * new, (j + 1) * old) - max(a * new, j * old)) / old for a in range(old)] for j in range(new)])
        want = weights(p.shape[0], h) @ p @ weights(p.shape[1], w).T
        got = np.full((h, w), np.nan)
        for r in rows:
            if r.image_id == i:
                assert (r.height, r.width) == (h, w)
                got[r.y, r.x] = r.v
        np.testing.assert_allclose(got, want)
        assert got.sum() * p.size / got.size == pytest.approx(p.sum())


def test_letterbox(spark):
    px = pixel_rows(spark, {"a": np.full((2, 4), 7), "b": np.full((9, 3), 8)})
    got = {i: np.zeros((4, 4)) for i in "ab"}
    for r in resize.letterboxed(px, ["v"], 4, 1.0).collect():
        got[r.image_id][r.y, r.x] = r.v
    np.testing.assert_array_equal(got["a"], [[1] * 4, [7] * 4, [7] * 4, [1] * 4])
    assert (got["b"] == 8).sum() == 4
