"""Components across tiles and the closure of a graph, against plain floods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import closure, raster


def flood(mask, eight):
    """Least row-major index from 1 of each pixel's component."""
    label, (h, w) = np.zeros(mask.shape, int), mask.shape
    for y0, x0 in zip(*np.nonzero(mask), strict=True):
        if label[y0, x0]:
            continue
        todo = [(y0, x0)]
        label[y0, x0] = y0 * w + x0 + 1
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    a, b = y + dy, x + dx
                    if (eight or dy * dx == 0) and 0 <= a < h and 0 <= b < w and mask[a, b] and not label[a, b]:
                        label[a, b] = y0 * w + x0 + 1
                        todo.append((a, b))
    return label


def frame(spark, masks):
    rows = [(i, y, x, bool(v), f"{i}-{y}-{x}") for i, m in enumerate(masks) for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "image_id int, y int, x int, on boolean, name string")


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(11)
    snake = np.zeros((17, 23), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True  # one component through all tiles
    return [rng.random((19, 26)) < 0.55, rng.random((8, 31)) < 0.4, snake, np.zeros((5, 5), bool), np.ones((12, 12), bool), np.eye(14, dtype=bool)]


@pytest.mark.parametrize("eight", [False, True])
def test_tiles_equal_the_whole(spark, masks, eight):
    for tile in (4, 7, 64):
        got = raster.components(frame(spark, masks), "on", eight, ("name",), tile=tile).collect()
        assert all(r.name == f"{r.image_id}-{r.y}-{r.x}" for r in got)
        found = {(r.image_id, r.y, r.x): r.label for r in got}
        assert found == {(i, y, x): int(v) for i, m in enumerate(masks) for (y, x), v in np.ndenumerate(flood(m, eight)) if v}
    known = raster.components(frame(spark, masks), "on", eight, frame=31).collect()
    assert {(r.image_id, r.y, r.x): r.label for r in known} == found


def test_images_beyond_what_is_held(spark, masks, monkeypatch):
    """Small images are joined in batches, without a join; those with more pixels than may be held by shuffles. Rows of an image come in many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    calls = []
    by_shuffles = raster._joined_by_shuffles
    monkeypatch.setattr(raster, "_joined_by_shuffles", lambda local, *more: calls.append({r.image_id for r in local.select("image_id").distinct().collect()}) or by_shuffles(local, *more))
    want = {(i, y, x): int(v) for i, m in enumerate(masks) for (y, x), v in np.ndenumerate(flood(m, True)) if v}
    try:
        for held in (1 << 20, 150, 1):
            assert {(r.image_id, r.y, r.x): r.label for r in raster.components(frame(spark, masks), "on", True, tile=4, held=held).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(calls) == 2 and all(got and got <= {i for i, m in enumerate(masks) if m.sum() > held} for got, held in zip(calls, (150, 1), strict=True))


def test_stack_of_planes(masks):
    stack = np.zeros((3, 19, 31), bool)
    for i, m in enumerate(masks[:3]):
        stack[i, : m.shape[0], : m.shape[1]] = m
    for i, got in enumerate(raster.label_stack(stack, True)):
        np.testing.assert_array_equal(np.where(got < 0, 0, got - i * got.size + 1), flood(stack[i], True))


def test_holes_across_tiles(spark, masks):
    ring = np.zeros((20, 20), bool)
    ring[2:18, 2:18] = True
    ring[4:16, 4:16] = False
    ring[8, 8] = True
    for kind in ({"tile": 6}, {"frame": 20}):
        got = {(r.y, r.x) for r in raster.fill_holes(frame(spark, [ring]), "on", **kind).collect()}
        assert got == {(y, x) for y in range(2, 18) for x in range(2, 18)}


def test_a_pixel_beyond_the_frame_is_an_error(spark, masks):
    with pytest.raises(Exception, match="beyond the frame"):
        raster.components(frame(spark, masks), "on", frame=20).count()


def test_no_pixels(spark, masks):
    assert raster.components(frame(spark, masks).limit(0), "on", tile=4).count() == 0


def test_closure(spark):
    rng = np.random.default_rng(2)
    chain = [("c", i, i + 1) for i in rng.permutation(150).tolist()]
    star = [("s", 7, i) for i in range(40)]
    loose = [("r", int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))]
    pairs = chain + star + loose + chain[:10]
    of = {}
    for k, a, b in pairs:
        find = lambda x: x if of.setdefault(x, x) == x else find(of[x])  # noqa: E731, B023
        a, b = find((k, a)), find((k, b))
        of[max(a, b)] = min(a, b)
    want = {(k, a): find((k, a))[1] for k, a in of if find((k, a))[1] != a}
    got = closure.least_members(spark.createDataFrame(pairs, "k string, a long, b long"), ["k"], "a", "b").collect()
    assert {(r.k, r.a): r.b for r in got} == want and len(got) == len(want)
    assert closure.least_members(spark.createDataFrame([("k", 1, 1)], "k string, a long, b long").withColumn("z", F.lit(0)), ["k"], "a", "b").count() == 0
