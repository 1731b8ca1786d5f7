"""Outlines by words of bits and hulls of many regions at once, against one region at a time."""

import math

import numpy as np
import pytest

from tests.conftest import DATA
from verdure.operators import shape
from verdure.plans import catalogue, photos  # noqa: F401


def test_words_of_bits_count_every_square(spark):
    """Wide regions of any labels, 4-connected or none, across words."""
    rng = np.random.default_rng(3)
    marks = [(i, y, x, int(v)) for i, (h, w, n) in enumerate([(9, 200, 3), (1, 64, 2), (70, 3, 4), (5, 127, 1)]) for (y, x), v in np.ndenumerate(rng.integers(0, n + 1, (h, w))) if v]
    marks += [(9, 4, x, 1) for x in (61, 62, 63)] + [(9, 5, 62, 1)]
    marks += [(10, 0, 62, 1), (10, 1, 63, 1), (10, 2, 125, 1), (10, 3, 0, 1)]
    got = {(r.image_id, r.label): r for r in shape.outlines(spark.createDataFrame(marks, "image_id int, y int, x int, label int")).collect()}
    every = {}
    for i, y, x, v in marks:
        every.setdefault((i, v), set()).add((y, x))
    assert set(got) == set(every)
    for k, places in every.items():
        area = perimeter = 0.0
        for y, x in {(y + dy, x + dx) for y, x in places for dy in (0, 1) for dx in (0, 1)}:
            on = [(y + dy, x + dx) in places for dy in (-1, 0) for dx in (-1, 0)]
            n, across = sum(on), on in ([True, False, False, True], [False, True, True, False])
            area += {4: 1.0, 3: 0.5}.get(n, 0.0)
            perimeter += math.sqrt(2) if n == 3 else 2 * math.sqrt(2) if across else 1.0 if n == 2 else 0.0
        assert got[k].area == area and got[k].perimeter == pytest.approx(perimeter)
    df = spark.createDataFrame(marks, "image_id int, y int, x int, label int")
    apart = {(r.image_id, r.label): tuple(r)[2:] for r in shape.hulls(df).collect()}
    for least in (1, 5):
        whole = {(r.image_id, r.label): r for r in shape.shapes(df, least).collect()}
        assert set(whole) == {k for k, v in every.items() if len(v) >= least}
        for k, r in whole.items():
            assert (r.area, r.perimeter) == (got[k].area, got[k].perimeter) and (r.hull_area, r.hull_perimeter, r.long_side, r.short_side) == pytest.approx(apart[k])


def test_hulls_of_many_equal_one_by_one():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, s, (n, 2)), axis=0) for s, n in [(2, 1), (9, 2), (3, 9), (12, 40), (40, 300), (1, 5)] for _ in range(8)]
    sets += [np.stack([np.arange(6), np.zeros(6, int)], 1), np.stack([np.zeros(4, int), np.arange(4)], 1)]
    n = np.array([len(p) for p in sets])
    points = np.zeros((len(sets), n.max(), 2), int)
    for i, p in enumerate(sets):
        points[i, : len(p)] = p
    corners, size = shape.hull_stack(points, n)
    numbers = shape.measured(corners, size)
    for p, c, m, (area, length, long_, short) in zip(sets, corners, size, numbers, strict=True):
        want = shape.hull(p)
        assert c[:m].tolist() == want.tolist()
        edges = np.roll(want, -1, 0) - want
        assert length == pytest.approx(np.hypot(*edges.T).sum() if m > 1 else 0.0) and area <= long_ * short + 1e-9
        if m > 2:
            frames = []
            for e in edges / np.hypot(*edges.T)[:, None]:
                frames.append(np.ptp(want @ e) * np.ptp(want @ np.array([-e[1], e[0]])))
            assert long_ * short == pytest.approx(min(frames)) and long_ >= short


def test_regions_are_read_once(spark):
    text = catalogue.queries()["region_shapes"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("MapInArrow label") == 1


def test_rows_within_hulls(spark):
    """Every place of the frame by the sides of its hull; a dot and a line hold only themselves."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, s, (n, 2)), axis=0) for s, n in [(2, 2), (9, 3), (14, 12)] for _ in range(6)] + [np.array([[3, 4]]), np.array([[0, 0], [6, 3]]), np.array([[1, 5], [8, 5]])]
    rows = [(i, 1, int(y), int(x)) for i, p in enumerate(sets) for x, y in p] + [(2, 99, 20, 20)]
    found = {r.image_id: r for r in shape.spans(spark.createDataFrame(rows, "image_id int, label int, y int, x int")).collect()}
    for i, p in enumerate(sets):
        c = shape.hull(p)
        q = np.roll(c, -1, 0)
        boxed = lambda x, y: p[:, 0].min() <= x <= p[:, 0].max() and p[:, 1].min() <= y <= p[:, 1].max()  # noqa: E731, B023
        want = {(x, y) for x in range(15) for y in range(15) if boxed(x, y) and ((q[:, 0] - c[:, 0]) * (y - c[:, 1]) - (q[:, 1] - c[:, 1]) * (x - c[:, 0]) >= 0).all()}
        assert found[i].label == 1 or len(p) == 1
        if found[i].label == 1:
            assert {(x, found[i].top + k) for k, s in enumerate(found[i].spans) for x in range(s.a, s.b + 1)} == want
    assert [(s.a, s.b) for s in found[18].spans] == [(3, 3)]
