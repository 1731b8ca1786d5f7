"""A pixel's new places are found by whole numbers, without arrays of its own."""

import math
from fractions import Fraction

import pytest

from tests.conftest import DATA
from verdure.operators import resize
from verdure.plans import catalogue, photos  # noqa: F401


@pytest.mark.parametrize(("h", "w", "most"), [(17, 5, 7), (6, 31, 30), (4, 4, 4), (9, 1, 2)])
def test_means_are_exact(spark, h, w, most):
    value = lambda y, x: (y * 37 + x * 11) % 256
    px = spark.createDataFrame([(1, y, x, h, w, value(y, x)) for y in range(h) for x in range(w)], "image_id int, y int, x int, height int, width int, v int")
    got = {(r.y, r.x): r.v for r in resize.work_frame(px, ["v"], most).collect()}
    scale = min(Fraction(1), Fraction(most, max(h, w)))
    nh, nw = (max(1, round(n * scale)) for n in (h, w))
    shared = lambda a, old, j, new: max(Fraction(0), min(Fraction(a + 1, old), Fraction(j + 1, new)) - max(Fraction(a, old), Fraction(j, new)))
    for j in range(nh):
        for i in range(nw):
            want = sum(value(y, x) * shared(y, h, j, nh) * shared(x, w, i, nw) for y in range(h) for x in range(w)) * nh * nw
            assert math.isclose(got[j, i], float(want), rel_tol=1e-12)
    assert len(got) == nh * nw


def test_one_generate_without_lambdas(spark):
    text = catalogue.queries()["photo_work_frame"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in text and text.count("Generate explode") == 2
