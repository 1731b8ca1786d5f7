"""Masks widened, narrowed and opened in tiles, and the focus of heat, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from verdure.operators import raster
from verdure.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("reach", [1, 3])
def test_masks_with_gaps_and_nulls(spark, reach):
    rng = np.random.default_rng(reach)
    there = {(i, y, x): (None if v < 0.1 else bool(v < 0.6)) for i, shape in enumerate([(9, 13), (1, 5), (130, 3)]) for (y, x), v in np.ndenumerate(rng.random(shape)) if v > 0.03}
    px = spark.createDataFrame([(*k, v, f"{k}") for k, v in there.items()], "image_id int, y int, x int, m boolean, name string")
    near = lambda of, k: [v for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if (v := of.get((k[0], k[1] + dy, k[2] + dx))) is not None]
    best = lambda of, f: {k: f(near(of, k), default=None) for k in there}
    for any_, f in ((True, max), (False, min)):
        got = raster.framed(px, "m", reach, "out", any_).collect()
        assert {(r.image_id, r.y, r.x): r.out for r in got} == best(there, f) and all(r.name == str((r.image_id, r.y, r.x)) for r in got)
    got = {(r.image_id, r.y, r.x): (r.narrowed, r.opened) for r in raster.opened(px, "m", reach).collect()}
    narrow = best(there, min)
    assert {k: v[0] for k, v in got.items()} == narrow
    wide = best(narrow, max)
    assert all(v[1] == wide[k] for k, v in got.items())


def test_focus_with_and_without_a_frame(spark):
    rng = np.random.default_rng(4)
    rows = [(i, y, x, None if rng.random() < 0.02 else float(rng.integers(0, 40)) / 39, bool(rng.random() < 0.6), bool(rng.random() < 0.5)) for i in range(5) for y in range(12) for x in range(9 + i)]
    rows += [(9, 0, 0, None, True, False)]
    px = spark.createDataFrame(rows, "image_id int, y int, x int, heat double, leaf boolean, lesion boolean")
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    known = key(raster.focus(px, "heat", "leaf", "lesion", frame=16))
    assert known == key(raster.focus(px, "heat", "leaf", "lesion"))
    for i in range(5):
        mine = [r for r in rows if r[0] == i and r[3] is not None]
        cut, top = np.quantile([r[3] for r in mine], 0.9), max(r[3] for r in mine)
        got = next(r for r in known if r[0] == i)
        assert got[2] == min((r for r in mine if r[3] == top), key=lambda r: r[1:3])[4]
        assert got[3] == pytest.approx(np.mean([r[4] for r in mine if r[3] >= cut - 1e-12]))


@pytest.mark.parametrize("name", ["focus_metrics", "opened_masks"])
def test_pixels_are_neither_sorted_nor_made_twice(spark, name):
    text = plan(catalogue.queries()[name](spark, DATA))
    assert "Window" not in text and "Join" not in text and text.count("Generate explode(org") <= 1
