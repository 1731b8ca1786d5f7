"""The rule for patches at a leaf's margin against plain loops over whole images."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_components import flood
from verdure.operators import lesions, shape, tiles


def footprint(size):
    k = np.zeros((size, size), bool)
    for i, reach in enumerate(tiles.ellipse(size)):
        k[i, size // 2 - reach : size // 2 + reach + 1] = True
    return k


def round_(mask, size, most=True):
    r, k = size // 2, footprint(size)
    padded = np.pad(mask, r, constant_values=not most)
    out = np.full(mask.shape, not most)
    for dy, dx in zip(*np.nonzero(k), strict=True):
        part = padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
        out = out | part if most else out & part
    return out


def test_ellipses():
    assert tiles.ellipse(3) == [0, 1, 0] and tiles.ellipse(5) == [0, 2, 2, 2, 0] and footprint(31).sum() > 600


def test_rounds_over_tiles(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((21, 33)) < 0.5
    px = spark.createDataFrame([("a", y, x, int(v)) for (y, x), v in np.ndenumerate(mask)], "image_id string, y int, x int, v int")
    for size, most in ((3, False), (5, True), (9, False)):
        got = tiles.filtered(px, ["v"], lambda p, size=size, most=most: {"o": p.round(size, most)}, {"o": "boolean"}, size // 2, tile=8).collect()
        back = np.zeros(mask.shape, bool)
        for r in got:
            back[r.y, r.x] = r.o
        np.testing.assert_array_equal(back, round_(mask, size, most))


def test_marginal_patches(spark):
    h, w = 40, 56
    yy, xx = np.mgrid[:h, :w]
    leaf = ((yy - 20) / 15) ** 2 + ((xx - 26) / 20) ** 2 < 1
    leaf[14:20, 38:50] = leaf[24:30, 2:14] = leaf[26:36, 28:44] = False
    leaf[2:6, 20:30] = True
    lesion = np.zeros((h, w), bool)
    lesion[14:19, 38:43] = lesion[24:30, 10:14] = lesion[1:4, 12:16] = lesion[29:32, 32:36] = True
    rng = np.random.default_rng(0)
    a, b = rng.integers(-5, 6, (h, w)).astype(float), rng.integers(-5, 6, (h, w)).astype(float)
    a[14:19, 38:43] += 30
    rows = [("i", y, x, h, w, bool(leaf[y, x]), bool(lesion[y, x]), float(a[y, x]), float(b[y, x])) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "image_id string, y int, x int, height int, width int, on boolean, lesion boolean, lab_a double, lab_b double")
    label = flood(leaf, True)
    largest = label == np.bincount(label[leaf]).argmax()
    points = np.array(sorted((x, y) for y, x in zip(*np.nonzero(largest), strict=True)))
    c = shape.hull(points)
    inside = np.ones((h, w), bool)
    for p, q in zip(c, np.roll(c, -1, 0), strict=True):
        inside &= (q[0] - p[0]) * (yy - p[1]) - (q[1] - p[1]) * (xx - p[0]) >= 0
    candidate = round_(round_(lesion & ~leaf & inside, 3, False), 3)
    near, patches, want = round_(leaf, 5), flood(candidate, False), {}
    for j in set(patches[candidate].tolist()):
        comp = patches == j
        ring = round_(comp, 5) & ~comp
        border = (ring & leaf).sum() / ring.sum()
        around = round_(comp, 31) & ~near & ~candidate
        far = np.hypot(a[comp].mean() - np.median(a[around]), b[comp].mean() - np.median(b[around])) if around.any() else None
        keeps = border >= 0.62 or (border >= 0.40 and (around.sum() < 20 or far >= 9))
        want[j] = (int(comp.sum()), round(float(border), 9), int(around.sum()), None if far is None else round(float(far), 9), bool(keeps))
    for tile in (20, 64):
        got = {r.label: (r.pixels, round(r.border, 9), r.around, None if r.distance is None else round(r.distance, 9), r.keeps) for r in lesions.marginal(px, "on", "lesion", tile=tile).collect()}
        assert got == want
    assert len(want) >= 2 and {v[4] for v in want.values()} == {True, False}
    assert lesions.marginal(px.withColumn("lesion", F.lit(False)), "on", "lesion").count() == 0
