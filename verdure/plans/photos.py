"""Queries on photos that are measured pixel by pixel: quality, blurs, texture and structure.  The photos are made by a rule from the suppliers: soil, noise and a leaf, some of them flat, dim, dark, glaring or small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gate, lesions, raster, resize, segment, shape, tiles
from ..sources import synthetic
from .catalogue import _CC, _EIGHT, _HSV, _PX, SIDE, _pixels, _t, query

_SPEC = {"height": "64", "width": "56 + 8 * (s_suppkey % 4)", "noise": "CASE s_suppkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 400 WHEN 3 THEN 100 ELSE 25 END", "light": "CASE s_suppkey % 7 WHEN 1 THEN 40 WHEN 2 THEN 5 WHEN 3 THEN 300 ELSE 100 END", "has_leaf": "s_suppkey % 7 NOT IN (0, 3)"}
_NOISE = "((((image_id * 31 + i * 17 + {c} * 7) * 2654435761 % 4294967296) >> 16) % noise)"
_VALUE = "least(255, floor((CASE WHEN leaf THEN {leaf} ELSE {soil} + " + _NOISE + " END) * light / 100))::INT AS {k}"
_PHOTO = (
    "spec AS (SELECT s_suppkey AS image_id, " + ", ".join(f"{v} AS {k}" for k, v in _SPEC.items()) + " FROM supplier), "
    "cell AS (SELECT *, i // width AS y, i % width AS x FROM (SELECT *, unnest(range(height::BIGINT * width)) AS i FROM spec)), "
    f"lf AS (SELECT *, has_leaf AND pow((x - width / 2.0::DOUBLE) / (width * {synthetic.HALF_WIDTH!r}::DOUBLE), 2) + pow((y - height / 2.0::DOUBLE) / (height * {synthetic.HALF_HEIGHT!r}::DOUBLE), 2) < 1 AS leaf FROM cell), "
    "px AS MATERIALIZED (SELECT image_id, y, x, height, width, leaf, " + ", ".join(_VALUE.format(k=k, c=c, leaf=synthetic.LEAF[k], soil=synthetic.SOIL[k]) for c, k in enumerate("bgr")) + " FROM lf)"
)
_PHOTO_HSV = _HSV.replace(_PX, _PHOTO)


def _photos(spark, d) -> DataFrame:
    return synthetic.photos(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), *(F.expr(v).alias(k) for k, v in _SPEC.items())))


def _mirror(at: str, size: str) -> str:
    return f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} >= {size} THEN 2 * {size} - 2 - ({at}) ELSE {at} END"


def _taps(name: str, kernel) -> str:
    """A table of a kernel: (k, w)."""
    reach = len(kernel) // 2
    return f"{name}(k, w) AS (VALUES " + ", ".join(f"({i - reach}, {float(w)!r}::DOUBLE)" for i, w in enumerate(kernel)) + ")"


def _weighted(out: str, of: str, value: str, down: str, across: str) -> str:
    """Two self-joins with weights, down and then across: (image_id, y, x, height, width, v)."""
    one = "{out}_q AS MATERIALIZED (SELECT a.image_id, a.y, a.x, a.height, a.width, k.w, {y} AS to_y, {x} AS to_x FROM {of} a, {taps} k), {out} AS MATERIALIZED (SELECT q.image_id, q.y, q.x, q.height, q.width, sum(b.{value} * q.w) AS v FROM {out}_q q JOIN {of} b ON b.image_id = q.image_id AND b.y = q.to_y AND b.x = q.to_x GROUP BY ALL)"
    first = one.format(out=f"{out}_1", of=of, value=value, taps=down, y=_mirror("a.y + k.k", "a.height"), x="a.x")
    return first + ", " + one.format(out=out, of=f"{out}_1", value="v", taps=across, y="a.y", x=_mirror("a.x + k.k", "a.width"))


def _laplacian(out: str, of: str, value: str) -> str:
    taps = "(VALUES (0, 0, -4), (-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1)) k(dy, dx, w)"
    return f"{out}_q AS MATERIALIZED (SELECT a.image_id, a.y, a.x, k.w, {_mirror('a.y + k.dy', 'a.height')} AS to_y, {_mirror('a.x + k.dx', 'a.width')} AS to_x FROM {of} a, {taps}), {out} AS MATERIALIZED (SELECT q.image_id, q.y, q.x, sum(b.{value} * q.w)::DOUBLE AS v FROM {out}_q q JOIN {of} b ON b.image_id = q.image_id AND b.y = q.to_y AND b.x = q.to_x GROUP BY ALL)"


@query(f"""WITH {_PHOTO}, g AS MATERIALIZED (SELECT *, (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 AS grey FROM px),
{_laplacian('lap', 'g', 'grey')},
m AS (SELECT image_id, any_value(height) AS height, any_value(width) AS width, stddev_pop(grey) AS std, var_pop(v) AS sharpness, avg(grey) AS mean, avg((grey < 10)::INT) AS dark, avg((grey > 246)::INT) AS bright FROM g JOIN lap USING (image_id, y, x) GROUP BY image_id)
SELECT image_id, CASE WHEN least(height, width) < 64 THEN 'resolution_too_low' WHEN std < 3 THEN 'blank_or_solid_colour' WHEN sharpness < 12 THEN 'too_blurry' WHEN mean < 18 OR dark > 0.8 THEN 'too_dark' WHEN mean > 245 OR bright > 0.8 THEN 'overexposed' END AS reason,
round(std, 6) AS std, round(sharpness, 6) AS sharpness, round(mean, 6) AS mean, round(dark, 6) AS dark, round(bright, 6) AS bright FROM m""")
def photo_quality(spark, d):
    """What is wrong with each photo, measured from its pixels: the Laplacian over tiles with a halo, then one sum a photo."""
    out = tiles.quality_metrics(_photos(spark, d), tile=32)
    return out.select("image_id", gate.quality_reason().alias("reason"), *(F.round(k, 6).alias(k) for k in ("std", "sharpness", "mean", "dark", "bright")))


@query(f"WITH {_PHOTO}, {_taps('t2', tiles.gaussian(2.0))}, {_weighted('bl', 'px', 'g', 't2', 't2')} SELECT image_id, round(sum(v), 4) AS total, round(min(v), 6) AS least, round(max(v), 6) AS most, round(sum(v * (bl.y * 3 + bl.x * 5)), 2) AS moment FROM bl GROUP BY image_id")
def photo_blur(spark, d):
    """The green plane under Gaussian weights of sigma 2."""
    out = tiles.blurred(_photos(spark, d), "g", 2.0, tile=32)
    v = F.col("blurred")
    return out.groupBy("image_id").agg(F.round(F.sum(v), 4).alias("total"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"), F.round(F.sum(v * (F.col("y") * 3 + F.col("x") * 5)), 2).alias("moment"))


_SQUARE = "{out} AS MATERIALIZED (SELECT image_id, y, x, {f}(v) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN {n} PRECEDING AND {n} FOLLOWING) AS v FROM (SELECT image_id, y, x, {f}(leaf::INT) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN {n} PRECEDING AND {n} FOLLOWING) AS v FROM m))"
_PRODUCT = "{out} AS MATERIALIZED (SELECT gx.image_id, gx.y, gx.x, gx.height, gx.width, {f} AS v FROM gx JOIN gy USING (image_id, y, x))"


@query(f"""WITH {_PHOTO_HSV}, {_taps('fine', tiles.gaussian(tiles.FINE))}, {_taps('coarse', tiles.gaussian(tiles.COARSE))}, {_taps('tex', tiles.gaussian(tiles.TEXTURE))}, {_taps('tensor', tiles.gaussian(tiles.TENSOR))}, {_taps('slope', tiles.SLOPE)}, {_taps('smooth', tiles.SMOOTH)},
mm AS MATERIALIZED (SELECT * FROM m), {_weighted('g1', 'mm', 'lab_l', 'fine', 'fine')}, {_weighted('g2', 'mm', 'lab_l', 'coarse', 'coarse')}, {_weighted('g3', 'mm', 'lab_l', 'tex', 'tex')},
{_laplacian('te', 'g3', 'v')},
{_weighted('gx', 'g1', 'v', 'smooth', 'slope')}, {_weighted('gy', 'g1', 'v', 'slope', 'smooth')}, {_PRODUCT.format(out='pxx', f='gx.v * gx.v')}, {_PRODUCT.format(out='pyy', f='gy.v * gy.v')}, {_PRODUCT.format(out='pxy', f='gx.v * gy.v')},
{_weighted('jxx', 'pxx', 'v', 'tensor', 'tensor')}, {_weighted('jyy', 'pyy', 'v', 'tensor', 'tensor')}, {_weighted('jxy', 'pxy', 'v', 'tensor', 'tensor')},
{_SQUARE.format(out='nr', f='min', n=tiles.INNER)}, {_SQUARE.format(out='co', f='min', n=tiles.RING)}, {_SQUARE.format(out='wi', f='max', n=tiles.RING)},
a AS (SELECT image_id, leaf, lab_l, lab_a, lab_b, abs(g1.v - g2.v) AS ridge, abs(te.v) AS texture, sqrt(pow(jxx.v - jyy.v, 2) + 4 * jxy.v * jxy.v) / (jxx.v + jyy.v + 1e-6::DOUBLE) AS coh, nr.v = 1 AS inner_, leaf AND co.v = 0 AS within, wi.v = 1 AND NOT leaf AS around
  FROM mm JOIN g1 USING (image_id, y, x) JOIN g2 USING (image_id, y, x) JOIN te USING (image_id, y, x) JOIN jxx USING (image_id, y, x) JOIN jyy USING (image_id, y, x) JOIN jxy USING (image_id, y, x) JOIN nr USING (image_id, y, x) JOIN co USING (image_id, y, x) JOIN wi USING (image_id, y, x)),
s AS (SELECT image_id, count(*) FILTER (WHERE inner_) AS n, count(*) FILTER (WHERE within) > 20 AND count(*) FILTER (WHERE around) > 20 AS rings, avg(ridge) FILTER (WHERE inner_) AS ri, avg(ridge) FILTER (WHERE leaf) AS rm, avg(texture) FILTER (WHERE inner_) AS ti, avg(texture) FILTER (WHERE leaf) AS tm, avg(coh) FILTER (WHERE inner_) AS ci, avg(coh) FILTER (WHERE leaf) AS cm, avg(texture) FILTER (WHERE around) AS t_out,
  sqrt(pow(avg(lab_l) FILTER (WHERE within) - avg(lab_l) FILTER (WHERE around), 2) + pow(avg(lab_a) FILTER (WHERE within) - avg(lab_a) FILTER (WHERE around), 2) + pow(avg(lab_b) FILTER (WHERE within) - avg(lab_b) FILTER (WHERE around), 2)) AS away FROM a GROUP BY image_id),
z AS (SELECT *, CASE WHEN n >= 30 THEN ri ELSE rm END AS ridge, CASE WHEN n >= 30 THEN ti ELSE tm END AS texture, CASE WHEN n >= 30 THEN ci ELSE cm END AS coh FROM s)
SELECT image_id, round(ridge, 6) AS vein_ridge, round(texture, 6) AS texture_energy, round(coh, 6) AS orientation_coherence, round(CASE WHEN rings THEN away ELSE 100 END, 6) AS boundary_contrast, round(CASE WHEN rings THEN (t_out - texture) / (t_out + texture + 1e-6::DOUBLE) ELSE 0 END, 6) AS texture_contrast FROM z""")
def photo_structure(spark, d):
    """Vein ridges, texture, orientation coherence and the contrasts along the leaf's border: one exchange of tiles for seven filters."""
    out = tiles.structure_cues(raster.with_masks(_photos(spark, d)), "leaf")
    return out.select("image_id", *(F.round(k, 6).alias(k) for k in ("vein_ridge", "texture_energy", "orientation_coherence", "boundary_contrast", "texture_contrast")))


@query(f"""WITH {_PHOTO_HSV}, mm AS MATERIALIZED (SELECT * FROM m), e AS (SELECT * FROM mm WHERE y = 0 UNION ALL SELECT * FROM mm WHERE y = height - 1 UNION ALL SELECT * FROM mm WHERE x = 0 UNION ALL SELECT * FROM mm WHERE x = width - 1),
c AS (SELECT image_id, median(lab_l) AS el, median(lab_a) AS ea, median(lab_b) AS eb FROM e GROUP BY image_id), d AS (SELECT image_id, sqrt((lab_l - el) * (lab_l - el) + (lab_a - ea) * (lab_a - ea) + (lab_b - eb) * (lab_b - eb)) AS d FROM mm JOIN c USING (image_id)),
q AS (SELECT image_id, min(d) AS low, max(d) AS high FROM d GROUP BY image_id), lev AS MATERIALIZED (SELECT image_id, CASE WHEN high > low THEN floor((d - low) * 255 / (high - low)) ELSE 0 END::INT AS v FROM d JOIN q USING (image_id)),
g AS (SELECT image_id, v, count(*) AS n FROM lev GROUP BY ALL), s AS (SELECT image_id, v, sum(n) OVER up AS n0, sum(v * n) OVER up AS m0, sum(n) OVER every AS n, sum(v * n) OVER every AS m FROM g WINDOW up AS (PARTITION BY image_id ORDER BY v), every AS (PARTITION BY image_id)),
b AS (SELECT image_id, v, (n0 / n) * ((n - n0) / n) * (m0 / n0 - (m - m0) / (n - n0)) * (m0 / n0 - (m - m0) / (n - n0)) AS b FROM s WHERE n0 < n), t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(b, 9) DESC, v) AS place FROM b)
SELECT i.image_id, t.v AS threshold, round(t.b, 6) AS between_, above FROM (SELECT image_id, sum((lev.v > coalesce(t.v, 255))::INT)::BIGINT AS above FROM lev LEFT JOIN (SELECT * FROM t WHERE place = 1) t USING (image_id) GROUP BY image_id) i LEFT JOIN t ON t.image_id = i.image_id AND place = 1""")
def photo_threshold(spark, d):
    """The threshold between the border's colour and what differs from it, and how many pixels are above."""
    px = segment.away_from_border(raster.with_masks(_photos(spark, d)))
    return segment.thresholds(px, "away").select("image_id", "threshold", F.round("between", 6).alias("between_"), "above")


_F = {"f0": "lab_l / 10", "f1": "lab_a / 5", "f2": "lab_b / 5"}
_ROUNDS = 3


def _lloyd(k: int) -> str:
    """CTEs of rounds for k clusters: a start, then assignments and means; a cluster that got nothing keeps its centre."""
    start = f"c{k}_0 AS MATERIALIZED (SELECT image_id, j AS i, low + (high - low) * (j + 0.5::DOUBLE) / {k} AS f0, a1 AS f1, a2 AS f2 FROM sp, range({k}) r(j))"
    out = [start]
    for n in range(1, _ROUNDS + 1):
        far = " + ".join(f"(x.f{i} - c.f{i}) * (x.f{i} - c.f{i})" for i in range(3))
        out.append(f"a{k}_{n} AS MATERIALIZED (SELECT x.image_id, x.y, x.x, any_value(x.f0) AS f0, any_value(x.f1) AS f1, any_value(x.f2) AS f2, arg_min(c.i, [round({far}, 9), c.i]) AS i FROM fx x JOIN c{k}_{n - 1} c USING (image_id) GROUP BY ALL)")
        out.append(f"c{k}_{n} AS MATERIALIZED (SELECT c.image_id, c.i, " + ", ".join(f"coalesce(m.f{i}, c.f{i}) AS f{i}" for i in range(3)) + f" FROM c{k}_{n - 1} c LEFT JOIN (SELECT image_id, i, avg(f0) AS f0, avg(f1) AS f1, avg(f2) AS f2 FROM a{k}_{n} GROUP BY ALL) m ON m.image_id = c.image_id AND m.i = c.i)")
    return ", ".join(out)


@query(f"WITH {_PHOTO_HSV}, fx AS MATERIALIZED (SELECT image_id, y, x, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _F.items()) + " FROM m), sp AS (SELECT image_id, min(f0) AS low, max(f0) AS high, avg(f1) AS a1, avg(f2) AS a2 FROM fx GROUP BY image_id), " + ", ".join(map(_lloyd, (2, 3, 4))) + " " + " UNION ALL ".join(f"SELECT image_id, {k} AS k, i::INT AS cluster, round(f0, 6) + 0.0::DOUBLE AS f0, round(f1, 6) + 0.0::DOUBLE AS f1, round(f2, 6) + 0.0::DOUBLE AS f2 FROM c{k}_{_ROUNDS}" for k in (2, 3, 4)))
def photo_clusters(spark, d):
    """Two, three and four clusters of colour of every photo, after three rounds from a fixed start."""
    px = raster.with_masks(_photos(spark, d)).select("image_id", *(F.expr(v).cast("double").alias(k) for k, v in _F.items()))
    out = segment.clusters(px, list(_F), (2, 3, 4), _ROUNDS).select("image_id", "k", F.posexplode("centres").alias("cluster", "c"))
    return out.select("image_id", "k", "cluster", *((F.round(F.get("c", F.lit(i)), 6) + F.lit(0.0)).alias(f"f{i}") for i in range(3)))


_SIDE48 = "CASE WHEN greatest(height, width) > 48 THEN greatest(1, round_even({0} * (48.0::DOUBLE / greatest(height, width)), 0))::BIGINT ELSE {0} END"


@query(f"""WITH {_PHOTO}, o AS (SELECT *, {_SIDE48.format('height')} AS h, {_SIDE48.format('width')} AS w FROM px), j AS (SELECT *, unnest(range(y * h // height, ((y + 1) * h - 1) // height + 1)) AS ny FROM o), k AS (SELECT *, unnest(range(x * w // width, ((x + 1) * w - 1) // width + 1)) AS nx FROM j),
p AS (SELECT *, (least((y + 1) * h, (ny + 1) * height) - greatest(y * h, ny * height)) * (least((x + 1) * w, (nx + 1) * width) - greatest(x * w, nx * width)) AS part FROM k), n AS (SELECT image_id, ny, nx, any_value(h) AS h, any_value(w) AS w, sum(b * part) / sum(part) AS b, sum(g * part) / sum(part) AS g, sum(r * part) / sum(part) AS r FROM p GROUP BY image_id, ny, nx)
SELECT image_id, any_value(h)::INT AS height, any_value(w)::INT AS width, count(*) AS pixels, round(sum(b) + 1.234e-5::DOUBLE, 4) AS b, round(sum(g) + 1.234e-5::DOUBLE, 4) AS g, round(sum(r * (ny * 2 + nx)) + 1.234e-5::DOUBLE, 4) AS r FROM n GROUP BY image_id""")
def photo_work_frame(spark, d):
    """Photos to at most 48 pixels a side by areas."""
    out = resize.work_frame(_photos(spark, d), ["b", "g", "r"], 48)
    total = lambda c: F.round(F.sum(c) + 1.234e-5, 4)  # noqa: E731  no longer halfway between two roundings, where engines differ
    return out.groupBy("image_id").agg(F.max("height").alias("height"), F.max("width").alias("width"), F.count("*").alias("pixels"), total("b").alias("b"), total("g").alias("g"), total(F.col("r") * (F.col("y") * 2 + F.col("x"))).alias("r"))


_REGIONS = f"on_ AS MATERIALIZED (SELECT image_id, y, x FROM px WHERE leaf AND heat > 0.3), {_CC.format(name='cc', of='on_', near=_EIGHT)}, l AS MATERIALIZED (SELECT image_id, y, x, min(label) AS label FROM cc GROUP BY ALL)"
_LEAST_REGION = 12


@query(f"""WITH RECURSIVE {_PX}, {_REGIONS}, big AS (SELECT image_id, label FROM l GROUP BY ALL HAVING count(*) >= {_LEAST_REGION}), r AS MATERIALIZED (SELECT l.* FROM l JOIN big USING (image_id, label)),
sq AS (SELECT image_id, label, y + dy AS y, x + dx AS x, sum(1 << (dy * 2 + dx))::INT AS bits FROM r, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dy, dx) GROUP BY ALL),
o AS (SELECT image_id, label, sum(CASE bit_count(bits) WHEN 4 THEN 1 WHEN 3 THEN 0.5::DOUBLE ELSE 0 END) AS area, sum(CASE WHEN bit_count(bits) = 3 THEN sqrt(2) WHEN bits IN (9, 6) THEN 2 * sqrt(2) WHEN bit_count(bits) = 2 THEN 1 ELSE 0 END) AS perimeter FROM sq GROUP BY ALL),
e AS (SELECT image_id, label, y, min(x) AS a, max(x) AS b FROM r GROUP BY ALL), p AS MATERIALIZED (SELECT image_id, label, y, a AS x FROM e UNION SELECT image_id, label, y, b FROM e),
h AS MATERIALIZED (SELECT p.image_id, p.label, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM p JOIN p q ON p.image_id = q.image_id AND p.label = q.label AND (p.x <> q.x OR p.y <> q.y) JOIN p s ON s.image_id = p.image_id AND s.label = p.label
  GROUP BY ALL HAVING min((q.x - p.x) * (s.y - p.y) - (q.y - p.y) * (s.x - p.x)) >= 0 AND bool_and((q.x - p.x) * (s.y - p.y) - (q.y - p.y) * (s.x - p.x) <> 0 OR ((s.x - p.x) * (s.x - q.x) <= 0 AND (s.y - p.y) * (s.y - q.y) <= 0))),
hu AS (SELECT image_id, label, abs(sum(px * qy - qx * py)) / 2 AS hull_area, sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))) AS hull_perimeter FROM h GROUP BY ALL),
f AS (SELECT h.image_id, h.label, (max(ux * p.x + uy * p.y) - min(ux * p.x + uy * p.y)) AS along, (max(ux * p.y - uy * p.x) - min(ux * p.y - uy * p.x)) AS over_ FROM (SELECT *, (qx - px) / sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) AS ux, (qy - py) / sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) AS uy FROM h) h JOIN p ON p.image_id = h.image_id AND p.label = h.label GROUP BY h.image_id, h.label, h.px, h.py, h.qx, h.qy),
t AS (SELECT image_id, label, min(round(along * over_, 6)) AS frame FROM f GROUP BY ALL)
SELECT image_id, label::INT AS label, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(hull_area, 6)::DOUBLE AS hull_area, round(hull_perimeter, 6) AS hull_perimeter, round((area + 1e-6::DOUBLE) / (hull_area + 1e-6::DOUBLE), 6) AS solidity, round(perimeter / (hull_perimeter + 1e-6::DOUBLE), 6) AS convexity_ratio, frame + 0.0::DOUBLE AS frame FROM o JOIN hu USING (image_id, label) JOIN t USING (image_id, label)""")
def region_shapes(spark, d):
    """Outline, hull and least turned frame of the warm regions of at least 12 pixels."""
    labelled = raster.components(_pixels(spark, d).withColumn("warm", F.col("leaf") & (F.col("heat") > 0.3)), "warm", eight=True, frame=SIDE)
    out = shape.shapes(labelled, _LEAST_REGION)
    frame = F.round(F.col("long_side") * F.col("short_side"), 6) + F.lit(0.0)
    return out.select("image_id", "label", *(F.round(k, 6).alias(k) for k in ("area", "perimeter", "hull_area", "hull_perimeter", "solidity", "convexity_ratio")), frame.alias("frame"))


@query()
def marginal_patches(spark, d):
    """Patches cut out of each photo's leaf: which of them belong to it, by their rings, their surroundings and their colour. Its SQL would be thousands of steps of recursion; tests/test_lesions.py has the rule in plain loops."""
    patch = (F.floor((F.col("x") * 7 + F.col("image_id")) / 63) + F.floor(F.col("y") / 7)) % 5 == 0
    px = raster.with_masks(_photos(spark, d)).withColumns({"lesion": patch, "leaf": F.col("leaf") & ~patch})
    out = lesions.marginal(px.select("image_id", "y", "x", "height", "width", "leaf", "lesion", "lab_a", "lab_b"), "leaf", "lesion")
    return out.select("image_id", "label", "pixels", F.round("border", 6).alias("border"), "around", F.round("distance", 6).alias("distance"), "keeps")
