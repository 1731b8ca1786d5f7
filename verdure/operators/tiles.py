"""Neighbourhoods of pixels: tiles with a halo.

A pixel goes to its own tile and to the tiles whose halo it lies in (one shuffle; at most four tiles while the halo is no wider than a tile).  A tile is then
a row of bounded size, whatever the size of its image, and a task filters tiles one after the other.  Several filters in a row take one exchange:
the halo is as wide as their reaches together.  Image edges are mirrored without repeating the edge pixel, at each filter anew.

Pixel tables: (image_id, y, x, ...), with `height` and `width` where the caller knows them; else they are found from the pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship

TILE = 128

#: Pixels of tiles that are filtered at once.
ALIKE = 1 << 15


def gaussian(sigma: float) -> np.ndarray:
    """Weights of a blur, four sigmas to each side, that add up to 1."""
    reach = int(math.floor(sigma * 8 + 1 + 0.5) | 1) // 2
    w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


#: The weights of a slope, of what smooths it, and of a second difference.
SLOPE, SMOOTH, SECOND = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0]), np.array([1.0, -2.0, 1.0])


def ellipse(size: int) -> list[int]:
    """How far an ellipse of `size` (odd) rows and columns reaches to each side, for each of its rows."""
    r = size // 2
    return [round(r * math.sqrt((r * r - d * d) / (r * r))) if r else 0 for d in range(-r, r + 1)]


def mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Places inside 0 .. size-1 for places beyond: mirrored at the first and last, which aren't repeated."""
    if size == 1:
        return np.zeros_like(at)
    at = np.abs(at) % (2 * size - 2)
    return np.minimum(at, 2 * size - 2 - at)


class Patch:
    """A part of one plane of an image, or of many images alike in size and place: values (..., y, x), the place of the first, and the image's size.  Filters shrink it by their reach, save at the image's edges."""

    def __init__(self, values: np.ndarray, top: int, left: int, height: int, width: int):
        self.values, self.at, self.size = values, (top, left), (height, width)

    def _like(self, values: np.ndarray, at: tuple[int, int]) -> Patch:
        return Patch(values, *at, *self.size)

    def _taps(self, reach: int, axis: int) -> tuple[int, Callable[[int], np.ndarray]]:
        """(first place after the filter, the values `k` places on)."""
        start, size = self.at[axis], self.size[axis]
        stop = start + self.values.shape[axis - 2]
        lo, hi = 0 if start == 0 else start + reach, size if stop == size else stop - reach
        n = max(0, hi - lo)
        wide = np.take(self.values, mirrored(np.arange(lo - reach, hi + reach), size) - start, axis - 2) if n else self.values  # mirrored once, then only cut
        part = (lambda a: wide[..., a : a + n, :]) if axis == 0 else (lambda a: wide[..., a : a + n])
        return lo, lambda k: part(reach + k)

    def _moved(self, lo: int, axis: int) -> tuple[int, int]:
        return (lo, self.at[1]) if axis == 0 else (self.at[0], lo)

    def along(self, kernel: np.ndarray, axis: int) -> Patch:
        """Weighted sums along an axis: 0 down, 1 across."""
        reach = len(kernel) // 2
        lo, tap = self._taps(reach, axis)
        out, one = np.zeros(tap(0).shape), np.empty(tap(0).shape)
        for k, w in enumerate(kernel):
            if w:
                out += np.multiply(tap(k - reach), w, out=one)
        return self._like(out, self._moved(lo, axis))

    def weighted(self, down: np.ndarray, across: np.ndarray) -> Patch:
        return self.along(down, 0).along(across, 1)

    def blurred(self, sigma: float) -> Patch:
        return self.weighted(gaussian(sigma), gaussian(sigma))

    def laplacian(self) -> Patch:
        """Second differences down and across, added."""
        return combined(lambda a, b: a + b, self.along(SECOND, 0), self.along(SECOND, 1))

    def framed(self, reach: int, most: bool = True, gaps: bool = True) -> Patch:
        """The largest (else the least) value in a square of `reach` places each way.  Beyond the image nothing counts, and a mirrored square holds nothing that isn't in it.
        gaps: what isn't a number makes the square none; else it doesn't count."""
        best, out = ((np.maximum, np.minimum) if gaps else (np.fmax, np.fmin))[not most], self
        for axis in (0, 1):
            lo, tap = out._taps(reach, axis)
            value = tap(0)
            for k in range(1, reach + 1):
                value = best(value, best(tap(k), tap(-k)))
            out = self._like(value, out._moved(lo, axis))
        return out

    def round(self, size: int, most: bool = True) -> Patch:
        """The largest (else the least) value in an ellipse of `size` (odd) rows and columns. Beyond the image nothing counts."""
        best, reach = (np.maximum if most else np.minimum), size // 2
        lo, tap = self._taps(reach, 1)
        rows = [self._like(tap(0), self._moved(lo, 1))]
        for k in range(1, reach + 1):  # rows[k]: the best of k places each way
            rows.append(self._like(best(rows[-1].values, best(tap(k), tap(-k))), self._moved(lo, 1)))
        out = None
        for dy, dx in enumerate(ellipse(size)):
            lo, tap = rows[dx]._taps(reach, 0)
            value = tap(dy - reach)
            out = value if out is None else best(out, value)
        return self._like(out, rows[0]._moved(lo, 0))

    def cut(self, top: int, left: int, rows: int, columns: int) -> np.ndarray:
        y, x = top - self.at[0], left - self.at[1]
        return self.values[..., y : y + rows, x : x + columns]


def combined(f: Callable, *patches: Patch) -> Patch:
    """f of the patches' values where all of them have some."""
    top, left = (max(p.at[i] for p in patches) for i in (0, 1))
    rows, columns = (min(p.at[i] + p.values.shape[i - 2] for p in patches) for i in (0, 1))
    values = f(*(p.cut(top, left, rows - top, columns - left) for p in patches))
    return patches[0]._like(values, (top, left))


def sized(pixels: DataFrame) -> DataFrame:
    """pixels with `height` and `width`."""
    if {"height", "width"} <= set(pixels.columns):
        return pixels
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return pixels.join(size.hint("shuffle_hash"), "image_id")


def gathered(pixels: DataFrame, columns: list[str], tile: int, halo: int) -> DataFrame:
    """A row a tile: image_id, ty, tx, height, width, cells: array of (y, x, columns); of the tile and its halo."""
    if halo > tile:
        raise ValueError("a halo is no wider than a tile")
    span = lambda at, size: F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - halo) / tile)), F.least(F.floor((F.col(size) - 1) / tile), F.floor((F.col(at) + halo) / tile))).cast("array<int>")
    rows = sized(pixels).select("image_id", "height", "width", F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *columns).alias("cell"), F.explode(span("y", "height")).alias("ty"), "y", "x")
    rows = rows.select("image_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "cell", "ty", F.explode(span("x", "width")).alias("tx"))
    return rows.groupBy("image_id", "ty", "tx").agg(F.max("height").alias("height"), F.max("width").alias("width"), F.collect_list("cell").alias("cells"))


def filtered(pixels: DataFrame, planes: list[str], function: Callable[..., dict[str, Patch]], outputs: dict[str, str], halo: int, keep: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """(image_id, y, x, keep, outputs) of every pixel.  function: from a Patch of doubles for each of `planes` to one for each of `outputs` (name: type), which reach no farther than `halo` together.
    Tiles of a batch that are alike in place and image size are one stack of planes, of at most ALIKE pixels.
    A pixel that isn't there, or null, is not a number; what comes from it is null."""
    ship(pixels.sparkSession)
    kept = [f"_k{i}" for i in range(len(keep))]
    values = [f"_v{i}" for i in range(len(planes))]
    named = sized(pixels).select("image_id", "y", "x", "height", "width", *(F.col(k).alias(n) for k, n in zip(keep, kept, strict=True)), *(F.col(p).cast("double").alias(n) for p, n in zip(planes, values, strict=True)))
    whole = {n: t in ("boolean", "int", "long") for n, t in outputs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("cells").value_lengths().to_numpy(zero_copy_only=False)
            first = np.append(0, np.cumsum(lengths))
            cells = batch.column("cells").flatten()
            ys, xs = (cells.field(k).to_numpy() for k in ("y", "x"))
            data = [cells.field(n).to_numpy(zero_copy_only=False) for n in values]
            ty, tx, heights, widths = (batch.column(k).to_numpy() for k in ("ty", "tx", "height", "width"))
            own, got = [], {n: [] for n in outputs}
            places, kind = np.unique(np.stack([ty, tx, heights, widths], 1), axis=0, return_inverse=True)
            for j, (y0, x0, h, w) in enumerate((places * (tile, tile, 1, 1)).tolist()):
                top, left, bottom, right = max(0, y0 - halo), max(0, x0 - halo), min(h, y0 + tile + halo), min(w, x0 + tile + halo)
                alike, several = np.flatnonzero(kind.ravel() == j), max(1, ALIKE // ((bottom - top) * (right - left)))
                for i in range(0, len(alike), several):
                    at = alike[i : i + several]
                    n = lengths[at]
                    rows = np.arange(n.sum()) + np.repeat(first[at] - np.cumsum(n) + n, n)
                    z, y, x = np.repeat(np.arange(len(at)), n), ys[rows], xs[rows]
                    patches = []
                    for d in data:
                        plane = np.full((len(at), bottom - top, right - left), np.nan)
                        plane[z, y - top, x - left] = d[rows]
                        patches.append(Patch(plane, top, left, h, w))
                    found = function(*patches)
                    core = np.flatnonzero((y >= y0) & (y < y0 + tile) & (x >= x0) & (x < x0 + tile))
                    own.append(rows[core])
                    for k in outputs:
                        got[k].append(found[k].cut(y0, x0, min(tile, h - y0), min(tile, w - x0))[z[core], y[core] - y0, x[core] - x0].astype(float))
            if not own:
                continue
            rows = np.concatenate(own)
            owner = np.repeat(np.arange(batch.num_rows), lengths)[rows]
            out = [batch.column("image_id").take(pa.array(owner)), pa.array(ys[rows]), pa.array(xs[rows])]
            out += [cells.field(n).take(pa.array(rows)) for n in kept]
            for n, kind in outputs.items():
                v = np.concatenate(got[n])
                bad = np.isnan(v)
                out.append(pa.array(np.where(bad, 0, v) if whole[n] else v, mask=bad).cast({"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}.get(kind, pa.float64())))
            yield pa.RecordBatch.from_arrays(out, names=["image_id", "y", "x", *kept, *outputs])

    kinds = dict(named.dtypes)
    schema = ", ".join([f"image_id {kinds['image_id']}", "y int", "x int", *(f"{n} {kinds[n]}" for n in kept), *(f"{n} {t}" for n, t in outputs.items())])
    out = gathered(named, [*kept, *values], tile, halo).mapInArrow(run, schema)
    return out.withColumnsRenamed(dict(zip(kept, keep, strict=True)))


def laplacian(pixels: DataFrame, plane: str, keep: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """Adds `laplacian` of a plane."""
    return filtered(pixels, [plane], lambda p: {"laplacian": p.laplacian()}, {"laplacian": "double"}, 1, keep, tile)


def blurred(pixels: DataFrame, plane: str, sigma: float, keep: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """Adds `blurred`: the plane under Gaussian weights."""
    return filtered(pixels, [plane], lambda p: {"blurred": p.blurred(sigma)}, {"blurred": "double"}, len(gaussian(sigma)) // 2, keep, tile)


#: The blurs of fine and coarse veins, of texture and of the structure tensor, the squares of the inner part and of the rings, and the least sizes of these.
FINE, COARSE, TEXTURE, TENSOR, INNER, RING, LEAST_INNER, LEAST_RING, NO_OUTSIDE = 1.2, 3.0, 0.8, 4.0, 3, 4, 30, 20, 100.0


def _structure(light: Patch, mask: Patch) -> dict[str, Patch]:
    fine = light.blurred(FINE)
    across, down = fine.weighted(SMOOTH, SLOPE), fine.weighted(SLOPE, SMOOTH)
    product = lambda a, b: combined(lambda p, q: p * q, a, b).blurred(TENSOR)
    xx, yy, xy = product(across, across), product(down, down), product(across, down)
    return {
        "ridge": combined(lambda a, b: np.abs(a - b), fine, light.blurred(COARSE)),
        "texture": combined(np.abs, light.blurred(TEXTURE).laplacian()),
        "coherence": combined(lambda a, b, m: np.sqrt((a - b) ** 2 + 4 * m * m) / (a + b + 1e-6), xx, yy, xy),
        "inner": mask.framed(INNER, most=False), "core": mask.framed(RING, most=False), "wide": mask.framed(RING),
    }


def structure_cues(pixels: DataFrame, mask: str, light: str = "lab_l", a: str = "lab_a", b: str = "lab_b", tile: int = TILE) -> DataFrame:
    """A row an image: vein_ridge (difference of two blurs), texture_energy (second differences) and orientation_coherence (of the structure tensor), means over the mask's inner part,
    boundary_contrast (distance of the Lab means of the rings within and around the mask's border) and texture_contrast of that ring with the inner part.
    The inner part is the mask less 3 pixels, or all of it if less than 30 pixels stay; images without two rings of more than 20 pixels have contrasts of 100 and 0; those without a mask have nulls there."""
    halo = len(gaussian(FINE)) // 2 + 1 + len(gaussian(TENSOR)) // 2
    flags = ("inner", "core", "wide")
    at = filtered(pixels.withColumn("_m", F.col(mask).cast("int")), [light, "_m"], _structure, {"ridge": "double", "texture": "double", "coherence": "double"} | dict.fromkeys(flags, "boolean"), halo, (mask, light, a, b), tile)
    mean = lambda c, where: F.avg(F.when(where, F.col(c)))
    on, inside, around = F.col(mask), F.col(mask) & ~F.col("core"), F.col("wide") & ~F.col(mask)
    cues = ("ridge", "texture", "coherence")
    sums = at.groupBy("image_id").agg(
        F.count_if(F.col("inner")).alias("n"), F.count_if(inside).alias("n_in"), F.count_if(around).alias("n_out"), *(mean(c, w).alias(f"{c}_{n}") for c in cues for n, w in (("inner", F.col("inner")), ("mask", on))),
        mean("texture", around).alias("out"), *(mean(c, w).alias(f"{n}_{i}") for i, c in enumerate((light, a, b)) for n, w in (("in", inside), ("around", around))),
    )
    of = lambda c: F.when(F.col("n") >= LEAST_INNER, F.col(f"{c}_inner")).otherwise(F.col(f"{c}_mask"))
    rings = (F.col("n_in") > LEAST_RING) & (F.col("n_out") > LEAST_RING)
    away = F.sqrt(sum(((F.col(f"in_{i}") - F.col(f"around_{i}")) * (F.col(f"in_{i}") - F.col(f"around_{i}")) for i in range(3)), F.lit(0.0)))
    return sums.select(
        "image_id", of("ridge").alias("vein_ridge"), of("texture").alias("texture_energy"), of("coherence").alias("orientation_coherence"), F.when(rings, away).otherwise(NO_OUTSIDE).alias("boundary_contrast"),
        F.when(rings, (F.col("out") - of("texture")) / (F.col("out") + of("texture") + 1e-6)).otherwise(0.0).alias("texture_contrast"),
    )


def quality_metrics(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """A row an image: height, width, and of its grey values std, sharpness (variance of the Laplacian), mean and the shares of dark (< 10) and bright (> 246) pixels. For gate.quality_reason()."""
    grey = sized(pixels).withColumn("grey", grey_value())
    at = laplacian(grey, "grey", ("grey", "height", "width"), tile)
    share = lambda c: F.avg(c.cast("double"))
    g = F.col("grey")
    return at.groupBy("image_id").agg(
        F.max("height").alias("height"), F.max("width").alias("width"), F.stddev_pop("grey").alias("std"), F.var_pop("laplacian").alias("sharpness"), F.avg("grey").alias("mean"), share(g < 10).alias("dark"), share(g > 246).alias("bright"),
    )


def grey_value():
    """8-bit grey of b, g, r. Its whole weights of 16,384."""
    return F.shiftright(F.col("r") * 4899 + F.col("g") * 9617 + F.col("b") * 1868 + 8192, 14)
