"""Shapes of labelled regions: outlines by counts of 2 x 2 squares, hulls by an ordered fold over each region's rows, and turned frames around hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship


#: Columns of squares in a word: bit j stands for column 63 * word + j - 1, so that bit 0 repeats the last of the word before.
WORD = 63


def _squares(labelled: DataFrame) -> DataFrame:
    """(image_id, label, y, word, up, here): the region's pixels of rows y - 1 and y as bits, for each row of 2 x 2 squares that it touches. Bits are put together by task before the one shuffle of rows."""
    x = F.col("x").cast("long")
    word, bit = F.floor(x / WORD), (x % WORD + 1).cast("int")
    row = lambda up, w, b: F.struct((F.col("y") + int(up)).cast("int").alias("y"), w.cast("int").alias("word"), F.lit(up).alias("up"), b.alias("bit"))
    at = lambda b: F.expr("shiftleft(1L, _bit)") if b is None else F.lit(b).cast("long")
    own, carried = [row(u, F.col("_word"), at(None)) for u in (False, True)], [row(u, F.col("_word") + 1, at(1)) for u in (False, True)]
    rows = labelled.select("image_id", "label", "y", word.alias("_word"), bit.alias("_bit"))
    each = rows.select("image_id", "label", F.explode(F.when(F.col("_bit") == WORD, F.array(*own, *carried)).otherwise(F.array(*own))).alias("s"))
    bits = lambda up: F.coalesce(F.bit_or(F.when(F.col("s.up") == F.lit(up), F.col("s.bit"))), F.lit(0).cast("long"))
    return each.groupBy("image_id", "label", "s.y", "s.word").agg(bits(True).alias("up"), bits(False).alias("here"))


def _steps(squares: DataFrame) -> dict[str, Column]:
    """Numbers of the squares of a row with four pixels, with three, with two across and with two side by side: 63 squares at a time."""
    a, b, c, d = F.shiftleft("up", 1), F.col("up"), F.shiftleft("here", 1), F.col("here")
    no = F.bitwise_not
    both = lambda *k: _all(k)
    n = lambda v: F.bit_count(v.bitwiseAND(F.lit(-2).cast("long"))).cast("long")  # noqa: E731  the first bit is the word before's
    odd = lambda p, q: p.bitwiseXOR(q)
    three = both(a, b, odd(c, d)).bitwiseOR(both(odd(a, b), c, d))
    across = both(a, d, no(b), no(c)).bitwiseOR(both(b, c, no(a), no(d)))
    side = both(a, b, no(c), no(d)).bitwiseOR(both(c, d, no(a), no(b))).bitwiseOR(both(a, c, no(b), no(d))).bitwiseOR(both(b, d, no(a), no(c)))
    return {"_four": n(both(a, b, c, d)), "_three": n(three), "_across": n(across), "_side": n(side), "_pixels": n(d)}


def _all(parts) -> Column:
    first, *more = parts
    for p in more:
        first = first.bitwiseAND(p)
    return first


def _outline() -> dict[str, Column]:
    """area and perimeter of sums of _steps()."""
    four, three, across, side = (F.col(k) for k in ("_four", "_three", "_across", "_side"))
    return {"area": four + three * 0.5, "perimeter": three * math.sqrt(2) + across * (2 * math.sqrt(2)) + side * 1.0}


def outlines(labelled: DataFrame) -> DataFrame:
    """(image_id, label, area, perimeter) of the outline through the outer pixels' centres, which goes from pixel to pixel straight or aslant. Regions are 8-connected; the outlines of holes count too, so fill_holes() first where only the outer one is wanted.

    Nothing is traced: every 2 x 2 square that a region touches tells its part. Four pixels enclose a unit of area; three half a unit and a slanting step; two neighbours a straight
    step; two across a slanting step there and back. Squares are counted by words of bits, so a region of any size is summed in parts."""
    squares = _squares(labelled)
    sums = squares.withColumns(_steps(squares)).groupBy("image_id", "label").agg(*(F.sum(k).alias(k) for k in ("_four", "_three", "_across", "_side")))
    return sums.withColumns(_outline()).select("image_id", "label", "area", "perimeter")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (x, y) sorted by x, then y: a chain below, a chain above; no point on an edge is a corner."""
    if len(points) < 3:
        return points
    chains = []
    for side in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


def hull_stack(points: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hull() of many regions at once: points (region, place, 2), of which the first n of a region are its own, sorted by x, then y, each once. The corners in turn, and how many there are."""
    every, most = np.arange(len(points)), points.shape[1]
    out, size = np.zeros((len(points), 2 * most + 1, 2), points.dtype), np.zeros(len(points), int)
    few = n < 3
    for back in (False, True):
        base = size.copy()
        for k in range(most):
            i = np.flatnonzero((k < n) & ~few)
            if not len(i):
                break
            p = points[i, n[i] - 1 - k if back else k]
            left = np.arange(len(i))
            while len(left):  # corners that the new point makes none
                left = left[size[i[left]] - base[i[left]] > 1]
                r = i[left]
                u, v, q = out[r, size[r] - 2], out[r, size[r] - 1], p[left]
                left = left[(v[:, 0] - u[:, 0]) * (q[:, 1] - u[:, 1]) - (v[:, 1] - u[:, 1]) * (q[:, 0] - u[:, 0]) <= 0]
                size[i[left]] -= 1
            out[i, size[i]] = p
            size[i] += 1
        size -= ~few  # the last is the other chain's first
    out[few, :most] = points[few]
    size[few] = n[few]
    return out[every, : max(1, int(size.max(initial=0)))], size


#: Pairs of corners that are turned at once.
PAIRS = 1 << 21


def measured(corners: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(area, perimeter, longer and shorter side of the least turned frame) of each of many hulls: corners (region, place, 2), of which the first n are a region's."""
    out = np.zeros((len(corners), 4))
    two = np.flatnonzero(n == 2)
    far = np.hypot(*(corners[two, 1] - corners[two, 0]).astype(float).T) if len(two) else np.zeros(0)
    out[two, 1], out[two, 2] = 2 * far, far
    order = np.flatnonzero(n > 2)
    order = order[np.argsort(n[order], kind="stable")]
    while len(order):
        take = int(np.searchsorted(np.arange(1, len(order) + 1) * n[order].astype(np.int64) ** 2, PAIRS, side="right"))
        i, order = order[: max(1, take)], order[max(1, take) :]
        m = int(n[i[-1]])
        last = np.minimum(np.arange(m), n[i, None] - 1)  # beyond the end the last corner stays: an edge without length
        c = corners[i[:, None], last].astype(float)
        x, y = c[..., 0], c[..., 1]
        to = np.where(np.arange(m) < n[i, None] - 1, np.arange(m) + 1, 0)
        tox, toy = np.take_along_axis(x, to, 1), np.take_along_axis(y, to, 1)
        real = np.arange(m) < n[i, None]
        dx, dy = np.where(real, tox - x, 0), np.where(real, toy - y, 0)
        length = np.hypot(dx, dy)
        out[i, 0] = abs(np.where(real, x * toy - tox * y, 0).sum(1)) / 2
        out[i, 1] = length.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            ux, uy = (dx / length)[..., None], (dy / length)[..., None]
        along, over = ux * x[:, None] + uy * y[:, None], ux * y[:, None] - uy * x[:, None]  # a side of the least frame lies on an edge
        sides = np.stack([np.ptp(along, axis=2), np.ptp(over, axis=2)], 2)
        best = sides[np.arange(len(i)), np.argmin(np.where(real, np.round(sides.prod(2), 9), np.inf), axis=1)]
        out[i, 2], out[i, 3] = best.max(1), best.min(1)
    return out


def _extremes(labelled: DataFrame) -> DataFrame:
    """(image_id, label, rows): the first and last pixel of each row of a region, which alone can be corners."""
    rows = labelled.groupBy("image_id", "label", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return rows.groupBy("image_id", "label").agg(F.collect_list(F.struct("y", "a", "b")).alias("rows"))


#: Places of regions that are folded at once.
PLACES = 1 << 18


def _hulls(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(regions of the batch, their corners, their numbers), regions of like size together."""
    rows = batch.column("rows").value_lengths().to_numpy(zero_copy_only=False)
    region = np.repeat(np.arange(batch.num_rows), rows)
    cells = batch.column("rows").flatten()
    y, a, b = (cells.field(k).to_numpy().astype(np.int64) for k in ("y", "a", "b"))
    r, x, y = np.tile(region, 2), np.concatenate([a, b]), np.tile(y, 2)
    at = np.lexsort((y, x, r))
    r, x, y = r[at], x[at], y[at]
    new = np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(r)]
    r, x, y = r[new], x[new], y[new]
    n = np.bincount(r, minlength=batch.num_rows)
    first = np.cumsum(n) - n
    order = np.argsort(n, kind="stable")
    while len(order):
        take = max(1, int(np.searchsorted(np.arange(1, len(order) + 1) * n[order].astype(np.int64), PLACES, side="right")))
        some, order = order[:take], order[take:]
        points = np.zeros((len(some), int(n[some[-1]]), 2), np.int64)
        total = n[some]
        i = np.repeat(np.arange(len(some)), total)
        k = np.arange(len(i)) - np.repeat(np.cumsum(total) - total, total)
        points[i, k, 0], points[i, k, 1] = x[first[some][i] + k], y[first[some][i] + k]
        yield some, *hull_stack(points, total)


def rows_within(corners: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(first row, first and last column) of the places within a hull or on its edge, for each of its rows; a row without any has its last before its first."""
    (left, top), (right, bottom) = corners.min(0), corners.max(0)
    y = np.arange(top, bottom + 1)
    a, b = np.full(len(y), left), np.full(len(y), right)
    for (px, py), (qx, qy) in zip(corners, np.roll(corners, -1, 0), strict=True):
        run = (qx - px) * (y - py)
        if qy > py:
            b = np.minimum(b, px + run // (qy - py))
        elif qy < py:
            a = np.maximum(a, px - run // (py - qy))
    return int(top), a, b


def spans(labelled: DataFrame) -> DataFrame:
    """(image_id, label, top, spans): of the convex hull of each image's largest region (of those alike the one with the least label), the first and last column (a, b) of its rows from `top` on."""
    ship(labelled.sparkSession)
    rows = labelled.groupBy("image_id", "label", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n"))
    each = rows.groupBy("image_id", "label").agg(F.sum("n").alias("n"), F.collect_list(F.struct("y", "a", "b")).alias("rows"))
    best = each.groupBy("image_id").agg(F.max_by(F.struct("label", "rows"), F.struct("n", -F.col("label"))).alias("r")).select("image_id", "r.label", "r.rows")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, out = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for some, places, n in _hulls(batch):
                for i, c, m in zip(some, places, n, strict=True):
                    tops[i], a, b = rows_within(c[:m])
                    out[i] = [{"a": x, "b": z} for x, z in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("label"), pa.array(tops), pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["image_id", "label", "top", "spans"])

    kinds = dict(best.dtypes)
    return best.mapInArrow(fold, f"image_id {kinds['image_id']}, label {kinds['label']}, top int, spans array<struct<a: bigint, b: bigint>>")


def inside(top: str, spans: str, x: str, y: str) -> Column:
    """Whether a place lies in a hull of spans() or on its edge."""
    row = F.get(F.col(spans), F.col(y) - F.col(top))
    return F.coalesce(F.col(x).between(row["a"], row["b"]), F.lit(False))


def hulls(labelled: DataFrame) -> DataFrame:
    """(image_id, label, hull_area, hull_perimeter, long_side, short_side): of the convex hull through pixel centres, and of the least frame around it at any turn.

    Only a row's first and last pixel can be a corner: a region is two points a row of its image before it is gathered, however many pixels it has."""
    return _measured(_extremes(labelled), [])


def _measured(regions: DataFrame, keep: list[str]) -> DataFrame:
    """The measures of hulls() of regions (image_id, label, keep, rows: of (y, a, b))."""
    ship(regions.sparkSession)
    names = ["image_id", "label", *keep]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.zeros((batch.num_rows, 4))
            for some, places, n in _hulls(batch):
                numbers[some] = measured(places, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *(pa.array(numbers[:, k]) for k in range(4))], names=[*names, "hull_area", "hull_perimeter", "long_side", "short_side"])

    kinds = dict(regions.dtypes)
    return regions.select(*names, "rows").mapInArrow(fold, ", ".join(f"{k} {kinds[k]}" for k in names) + ", hull_area double, hull_perimeter double, long_side double, short_side double")


def shapes(labelled: DataFrame, least: int = 1) -> DataFrame:
    """outlines() and hulls() with solidity (area by the hull's), elongation (long by short side) and convexity_ratio (perimeter by the hull's). Regions without area have a solidity of 1 and large elongations.
    Regions of less than `least` pixels have no row. The rows of bits that give the outlines give the ends of rows too, so regions are read once and nothing is joined."""
    squares = _squares(labelled)
    own = F.shiftrightunsigned("here", 1)  # a bit a column, never negative
    low, high = F.bit_count(own.bitwiseAND(-own) - 1), F.length(F.bin(own)) - 1
    squares = squares.select("*", F.col("word").cast("long").alias("_w"), low.alias("_low"), high.alias("_high"), *(v.alias(k) for k, v in _steps(squares).items()))
    ends = F.struct("y", (F.col("_w") * WORD + F.col("_low")).cast("int").alias("a"), (F.col("_w") * WORD + F.col("_high")).cast("int").alias("b"))
    regions = squares.groupBy("image_id", "label").agg(*(F.sum(k).alias(k) for k in ("_four", "_three", "_across", "_side", "_pixels")), F.collect_list(F.when(F.col("_pixels") > 0, ends)).alias("rows"))
    regions = regions.filter(F.col("_pixels") >= least).withColumns(_outline())
    out = _measured(regions.select("image_id", "label", "area", "perimeter", "rows"), ["area", "perimeter"])
    return out.withColumns({
        "solidity": (F.col("area") + 1e-6) / (F.col("hull_area") + 1e-6), "elongation": F.col("long_side") / F.greatest(F.lit(1e-6), F.col("short_side")), "convexity_ratio": F.col("perimeter") / (F.col("hull_perimeter") + 1e-6),
    })
