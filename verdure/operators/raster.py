"""Pixel tables: (image_id, y, x, b, g, r). Colour predicates and sums are Catalyst's; connected components run by tiles in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ship, stored
from .closure import least_members
from .tiles import combined, filtered

EPS = 1e-6


def chromaticity() -> dict[str, Column]:
    """r, g, b shares and the excess indices, in double precision."""
    total = F.col("r") + F.col("g") + F.col("b") + EPS
    r, g, b = (F.col(k) / total for k in "rgb")
    exg, exr = 2 * g - r - b, 1.4 * r - g
    return {"exg": exg, "exr": exr, "exgr": exg - exr}


def hsv() -> dict[str, Column]:
    """8-bit hue (0-179), saturation and value."""
    r, g, b = (F.col(k).cast("double") for k in "rgb")
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    span = v - low
    hue = F.when(span == 0, 0.0).when(v == r, (g - b) * 30 / span).when(v == g, 60 + (b - r) * 30 / span).otherwise(120 + (r - g) * 30 / span)
    hue = F.floor(F.when(hue < 0, hue + 180).otherwise(hue) + 0.5) % 180
    return {"h": hue.cast("int"), "s": F.floor(F.when(v == 0, 0.0).otherwise(span * 255 / v) + 0.5).cast("int"), "v": v.cast("int")}


def lab() -> dict[str, Column]:
    """The 8-bit Lab plane, a and b less 128: sRGB to XYZ at D65 in double precision, then rounded. The matrix and the curve of that colour space."""
    linear = lambda k: F.when(F.col(k) <= 0.04045 * 255, F.col(k) / 255 / 12.92).otherwise(F.pow((F.col(k) / 255 + 0.055) / 1.055, F.lit(2.4)))
    r, g, b = linear("r"), linear("g"), linear("b")
    xyz = (
        (r * 0.412453 + g * 0.357580 + b * 0.180423) / 0.950456, r * 0.212671 + g * 0.715160 + b * 0.072169,
        (r * 0.019334 + g * 0.119193 + b * 0.950227) / 1.088754,
    )
    curve = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16 / 116)
    fx, fy, fz = map(curve, xyz)
    whole = lambda x: F.floor(x + 0.5).cast("int")
    return {"lab_l": whole((fy * 116 - 16) * 2.55), "lab_a": whole((fx - fy) * 500), "lab_b": whole((fy - fz) * 200)}


def with_masks(pixels: DataFrame) -> DataFrame:
    """Adds h, s, v, exgr, lab_l, lab_a, lab_b and the masks green, soil, stone, lesion, skin. The bounds of all of them."""
    out = pixels.withColumns(hsv() | lab() | {"exgr": chromaticity()["exgr"]})
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    green = h.between(22, 95) & (s >= 28) & (v >= 28) & ((F.col("exgr") > -0.03) | (F.col("lab_a") < -7))
    soil = ((h < 25) | (h >= 165)) & (s >= 25) & (s < 170) & (v >= 30) & (v < 200) & (F.col("exgr") < -0.05)
    stone = (s < 32) & (v >= 45)
    yellow = (h >= 14) & (h < 35) & (s >= 55) & (v >= 70)
    brown = ((h < 22) | (h >= 165)) & (s >= 45) & v.between(25, 215)
    olive = (v >= 15) & (v < 90) & (s >= 40) & (F.col("lab_b") > 2)
    skin = ((h < 20) | (h > 170)) & (s > 40) & (s < 170) & (v > 80) & (F.col("lab_a") > 8) & (F.col("lab_b") > 8)
    return out.withColumns({"green": green, "soil": soil, "stone": stone, "lesion": yellow | brown | olive, "skin": skin})


def abnormal(leaf: str) -> Column:
    """Colours of ill tissue on the leaf, before any opening. Of with_masks(). Its weights and bounds."""
    cut = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    away = F.when(h < 35, 35 - h).when(h > 85, h - 85).otherwise(0)
    score = F.lit(0.45) * cut(away / 20) * (s > 45).cast("int") + F.lit(0.30) * cut(F.col("lab_a") / 25) + F.lit(0.25) * cut((F.col("lab_b") - 25) / 25)
    return (F.greatest(score, cut((70 - v) / 40) * 0.8) >= 0.35) & F.col(leaf)


def framed(pixels: DataFrame, mask: str, reach: int, name: str, any_: bool = True) -> DataFrame:
    """pixels with `name`: the mask widened (or, without any_, narrowed) by a square of `reach` pixels each way, in tiles. Beyond the edge nothing counts, nor does what is null or isn't there."""
    keep = tuple(c for c in pixels.columns if c not in ("image_id", "y", "x", name))
    flat = pixels.withColumn("_m", F.col(mask).cast("int"))
    return filtered(flat, ["_m"], lambda m: {name: m.framed(reach, any_, gaps=False)}, {name: "boolean"}, reach, keep)


def opened(pixels: DataFrame, mask: str, reach: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, y, x, keep, narrowed, opened): the mask narrowed by a square of `reach` pixels each way, and that widened again; one exchange of tiles for both."""

    def both(m, there):
        narrowed = combined(lambda n, t: np.where(np.isnan(t), np.nan, n), m.framed(reach, False, gaps=False), there)
        return {"narrowed": narrowed, "opened": narrowed.framed(reach, gaps=False)}

    flat = pixels.withColumns({"_m": F.col(mask).cast("int"), "_there": F.lit(1)})
    return filtered(flat, ["_m", "_there"], both, {"narrowed": "boolean", "opened": "boolean"}, 2 * reach, keep)


def false_colours(spark) -> DataFrame:
    """(level, red, green, blue) for 256 levels of heat, by a rule: three ramps of slope 4 around 3/4, 1/2 and 1/4."""
    ramp = lambda centre: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(F.col("level") / 255 * 4 - 4 * centre))) * 255).cast("int")
    return spark.range(256).select(F.col("id").cast("int").alias("level")).withColumns({"red": ramp(0.75), "green": ramp(0.5), "blue": ramp(0.25)})


def overlaid(pixels: DataFrame, heat: str, alpha: Column, prefix: str = "") -> DataFrame:
    """pixels with b, g, r (or, with a prefix, further columns) blended with the false colour of their heat (0 .. 1), cut to whole numbers."""
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(heat))) * 255).cast("int")
    out = pixels.withColumn("_level", level).join(F.broadcast(false_colours(pixels.sparkSession).toDF("_level", "_r", "_g", "_b")), "_level")
    return out.withColumns({f"{prefix}{k}": F.floor((1 - alpha) * F.col(k) + alpha * F.col(f"_{k}")).cast("int") for k in "bgr"}).drop("_level", "_r", "_g", "_b")


def focus_alpha(heat: str) -> Column:
    """How much an overlay shows: nothing below .15 of heat, 0.7 at most."""
    return F.lit(0.7) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(heat) - 0.15) / 0.85))


def label_sums(labelled: DataFrame, index: DataFrame, value: str) -> DataFrame:
    """A row for each (image_id, label) of index: the sum of the label's values, 0.0 for one without pixels. Sums are far more than the files of their pixels' rule tell, so they are never sent to all tasks."""
    sums = labelled.groupBy("image_id", "label").agg(F.sum(F.col(value).cast("double")).alias("total"))
    return index.hint("merge").join(sums.hint("merge"), ["image_id", "label"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def seeds(labelled: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, label, score) of the component that a segmentation starts from: large, central, off the edge; images whose components are all too small have no row. Its weights."""
    y, x = F.col("y"), F.col("x")
    edge = (y == 0) | (x == 0) | (y == height - 1) | (x == width - 1)
    each = labelled.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.sum(edge.cast("int")).alias("edge"))
    away = F.pow(F.col("cy") / height - 0.5, F.lit(2.0)) + F.pow(F.col("cx") / width - 0.5, F.lit(2.0))
    share = F.col("area") / (height * width)
    border = F.least(F.lit(1.0), F.col("edge") / F.greatest(F.sqrt("area") * 4, F.lit(1.0)))
    score = F.when(share < 0.004, 0.0).otherwise(share * F.exp(-away / 0.18) * (1 - border * 0.5))
    best = each.withColumn("score", score).groupBy("image_id").agg(F.max_by(F.struct("label", "score"), F.struct(F.round("score", 12), -F.col("label"))).alias("b"))
    return best.select("image_id", "b.label", "b.score").filter("score > 0")


def touching(labelled: DataFrame, others: DataFrame) -> DataFrame:
    """The components (all their pixels) of which a pixel is in `others` (image_id, y, x). Where a column of the pixels tells it, components(spread=True) does so without a join."""
    met = labelled.join(others.select("image_id", "y", "x").hint("merge"), ["image_id", "y", "x"], "left_semi").select("image_id", "label").distinct()
    return labelled.join(met.hint("merge"), ["image_id", "label"], "left_semi")


def keeps_marginal(border: Column, around: Column, distance: Column) -> Column:
    """A candidate beside the leaf belongs to it if most of its border does, or enough of it and the colour around differs or can't be told."""
    return (border >= 0.62) | ((border >= 0.40) & ((around < 20) | (distance >= 9)))


def composition(masked: DataFrame) -> DataFrame:
    """A row an image: shares of green, soil, stone that isn't soil, and other (at least 0)."""
    share = lambda x: F.avg(x.cast("double"))
    out = masked.groupBy("image_id").agg(share(F.col("green")).alias("green"), share(F.col("soil")).alias("soil"), share(F.col("stone") & ~F.col("soil")).alias("stone"))
    return out.withColumn("other", F.greatest(F.lit(0.0), 1 - F.col("green") - F.col("soil") - F.col("stone")))


TILE = 128


def label_stack(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Components of many planes at once (plane, y, x): for each pixel the least flat index of its component in the stack; -1 beside the mask.

    A round takes the least label of each neighbourhood, hangs it under what the labels in it stood for, and follows labels to their own labels until they rest."""
    n, h, w = mask.shape
    far = mask.size
    label = np.where(mask, np.arange(far).reshape(mask.shape), far)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * eight
    root = np.arange(far + 1)
    padded = np.full((n, h + 2, w + 2), far)
    while True:
        padded[:, 1:-1, 1:-1] = label
        best = label.copy()
        for dy, dx in steps:
            np.minimum(best, padded[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], out=best)
        lower = mask & (best < label)
        if not lower.any():
            return np.where(mask, label, -1)
        np.minimum.at(root, label[lower], best[lower])
        while True:
            after = root[root]
            if (after == root).all():
                break
            root = after
        label = np.where(mask, root[label], far)


def label_array(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Least row-major index of each pixel's component, from 1; 0 is background."""
    return label_stack(mask[None], eight)[0] + 1


#: Pixels of one image that are held at once to join its tiles; an image with more is joined by shuffles.
HELD = 1 << 22


def closed(image: np.ndarray, y: np.ndarray, x: np.ndarray, code: np.ndarray, tile: int, eight: bool) -> np.ndarray:
    """The least code of each pixel's component, of the pixels of whole images (numbered) with the codes (row << 32 | column of the first pixel) of their tiles' components."""
    if not len(y):
        return code
    tall, wide = int(y.max()) + 3, int(x.max()) + 3  # a margin, so that a step never leads into another row or image
    place = lambda i, y, x: (i * tall + y + 1) * wide + x + 1
    node, own = np.unique(place(image, code >> 32, code & 0xFFFFFFFF), return_inverse=True)
    edge = np.flatnonzero(np.isin(y % tile, (0, tile - 1)) | np.isin(x % tile, (0, tile - 1)))
    edge = edge[np.argsort(place(image[edge], y[edge], x[edge]), kind="stable")]
    i, v, h = image[edge], y[edge], x[edge]
    there, pairs = place(i, v, h), []
    for dy, dx in [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * eight:
        out = np.flatnonzero(((v + dy) // tile != v // tile) | ((h + dx) // tile != h // tile))
        to = there[out] + dy * wide + dx
        at = np.minimum(np.searchsorted(there, to), len(there) - 1)
        met = there[at] == to
        pairs.append(np.stack([own[edge[out[met]]], own[edge[at[met]]]]))
    a, b = np.concatenate(pairs, 1)
    root = np.arange(len(node))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    first = node[root[own]]
    return (first // wide % tall - 1 << 32) + first % wide - 1


def components(pixels: DataFrame, mask: str, eight: bool = False, keep: tuple[str, ...] = (), frame: int | None = None, tile: int = TILE, spread: bool = False, held: int = HELD) -> DataFrame:
    """(image_id, y, x, label, keep) of the mask's pixels; a label is the least row-major index of its component, from 1.

    Pixels are gathered by tiles, so a row is bounded whatever an image's size, and a task labels many tiles at once. Tiles are dealt by image and come in turn; the labels on both sides of
    the tiles' borders are joined by place and closed for all images in a batch at once, as an image is held up to `held` pixels. The labels of an image with more are joined by shuffles, and their graph is closed by rounds of stars.
    frame: the most rows and columns of an image, where the caller knows them: images within one tile need no second step; a pixel beyond is an error.
    spread: with a frame; a pixel's value of the first column of `keep`, a flag, is then whether any pixel of its component has it.
    `width` of an image is taken from a column of that name, else it is the mask's and the other pixels' largest x + 1."""
    ship(pixels.sparkSession)
    frame = frame if frame and frame <= TILE else None
    if spread and not frame:
        raise ValueError("flags are spread within a frame")
    tile = TILE if frame else tile
    kept = [f"_k{i}" for i in range(len(keep))]
    if frame:
        pixels = pixels.withColumn("x", F.when(F.greatest("y", "x") < frame, F.col("x")).otherwise(F.raise_error(F.lit("a pixel beyond the frame"))))

    def tiles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]:
        """(row of the batch, y, x, code, kept) of the pixels."""
        first = np.append(0, np.cumsum(batch.column("cells").value_lengths().to_numpy(zero_copy_only=False)))
        cells = batch.column("cells").flatten()
        place = (cells.field("at") if kept else cells).to_numpy()
        ys, xs = place >> 32, place & 0xFFFFFFFF
        tops, lefts = (batch.column(k).to_numpy().astype(np.int64) * tile for k in ("ty", "tx"))
        plane = np.repeat(np.arange(batch.num_rows), np.diff(first))
        y, x = ys - tops[plane], xs - lefts[plane]
        code = np.zeros(len(ys), np.int64)
        several = max(1, (4 << 20) // (tile * tile))
        for i in range(0, batch.num_rows, several):
            at = slice(first[i], first[min(i + several, batch.num_rows)])
            if at.start == at.stop:
                continue
            n, h, w = int(plane[at][-1]) - i + 1, int(y[at].max()) + 1, int(x[at].max()) + 1
            grid = np.zeros((n, h, w), bool)
            grid[plane[at] - i, y[at], x[at]] = True
            least = label_stack(grid, eight)[plane[at] - i, y[at], x[at]] % (h * w)
            code[at] = (least // w + tops[plane[at]] << 32) + least % w + lefts[plane[at]]
        return plane, ys, xs, code, [cells.field(n) for n in kept]

    names = ["image_id", "y", "x", "width", "_code", *kept]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plane, ys, xs, code, more = tiles(batch)
            out = [batch.column("image_id").take(pa.array(plane)), pa.array(ys.astype(np.int32)), pa.array(xs.astype(np.int32)), batch.column("width").take(pa.array(plane)), pa.array(code)]
            if spread:
                key = (plane << 14) + (code >> 32 << 7) + (code & 127)
                more[0] = pa.array(np.isin(key, key[more[0].fill_null(False).to_numpy(zero_copy_only=False)]))
            yield pa.RecordBatch.from_arrays([*out, *more], names=names)

    def whole(rows: pa.Table, open_: bool) -> Iterator[pa.RecordBatch]:
        """Pixels of the tiles of whole images (or, open_, of a part of one) in turn."""
        for batch in rows.combine_chunks().to_batches():
            plane, ys, xs, code, more = tiles(batch)
            image = changes(batch.column("image_id")).cumsum()
            width = np.zeros(image[-1] + 1, np.int32)
            np.maximum.at(width, image, batch.column("width").to_numpy())
            code = code if open_ else closed(image[plane], ys, xs, code, tile, eight)
            out = [batch.column("image_id").take(pa.array(plane)), pa.array(ys.astype(np.int32)), pa.array(xs.astype(np.int32)), pa.array(width[image[plane]]), pa.array(code)]
            yield pa.RecordBatch.from_arrays([*out, *more, pa.array(np.full(len(ys), open_))], names=[*names, "_open"])

    def changes(ids: pa.Array) -> np.ndarray:
        """Whether a row's image is another than that of the row before."""
        return np.append(False, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) if len(ids) > 1 else np.zeros(len(ids), bool)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, large = None, None  # the tiles of an image that may go on; the image that has gone beyond `held`
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([last, rows]) if last is not None else rows
            ids = rows["image_id"].combine_chunks()
            begins = np.append(0, np.flatnonzero(changes(ids)))
            if large is not None:
                end = int(begins[1]) if len(begins) > 1 else len(ids)
                if ids[0] == large:
                    yield from whole(rows.slice(0, end), True)
                    rows, begins = rows.slice(end), begins[1:] - end
                large = None if rows.num_rows else large
            if not rows.num_rows:
                last = None
                continue
            if begins[-1]:
                yield from whole(rows.slice(0, int(begins[-1])), False)
            last = rows.slice(int(begins[-1]))
            if pc.sum(pc.list_value_length(last["cells"])).as_py() > held:
                large = last["image_id"][0]
                yield from whole(last, True)
                last = None
        if last is not None and last.num_rows:
            yield from whole(last, False)

    part = lambda c: F.floor(F.col(c) / tile).cast("int")
    cell = F.shiftleft(F.col("y").cast("long"), 32).bitwiseOR(F.col("x").cast("long"))
    cell = F.when(F.col(mask), F.struct(cell.alias("at"), *(F.col(k).alias(n) for k, n in zip(keep, kept, strict=True))) if keep else cell)
    kinds = dict(pixels.dtypes)
    schema = ", ".join([f"image_id {kinds['image_id']}", "y int", "x int", "width int", "_code long", *(f"{n} {kinds[k]}" for k, n in zip(keep, kept, strict=True))])
    width = F.max(F.col("width") if "width" in pixels.columns and not frame else F.col("x") + 1).cast("int").alias("width")  # the image's largest x + 1, of all its pixels, by one cheap maximum
    if frame:
        rows = pixels.groupBy("image_id").agg(F.collect_list(cell).alias("cells"), width).filter(F.size("cells") > 0).select("image_id", F.lit(0).alias("ty"), F.lit(0).alias("tx"), "width", "cells")
        local = rows.mapInArrow(label, schema)
    else:
        rows = pixels.groupBy("image_id", part("y").alias("ty"), part("x").alias("tx")).agg(width, F.collect_list(cell).alias("cells"))
        local = stored(rows.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(joined, schema + ", _open boolean"))
        beyond = local.filter("_open").drop("_open")
        local = local.filter("not _open").drop("_open")
        if beyond.limit(1).count():
            local = local.unionByName(_joined_by_shuffles(beyond, rows.groupBy("image_id").agg(F.max("width").alias("width")), eight, tile))
    code = F.col("_code")
    out = local.withColumn("label", (F.shiftright(code, 32) * F.col("width") + code.bitwiseAND(0xFFFFFFFF) + 1).cast("long"))
    return out.select("image_id", "y", "x", F.col("label").cast("int") if frame else "label", *(F.col(n).alias(k) for k, n in zip(keep, kept, strict=True)))


def _joined_by_shuffles(local: DataFrame, widths: DataFrame, eight: bool, tile: int) -> DataFrame:
    """local with the least code of each component, of images of any size: neighbours across borders by a join, then rounds of stars."""
    part = lambda c: F.floor(F.col(c) / tile).cast("int")
    columns, local = local.columns, local.drop("width").join(widths.hint("merge"), "image_id")
    reach = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * eight
    here = local.select("image_id", "y", "x", F.col("_code").alias("_a"), F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in reach))).alias("d"))
    here = here.select("image_id", "_a", part("y").alias("ty"), part("x").alias("tx"), (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    here = here.filter((part("y") != F.col("ty")) | (part("x") != F.col("tx"))).select("image_id", "y", "x", "_a")
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    pairs = here.join(local.filter(edge("y") | edge("x")).select("image_id", "y", "x", F.col("_code").alias("_b")).hint("merge"), ["image_id", "y", "x"]).select("image_id", "_a", "_b")
    least = least_members(pairs, ["image_id"], "_a", "_b").select("image_id", F.col("_a").alias("_code"), F.col("_b").alias("_least"))
    return local.join(least.hint("merge"), ["image_id", "_code"], "left").withColumn("_code", F.coalesce("_least", "_code")).select(*columns)


def fill_holes(pixels: DataFrame, mask: str, frame: int | None = None, tile: int = TILE) -> DataFrame:
    """(image_id, y, x): the mask and what it encloses: background components that don't reach the frame's edge."""
    size = pixels.groupBy("image_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    border = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("_h")) | (F.col("x") == F.col("_w"))
    marked = pixels.join(size.hint("shuffle_hash"), "image_id").withColumns({"_not": ~F.col(mask), "_open": border})
    within = bool(frame and frame <= TILE)
    outside = components(marked, "_not", keep=("_open",), frame=frame, tile=tile, spread=within)
    if within:
        enclosed = outside.filter(~F.col("_open"))
    else:  # a component may be as large as an image: its pixels stay where they are
        enclosed = outside.join(outside.filter("_open").select("image_id", "label").distinct().hint("merge"), ["image_id", "label"], "left_anti")
    return pixels.filter(mask).select("image_id", "y", "x").unionByName(enclosed.select("image_id", "y", "x"))


def regions(labelled: DataFrame, heat: str, least: int = 25, top: int = 5) -> DataFrame:
    """The regions with most heat of each image: box, area, mass and share of the mass of all regions of at least `least` pixels."""
    each = labelled.groupBy("image_id", "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area"), F.sum(heat).alias("mass"))
    each = each.filter(F.col("area") >= least).withColumn("share", F.col("mass") / (F.sum("mass").over(Window.partitionBy("image_id")) + 1e-8))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(F.round("mass", 9)), "label"))).filter(F.col("rank") <= top)


def tops(heat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of planes (plane, y, x): whether a place is at least its plane's 0.9 quantile (between the two nearest values), and whether it is the plane's largest. What isn't a number doesn't count; where nothing is one, all are largest."""
    flat = np.sort(heat.reshape(len(heat), -1), axis=1)
    n = (~np.isnan(flat)).sum(1)
    at = np.maximum(n - 1, 0) * 0.9
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    every = np.arange(len(heat))
    a, b = flat[every, low], flat[every, high]
    cut = np.where(low == high, a, (high - at) * a + (at - low) * b)[:, None, None]
    most = flat[every, np.maximum(n - 1, 0)][:, None, None]
    return np.where(np.isnan(heat), np.nan, heat >= cut), ((heat == most) | np.isnan(most)).astype(float)


def focus(pixels: DataFrame, heat: str, leaf: str, lesion: str, frame: int | None = None) -> DataFrame:
    """A row an image: how much of all heat, of its peak and of its hottest tenth lies on the leaf and on lesions (with 4 pixels around, for peak and tenth).
    Images with at most 20 lesion pixels have null for what speaks of lesions, and a share of 0.
    frame: the most rows and columns of an image, where the caller knows them: pixels are then made once and nothing is joined; a pixel beyond is an error."""
    size = [c for c in ("height", "width") if c in pixels.columns]
    rows = pixels.select("image_id", "y", "x", *size, F.col(heat).alias("_heat"), F.col(leaf).alias("_leaf"), (F.col(lesion) & F.col(leaf)).alias("_ill"))
    if frame and frame <= TILE:  # a tile is an image, so its quantile is found where it lies

        def marked(h, ill):
            hot, peak = tops(h.values)
            return {"_wide": ill.framed(4, gaps=False), "_hot": h._like(hot, h.at), "_peak": h._like(peak, h.at)}

        rows = rows.withColumn("x", F.when(F.greatest("y", "x") < frame, F.col("x")).otherwise(F.raise_error(F.lit("a pixel beyond the frame"))))
        at = filtered(rows.withColumn("_m", F.col("_ill").cast("int")), ["_heat", "_m"], marked, dict.fromkeys(("_wide", "_hot", "_peak"), "boolean"), 4, ("_heat", "_leaf", "_ill"))
    else:
        marks = rows.groupBy("image_id").agg(F.expr("percentile(_heat, 0.9)").alias("_cut"), F.max("_heat").alias("_most")).hint("shuffle_hash")
        rows = rows.join(marks, "image_id").withColumns({"_hot": F.col("_heat") >= F.col("_cut"), "_peak": F.col("_heat").eqNullSafe(F.col("_most"))}).drop("_cut", "_most")
        at = framed(rows, "_ill", 4, "_wide")
    mass = lambda c: F.sum(F.when(F.col(c), F.col("_heat")).otherwise(0.0))
    bit = lambda c, n: F.coalesce(F.col(c).cast("long"), F.lit(2).cast("long")) * n  # noqa: E731  2: null
    place = F.shiftleft(F.col("y").cast("long"), 36).bitwiseOR(F.shiftleft(F.col("x").cast("long"), 4)) + bit("_leaf", 4) + bit("_wide", 1)
    part = lambda c: F.avg(F.when(F.col("_hot"), F.col(c).cast("double")))
    out = at.groupBy("image_id").agg(
        (mass("_leaf") / (F.sum("_heat") + 1e-8)).alias("on_leaf"), (mass("_ill") / (F.sum("_heat") + 1e-8)).alias("on_lesion"), F.min(F.when(F.col("_peak"), place)).alias("peak"), part("_leaf").alias("top_on_leaf"), part("_wide").alias("top_on_lesion"),
        F.sum(F.col("_ill").cast("int")).alias("lesions"), F.sum(F.col("_leaf").cast("int")).alias("leaves"),
    )
    flag = lambda n: F.nullif(F.shiftright("peak", n).bitwiseAND(3), F.lit(2).cast("long")).cast("boolean")  # noqa: E731  the first of the hottest pixels
    enough = lambda x: F.when(F.col("lesions") > 20, x)
    share = F.coalesce(enough(F.col("lesions") / F.greatest("leaves", F.lit(1))), F.lit(0.0))
    enrichment = (F.col("on_lesion") / F.greatest("on_leaf", F.lit(1e-6))) / F.greatest(share, F.lit(1e-6))
    return out.select(
        "image_id", "on_leaf", flag(2).alias("peak_on_leaf"), "top_on_leaf", enough(F.col("on_lesion")).alias("on_lesion"), enough(flag(0)).alias("peak_on_lesion"), enough(F.col("top_on_lesion")).alias("top_on_lesion"),
        share.alias("lesion_share"), enough(enrichment).alias("enrichment"),
    )


def overlap(pixels: DataFrame, a: str, b: str) -> DataFrame:
    """A row an image: pixels in either mask, in both, in `a` alone, and intersection over union (0 for two empty masks)."""
    count = lambda c: F.sum(c.cast("long"))
    x, y = F.col(a), F.col(b)
    out = pixels.groupBy("image_id").agg(count(x | y).alias("either"), count(x & y).alias("both"), count(x & ~y).alias("alone"))
    return out.withColumn("iou", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(0.0))


def affected(pixels: DataFrame, leaf: str, lesion: str, healthy: Column) -> DataFrame:
    """A row an image: lesions' share of the leaf; null for healthy images and for those without a leaf."""
    out = pixels.groupBy("image_id").agg(F.sum(F.col(leaf).cast("long")).alias("n"), F.sum((F.col(leaf) & F.col(lesion)).cast("long")).alias("ill"))
    return out.select("image_id", F.when(~healthy & (F.col("n") > 0), F.col("ill") / F.col("n")).alias("affected"))


def centres(labelled: DataFrame, weight: str, share: float = 0.15) -> DataFrame:
    """Components of at least `share` of their image's largest: area, weight and weighted centre (NaN without any weight)."""
    each = labelled.withColumn("_w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    each = each.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.sum("_w").alias("mass"), F.sum(F.col("y") * F.col("_w")).alias("_y"), F.sum(F.col("x") * F.col("_w")).alias("_x"))
    each = each.withColumn("_most", F.max("area").over(Window.partitionBy("image_id"))).filter(F.col("area") >= share * F.col("_most"))
    at = lambda c: F.when(F.col("mass") != 0, F.col(c) / F.col("mass")).otherwise(float("nan"))
    return each.select("image_id", "label", "area", "mass", at("_y").alias("cy"), at("_x").alias("cx"))


def edge_contact(pixels: DataFrame, mask: str, height: int, width: int) -> DataFrame:
    """A row an image: the mean of the mask's shares of the four edges, and how many edges it touches."""
    edges = [F.col("y") == 0, F.col("y") == height - 1, F.col("x") == 0, F.col("x") == width - 1]
    on = F.col(mask).cast("double")
    out = pixels.filter(edges[0] | edges[1] | edges[2] | edges[3]).groupBy("image_id").agg(*(F.avg(F.when(e, on)).alias(f"e{i}") for i, e in enumerate(edges)))
    shares = [F.coalesce(f"e{i}", F.lit(0.0)) for i in range(4)]
    return out.select("image_id", (sum(shares[1:], shares[0]) / 4).alias("contact"), sum(((s > 0).cast("int") for s in shares[1:]), (shares[0] > 0).cast("int")).alias("sides"))


#: Blue, green and red of the tints, and the photograph's share.
LEAF_TINT, LESION_TINT, PHOTO = (0, 200, 80), (0, 60, 255), 0.65


def tinted(pixels: DataFrame, leaf: str, lesion: str) -> DataFrame:
    """pixels with b, g, r blended with the tint of their mask, rounded to even; a lesion's tint covers the leaf's."""
    tint = lambda i: F.when(F.col(lesion), LESION_TINT[i]).when(F.col(leaf), LEAF_TINT[i]).otherwise(0)
    return pixels.withColumns({k: F.rint(F.col(k) * F.lit(PHOTO) + tint(i) * F.lit(1 - PHOTO)).cast("int") for i, k in enumerate("bgr")})
