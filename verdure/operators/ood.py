"""Out-of-distribution scores: class means, Mahalanobis distances, empirical p-values, AUROC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .. import shared_folder, ship


def class_means(rows: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, pos, mean, n). Long form: partial sums before the shuffle."""
    return rows.select(F.col(label).alias("label"), F.posexplode(vec).alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def mean_table(rows: DataFrame, label: str, vec: str) -> list[tuple[int, list[float]]]:
    """Classes times dimensions numbers: a bounded state, kept on the driver."""
    got = class_means(rows, label, vec).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("mean")).collect()
    return sorted((r.label, list(r["mean"])) for r in got)


def relative_mahalanobis(rows: DataFrame, vec: str, means: list[tuple[int, list[float]]], overall: list[float], precision: np.ndarray | None = None, precision0: np.ndarray | None = None) -> DataFrame:
    """Adds nearest (label), distance and rmd = min over classes of d_c, less d_0; null for rows without a vector. Precisions default to the identity.

    One Arrow pass multiplies a batch of vectors by the factors of both precisions: |L'x - L'm|**2 is the form of LL'."""
    ship(rows.sparkSession)
    centres, mu = np.array([m for _, m in means], float), np.array(overall, float)
    d = centres.shape[1]
    factor, factor0 = (np.eye(d) if p is None else np.linalg.cholesky(p) for p in (precision, precision0))
    labels, centres, mu = np.array([k for k, _ in means], np.int32), centres @ factor, mu @ factor0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_vec")
            there = np.array(column.is_valid())
            x = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            own = x @ factor
            each = np.stack([((own - m) ** 2).sum(1) for m in centres], 1) if len(x) else np.zeros((0, len(labels)))
            best, base = each.argmin(1) if len(x) else np.zeros(0, int), ((x @ factor0 - mu) ** 2).sum(1)
            least = each[np.arange(len(x)), best]
            full = lambda v, kind: pa.array(_spread(v, there), kind, mask=~there)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), full(labels[best], pa.int32()), full(least, pa.float64()), full(least - base, pa.float64())], names=[*names, "nearest", "distance", "rmd"])

    names = [f"_c{i}" for i in range(len(rows.columns))]
    named = rows.toDF(*names).withColumn("_vec", F.col(names[rows.columns.index(vec)]).cast("array<double>"))
    schema = StructType([*named.drop("_vec").schema.fields, StructField("nearest", IntegerType()), StructField("distance", DoubleType()), StructField("rmd", DoubleType())])
    return named.mapInArrow(measure, schema).toDF(*rows.columns, "nearest", "distance", "rmd")


def _spread(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    out = np.zeros(len(there), values.dtype)
    out[there] = values
    return out


def ledoit_wolf(rows: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, precision, shrinkage)."""
    mu, covariance, shrink = shrunk_covariance(rows, vec)
    return mu, np.linalg.inv(covariance), shrink


def shrunk_covariance(rows: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, shrinkage) from sums that Spark makes: d*d products and d*d squared products a task, whatever the number of rows."""
    ship(rows.sparkSession)
    x = rows.select(F.col(vec).cast("array<double>").alias("v"))
    n = x.count()
    mean = {r.pos: r.m for r in x.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).collect()}
    mu = np.array([mean[i] for i in range(len(mean))])
    centred = x.select(F.zip_with("v", F.array(*map(F.lit, map(float, mu))), lambda a, b: a - b).alias("v"))
    d = len(mu)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, q = np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            v = batch.column(0).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            s += v.T @ v
            q += (v * v).T @ (v * v)
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), s.ravel(), q.ravel())], names=["i", "j", "s", "q"])

    sums = centred.mapInArrow(products, "i int, j int, s double, q double").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    s, q = np.zeros((d, d)), np.zeros((d, d))
    for r in sums:
        s[r.i, r.j], q[r.i, r.j] = r.s / n, r.q
    scale = np.trace(s) / d
    spread = ((s - scale * np.eye(d)) ** 2).sum()
    noise = min((q.sum() / n - (s * s).sum()) / n, spread)
    shrink = float(noise / spread) if spread else 0.0
    return mu, (1 - shrink) * s + shrink * scale * np.eye(d), shrink


def running(counts: DataFrame, value: str, *sums: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """counts with, for each of `sums`, `<name>_below`: its sum over the group's rows of a smaller value (values differ within a group).

    Values are dealt out in ranges; only the sums of ranges are added up together, the rest inside each range. So no task holds a whole group."""
    shared_folder(counts.sparkSession)
    dealt = counts.repartitionByRange(*groups, value).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*groups, "_range"]
    ranges = dealt.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in sums))
    ranges = ranges.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.coalesce(F.sum(x).over(before(groups, "_range")), F.lit(0)).alias(f"_{x}") for x in sums))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = dealt.join(ranges, same)
    return out.select(*counts.columns, *((F.col(f"_{x}") + F.coalesce(F.sum(x).over(before(keys, value)), F.lit(0))).alias(f"{x}_below") for x in sums))


def placed(rows: DataFrame, group: str, value: str, reference: DataFrame, of_group: str, of_value: str) -> DataFrame:
    """Adds `below`, how many values the row's group has in `reference` that are less than the row's, and `all`, how many it has. Null values are no values and have no place.

    A merge of two sorted sides: equal values of the reference are counted first, then both sides are dealt out together in ranges of (group, value), rows of equal value
    over several ranges if there are many. A range adds up what it holds; the sums of the ranges before it, a row for each group and range, come by a join.
    No side is broadcast whole, no value is joined, and no task holds a group."""
    shared_folder(rows.sparkSession)
    columns = rows.columns
    ours = rows.select(F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(columns))).alias("_row"), F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_c"), F.monotonically_increasing_id().alias("_salt"))
    counts = reference.filter(F.col(of_value).isNotNull()).groupBy(F.col(of_group).alias("_g"), F.col(of_value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    theirs = counts.select(F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), F.col("_g").cast(ours.schema["_g"].dataType).alias("_g"), "_v", F.lit(1).alias("_side"), "_c", F.lit(0).cast("long").alias("_salt"))
    dealt = ours.unionByName(theirs).repartitionByRange("_g", "_v", "_side", "_salt").withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_g", "_range").agg(F.sum("_c").alias("_here")).select(F.col("_g").alias("_h"), F.col("_range").alias("_r"), F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"), F.sum("_here").over(Window.partitionBy("_g")).alias("_all"))
    within = Window.partitionBy("_g", "_range").orderBy("_v", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_within", F.sum("_c").over(within)).filter("_side = 0").join(ranges, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_range") == F.col("_r")))
    return out.select(*(F.col(f"_row.c{i}").alias(n) for i, n in enumerate(columns)), F.when(F.col("_v").isNotNull(), F.col("_before") + F.col("_within")).alias("below"), F.col("_all").alias("all"))


def p_values(rows: DataFrame, group: str, value: str, reference: DataFrame | None = None, of_group: str | None = None, of_value: str | None = None) -> DataFrame:
    """Adds p: the share of the reference's values in the row's group that are at least the row's; null without such a group. The reference is the rows' own values if none is given."""
    out = placed(rows, group, value, rows if reference is None else reference, of_group or group, of_value or value)
    return out.withColumn("p", F.when(F.col("all") > 0, 1 - F.col("below") / F.col("all"))).drop("below", "all")


def positions(rows: DataFrame, groups: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Adds each row's place in its group, from 0, in the order of the columns `order` (rows that are alike in them in any): ranges, counted one by one."""
    shared_folder(rows.sparkSession)
    keys = [*groups, "_range"]
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*groups, *order, "_salt").withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*keys).agg(F.count("*").alias("_n")).select(*(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_salt")) - 1).join(ranges, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return out.select(*rows.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, share, quantile): exact, between neighbours by weight. Null values are none; a group without values has no rows.

    Equal values are counted, counts added up over ranges, and only the values at the wanted places go on: two a group and share. No task holds a group."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    ranked = running(counts, "_v", "_c", groups=("_g",)).checkpoint()
    every = ranked.groupBy(F.col("_g").alias("_h")).agg(F.sum("_c").alias("_n"))
    at = ranked.join(every, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_v", "_c", "_c_below", F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("at")) for q in shares))).alias("x"))
    low, high = F.floor("x.at"), F.ceil("x.at")
    holds = lambda k: (F.col("_c_below") <= k) & (F.col("_c_below") + F.col("_c") > k)
    at = at.filter(holds(low) | holds(high)).groupBy("_g", "x.q").agg(F.max(F.when(holds(low), F.col("_v"))).alias("a"), F.max(F.when(holds(high), F.col("_v"))).alias("b"), F.max("x.at").alias("at"))
    return at.select(F.col("_g").alias(group), F.col("q").alias("share"), (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("quantile"))


def separation(rows: DataFrame, score: str, inside: str) -> DataFrame:
    """One row: auroc (mid ranks), fpr95, n_in, n_out. Works on the distinct scores' counts; the 5 % cut is found among the running counts of the inner scores."""
    counts = rows.filter(F.col(score).isNotNull() & F.col(inside).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(inside).cast("long")).alias("a"), F.sum((~F.col(inside)).cast("long")).alias("b"))
    ranked = running(counts, "s", "a", "b").checkpoint()
    n_in = ranked.agg(F.sum("a").alias("n")).first().n or 0
    at = 0.05 * max(0, n_in - 1)
    held = lambda k: F.max(F.when((F.col("a") > 0) & (F.col("a_below") <= k) & (F.col("a_below") + F.col("a") > k), F.col("s")))
    low, high = ranked.agg(held(int(at)).alias("x"), held(min(int(at) + 1, max(0, n_in - 1))).alias("y")).first()
    cut = None if low is None else float(low) + (at - int(at)) * (float(high) - float(low))
    sums = ranked.agg(F.sum(F.col("a") * (F.col("b_below") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n_in"), F.sum("b").alias("n_out"), F.sum(F.when(F.col("s") >= F.lit(cut), F.col("b")).otherwise(0)).alias("above"))
    return sums.select((F.col("u") / (F.col("n_in") * F.col("n_out"))).alias("auroc"), (F.col("above") / F.col("n_out")).alias("fpr95"), "n_in", "n_out")
