"""Operator 8, mixing sources to target weights along a time-varying curriculum.

Targets: sources share `budget` x all words by weight, none above `most` x its own words; what is over
goes to the others by weight.  The level is found from sorted caps, without iterating.
Each source's documents lie on an endless tape in the order of the md5 of id and text; the mix takes what lies
before the source's target, whole documents, the one on the border by its middle.
A source's weight changes linearly over training: 1 + tilt * (2t - 1) times its mean.  Its integral is the
source's cumulative demand; inverting it turns a tape position into a training position in [0, 1], and a
range partition by position writes the order of training.

The prefix sums that this needs go over 4096 md5 ranges a source, so that no source, however large, is
summed in one task.

Edge cases: null text has size 0; null source is a source, the last; null id counts as empty text; rows alike in
id, text and source are interchangeable, and training_order() writes the copies of all of them with the other columns of one; a source without words has target 0; an empty table gives no rows; other
columns stay in training_order() and are ignored else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

WEIGHTS, TILTS, BUDGET, MOST = (5.0, 2.0, 1.0), (0.5, 0.0, -0.5), 1.5, 2.0
RANGES = 4096


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def row_key(key: str, text: str) -> Column:
    """md5 of id and text, so that rows without an id, or with the same one, are spread as well."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sizes: (none, name, source_size), a row a source. Adds rank, weight and target."""
    by_name = Window.orderBy("none", "name")
    up = Window.orderBy("ratio", "rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    out = out.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("all", F.sum("source_size").over(every) * F.lit(float(budget))).withColumn("weights", F.sum("weight").over(every))
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("capped", level >= F.col("ratio"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(every)
    left = F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    return out.withColumn("free", free).withColumn("left", left).withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("left") / F.col("free")))).select("none", "name", "source_size", "rank", "target")


def curriculum(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, tilts=TILTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Columns key, source, size, source_size, target, taken, positions (of each copy taken, rising), row_key (see there). The work's rows hold no texts."""
    order = row_key(key, text)
    docs = c.checkpointed(docs.select(F.col(key).alias("key"), F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"), words(text).alias("size"), order.alias("order")).withColumn("range", F.conv(F.substring("order", 1, 3), 16, 10).cast("int")))
    ranges = c.checkpointed(docs.groupBy("none", "name", "range").agg(F.sum("size").alias("range_size")))
    goal = targets(ranges.groupBy("none", "name").agg(F.sum("range_size").alias("source_size")), weights, budget, most)
    starts = ranges.join(goal, ["none", "name"]).withColumn("start", F.sum("range_size").over(Window.partitionBy("none", "name").orderBy("range")) - F.col("range_size")).drop("range_size")
    within = Window.partitionBy("none", "name", "range").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("here", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["none", "name", "range"])
    docs = docs.withColumn("at", F.col("start") + F.col("here"))
    place = lambda j: F.col("at") + F.col("source_size") * j
    copies = F.filter(F.array(*map(F.lit, range(int(-(-most // 1))))), lambda j: (F.col("size") > 0) & (place(j) + F.col("size") / F.lit(2.0) < F.col("target")))
    tilt = F.element_at(F.array(*map(F.lit, tilts)), ((F.col("rank") - 1) % len(tilts) + 1).cast("int"))

    def position(j: Column) -> Column:
        """t with t + g (t*t - t) = the part of the demand before this copy."""
        part, g = F.least(place(j) / F.col("target"), F.lit(1.0)), F.col("tilt")
        return F.when(g == 0, part).otherwise((g - 1 + F.sqrt((1 - g) * (1 - g) + 4 * g * part)) / (2 * g)) + F.lit(0.0)  # no negative zero

    docs = docs.withColumn("copies", copies).withColumn("tilt", tilt)
    return docs.select(
        F.col("key").alias(key), F.when(~F.col("none"), F.col("name")).alias(source), "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("size") * F.size("copies")).cast("long").alias("taken"), F.transform("copies", position).alias("positions"), F.col("order").alias("row_key"),
    )


def training_order(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, a row for each copy taken, with `position` (in place of a column of that name), range-sorted by it. mixed: curriculum(docs)."""
    columns = [n for n in docs.columns if n != "position"]
    docs = docs.select(*(F.col(n).alias(f"_c{i}") for i, n in enumerate(columns)))  # columns of any name pass through
    of = [f"_c{columns.index(n)}" for n in (key, text, source)]
    one = lambda k, s: F.concat(k, F.lit(":"), F.coalesce(F.concat(F.lit("="), s.cast("string")), F.lit("")))
    docs = docs.withColumn("_row", one(row_key(of[0], of[1]), F.col(of[2]))).dropDuplicates(["_row"])
    taken = mixed.filter(F.size("positions") > 0).select(one(F.col("row_key"), F.col(source)).alias("_row"), "positions").groupBy("_row").agg(F.flatten(F.collect_list("positions")).alias("positions"))
    out = docs.join(taken, "_row").select(*docs.columns[:-1], F.explode("positions").alias("position"))
    return out.repartitionByRange(F.col("position"), F.col(of[0])).sortWithinPartitions("position", of[0]).toDF(*columns, "position")


def op8_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    mixed = curriculum(c.table(spark, sf_dir, "documents"))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", (F.round(F.get("positions", F.lit(0)), 9) + F.lit(0.0)).alias("position"))
    return out.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS ord FROM documents),
z AS (SELECT none, name, sum(size)::BIGINT AS source_size FROM d GROUP BY none, name),
s AS (SELECT *, row_number() OVER (ORDER BY none, name) AS rank FROM z),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap,
  [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][((rank - 1) % 3 + 1)::INT] AS g FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights,
  coalesce(sum(cap) OVER up, 0) AS caps_before, coalesce(sum(weight) OVER up, 0) AS weights_before FROM w
  WINDOW up AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, (total - caps_before) / (weights - weights_before) >= cap / weight AS capped FROM l),
t AS (SELECT *, CASE WHEN capped THEN cap ELSE weight * ((total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target FROM k),
p AS (SELECT doc_id, size, source_size, target, g,
  coalesce(sum(size) OVER (PARTITION BY d.none, d.name ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t USING (none, name)),
q AS (SELECT *, size > 0 AND start + size / 2.0::DOUBLE < target AS one, size > 0 AND start + source_size + size / 2.0::DOUBLE < target AS two, least(start / target, 1.0::DOUBLE) AS part FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target, (size * (one::INT + two::INT))::BIGINT AS taken,
  round(CASE WHEN NOT one THEN NULL WHEN g = 0 THEN part ELSE (g - 1 + sqrt((1 - g) * (1 - g) + 4 * g * part)) / (2 * g) END, 9) + 0.0::DOUBLE AS position
FROM q
"""
