"""Event streams: progress lines of a diagnosis, and a bounded history for each user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.gate import stops_early
from ..operators.scoring import HISTORY, newest


def progress(done: Column, models: Column) -> Column:
    """Per cent while models run: 40 and 45 for all of them, whole numbers."""
    return (F.lit(40) + F.floor(F.lit(45) * done / models)).cast("int")


#: Stages, their per cent and place; those of models lie between.
STAGES = {"decode": (5, 1), "segment": (15, 2), "leafcheck": (30, 3), "advice": (92, 100_000)}


def analysis(requests: DataFrame, key: str) -> DataFrame:
    """(key, seq, type, stage, pct, detail): the events of each request in order; the last is a `result` or, for a request that failed, an `error`.

    requests: key, models (array of names), veto (of the first pass, or null), rejected (by the second pass), error (text or null). A failed request has one row, the error;
    a first-pass veto other than a low confidence ends after the segmentation, a rejection after the leaf check; else each model has a progress and a partial event."""
    event = lambda type_, stage, pct, detail, place: F.struct(F.lit(place).cast("int").alias("place") if isinstance(place, int) else place.cast("int").alias("place"), F.lit(type_).alias("type"), stage.alias("stage"), pct.cast("int").alias("pct"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    stage = lambda n: event("progress", F.lit(n), F.lit(STAGES[n][0]), none, STAGES[n][1])
    ends = lambda how: event("result", F.lit(how), none, none, 100_001)
    text = none.cast("string")
    each = F.flatten(F.transform("models", lambda m, i: F.array(event("progress", F.lit("predict"), progress(i, F.size("models")), m, 10 + 2 * i), event("partial", text, none, m, 11 + 2 * i))))
    start = F.array(stage("decode"), stage("segment"))
    rows = (
        F.when(F.col("error").isNotNull(), F.array(event("error", text, none, F.col("error"), 0))).when(stops_early(F.col("veto")), F.concat(start, F.array(ends("gate")))).when(F.size("models") == 0, F.concat(start, F.array(ends("setup"))))
        .when(F.col("rejected"), F.concat(start, F.array(stage("leafcheck"), ends("gate")))).otherwise(F.concat(start, F.array(stage("leafcheck")), each, F.array(stage("advice"), ends("done"))))
    )
    return requests.select(key, F.posexplode(F.array_sort(rows)).alias("seq", "x")).select(key, "seq", "x.type", "x.stage", "x.pct", "x.detail")


def lines(events: DataFrame, columns: list[str]) -> DataFrame:
    """NDJSON: a JSON object a row, nulls kept."""
    return events.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def last_results(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """A row a key: the columns of its last event. A partial maximum goes into the shuffle, not the events."""
    last = events.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("_last"))
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in (order, *columns)))


#: Owners are dealt to so many buckets; a batch rewrites only those of its own owners.
BUCKETS = 64


def _forget(spark: SparkSession, out: str, number: int) -> None:
    """Removes what no batch from `number` on reads: of each bucket all versions before the newest one that is older than `number`. Folders only, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    older: dict[str, list] = {}
    for v in fs.listStatus(root):
        name = v.getPath().getName()
        if name.startswith("version=") and int(name[8:]) < number:
            for b in fs.listStatus(v.getPath()):
                if b.isDirectory():
                    older.setdefault(b.getPath().getName(), []).append((int(name[8:]), b.getPath()))
    for versions in older.values():
        for version, path in sorted(versions, key=lambda x: x[0])[:-1]:
            if version >= 0:  # the first, empty one holds the schema's place
                fs.delete(path, True)


def history_stream(spark: SparkSession, source: str, file: str, schema: str, owner: str, order: list[str], out: str, checkpoint: str, keep: int = HISTORY) -> DataFrame:
    """Reads the files of `source` that match `file`, or of the folders that do, as a stream and keeps each owner's newest rows in the folder `out`: a version of a bucket of owners for each batch that has rows of it; returns the last version of each.

    A batch builds on the versions before its own and overwrites its own, so a stream that starts again from its checkpoint goes on where it stopped. Of each bucket at most two versions stay: the batch's
    own and the one that it was built on."""
    stream = spark.readStream.schema(schema).parquet(f"{source}/{file}")
    columns = stream.columns
    kept = StructType([*stream.schema.fields, StructField("version", IntegerType()), StructField("bucket", IntegerType())])
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{out}/version=-1/bucket=0")

    def last(before: int | None, buckets: DataFrame | None) -> DataFrame:
        versions = spark.read.schema(kept).parquet(out)
        versions = versions if before is None else versions.filter(F.col("version") < before)
        newest_of = versions.groupBy("bucket").agg(F.max("version").alias("version"))
        newest_of = newest_of if buckets is None else newest_of.join(buckets, "bucket", "left_semi")
        return versions.join(F.broadcast(newest_of), ["bucket", "version"]).select(*columns, "bucket")

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(owner), F.lit(BUCKETS)).cast("int"))
        rows = last(number, rows.select("bucket").distinct()).unionByName(rows)
        newest(rows, owner, *(F.desc(c) for c in order), keep=keep).drop("r").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/version={number}")
        _forget(spark, out, number)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last(None, None).select(*columns)
