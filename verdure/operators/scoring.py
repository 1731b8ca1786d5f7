"""Classifier outputs: calibrated probabilities, top classes, advice level, votes of several models, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector

CONFIDENT, ADVICE_HIGH, ADVICE_MODERATE, HISTORY = 0.60, 0.85, 0.60, 25


def advice_level(confidence) -> Column:
    x = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(x >= ADVICE_HIGH, "high").when(x >= ADVICE_MODERATE, "moderate").otherwise("low")


def healthy(name) -> Column:
    return F.contains(F.lower(F.col(name) if isinstance(name, str) else name), F.lit("healthy"))


def input_error(cls: str, confidence: str, known) -> Column:
    """Null for a class that is known and a confidence in 0 .. 1, else what is wrong."""
    x = F.col(confidence)
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    return F.when(F.col(cls).isNull() | ~F.col(cls).isin(*known), "unknown class").when(bad, "confidence must be in [0, 1]")


def model_or_default(asked: str, available: str, preferred: str) -> Column:
    """The model asked for if it is in the array of available ones, else the preferred one if that is, else the first; null if there is none."""
    first = F.get(F.col(available), F.lit(0))
    default = F.when(F.array_contains(available, preferred), F.lit(preferred)).otherwise(first)
    return F.when(F.array_contains(F.col(available), F.col(asked)), F.col(asked)).otherwise(default)


def classify(outputs: DataFrame, logits: str = "logits", temperature: Column | float = 1.0, top: int = 5) -> DataFrame:
    """Adds class_id, confidence, confident and top (array of struct<p, i>)."""
    out = outputs.withColumn("_p", vector.softmax(logits, temperature)).withColumn("_r", vector.ranked("_p"))
    out = out.withColumn("class_id", F.get("_r", F.lit(0))["i"]).withColumn("confidence", F.get("_r", F.lit(0))["p"])
    return out.withColumn("confident", F.col("confidence") >= CONFIDENT).withColumn("top", F.slice("_r", 1, top)).drop("_p", "_r")


def consensus(votes: DataFrame, image: str, cls: str, confidence: str, order: str) -> DataFrame:
    """A row an image: the class with the largest summed confidence (ties: the first model's), its votes, all votes, and the row shown first:
    the default model's if it voted for that class, else the most confident voter's. order: a model's place, 0 the default."""
    by_class = votes.groupBy(image, cls).agg(F.sum(confidence).alias("weight"), F.count("*").alias("agree"), F.min(order).alias("first"))
    best = Window.partitionBy(image).orderBy(F.desc(F.round("weight", 9)), "first")
    chosen = by_class.withColumn("r", F.row_number().over(best)).withColumn("votes", F.sum("agree").over(Window.partitionBy(image))).filter("r = 1")
    main = Window.partitionBy(image).orderBy(F.desc(F.col(order) == 0), F.desc(confidence), order)
    shown = votes.join(chosen.select(image, cls), [image, cls]).withColumn("r", F.row_number().over(main)).filter("r = 1").select(image, F.col(order).alias("main"))
    return chosen.join(shown, image).select(image, F.col(cls).alias("winner"), "weight", "agree", "votes", "main")


def newest(rows: DataFrame, owner: str, *order: Column, keep: int = HISTORY) -> DataFrame:
    """The `keep` newest rows of each owner. A rank filter, so Spark drops rows before the shuffle too."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).filter(F.col("r") <= keep)


def search(rows: DataFrame, words: str, *columns: str) -> DataFrame:
    """Rows whose columns, joined by spaces, hold `words`, whatever the case; nulls are left out of the text."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(words.lower())))


def fidelity(rows: DataFrame, key: str, logits: tuple[str, str], maps: tuple[str, str], most_p: float = 6e-5, most_map: float = 2e-3) -> DataFrame:
    """(key, runs, probability_difference, cam_difference, equal): what two runs of one model give for the same rows: the largest absolute difference of any probability, and of any
    place of a map that is cut at 0 and divided by its own largest value."""
    apart = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    scaled = lambda m: F.transform(m, lambda x: F.greatest(x, F.lit(0.0)) / F.greatest(F.array_max(m), F.lit(1e-8)))
    each = rows.select(key, *(vector.softmax(c).alias(f"_p{i}") for i, c in enumerate(logits)), *(scaled(c).alias(f"_m{i}") for i, c in enumerate(maps)))
    out = each.groupBy(key).agg(F.count("*").alias("runs"), F.max(apart("_p0", "_p1")).alias("_p"), F.max(apart("_m0", "_m1")).alias("_m"))
    return out.select(key, "runs", F.round("_p", 9).alias("probability_difference"), F.round("_m", 9).alias("cam_difference"), ((F.col("_p") <= most_p) & (F.col("_m") <= most_map)).alias("equal"))
