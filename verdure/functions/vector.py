"""Array expressions: softmax, energy, ranking. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def softmax(logits, temperature: Column | float = 1.0) -> Column:
    t = F.greatest(F.lit(temperature) if isinstance(temperature, int | float) else temperature, F.lit(1e-3))
    z = F.transform(logits, lambda x: x / t)
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / total(e))


def energy(logits, temperature: float = 1.0) -> Column:
    """-T log sum exp(z / T), shifted by the largest for range."""
    z = F.transform(logits, lambda x: x / F.lit(temperature))
    top = F.array_max(z)
    return -F.lit(temperature) * (top + F.ln(total(F.transform(z, lambda x: F.exp(x - top)))))


def ranked(probabilities) -> Column:
    """array<struct<p, i>>: most probable first, equal ones by index."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("m"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda x: F.struct((-x["m"]).alias("p"), x["i"].alias("i")))


def band(value, low: float, high: float, soft: float) -> Column:
    """1 inside [low, high], falling to 0 over `soft` outside; 0 for null and non-finite values."""
    v = F.col(value) if isinstance(value, str) else value
    away = F.greatest(F.lit(low) - v, v - F.lit(high), F.lit(0.0))
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - away / F.lit(soft)))


def weighted(weights: Column, vectors: Column) -> Column:
    """Sum of the vectors (an array of arrays of one length), each by its weight."""
    size = F.size(F.get(vectors, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda j: total(F.zip_with(weights, vectors, lambda w, v: w * F.get(v, j))))


def token_pool(tokens: Column, scores: Column, tau: float = 0.5413) -> Column:
    """Tokens by the softmax of softplus(tau) times the log odds of their scores."""
    sharp = F.lit(math.log1p(math.exp(tau)))
    odds = F.transform(scores, lambda s: sharp * F.ln(F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), s)) / (1 - F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), s)))))
    return weighted(softmax(odds), tokens)


def gated_fusion(vectors: Column, logits: Column) -> Column:
    """Vectors of one width by the softmax of their logits."""
    return weighted(softmax(logits), vectors)


def grad_cam(activations: Column, gradients: Column) -> Column:
    """relu of the channels' sum at each position, a channel weighing its mean gradient. Both: an array of positions, each an array of channels."""
    n = F.size(gradients)
    alpha = F.transform(F.sequence(F.lit(0), F.size(F.get(gradients, F.lit(0))) - 1), lambda j: total(F.transform(gradients, lambda g: F.get(g, j))) / n)
    return F.transform(activations, lambda a: F.greatest(F.lit(0.0), total(F.zip_with(alpha, a, lambda w, x: w * x))))


def upsampled(cam: Column, side: int, to: int) -> Column:
    """A side x side map (by rows) by its largest value, made to x to by bilinear weights between pixel centres, cut to 0 .. 1."""
    top = F.array_max(cam)
    scaled = F.transform(cam, lambda x: F.when(top > 0, x / top).otherwise(x))

    def axis(i: Column) -> tuple[Column, Column, Column]:
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(side - 1)), (i + 0.5) * side / to - 0.5))
        low = F.floor(at)
        return low, F.least(low + 1, F.lit(side - 1)), at - low

    def value(k: Column) -> Column:
        (y0, y1, fy), (x0, x1, fx) = axis(F.floor(k / to)), axis(k % to)
        of = lambda y, x: F.get(scaled, (y * side + x).cast("int"))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (of(y0, x0) * (1 - fx) + of(y0, x1) * fx) * (1 - fy) + (of(y1, x0) * (1 - fx) + of(y1, x1) * fx) * fy))

    return F.transform(F.sequence(F.lit(0), F.lit(to * to - 1)), value)


def variance(values: Column) -> Column:
    """Variance of an array's values (of a population), a value at a time in their order: running mean and squares. Null values don't count; null without any."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def add(a: Column, v: Column) -> Column:
        n = a["n"] + 1
        mean = a["mean"] + (v - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["squares"] + (v - mean) * (v - a["mean"])).alias("squares"))

    kept = F.filter(F.transform(values, lambda v: v.cast("double")), lambda v: v.isNotNull())
    return F.aggregate(kept, start, add, lambda a: F.when(a["n"] > 0, a["squares"] / a["n"]))
