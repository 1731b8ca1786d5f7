"""Connected components of a graph of pairs, by rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared_folder


def least_members(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, a, b): for every member `a` of a component but the least, the least member `b`. pairs: (keys, a, b), undirected, within the same keys.

    A round links every member's larger neighbours to its least neighbour, then all its smaller ones; the number of rounds grows with the logarithm of
    the longest way. Each round is written to the shared folder, so a lost executor costs a round at most, and no component is gathered anywhere."""
    shared_folder(pairs.sparkSession)
    u, v, m = F.col("_u"), F.col("_v"), F.col("_m")
    named = pairs.select(*keys, F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")).filter(u != v).distinct().checkpoint()
    before = None
    while True:
        both = named.unionByName(named.select(*keys, v.alias("_u"), u.alias("_v")))
        least = both.groupBy(*keys, "_u").agg(F.least(F.min("_v"), u).alias("_m"))
        large = both.join(least.hint("merge"), [*keys, "_u"]).filter(v > u).select(*keys, v.alias("_u"), m.alias("_v")).distinct()
        small = large.groupBy(*keys, "_u").agg(F.min("_v").alias("_m"))
        linked = large.join(small.hint("merge"), [*keys, "_u"]).filter(v != m).select(*keys, v.alias("_u"), m.alias("_v"))
        named = linked.unionByName(small.select(*keys, "_u", m.alias("_v"))).filter(u != v).distinct().checkpoint()
        now = tuple(named.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "_u", "_v"))).first())
        if now == before or not now[0]:
            return named.select(*keys, u.alias(a), v.alias(b))
        before = now
