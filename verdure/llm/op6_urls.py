"""Operator 6, URL filters: hash-prefix lists with host-suffix and path-prefix expressions.

Every distinct URL becomes the expressions a rule could be written as: its host's suffixes, each with the
path's prefixes, of the (labels, path length) shapes that rules have.  Expressions meet rules in an equi-join
on the first 32 bits of their SHA-256; the full digests confirm.  The longest confirmed rule wins, of equally
long ones a block.  Rules are broadcast while they are at most BROADCAST_RULES, else both sides are shuffled.

Edge cases: a null URL, or one without "://", has an empty host and path and no rule but the method's own verdict;
repeated rows are judged each; an empty table gives no rows; an empty rule table leaves all to `otherwise`; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BROADCAST_RULES = 100_000


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(expression) -> Column:
    return F.sha2(F.encode(expression, "UTF-8"), 256)


def url_verdicts(urls: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict added. rules: (verdict, host, path), hosts in lower case."""
    labels = F.size(F.split("host", r"\."))
    listed = rules.select("verdict", F.concat("host", "path").alias("rule"), labels.alias("labels"), F.length("path").alias("chars"), digest(F.concat("host", "path")).alias("digest")).dropDuplicates(["rule", "verdict"])
    shapes = [(r.labels, r.chars) for r in listed.select("labels", "chars").distinct().collect()]  # at most a host's labels times a path's length
    keyed = listed.withColumn("prefix", F.substring("digest", 1, 8)).select("prefix", F.col("digest").alias("full"), "rule", F.col("verdict").alias("ruled"))
    if rules.count() <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    h, p = host_and_path("_url")
    parts = F.split("host", r"\.")
    every = F.array(*(F.when((F.size(parts) >= n) & (F.length("path") >= m), F.concat(F.array_join(F.slice(parts, F.size(parts) - n + 1, F.lit(n)), "."), F.substring("path", 1, m))) for n, m in shapes)) if shapes else F.array().cast("array<string>")
    found = urls.select(F.col(url).alias("_url")).distinct().withColumn("host", h).withColumn("path", p).filter((F.col("host") != "") | (F.col("path") != ""))
    found = found.select("_url", F.explode(F.array_compact(every)).alias("expression")).withColumn("digest", digest(F.col("expression"))).withColumn("prefix", F.substring("digest", 1, 8))
    found = found.join(keyed, "prefix").filter(F.col("digest") == F.col("full"))
    best = found.groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("ruled") == "block").alias("block"), "rule", "ruled")).alias("_best"))
    out = urls.join(best, urls[url] == best["_url"], "left")
    h, p = host_and_path(url)
    return out.withColumn("host", h).withColumn("path", p).withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.coalesce("_best.ruled", F.lit(otherwise))).drop("_url", "_best")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_verdicts(c.table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(v, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, host, path, (SELECT rh || rp || '|' || v FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS won FROM h)
SELECT page_id, host, path, split_part(won, '|', 1) AS rule, coalesce(split_part(won, '|', 2), 'allow') AS verdict FROM m
"""
