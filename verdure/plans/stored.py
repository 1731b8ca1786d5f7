"""Queries that write files from the tables and read them back: uploads, photographs, manifests, side files, plain CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import shared_folder
from ..functions import names
from ..sources import files, named
from .catalogue import _t, query
from .photos import _PHOTO, _photos

_ENDINGS = ("png", "JPG", "txt", "webp", "")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


_NAME = "'doc-' || doc_id || " + "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{'.' + e if e else ''}'" for i, e in enumerate(_ENDINGS)) + " END"
_MOST = 4000


@query(f"WITH f AS (SELECT {_NAME} AS name, doc_id % 5 AS e, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS text FROM documents), b AS (SELECT *, octet_length(encode(text)) AS bytes FROM f) SELECT name, bytes, CASE WHEN e = 2 THEN 'unsupported extension' WHEN bytes = 0 THEN 'empty file' WHEN bytes > {_MOST} THEN 'file too large' END AS error, CASE WHEN e = 2 OR bytes = 0 OR bytes > {_MOST} THEN NULL ELSE sha256(text) END AS sha256 FROM b")
def uploaded_files(spark, d):
    """A file for each document, some empty, some with endings that aren't taken: what is wrong with each, and the digest of those that can be taken."""
    rows = _t(spark, d, "documents")
    end = F.element_at(F.array(*(F.lit(f".{e}" if e else "") for e in _ENDINGS)), (F.col("doc_id") % 5 + 1).cast("int"))
    folder = _folder(spark)
    named.write(rows.select(F.concat(F.lit("doc-"), "doc_id", end).alias("name"), F.encode(F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text")), "UTF-8").alias("content")), folder)
    out = files.uploads(spark, folder, _MOST).withColumn("name", F.substring_index("path", "/", -1)).filter(F.col("name") != named.MANIFEST)
    return out.select("name", F.col("length").alias("bytes"), "error", F.when(F.col("error").isNull(), F.sha2("content", 256)).alias("sha256"))


@query(f"WITH {_PHOTO} SELECT image_id, any_value(height) AS height, any_value(width)::INT AS width, sum(b)::BIGINT AS b, sum(g)::BIGINT AS g, sum(r * (y * 3 + x))::BIGINT AS r FROM px GROUP BY image_id")
def decoded_photos(spark, d):
    """Photos encoded, written as files, found and decoded by Spark's image source, and unpacked to pixels."""
    folder = _folder(spark)
    named.write(files.png(_photos(spark, d)).select(F.concat(F.col("image_id"), F.lit(".png")).alias("name"), "content"), folder)
    px = files.decoded(spark, folder, pattern="*.png").withColumn("image_id", F.substring_index(F.substring_index("image_id", "/", -1), ".", 1).cast("long"))
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return px.groupBy("image_id").agg(F.max("height").alias("height"), F.max("width").alias("width"), total("b"), total("g"), F.sum((F.col("r") * (F.col("y") * 3 + F.col("x"))).cast("long")).alias("r"))


@query("SELECT 'page-' || page_id || '.html' AS name, octet_length(encode(html)) AS bytes, sha256(html) AS sha256, true AS sound FROM pages")
def written_manifest(spark, d):
    """A file for each page, the manifest that the write's commit left, and whether each file is as the manifest has it."""
    folder = _folder(spark)
    named.write(_t(spark, d, "pages").select(F.concat(F.lit("page-"), "page_id", F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content")), folder)
    there = named.read(spark, folder).select("name", F.sha2("content", 256).alias("_sha"), F.col("bytes").alias("_bytes"))
    out = named.manifest(spark, folder).join(there, "name", "left")
    return out.select("name", "bytes", "sha256", (F.col("sha256").eqNullSafe(F.col("_sha")) & F.col("bytes").eqNullSafe(F.col("_bytes"))).alias("sound"))


@query("SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'missing' END AS error, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN s_name END AS supplier, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN s_acctbal::DOUBLE END AS balance, CASE WHEN s_suppkey % 3 <> 0 THEN md5(CASE WHEN s_suppkey % 5 = 0 THEN '{' ELSE '' END || s_name) END AS seen FROM supplier")
def side_files(spark, d):
    """A JSON file for each supplier, a third of them missing and some cut short: a row for each asked name, null for what isn't there or can't be read."""
    rows, folder = _t(spark, d, "supplier"), _folder(spark)
    name = F.concat(F.lit("supplier-"), "s_suppkey", F.lit(".json"))
    whole = F.to_json(F.struct(F.col("s_name").alias("supplier"), F.col("s_acctbal").cast("double").alias("balance")))
    broken = F.col("s_suppkey") % 5 == 0
    named.write(rows.filter("s_suppkey % 3 <> 0").select(name.alias("name"), F.encode(F.when(broken, F.concat(F.lit("{"), "s_name")).otherwise(whole), "UTF-8").alias("content")), folder)
    # every supplier's file is asked for, those that were never written too: their names go through a file of names
    named.write(rows.filter("s_suppkey % 3 = 0").select(name.alias("name"), F.encode(F.lit(""), "UTF-8").alias("content")), f"{folder}-asked")
    listed = named.manifest(spark, folder).select("name").unionByName(named.manifest(spark, f"{folder}-asked").select("name"))
    got = named.read_named(listed, folder)
    x = named.json_or_null("content", "supplier string, balance double")
    text = F.decode("content", "UTF-8")
    seen = F.md5(F.encode(F.when(x.isNull(), text).otherwise(x["supplier"]), "UTF-8"))
    return got.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("key"), "error", x["supplier"].alias("supplier"), x["balance"].alias("balance"), F.when(F.col("error").isNull(), seen).alias("seen"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN contains(c, '.') AND abs(try_cast(c AS DOUBLE)) <= 1 THEN printf('%.2f', try_cast(c AS DOUBLE) * 100) || '%' ELSE c END AS cell, 9::INT AS columns FROM (SELECT l_orderkey, l_linenumber, l_discount::VARCHAR AS c FROM lineitem)")
def plain_csv_files(spark, d):
    """Lines written as text and split at commas, without quoting, to the first nine columns."""
    rows, folder = _t(spark, d, "lineitem"), _folder(spark)
    cells = ["l_orderkey", "l_linenumber", "l_returnflag", F.col("l_discount").cast("string"), "l_quantity", "l_tax", "l_linestatus", "l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate"]
    rows.select(F.concat_ws(",", *cells).alias("value")).write.text(folder)
    c = F.col("cells")
    return files.plain_csv(spark, folder).select(c[0].cast("long").alias("l_orderkey"), c[1].cast("int").alias("l_linenumber"), names.percent_cell(c[3]).alias("cell"), F.size(c).alias("columns"))
