"""Files by name, uploads, images: round trips and what is wrong with them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.sources import files, named


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [("a.json", b'{"x": 1, "y": "z"}'), ("b.json", b'{"x": '), ("empty.png", b""), ("big.jpg", b"1234567890"), ("name", b"ok"), ("no.gif", b"gif"), ("nothing.png", None)]
    named.write(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "f"))
    return str(tmp_path / "f")


def test_named_files_and_missing_ones(spark, folder):
    got = named.read(spark, folder, ["a.json", "zz", "b.json", "empty.png"], slice=1).withColumn("j", named.json_or_null("content", "x int, y string")).collect()
    assert [(r.name, r.bytes, r.error, r.j and tuple(r.j)) for r in sorted(got)] == [("a.json", 18, None, (1, "z")), ("b.json", 6, None, None), ("empty.png", 0, None, None), ("zz", None, "missing", None)]
    assert named.read(spark, folder, []).count() == 0
    asked = spark.createDataFrame([("a.json",), ("zz",), ("a.json",)], "name string")
    assert sorted((r.name, r.bytes, r.error or "") for r in named.read_named(asked, folder).collect()) == [("a.json", 18, ""), ("a.json", 18, ""), ("zz", None, "missing")]


def test_manifest_lists_what_was_written(spark, folder):
    got = {r.name: r.bytes for r in named.manifest(spark, folder).collect()}
    assert got == {"a.json": 18, "b.json": 6, "empty.png": 0, "big.jpg": 10, "name": 2, "no.gif": 3, "nothing.png": 0}
    assert set(json.load(open(f"{folder}/manifest.json"))["files"]) == set(got)
    assert sorted(r.name for r in named.read(spark, f"file://{folder}").collect()) == sorted(got)  # without names: the manifest's
    assert named.manifest(spark, f"{folder}-none").count() == 0 and named.read(spark, f"{folder}-none").count() == 0


def test_uploads(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: (r.error, r.content is None) for r in files.uploads(spark, folder, most=9).collect()}
    assert got.pop("manifest.json") == ("unsupported extension", True)
    assert got == {"a.json": ("unsupported extension", True), "b.json": ("unsupported extension", False), "empty.png": ("empty file", False), "big.jpg": ("file too large", True), "name": (None, False), "no.gif": ("unsupported extension", False), "nothing.png": ("empty file", False)}


def test_images_come_back(spark, tmp_path):
    rng = np.random.default_rng(6)
    planes = {"a": rng.integers(0, 256, (7, 5, 3)), "b": rng.integers(0, 256, (1, 1, 3))}
    rows = [(i, y, x, *map(int, p[y, x])) for i, p in planes.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    px = spark.createDataFrame(rows, "image_id string, y int, x int, b int, g int, r int")
    named.write(files.png(px).select(F.concat("image_id", F.lit(".png")).alias("name"), "content"), str(tmp_path / "i"))
    (tmp_path / "i" / "bad.png").write_bytes(b"no image")
    images = files.photographs(spark, f"{tmp_path}/i/*.png")
    got = {(r.image_id.split("/")[-1][0], r.y, r.x): (r.b, r.g, r.r) for r in files.pixels(images).collect()}
    assert got == {(r[0], r[1], r[2]): r[3:] for r in rows}
    small = files.decoded(spark, f"{tmp_path}/i/*.png", most=3)
    assert small.groupBy("image_id").agg(F.max("height").alias("h"), F.max("width").alias("w")).filter("h = 3 AND w = 2").count() == 1


def test_grey_and_alpha(spark):
    images = spark.createDataFrame([("g", 1, 2, 1, bytearray([5, 9])), ("t", 1, 1, 4, bytearray([1, 2, 3, 77])), ("bad", -1, -1, -1, bytearray())], "origin string, height int, width int, nChannels int, data binary")
    assert sorted(tuple(r) for r in files.pixels(images).select("image_id", "x", "b", "g", "r").collect()) == [("g", 0, 5, 5, 5), ("g", 1, 9, 9, 9), ("t", 0, 1, 2, 3)]


def test_small_images_are_not_resized(spark, tmp_path):
    """Large and small images of one folder; files that no pattern fits aren't opened; the small ones aren't shuffled."""
    rows = [(n, y, x, 9 * y + x, y, x) for n, (h, w) in {"a": (3, 5), "b": (8, 6)}.items() for y in range(h) for x in range(w)]
    made = files.png(spark.createDataFrame(rows, "image_id string, y int, x int, b int, g int, r int"))
    named.write(made.select(F.concat("image_id", F.lit(".png")).alias("name"), "content"), f"{tmp_path}/p")
    got = files.decoded(spark, f"{tmp_path}/p", most=5, pattern="*.png")
    sizes = {(r.image_id.rsplit("/", 1)[-1], r.height, r.width, r.n) for r in got.groupBy("image_id", "height", "width").agg(F.count("*").alias("n")).collect()}
    assert sizes == {("a.png", 3, 5, 15), ("b.png", 5, 4, 20)}
    assert {(r.y, r.x, r.b, r.g, r.r) for r in got.filter("height = 3").collect()} == {tuple(map(float, r[1:])) for r in rows if r[0] == "a"}
    total = got.filter("height = 5").agg(F.avg("b")).first()[0]
    assert abs(total - sum(r[3] for r in rows if r[0] == "b") / 48) < 1e-9
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.index("Union") < text.index("HashAggregate") and text.count("Exchange hashpartitioning") == 1
