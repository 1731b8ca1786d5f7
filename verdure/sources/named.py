"""Small files by name as a Spark data source: a folder of files is written a file a row, with a manifest, and named files are read, a row for each name, there or not.

    spark.dataSource.register(NamedFiles)
    frame.write.format("named_files").option("path", folder).mode("append").save()          # name, content
    spark.read.format("named_files").option("path", folder).option("names", json).load()    # name, content, bytes, error

Folders are of any kind that Arrow's file systems open (file:, hdfs:, s3:, gs:). Names are dealt out to tasks in slices; without `names` the manifest tells them, or with `everything` the
folder does. Unlike Spark's own sources, files of no bytes have a row too. Files of more than `most` bytes aren't read. Names and digests pass the driver, as file listings and
commits do; contents don't."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .. import ship

MANIFEST, SLICE, CHUNK_ROWS = "manifest.json", 200, 16


@dataclass
class Names(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, dict]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(system: fs.FileSystem, file: str, most: int | None = None) -> tuple[bytes | None, int | None]:
    """(content, size); no content if the file has more than `most` bytes, nothing if it isn't there."""
    info = system.get_file_info(file)
    if info.type != fs.FileType.File:
        return None, None
    if most is not None and info.size > most:
        return None, info.size
    with system.open_input_stream(file) as f:
        return f.read(), info.size


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary, bytes long, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.names, self.slice, self.everything = options["path"], options.get("names"), int(options.get("slice", SLICE)), options.get("everything") == "true"
        self.most = int(options["most"]) if "most" in options else None

    def partitions(self) -> list[InputPartition]:
        if self.names is not None:
            names = json.loads(self.names)
        else:
            system, folder = _opened(self.path)
            if self.everything:
                found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
                names = sorted(x.path.removeprefix(folder).lstrip("/") for x in found if x.type == fs.FileType.File and not x.base_name.startswith("."))
            else:
                names = sorted(json.loads(_read(system, f"{folder}/{MANIFEST}")[0] or b'{"files": {}}')["files"])
        return [Names(names[i : i + self.slice]) for i in range(0, len(names), self.slice)] or [Names([])]

    def read(self, partition: Names) -> Iterator[tuple]:
        system, folder = _opened(self.path)
        for name in partition.names:
            try:
                content, size = _read(system, f"{folder}/{name}", self.most)
                yield name, content, size, "missing" if size is None else None
            except OSError as e:
                yield name, None, None, f"unreadable: {type(e).__name__}"


class _Writer(DataSourceArrowWriter):
    """A task writes each file beside its place and moves it there, so a task that runs twice leaves whole files; the manifest of all of them is written last, by the commit."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        files = {}
        for batch in batches:
            for name, content in zip(batch.column(self.columns.index("name")), batch.column(self.columns.index("content")), strict=True):
                name, content = name.as_py(), content.as_py() or b""
                beside = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as f:
                    f.write(content)
                system.move(beside, f"{folder}/{name}")
                files[name] = {"bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        files = {n: v for m in messages if m for n, v in m.files.items()}
        beside = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as f:
            f.write(json.dumps({"files": files}, sort_keys=True).encode())
        system.move(beside, f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        """Files stay; without a manifest no reader counts them."""


def _ready(spark: SparkSession) -> None:
    ship(spark)
    if not getattr(spark, "_verdure_named", False):
        spark.dataSource.register(NamedFiles)
        spark._verdure_named = True


def found(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A row for each file of a folder and those within, without those whose names begin with a dot; no content above `most` bytes."""
    _ready(spark)
    reader = spark.read.format("named_files").option("path", path).option("everything", "true")
    return (reader if most is None else reader.option("most", most)).load()


def write(files: DataFrame, path: str) -> None:
    """files: name and content (binary; null is empty), a file each."""
    _ready(files.sparkSession)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, names: list[str] | None = None, slice: int = SLICE) -> DataFrame:
    """A row for each name, in the manifest if none are given: content and bytes, or what is wrong."""
    _ready(spark)
    reader = spark.read.format("named_files").option("path", path).option("slice", slice)
    return (reader if names is None else reader.option("names", json.dumps(names))).load()


def read_named(names: DataFrame, path: str) -> DataFrame:
    """As read(), for a column `name` of a table: names stay where they are, each task reads its own files."""
    ship(names.sparkSession)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK_ROWS):
                rows = list(_Reader({"path": path}).read(Names(batch.column(0)[i : i + CHUNK_ROWS].to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64(), pa.string()))], names=["name", "content", "bytes", "error"])

    return names.select("name").mapInArrow(fetch, "name string, content binary, bytes long, error string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the folder's manifest; no rows without one, or with one that can't be read."""
    text = read(spark, path, [MANIFEST]).select(F.decode("content", "UTF-8").alias("t"))
    files = F.from_json("t", "files map<string, struct<bytes: bigint, sha256: string>>")["files"]
    return text.select(F.explode(files).alias("name", "v")).select("name", "v.bytes", "v.sha256")


def json_or_null(content: Column | str, schema: str) -> Column:
    """A whole JSON object of a file's content, null where it is missing or broken."""
    text = F.decode(content, "UTF-8")
    return F.when(F.from_json(text, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})["_broken"].isNull(), F.from_json(text, schema))
