"""Leaf-photo diagnostics and training-data operators as Spark jobs."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Give the Python workers this package, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_verdure_shipped", False):
        return
    here, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path(here.name) / p.relative_to(here))
    folder = tempfile.mkdtemp(prefix="verdure-")
    path = os.path.join(folder, "verdure_workers.zip")
    Path(path).write_bytes(data.getvalue())
    context.addPyFile(path)
    context._verdure_shipped = True


def stored(df):
    """df, computed once into files of the shared folder: packed, unlike a checkpoint, and of a size that Spark knows when it plans joins."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of its own only where that is unset and all run on this machine."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
