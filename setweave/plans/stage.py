"""Tables written to the shared folder between steps that must see the same rows."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_opened: list[list[tuple[SparkSession, str]]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set, on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="setweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/setweave-{uuid.uuid4().hex}"
    if _opened:
        _opened[-1].append((spark, path))
    return path


def materialised(df: DataFrame, path: str | None = None, **options) -> DataFrame:
    path = path or new_path(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released():
    """For results that are written or counted inside: the tables materialised on the way are removed at the end."""
    _opened.append([])
    try:
        yield
    finally:
        for spark, name in _opened.pop():
            remove(spark, name)
