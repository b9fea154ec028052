"""Intermediate tables in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir.

    Where that is unset, a folder of our own serves in local mode, where driver
    and executors are one process; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quiltgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/quiltgraph/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    where = _path(spark, path)
    _system(spark, where).deleteOnExit(where)
    return path


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, where):
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_open = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is stored inside goes at the end: for work whose results are written elsewhere."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        paths, _open.paths = _open.paths, outer
        for path in paths:
            remove(spark, path)


#: Spark's setting that shuffle files go when the query ends that made them, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: cuts lineage and survives lost executors.

    The shuffle files that led to it go at once.
    """
    spark = df.sparkSession
    path = folder(spark)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def unstored(df: DataFrame | None) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = _path(spark, path)
    _system(spark, where).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = _path(spark, path)
    return _system(spark, where).exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, sorted; none if it isn't there."""
    where = _path(spark, path)
    system = _system(spark, where)
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in whatever store the path names; written beside and renamed, so that a reader finds the old one or the new one whole."""
    beside = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = _system(spark, beside).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    _rename(spark, beside, _path(spark, path))


def _rename(spark: SparkSession, old, new) -> None:
    """In place of what is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    where = _system(spark, old).makeQualified(old)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(where, _system(spark, new).makeQualified(new), options)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
