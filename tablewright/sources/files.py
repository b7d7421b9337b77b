"""Bytes of files through the cluster's file systems."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def natural(name: str) -> list:
    """A name as a sort key: numbers in it count by their value."""
    return [int(x) if x.isdecimal() else x for x in re.split(r"([0-9]+)", name)]


def _pieces(fs, p) -> list:
    """States of a file, or of the files of a folder that are its parts, in the order of their names."""
    status = fs.getFileStatus(p)
    if not status.isDirectory():
        return [status]
    found = [s for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(found, key=lambda s: natural(s.getPath().getName()))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of a folder's parts together."""
    return sum(s.getLen() for s in _pieces(*_open(spark, path)))


def head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first ``n`` bytes of a file, or of a folder's parts one after another."""
    fs, p = _open(spark, path)
    out = b""
    for status in _pieces(fs, p):
        if len(out) >= n:
            break
        stream = fs.open(status.getPath())
        try:
            out += bytes(stream.readNBytes(n - len(out)))
        finally:
            stream.close()
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file."""
    fs, p = _open(spark, path)
    return fs.exists(p)


def replace(spark: SparkSession, path: str, data: bytes) -> None:
    """Put a file in place of another at once: written aside, then renamed over it, so a reader finds the old one or the new."""
    fs, p = _open(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside = hadoop.Path(f"{path}-{uuid.uuid4().hex}")
    stream = fs.create(aside)
    try:
        stream.write(data)
    finally:
        stream.close()
    kind = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.valueOf("OVERWRITE")
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(p), how)


def name(path: str) -> str:
    """The last part of a path."""
    return path.rstrip("/").rsplit("/", 1)[-1]


def signature(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """Path, bytes and time of the last change of a file or a folder's parts: another one means other contents."""
    found = _pieces(*_open(spark, path))
    return path, sum(s.getLen() for s in found), max((s.getModificationTime() for s in found), default=0)


def parts(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the data files that a writer left in a folder, in order."""
    fs, p = _open(spark, folder)
    return [f.getPath().toString() for f in _pieces(fs, p) if f.getPath().getName().startswith("part-")]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir); it goes when the session's JVM ends.

    Where that is unset, a local master (whose executors are in this machine) gets a temporary folder; on a
    cluster the warehouse, which all executors share, takes its place.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and context.master.split("[")[0] == "local":
        base = "file://" + os.path.join(tempfile.gettempdir(), "tablewright-scratch")
        os.makedirs(base[7:], exist_ok=True)
        context.setCheckpointDir(base)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tablewright-scratch"
    fs, p = _open(spark, base)
    if "://" not in base:  # a bare path belongs to the cluster's default file system, which other readers must be told
        base = fs.makeQualified(p).toString()
        base = "file://" + base[5:] if base.startswith("file:/") and "://" not in base else base
    out = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs.deleteOnExit(_open(spark, out)[1])
    return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """A frame written as Parquet in the shared folder and read back: its rows and their order in files stay what they were."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
