"""Small file-system helpers on the file system Spark itself uses."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession

from civicsift.session import scratch_path


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def is_file(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).getFileStatus(_path(spark, path)).isFile()


def require_file(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """Absolute form with scheme, as Spark reports file paths."""
    return _fs(spark, path).makeQualified(_path(spark, path)).toString()


def beside(target: str) -> str:
    """A path next to ``target`` that nothing else uses."""
    return f"{target.rstrip('/')}.new-{uuid.uuid4().hex}"


def swap_into(spark: SparkSession, new: str, target: str) -> None:
    """Put the finished output ``new`` in the place of ``target``."""
    fs = _fs(spark, target)
    old = _path(spark, f"{target.rstrip('/')}.replaced-{uuid.uuid4().hex}")
    destination = _path(spark, target)
    if destination.getParent() is not None:
        fs.mkdirs(destination.getParent())
    had_target = fs.exists(destination)
    if had_target and not fs.rename(destination, old):
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(_path(spark, new), destination):
        if had_target:
            fs.rename(old, destination)
        raise OSError(f"cannot move {new} to {target}")
    if had_target:
        fs.delete(old, True)


def write_document(df: DataFrame, path: str) -> None:
    """Write a small frame of text rows as one plain file."""
    spark = df.sparkSession
    folder = scratch_path(spark, "document")
    df.coalesce(1).write.option("lineSep", "\n").text(folder)
    publish(spark, folder, path)


def publish(spark: SparkSession, folder: str, path: str) -> None:
    """Copy the only part file in ``folder`` to ``path``."""
    fs = _fs(spark, folder)
    parts = [status.getPath() for status in fs.listStatus(_path(spark, folder))
             if status.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{len(parts)} part files in {folder}, expected one")
    target = _path(spark, path)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(
        fs, parts[0], _fs(spark, path), target, False, True, spark._jsc.hadoopConfiguration())


def assemble(spark: SparkSession, folder: str, path: str) -> None:
    """Put the part files in ``folder`` end to end at ``path``, in order of their names.

    Their bytes pass through a buffer of a few kilobytes; nothing is held.
    """
    fs, target = _fs(spark, folder), _path(spark, path)
    parts = sorted(status.getPath().toString() for status in fs.listStatus(_path(spark, folder))
                   if status.getPath().getName().startswith("part-"))
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = _fs(spark, path).create(target, True)
    try:
        for part in parts:
            source = fs.open(_path(spark, part))
            try:
                copy(source, out, 1 << 16, False)
            finally:
                source.close()
    finally:
        out.close()
