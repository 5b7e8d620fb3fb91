"""Replacing a dataset by committing a version of it, for stores without a cheap or safe rename.

Rows go to a folder of their own below the target, and a numbered manifest then names that folder. Creating the manifest
is the commit: it is one small file, written in one step and never over another. Whoever reads takes the highest
manifest, so that a writer that fails, or reads what it replaces, leaves the old rows in place, and of two writers that start
from one version the second is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civicsift.sources.files import _fs, _path, exists

MANIFESTS = "_manifests"
WIDTH = 12  # digits of a manifest's number


class ConflictError(RuntimeError):
    """Someone else has committed since this writer looked."""


def latest(spark: SparkSession, target: str) -> int:
    """Number of the version that is read now; 0 if nothing has been committed."""
    folder = f"{target.rstrip('/')}/{MANIFESTS}"
    if not exists(spark, folder):
        return 0
    names = [status.getPath().getName() for status in _fs(spark, folder).listStatus(_path(spark, folder))]
    return max((int(name) for name in names if name.isdigit()), default=0)


def folder_of(spark: SparkSession, target: str, number: int | None = None) -> str:
    """The folder that holds a version of ``target``, the latest if no number is given.

    A target without versions is its own folder, so that plain outputs are read alike.
    """
    number = latest(spark, target) if number is None else number
    if number == 0:
        return target
    path = f"{target.rstrip('/')}/{MANIFESTS}/{number:0{WIDTH}d}"
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{target.rstrip('/')}/{name}"


def commit(spark: SparkSession, target: str, write: Callable[[str], None], after: int | None = None) -> int:
    """Let ``write`` fill a new folder and make it the next version, which is returned.

    ``after`` is the version the rows were made from, by default the latest when this is called.
    """
    after = latest(spark, target) if after is None else after
    name = f"version-{after + 1:0{WIDTH}d}-{uuid.uuid4().hex}"
    write(f"{target.rstrip('/')}/{name}")
    path = f"{target.rstrip('/')}/{MANIFESTS}/{after + 1:0{WIDTH}d}"
    store = _fs(spark, path)
    if latest(spark, target) > after or store.exists(_path(spark, path)):
        raise ConflictError(f"{target} has a version after {after} already")
    try:
        stream = store.create(_path(spark, path), False)
    except Exception as problem:
        raise ConflictError(f"cannot commit version {after + 1} of {target}: {problem}") from problem
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    return after + 1


def forget(spark: SparkSession, target: str, keep: int = 2) -> None:
    """Delete the rows and manifests of all but the ``keep`` latest versions. Nobody may still read those."""
    last = latest(spark, target)
    store = _fs(spark, target)
    for number in range(1, last - keep + 1):
        path = f"{target.rstrip('/')}/{MANIFESTS}/{number:0{WIDTH}d}"
        if store.exists(_path(spark, path)):
            store.delete(_path(spark, folder_of(spark, target, number)), True)
            store.delete(_path(spark, path), False)


def overwrite(df: DataFrame, target: str, write: Callable[[DataFrame, str], None]) -> int:
    """Commit ``df``, which may read ``target`` itself, as the next version of ``target``."""
    return commit(df.sparkSession, target, lambda path: write(df, path))
