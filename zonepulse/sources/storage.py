"""Folders of a table, in whatever file system they are: listing, safe replacement, recovery.

A write goes to a staging folder beside its target first. Only a finished one
is swapped in, by renaming folders: the whole table, or the folders of the
top-level partitions that the new rows have. A write that fails leaves the old
table as it is; a swap that is cut off between its two renames is put right by
``settle``, which every reader and writer of this package calls first.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

STAGED, OLD = ".staged-", ".old-"


class Folders:
    """The few file operations needed, through Spark's own Hadoop file systems."""

    def __init__(self, spark: SparkSession):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def rename(self, source: str, target: str) -> None:
        fs, at = self._at(source)
        if not fs.rename(at, self._path(target)):
            raise OSError(f"could not rename {source} to {target}")

    def make(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)


def _split(path: str) -> tuple[str, str]:
    path = path.rstrip("/")
    parent, _, name = path.rpartition("/")
    return parent or ("/" if path.startswith("/") else "."), name


def settle(spark: SparkSession, path: str) -> None:
    """Undo a swap that was cut off: a target that is gone gets its old folder back."""
    folders = Folders(spark)
    parent, name = _split(path)
    old = [x for x in folders.names(parent) if x.startswith(f".{name}{OLD}")]
    for left in old:
        if not folders.exists(path):
            folders.rename(f"{parent}/{left}", path)
    if folders.exists(path):
        inside = folders.names(path)
        for left in inside:
            cut = re.fullmatch(rf"\.(.+){re.escape(OLD)}\w+", left)
            if cut and cut[1] not in inside:
                folders.rename(f"{path.rstrip('/')}/{left}", f"{path.rstrip('/')}/{cut[1]}")


def _swap(folders: Folders, fresh: str, target: str) -> None:
    parent, name = _split(target)
    old = f"{parent}/.{name}{OLD}{uuid.uuid4().hex}"
    had = folders.exists(target)
    if had:
        folders.rename(target, old)
    try:
        folders.rename(fresh, target)
    except Exception:
        if had:
            folders.rename(old, target)
        raise
    if had:
        folders.delete(old)


def replace_table(
    df: DataFrame, path: str, fmt: str, options: dict, partition_by=None, only_partitions: bool = False
) -> list[str]:
    """Write ``df`` and swap it in; returns the folders that were replaced.

    With ``only_partitions`` just the top-level partitions that ``df`` has rows
    in are replaced, each as a whole; the others are not touched. It needs a
    partitioning.
    """
    if only_partitions and not partition_by:
        raise ValueError("replacing partitions needs a table that has them")
    spark = df.sparkSession
    settle(spark, path)
    folders = Folders(spark)
    parent, name = _split(path)
    fresh = f"{parent}/.{name}{STAGED}{uuid.uuid4().hex}"
    try:
        writer = df.write.options(**options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.format(fmt).save(fresh)
        if not only_partitions or not folders.exists(path):
            _swap(folders, fresh, path)
            return [path]
        made = [x for x in folders.names(fresh) if x.startswith(f"{partition_by[0]}=")]
        for x in made:
            _swap(folders, f"{fresh}/{x}", f"{path.rstrip('/')}/{x}")
        return made
    finally:
        folders.delete(fresh)
