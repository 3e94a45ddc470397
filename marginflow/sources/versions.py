"""Versions of a table under one folder: readers keep theirs while the next one is written.

    home/data-<id>/                      files of a version
    home/_versions/<number>-<ms>-<id>    empty file that makes it count, with the time it was made

The file is created in one step, after all data were written, and its name tells everything, so
nobody sees half of it. The current version is the one with the largest number. Of two that were
made at the same time under one number the larger id counts; both are whole.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

MARKS = "_versions"
KEEP_FOR = 24 * 3600.0  # seconds for which a replaced version is kept


@dataclass(frozen=True, order=True)
class Version:
    number: int
    id: str
    made: float  # seconds since 1970
    path: str

    @property
    def mark(self) -> str:
        return f"{self.number:010d}-{round(self.made * 1000)}-{self.id}"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as its API takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def every(spark: SparkSession, home: str) -> list[Version]:
    """All versions that count, oldest first."""
    files, marks = _files(spark, f"{home}/{MARKS}")
    if not files.exists(marks):
        return []
    found = []
    for status in files.listStatus(marks):
        number, made, name = status.getPath().getName().split("-")
        found.append(Version(int(number), name, int(made) / 1000, f"{home}/data-{name}"))
    return sorted(found)


def current(spark: SparkSession, home: str) -> Version | None:
    known = every(spark, home)
    return known[-1] if known else None


def add(spark: SparkSession, home: str, write: Callable[[str], None]) -> Version:
    """The version that `write` writes to the folder it is given.

    If it fails, what it has written goes, and the versions before are as they were.
    """
    name = uuid.uuid4().hex
    path = f"{home}/data-{name}"
    try:
        write(path)
    except BaseException:
        files, folder = _files(spark, path)
        files.delete(folder, True)
        raise
    last = current(spark, home)
    version = Version(last.number + 1 if last else 1, name, time.time(), path)
    files, mark = _files(spark, f"{home}/{MARKS}/{version.mark}")
    files.createNewFile(mark)
    return version


def drop_replaced(spark: SparkSession, home: str, keep_for: float = KEEP_FOR) -> list[Version]:
    """Remove versions that were replaced more than `keep_for` seconds ago; they are returned.

    The mark goes first, so a version that counts always has its files.
    """
    known = every(spark, home)
    limit = time.time() - keep_for
    gone = [old for old, new in zip(known, known[1:]) if new.made < limit]
    for version in gone:
        for path, deep in ((f"{home}/{MARKS}/{version.mark}", False), (version.path, True)):
            files, where = _files(spark, path)
            files.delete(where, deep)
    return gone
