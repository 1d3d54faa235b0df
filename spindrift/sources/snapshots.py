"""Versions of a table on shared storage, and a pointer that only one writer can move on from a version.

``commit`` writes the rows to a folder of their own and then makes the pointer file of the next
version, which fails if it is there already: of two writers that started from one version, the
second gets a Conflict, and its rows go. Readers see whole versions only. The file system has to
refuse to create a file that exists, as HDFS and local disks do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import remove_path


class Conflict(RuntimeError):
    """Another writer has moved the table on."""


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The newest version's number; 0 before the first."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return 0
    names = [x.getPath().getName() for x in files.listStatus(at)]
    return max((int(n[8:]) for n in names if n.startswith("version-")), default=0)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest."""
    number = number or version(spark, path)
    if not number:
        raise ValueError(f"no version at {path}")
    folder = spark.read.text(f"{path}/version-{number:08d}").first()["value"]
    return spark.read.parquet(f"{path}/{folder}")


def commit(rows: DataFrame, path: str, seen: int) -> int:
    """Makes rows the version after ``seen``, the one they were worked out from; its number, or Conflict if there is a later one already."""
    spark = rows.sparkSession
    if version(spark, path) != seen:
        raise Conflict(f"{path} is past version {seen}")
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    at, files = _files(spark, f"{path}/version-{seen + 1:08d}")
    try:
        out = files.create(at, False)
    except Exception as refused:
        remove_path(spark, f"{path}/{folder}")
        raise Conflict(f"{path} is past version {seen}") from refused
    out.write(bytearray(folder.encode()))
    out.close()
    return seen + 1
