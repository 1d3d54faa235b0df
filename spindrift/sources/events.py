"""Event logs: day-partitioned JSON spools, append-only tables, CSV plans, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vocabulary as V


def emit(events: DataFrame, path: str, at: str = "ts") -> None:
    """Events appended as JSON lines, a folder for each UTC day."""
    events.withColumn("day", F.date_format(at, "yyyyMMdd")).write.partitionBy("day").mode("append").json(path)


def read_spool(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_spool(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def serving_rows(served: DataFrame, most: int = V.SERVED_CANDIDATES) -> DataFrame:
    """Log rows with at most so many candidates, in their order."""
    return served.withColumn("candidates", F.slice("candidates", 1, most))


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan as CSV with a header and comment lines."""
    return spark.read.option("header", "true").option("comment", "#").csv(path)


def export_bundle(rows: DataFrame, path: str, drop: tuple[str, ...] = ("embedding", "content_hash")) -> None:
    rows.drop(*drop).write.mode("overwrite").json(path)


def replace_snapshot(rows: DataFrame, path: str, version: int) -> str:
    """A new version of a table beside the old ones; readers move on when they are told its path."""
    target = f"{path}/v{version:08d}"
    rows.write.mode("errorifexists").parquet(target)
    return target


def check_constraints(rows: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all rules, others with the names of the rules they break). A rule is a condition; null breaks it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    marked = rows.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)
