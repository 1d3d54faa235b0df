"""Counters kept by a stream: each batch is merged once, whatever is run again.

A batch's rows are summed and added to the newest snapshot before it, and the sum
is written as the snapshot of that batch's number. A batch that is replayed after
a crash finds its own snapshot, or overwrites an unfinished one from the same
predecessor, so its rows count once. The two newest snapshots stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import remove_path


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished snapshots, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [(x.getPath().getName(), x.getPath()) for x in files.listStatus(at)]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n[2:]) for n, p in found if n.startswith("v-") and n[2:].isdigit() and files.exists(done(p, "_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest snapshot; None before the first."""
    there = _snapshots(spark, path)
    return spark.read.parquet(f"{path}/v-{there[-1]}") if there else None


def merge(batch: DataFrame, number: int, path: str, keys: list[str], sums: list[str]) -> None:
    """Adds a batch's columns ``sums`` by keys to the snapshot before it, once."""
    spark = batch.sparkSession
    there = _snapshots(spark, path)
    if number in there:
        return
    earlier = [n for n in there if n < number]
    parts = [batch.select(*keys, *sums)] + ([spark.read.parquet(f"{path}/v-{earlier[-1]}")] if earlier else [])
    total = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    total.write.mode("overwrite").parquet(f"{path}/v-{number}")
    for old in earlier[:-1]:
        remove_path(spark, f"{path}/v-{old}")


def keep_counters(stream: DataFrame, path: str, keys: list[str], sums: list[str], state: str | None = None) -> StreamingQuery:
    """Starts the stream over what is there. state: the stream's own checkpoint folder (default: beside the snapshots)."""
    written = stream.writeStream.foreachBatch(lambda rows, n: merge(rows, n, path, keys, sums))
    return written.option("checkpointLocation", state or f"{path}/state").trigger(availableNow=True).start()
