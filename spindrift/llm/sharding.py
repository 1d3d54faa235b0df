"""Sharding by rendezvous hashing.

Every shard draws a score for a record key from a hash of (key, shard) and its
weight; the record goes to the highest. A shard that is added changes only the
records it wins, and one that is taken away only those it held, whatever the
number of shards; weights change shares in proportion.

All is an expression on the row: placing needs no shuffle. Slots (numbers
without gaps inside a shard) take one shuffle of small columns, which are written
first, so that texts are read once: rows are dealt into hash buckets, numbered
inside the bucket, and shifted by the sizes of the buckets before. A row's bucket
comes from its columns and the task that read it, so rows that repeat without end
don't meet in one bucket. There are enough buckets to keep each near
``BUCKET_ROWS`` rows; the table of their sizes is broadcast while small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, text_of

#: Hash buckets a shard for numbering, at least; and the rows of a bucket from which on there are more.
BUCKETS, BUCKET_ROWS = 256, 500_000


def _scores(key: Column, weights: Sequence[float]) -> list[Column]:
    out = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            raise ValueError("weights must be above zero")
        # 53 bits of the hash as a number inside (0, 1); -w / ln(u) is the weighted draw
        draw = (F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"/{shard}"))), 11).cast("double") + 0.5) / float(2**53)
        out.append(-F.lit(float(weight)) / F.ln(draw))
    return out


def place(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 ...) of a record key; a null key counts as the empty text. Ties go to the lower shard."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    pairs = [F.struct(score.alias("score"), F.lit(-i).alias("shard")) for i, score in enumerate(_scores(key, weights))]
    return (-F.array_max(F.array(*pairs))["shard"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard: one row for every row of docs.

    size: UTF-8 bytes plus 1 (null: none, so 1); text_crc32: of those bytes.
    grown_shard: the shard under the weights in ``grown`` (default: one more of
    the mean weight). Null keys share the key "". Rows that repeat a key share
    its shard, each with a slot of its own; rows alike in id, size and crc32 are
    interchangeable, so which of them has which slot doesn't matter. Empty
    tables give no rows.
    """
    grown = grown or [*weights, sum(weights) / len(weights)]
    binary = text_of(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(binary) + 1).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
        place(F.col(id_col), weights).alias("shard"),
        place(F.col(id_col), grown).alias("grown_shard"),
        F.spark_partition_id().alias("__task"),
    )
    rows = cut(rows.withColumn("__hash", F.xxhash64(F.col(id_col), "size", "text_crc32", "__task")).drop("__task"))
    buckets = max(BUCKETS, rows.count() // (len(weights) * BUCKET_ROWS))
    rows = rows.withColumn("__bucket", F.pmod("__hash", F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    offsets = cut(sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from")))
    inside = Window.partitionBy("shard", "__bucket").orderBy(F.col(id_col), "size", "text_crc32")
    numbered = rows.withColumn("__at", F.row_number().over(inside) - 1)
    return numbered.join(small(offsets), ["shard", "__bucket"]).select(
        F.col(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__from") + F.col("__at")).alias("slot"), "grown_shard"
    )
