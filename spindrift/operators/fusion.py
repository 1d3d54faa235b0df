"""Fusion, union and ordering of candidate lists. A candidate list has query_id, id, score and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .retrieval import top

_KEY = ["query_id", "id"]


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    d = dense.select(*_KEY, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_sim"))
    s = sparse.select(*_KEY, F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_sim"))
    return d.join(s, _KEY, "full")


def rrf(dense: DataFrame, sparse: DataFrame, k: int = V.TOP_K, rrf_k: int = V.RRF_K, weights: tuple[float, float] = V.WEIGHTS) -> DataFrame:
    """query_id, id, score, dense_rank, sparse_rank, rank by weighted reciprocal ranks; ties go to the lower id."""
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    fused = _both(dense, sparse).withColumn("score", part("dense_rank", weights[0]) + part("sparse_rank", weights[1]))
    return top(fused.select(*_KEY, "score", "dense_rank", "sparse_rank"), k)


def union_capped(dense: DataFrame, lexical: DataFrame, cap: int | None = 2 * V.PER_CHANNEL) -> DataFrame:
    """Dense candidates by rank, then lexical ones not yet there; arrival counts from 1 and ends at the cap. No cap: all."""
    both = _both(dense, lexical)
    order = Window.partitionBy("query_id").orderBy(F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "id")
    out = both.withColumn("arrival", F.row_number().over(order))
    return out if cap is None else out.filter(F.col("arrival") <= cap)


def extend_pool(pool: DataFrame, more: DataFrame) -> DataFrame:
    """pool (query_id, id, arrival) and the ids of ``more`` (query_id, id, rank) that it lacks, after it in order."""
    last = pool.groupBy("query_id").agg(F.max("arrival").alias("last"))
    fresh = more.join(pool.select(*_KEY), _KEY, "left_anti").join(last, "query_id", "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    return pool.select(*_KEY, "arrival").unionByName(fresh.select(*_KEY, (F.coalesce("last", F.lit(0)) + place).alias("arrival")))


def expanded_pool(pool: DataFrame, search, queries: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """pool (query_id, id, arrival) widened: what a second search finds for each query with its expansion, then boosted ids, unseen ones alone.

    search(queries) gives query_id, id, arrival for queries (query_id, query); queries: query_id, query, expansion; boosts: query_id, id, rank.
    """
    wide = queries.filter(F.length(F.trim(F.coalesce("expansion", F.lit("")))) > 0).select("query_id", F.trim(F.concat_ws(" ", "query", "expansion")).alias("query"))
    out = extend_pool(pool, search(wide).select(*_KEY, F.col("arrival").alias("rank")))
    return out if boosts is None else extend_pool(out, boosts)


def merge_hints(*hints: str) -> Column:
    """Arrays one after the other, each value at its first place."""
    return F.array_distinct(F.concat(*[F.coalesce(F.col(h), F.array().cast("array<string>")) for h in hints]))
