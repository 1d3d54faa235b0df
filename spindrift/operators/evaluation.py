"""Retrieval benchmarks and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gold_ranks(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, rank of the first gold id among the hits, null if none. gold: query_id, gold_id."""
    found = gold.join(hits.select("query_id", F.col("id").alias("gold_id"), "rank"), ["query_id", "gold_id"], "left")
    return found.groupBy("query_id").agg(F.min("rank").alias("rank"))


def recall_mrr(ranks: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: n, recall at each k, MRR at 10, share of queries without hits."""
    empty = ranks.join(hits.select("query_id").distinct().withColumn("any", F.lit(1)), "query_id", "left")
    at = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    mrr = F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)).alias("mrr_10")
    return empty.agg(F.count("*").alias("n"), *at, mrr, F.avg(F.col("any").isNull().cast("double")).alias("empty_rate"))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row of shares: both channels find the gold id, only one, neither, any. a, b: query_id, rank."""
    j = a.select("query_id", F.coalesce(F.col("rank") <= k, F.lit(False)).alias("x")).join(b.select("query_id", F.coalesce(F.col("rank") <= k, F.lit(False)).alias("y")), "query_id")
    share = lambda c, n: F.avg(c.cast("double")).alias(n)
    x, y = F.col("x"), F.col("y")
    return j.agg(share(x & y, "both"), share(x & ~y, "a_only"), share(~x & y, "b_only"), share(~x & ~y, "neither"), share(x | y, "oracle"))


def ndcg(ranks: DataFrame, k: int = 10) -> DataFrame:
    """One row: the mean of 1 / log2(rank + 1) within k, with one gold id a query."""
    return ranks.agg(F.avg(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("ndcg"))


def upper_median(column: str) -> Column:
    """Of the sorted values the one at n // 2, counted from zero: the lower median from the other end, so equal values are counted, not gathered."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def confusion(rows: DataFrame, want: str, got: str) -> DataFrame:
    w, g = F.col(want), F.col(got)
    return rows.agg(F.count_if(w & g).alias("tp"), F.count_if(~w & ~g).alias("tn"), F.count_if(~w & g).alias("fp"), F.count_if(w & ~g).alias("fn"))


def precision(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """query_id, precision: the share of the first k hits that are gold. hits: query_id, id, rank; gold: query_id, gold_id."""
    good = gold.select("query_id", F.col("gold_id").alias("id"), F.lit(1).alias("good")).distinct()
    return hits.filter(F.col("rank") <= k).join(good, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("good") / k).alias("precision"))


def sequence_accuracy(got: DataFrame, want: DataFrame) -> DataFrame:
    """One row: n, the share of wanted sequences met exactly, and the mean share of places met. Both: query_id, place, id."""
    both = want.select("query_id", "place", F.col("id").alias("w")).join(got.select("query_id", "place", F.col("id").alias("g")), ["query_id", "place"], "full")
    one = both.groupBy("query_id").agg(F.count("w").alias("n"), F.count_if(F.col("w") == F.col("g")).alias("met"), F.count_if(~F.col("w").eqNullSafe(F.col("g"))).alias("off")).filter("n > 0")
    return one.agg(F.count("*").alias("n"), F.avg((F.col("off") == 0).cast("double")).alias("exact"), F.avg(F.col("met") / F.col("n")).alias("places"))


def abstain_quality(decided: DataFrame) -> DataFrame:
    """One row of precision, recall and rate of abstaining. decided: abstained, answerable (booleans)."""
    a, y = F.col("abstained"), F.col("answerable")
    right = F.count_if(a & ~y)
    return decided.agg(F.try_divide(right, F.count_if(a)).alias("precision"), F.try_divide(right, F.count_if(~y)).alias("recall"), F.avg(a.cast("double")).alias("rate"))


def latency(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """by, n, p50, p95 of a column."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.95)).alias("p95"))


def population(table: DataFrame, vector: str = "embedding", key: str | None = None) -> DataFrame:
    """One row: rows, rows with a vector, rows without, and with a key how many rows repeat one."""
    repeated = [(F.count(key) - F.count_distinct(key)).alias("repeated")] if key else []
    return table.agg(F.count("*").alias("n"), F.count(vector).alias("embedded"), (F.count("*") - F.count(vector)).alias("missing"), *repeated)


def self_retrieval(ranks: DataFrame, ks: tuple[int, ...] = (1, 10)) -> DataFrame:
    """One row: how many probes (query_id, rank of their own item or null) found it first, and within each k."""
    return ranks.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"within_{k}") for k in ks])


def text_report(found: DataFrame, queries: DataFrame) -> DataFrame:
    """place, line: a readable report, a heading for each query and a line for each result. found: query_id, rank, title, score; queries: query_id, query."""
    heads = queries.select("query_id", F.lit(0).alias("rank"), F.concat(F.lit("== "), F.col("query"), F.lit(" ==")).alias("line"))
    body = found.select("query_id", "rank", F.format_string("%3d. %.4f  %s", F.col("rank").cast("int"), F.col("score").cast("double"), "title").alias("line"))
    none = queries.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(1).alias("rank"), F.lit("  (no results)").alias("line"))
    return heads.unionByName(body).unionByName(none)
