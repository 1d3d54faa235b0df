"""The service surface as functions over DataFrames: search, find, route, step resolution and feedback for batches of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import fusion, lifecycle, rerank, retrieval


class Engine:
    """A corpus of prompts (id, title, prompt_text, summary, domain, intent, task_type, status, ...) with vectors (id, chunk_id, embedding), skill steps (skill_id, id) and a scorer."""

    def __init__(self, prompts: DataFrame, vectors: DataFrame, steps: DataFrame | None = None, scorer: Callable = rerank.overlap_scorer, embedder: Callable[[Column], Column] | None = None):
        self.prompts, self.vectors, self.steps, self.scorer, self.embedder = prompts, vectors, steps, scorer, embedder

    def _with_vectors(self, queries: DataFrame) -> DataFrame:
        if "embedding" in queries.columns:
            return queries
        if self.embedder is None:
            raise ValueError("queries need an embedding column, or the engine an embedder")
        return queries.withColumn("embedding", self.embedder(F.col("query")))

    def candidates(self, queries: DataFrame, expand: bool = False, **filters) -> DataFrame:
        """query_id, id, arrival, ...: dense chunks rolled up to eligible prompts, then lexical ones, up to the cap."""
        if expand:
            queries = queries.withColumn("query", X.expand_acronyms("query"))
        allowed = retrieval.eligible(self.prompts, **filters)
        own = self.vectors.join(allowed.select("id"), "id", "left_semi")
        chunks = retrieval.dense_topk(own, self._with_vectors(queries), V.CANDIDATES, "chunk_id").withColumnRenamed("id", "chunk_id")
        dense = retrieval.rollup(chunks.drop("rank").join(own.select("id", "chunk_id"), "chunk_id"), V.PER_CHANNEL)
        lexical = retrieval.exact_search(allowed, queries, False, V.CANDIDATES, "id", "prompt_text")
        return fusion.union_capped(dense, lexical)

    def search(self, queries: DataFrame, k: int = V.TOP_K, **filters) -> DataFrame:
        """query_id, id, title, rerank_score, arrival, rank: candidates by their shaped rerank score."""
        pool = self.candidates(queries, **filters).select("query_id", "id", "arrival")
        texts = self.prompts.select("id", "title", "prompt_text", *(["summary"] if "summary" in self.prompts.columns else []))
        rows = pool.join(texts, "id").join(retrieval.bounded(queries.select("query_id", "query")), "query_id")
        rows = rows if "summary" in rows.columns else rows.withColumn("summary", F.lit(None).cast("string"))
        suppressed = F.lower("title").startswith(V.IMAGE_TITLE) & ~X.wants_image("query")
        scored = rerank.score_pairs(rows.filter(~suppressed).withColumn("document", rerank.rerank_document()), self.scorer)
        scored = scored.withColumn("score", rerank.shaped_score("raw", F.length("prompt_text")))
        best = retrieval.top(scored, k, order=[F.desc("score"), F.asc("arrival")])
        return best.select("query_id", "id", "title", F.col("score").alias("rerank_score"), "arrival", "rank")

    def find(self, queries: DataFrame, prefer: str = "auto", floor: float = V.MIN_CONFIDENCE, **filters) -> DataFrame:
        """query_id, mode, served_id, score: one decision a query; skills take part through the coverage of their steps."""
        ranked = self.search(queries, **filters).withColumnRenamed("rerank_score", "score")
        rows = ranked.select("query_id", "id", F.lit("prompt").alias("kind"), F.lit(0).cast("long").alias("n_steps"), "score", F.col("arrival").cast("long").alias("arrival"))
        covered = None
        if self.steps is not None:
            covered = rerank.coverage(ranked, self.steps)
            more = covered.select("query_id", F.col("skill_id").alias("id"), F.lit("skill").alias("kind"), F.col("hits").alias("n_steps"), "score", F.lit(0).cast("long").alias("arrival"))
            rows = rows.unionByName(more)
        return rerank.winner(rows, covered, prefer, floor)

    def route(self, queries: DataFrame, context: Column, **filters) -> DataFrame:
        """find with the served prompt's text, its slots filled from a context map, and what is still open."""
        served = self.find(queries, **filters).join(self.prompts.select(F.col("id").alias("served_id"), "prompt_text"), "served_id", "left")
        filled = X.fill_slots("prompt_text", context)
        return served.withColumn("filled", filled).select("query_id", "mode", "served_id", "score", F.col("filled.text").alias("prompt_text"), F.col("filled.unfilled").alias("unfilled"), (F.size("filled.unfilled") > 0).alias("needs_context"))

    def priors(self, feedback: DataFrame) -> DataFrame:
        return lifecycle.quality_prior(feedback)
