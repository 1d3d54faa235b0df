"""Analogue views of the retrieval system's tables over the supplied test tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators.retrieval import bounded
from ..session import spread


#: Tables whose rows cost much to read: texts.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, texts: bool = True) -> DataFrame:
    """A table; texts: whether its texts are read, so that it is worth spreading over the cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if texts and name in TEXTS else rows


def stream(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: a pattern lists either, where a filter on the name sees only files."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def prompts(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """documents as prompts: domain from the language, task type from the source, every tenth inactive."""
    d = table(spark, sf_dir, "documents", texts)
    return d.select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("prompt_text"),
        F.array("lang").alias("domain"),
        F.array("source").alias("task_type"),
        F.when(F.col("doc_id") % 10 == 0, "inactive").otherwise("active").alias("status"),
        "source",
        "n_chars",
    )


def chunk_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 5).alias("id"), "embedding", F.col("label").cast("string").alias("domain"))


def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query, so that queries grow with the table."""
    e = table(spark, sf_dir, "embeddings")
    return e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as queries, with the documents that hold them.

    A text that holds an item has the item's inner words (between blanks) as words of its own: documents and items
    meet by the longest of them, which few documents have, and are compared then. Items without inner words are compared with all documents.
    """
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gold_id"), "text")
    cut = F.split("query", " ", -1)
    inner = F.array_sort(F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(0))), lambda w: F.struct((-F.length(w)).alias("size"), w.alias("word"))))
    keyed = b.withColumn("word", F.get(inner, F.lit(0))["word"])
    words = d.select("gold_id", F.explode_outer(F.array_distinct(F.split("text", " ", -1))).alias("word"))
    pairs = words.join(bounded(keyed.filter("word IS NOT NULL")), "word").select("query_id", "query", "gold_id")
    held = d.join(bounded(pairs), "gold_id").filter(F.col("text").contains(F.col("query")))
    short = keyed.filter("word IS NULL")
    rest = d.join(short, F.col("text").contains(F.col("query"))) if not short.isEmpty() else None
    found = held.select("query_id", "query", "gold_id")
    return found if rest is None else found.unionByName(rest.select("query_id", "query", "gold_id"))


def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items' first six words as queries."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.substring_index("text", " ", 6).alias("query"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    outcome = F.when((q == 1) & (t == 0), "success").when((q == 1) & (t == 1), "partial").when((q == 0) & (t == 0), "failure").otherwise("skipped")
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 7).alias("prompt_id"), "doc_id", outcome.alias("outcome"), ((F.col("doc_id") % 100) / 100).alias("quality_score"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as skills, their distinct parts as steps."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("skill_id"), F.col("l_partkey").alias("id")).distinct()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


PROMPTS = "SELECT doc_id AS id, substr(text, 1, 60) AS title, text AS prompt_text, [lang] AS domain, [source] AS task_type, CASE WHEN doc_id % 10 = 0 THEN 'inactive' ELSE 'active' END AS status, source, n_chars FROM documents"
CHUNKS = "SELECT vec_id AS chunk_id, vec_id // 5 AS id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS VARCHAR) AS domain FROM embeddings"
VEC_QUERIES = "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE vec_id % 20 = 0"
GOLDEN = "SELECT item_id AS query_id, b.text AS query, doc_id AS gold_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"
WORD_QUERIES = "SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS query FROM benchmark"
FEEDBACK = "SELECT doc_id % 7 AS prompt_id, doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'success' WHEN quality = 1 AND toxic = 1 THEN 'partial' WHEN quality = 0 AND toxic = 0 THEN 'failure' ELSE 'skipped' END AS outcome, (doc_id % 100) / 100 AS quality_score FROM labels"
STEPS = "SELECT DISTINCT l_orderkey AS skill_id, l_partkey AS id FROM lineitem"
NOISE_SQL = str(sorted(V.NOISE_WORDS))
TERMS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_][\p{{L}}\p{{N}}_./-]*'), lambda x: lower(x))"


def doc_terms_sql(column: str) -> str:
    return f"list_distinct({TERMS.format(column)})"


def query_terms_sql(source: str = "word_queries") -> str:
    """query_id, term, ord of distinct literal terms in order."""
    terms = f"list_filter({TERMS.format('query')}, lambda t: length(t) > 1 AND NOT list_contains({NOISE_SQL}, t))"
    return f"SELECT query_id, term, min(i) AS ord FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS i FROM (SELECT query_id, {terms} AS ts FROM {source})) GROUP BY query_id, term"
