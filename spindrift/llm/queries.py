"""The training-data queries by name: thin digests of the operators beside this file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, language_id, line_dedup, phrases, quality_knn, quality_rules, resampling, sharding, simhash, spelling, toxicity
from .common import fold, read, small_batches


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2)
    scored = toxicity.score(docs.select("doc_id", "text"), scorer)
    score = F.col("toxicity.score")
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), "toxicity.n_clauses", "toxicity.worst")


def quality_scores(docs: DataFrame, spark: SparkSession, sf_dir: str, out: str = "score") -> DataFrame:
    """docs with the score of a space learned from the labelled rows outside the held-out fold."""
    small_batches(spark)
    space = quality_knn.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)
    return quality_knn.score(docs, space, out=out)


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), spark, sf_dir)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer file; spark.spindrift.tokenizers may name another folder."""
    import public_tokenizers

    folder = spark.conf.get("spark.spindrift.tokenizers", None)
    return f"{folder}/{name}" if folder else str(public_tokenizers.path(name))


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents."""
    small_batches(docs.sparkSession)
    coded = bpe.encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read(spark, sf_dir, "documents"), tokenizer_path(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    models = language_id.fit(docs.filter(fold("doc_id", 3) != 1))
    found = language_id.predict(docs.select("doc_id", "text"), models)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.cross_entropy", "language.rejected")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = html_text.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compare(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_knn, op3_line_dedup, op4_simhash, op5_bpe, op6_language_id, op7_html_text, op8_decontaminate, op9_quality_rules, op10_sharding, op11_resampling, op12_spelling, op13_phrases, pipeline)}

ORACLE_SQL = {"op3_line_dedup": line_dedup.SQL, "op8_decontaminate": decontaminate.SQL, "op11_resampling": resampling.SQL, "op12_spelling": spelling.SQL}
