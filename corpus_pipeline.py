"""A training corpus from raw documents, stage by stage.

Each stage gets the rows that its predecessor wrote and returns rows with the
columns of documents; the last returns the tokenised digest. run() writes each
stage's rows to the checkpoint folder and reads them again, which cuts lineage
and lets a stage be retried from what is on shared storage; what a stage wrote is
removed once the next one has been written.

All stages take null texts and ids, empty and very long texts, rows that repeat,
empty tables and columns beyond those of documents, which they hand on as they
are. A null text stays null where its row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, line_dedup, simhash
from spindrift.llm.common import cut, read, small, stage_folder
from spindrift.llm.queries import bpe_digest, quality_scores, tokenizer_path

#: Documents with a lower score go.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote for.

    Null, empty and blank texts have no neighbours and the share of good labels as
    their score, so they stay while at least QUALITY of the labels are good. Equal texts are treated alike.
    """
    return quality_scores(docs, spark, sf_dir, "__score").filter(F.col("__score") >= QUALITY).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many sites share, but for one place of each; n_chars follows.

    No row goes: a text whose lines all go is empty. A null text stays, with its n_chars; a null source is a site of its own.
    """
    cleaned = line_dedup.dedup(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document that names it; rows that repeat its id and text stay once.

    Null, empty and blank texts are one group. Rows are told apart by doc_id, and rows without one are one document:
    all rows of a document that names a group stay, once for each text, whatever group its other texts are in.
    """
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    named = cut(simhash.near_duplicates(docs).groupBy(F.col("doc_id").alias("__doc")).agg(F.count_if(own).alias("__n")))
    gone, again = named.filter("__n = 0"), named.filter("__n > 1")
    same = docs["doc_id"].eqNullSafe(F.col("__doc"))
    kept = docs.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return kept
    again = small(again)
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none, and all copies are treated alike."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; a null text is an empty one, with no tokens."""
    return bpe_digest(docs, tokenizer_path(spark))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with stage_folder(spark, "pipeline") as (folder, remove):
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(f"{folder}/{k - 1}")
    return docs


#: Neighbour votes and shingle hashes aren't SQL.
ORACLE_SQL = None
