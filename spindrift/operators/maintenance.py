"""Upkeep of vectors and chunks: embedding what is missing, chunk rebuilds, width changes, agreement with the model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plugins
from ..functions import text as X
from ..functions import vocabulary as V
from . import chunking


def embed_missing(prompts: DataFrame, version: str, embedder: Callable | None = None, size: int = 64, again: bool = False) -> DataFrame:
    """prompts (id, title, prompt_text, embedding, embedding_version) with vectors where they lack one; blank texts stay without."""
    blank = F.length(F.trim(F.coalesce("prompt_text", F.lit("")))) == 0
    todo = ~blank & (F.lit(again) | F.col("embedding").isNull())
    source = F.left(X.expand_acronyms(F.concat_ws("\n", "title", "prompt_text")), F.lit(V.MAX_DOC_CHARS))
    run = plugins.embed(size, embedder)
    fresh = prompts.filter(todo).withColumns({"embedding": run(source), "embedding_version": F.lit(version)})
    return fresh.unionByName(prompts.filter(~todo).withColumn("embedding", F.col("embedding").cast("array<float>")))


def embed_skills(skills: DataFrame, version: str, embedder: Callable | None = None, size: int = 64, again: bool = False) -> DataFrame:
    """skills (name, summary, status, routing_embedding, embedding_version, ...) with vectors of name and summary for active ones that lack one."""
    todo = (F.col("status") == "active") & (F.lit(again) | F.col("routing_embedding").isNull())
    source = F.left(X.expand_acronyms(F.concat_ws("\n", "name", "summary")), F.lit(V.MAX_DOC_CHARS))
    fresh = skills.filter(todo).withColumns({"routing_embedding": plugins.embed(size, embedder)(source), "embedding_version": F.lit(version)})
    return fresh.unionByName(skills.filter(~F.coalesce(todo, F.lit(False))).withColumn("routing_embedding", F.col("routing_embedding").cast("array<float>")))


def backfill_chunks(prompts: DataFrame, version: str, embedder: Callable | None = None, size: int = 64) -> DataFrame:
    """The chunk table, rebuilt: chunks with vectors, each distinct text embedded once, whole. prompts: id, title, prompt_text and, if there is one, summary."""
    summary = F.col("summary") if "summary" in prompts.columns else F.lit(None).cast("string")
    cut = chunking.chunks(prompts, "id", "prompt_text").join(prompts.select("id", "title", summary.alias("summary")), "id")
    cut = cut.withColumn("embed_text", chunking.embed_text(F.col("title"), F.col("label"), F.col("chunk_text"), F.col("summary"))).withColumn("key", X.content_hash("embed_text"))
    once = cut.select("key", "embed_text").dropDuplicates(["key"]).select("key", plugins.embed(size, embedder)("embed_text").alias("embedding"))
    return cut.join(once, "key").withColumn("embedding_version", F.lit(version)).drop("embed_text", "title", "summary")


def check_version(table: DataFrame, version: str) -> None:
    """Refuses an index of which a vector was made by another model; an empty one agrees with any."""
    others = table.filter(F.col("embedding").isNotNull() & ~F.col("embedding_version").eqNullSafe(F.lit(version))).select("embedding_version").distinct().limit(10).collect()
    if others:
        raise ValueError(f"vectors of {sorted(str(r[0]) for r in others)} can't be searched with {version}; embed them again")


def change_width(table: DataFrame, size: int) -> DataFrame:
    """table without vectors of another width, so that embed_missing makes them anew."""
    fits = F.size("embedding") == size
    return table.withColumns({"embedding_version": F.when(fits, F.col("embedding_version")), "embedding": F.when(fits, F.col("embedding"))})


def by_id_or_tag(skills: DataFrame, key: str) -> DataFrame:
    """The skill of an id, or the latest version of a tag. skills: skill_id, tag, version, ..."""
    if len(key) == 36 and key.count("-") == 4:
        return skills.filter(F.col("skill_id") == key)
    return skills.filter(F.col("tag") == key).orderBy(F.desc("version")).limit(1)


def add_summaries(prompts: DataFrame, summarise: Callable[[list[str]], list[str]]) -> DataFrame:
    """prompts with a summary from a plug-in where there is none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(summarise(texts.fillna("").tolist()))

    lacks = F.length(F.trim(F.coalesce("summary", F.lit("")))) == 0
    return prompts.filter(lacks).withColumn("summary", run("prompt_text")).unionByName(prompts.filter(~lacks))
