"""Prompt optimisation as tables: variants, runs, golden examples, their reports, and the gate that promotes.

Tables grow by appending; what is current is worked out on reading. "Now" is always an argument.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from . import rules

VARIANT = ["prompt_id", "model"]


def write_variants(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """table (prompt_id, model, content_hash, prompt_text, metric_score, created_at, is_current) after fresh rows (prompt_id, model, prompt_text, metric_score, created_at).

    A text that the table has for the prompt and model keeps its row and takes the new
    score; of each prompt and model with fresh rows the latest of these is current, all others not.
    """
    new = fresh.withColumn("content_hash", X.content_hash("prompt_text"))
    last = F.row_number().over(Window.partitionBy(*VARIANT).orderBy(F.desc("created_at"), F.desc("content_hash")))
    new = new.withColumn("__last", last == 1)
    once = new.groupBy(*VARIANT, "content_hash").agg(F.max_by(F.struct("prompt_text", "metric_score", "created_at"), "created_at").alias("n"), F.max("__last").alias("__last"))
    touched = new.select(*VARIANT, F.lit(True).alias("__touched")).distinct()
    both = table.join(once, [*VARIANT, "content_hash"], "full").join(touched, VARIANT, "left")
    return both.select(
        *VARIANT,
        "content_hash",
        F.coalesce("prompt_text", "n.prompt_text").alias("prompt_text"),
        F.coalesce("n.metric_score", "metric_score").alias("metric_score"),
        F.coalesce("created_at", "n.created_at").alias("created_at"),
        F.when(F.col("__touched"), F.coalesce("__last", F.lit(False))).otherwise(F.col("is_current")).alias("is_current"),
    )


def run_states(events: DataFrame) -> DataFrame:
    """run_id, prompt_id, model, metric_type, started_at, completed_at, baseline, optimized, improvement, status: from start and completion events of a log.

    events: run_id, kind (start, complete), ts, and the columns of their kind. A run without completion is running; its last completion counts.
    """
    start, done = F.col("kind") == "start", F.col("kind") == "complete"
    first = lambda c: F.min_by(F.when(start, F.col(c)), F.when(start, F.col("ts"))).alias(c)
    last = lambda c: F.max_by(F.when(done, F.col(c)), F.when(done, F.col("ts"))).alias(c)
    runs = events.groupBy("run_id").agg(*map(first, ("prompt_id", "model", "metric_type")), F.min(F.when(start, F.col("ts"))).alias("started_at"), F.max(F.when(done, F.col("ts"))).alias("completed_at"), *map(last, ("baseline", "optimized")), last("status").alias("__status"))
    return runs.withColumns({"improvement": F.col("optimized") - F.col("baseline"), "status": F.coalesce("__status", F.lit("running"))}).drop("__status")


def status_report(variants: DataFrame, runs: DataFrame, examples: DataFrame, recent: int = 10) -> DataFrame:
    """prompt_id, models (of current variants, latest first), runs (the most recent, latest first), n_examples, external_ratio: for every prompt with any of them."""
    now = variants.filter("is_current").groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("o"), "model", "metric_score"))).alias("m"))
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("started_at"), "run_id"))
    late = runs.withColumn("n", place).filter(F.col("n") <= recent).groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("n", "run_id", "status", "improvement"))).alias("r"))
    own = source_distribution(examples)
    out = now.join(late, "prompt_id", "full").join(own.select("prompt_id", F.col("total").alias("n_examples"), "external_ratio"), "prompt_id", "full")
    return out.select("prompt_id", F.transform("m", lambda x: x["model"]).alias("models"), F.transform("r", lambda x: x["run_id"]).alias("runs"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"), "external_ratio")


def source_distribution(examples: DataFrame) -> DataFrame:
    """prompt_id, total, external_count, memory_count, contrastive_count, manual_count, external_ratio of the examples that aren't negative."""
    source = F.col("source")
    own = examples.filter(~F.coalesce("is_negative", F.lit(False))).groupBy("prompt_id").agg(
        F.count("*").alias("total"),
        F.count_if(source != "memory_project").alias("external_count"),
        F.count_if(source == "memory_project").alias("memory_count"),
        F.count_if(source == "contrastive").alias("contrastive_count"),
        F.count_if(source == "manual").alias("manual_count"),
    )
    return own.withColumn("external_ratio", F.round(F.try_divide("external_count", "total"), 2))


def compare_report(prompts: DataFrame, variants: DataFrame) -> DataFrame:
    """prompt_id, model, prompt_text, metric_score, same_as_canonical: the canonical text (model null) and each current variant of prompts that have one."""
    now = variants.filter("is_current").select("prompt_id", "model", F.col("prompt_text").alias("text"), "metric_score")
    base = prompts.select("prompt_id", F.col("prompt_text").alias("canonical")).join(now.select("prompt_id").distinct(), "prompt_id", "left_semi")
    rows = now.join(base, "prompt_id").select("prompt_id", "model", F.col("text").alias("prompt_text"), "metric_score", (F.col("text") == F.col("canonical")).alias("same_as_canonical"))
    return rows.unionByName(base.select("prompt_id", F.lit(None).cast("string").alias("model"), F.col("canonical").alias("prompt_text"), F.lit(None).cast("double").alias("metric_score"), F.lit(True).alias("same_as_canonical")))


def list_examples(examples: DataFrame, preview: int = 100) -> DataFrame:
    """examples by prompt, newest first within it (place), with previews of input and output."""
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("created_at"), "example_id"))
    return examples.select("prompt_id", place.alias("place"), "example_id", "source", "model", "is_negative", F.left("input_text", F.lit(preview)).alias("input_preview"), F.left("output_text", F.lit(preview)).alias("output_preview"))


def ab_gate_scored(candidates: DataFrame, examples: DataFrame, metric: Callable[[str, str], float], margin: float = V.MIN_IMPROVEMENT) -> DataFrame:
    """prompt_id, baseline_score, candidate_score, n_examples, promoted, reason: each candidate text against the canonical one over its prompt's examples.

    candidates: prompt_id, canonical, candidate; examples: prompt_id, output_text. metric(expected,
    text) gives 0 to 1; one that raises scores 0. Equal outputs of a prompt are scored once. Without examples nothing is promoted.
    """

    @F.pandas_udf("struct<a: double, b: double>")
    def scores(expected: pd.Series, canonical: pd.Series, candidate: pd.Series) -> pd.DataFrame:
        def safe(x: str, y: str) -> float:
            try:
                return float(metric(x, y))
            except (TypeError, ValueError, ArithmeticError):
                return 0.0

        return pd.DataFrame({"a": [safe(x, y) for x, y in zip(expected, canonical, strict=True)], "b": [safe(x, y) for x, y in zip(expected, candidate, strict=True)]})

    outputs = examples.groupBy("prompt_id", "output_text").agg(F.count("*").alias("w"))
    rows = outputs.join(candidates.select("prompt_id", "canonical", "candidate"), "prompt_id").withColumn("s", scores("output_text", "canonical", "candidate"))
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w"))
    own = rows.groupBy("prompt_id").agg(mean("s.a").alias("baseline_score"), mean("s.b").alias("candidate_score"), F.sum("w").alias("n_examples"))
    out = candidates.join(own, "prompt_id", "left").withColumn("n_examples", F.coalesce("n_examples", F.lit(0)))
    gate = rules.ab_gate(F.coalesce("baseline_score", F.lit(0.0)), F.coalesce("candidate_score", F.lit(0.0)), F.col("n_examples"), X.same_fences("canonical", "candidate"), margin)
    return out.select("prompt_id", "baseline_score", "candidate_score", "n_examples", gate["promoted"].alias("promoted"), gate["reason"].alias("reason"))


def update_canonical(prompts: DataFrame, promoted: DataFrame, as_of: Column) -> DataFrame:
    """prompts (prompt_id, title, prompt_text, content_hash, last_updated, embedding, embedding_version, ...) with promoted texts (prompt_id, candidate) in place.

    What is derived from the text follows it: its hash, the time, and the vector, which goes so that it is made anew.
    """
    joined = prompts.join(promoted.select("prompt_id", F.col("candidate").alias("__new")), "prompt_id", "left")
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("prompt_text"))
    out = joined.withColumn("__changed", changed).withColumn("prompt_text", F.coalesce("__new", "prompt_text"))
    fields = {"content_hash": X.content_hash("prompt_text"), "last_updated": as_of, "embedding": F.lit(None).cast(prompts.schema["embedding"].dataType), "embedding_version": F.lit(None).cast("string")}
    return out.select(*[F.when(F.col("__changed"), fields[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in prompts.columns])
