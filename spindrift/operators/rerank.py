"""Reranking: document text, scores and their shaping, context, coverage and the final decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..session import settled
from .retrieval import bounded


def rerank_document(title: str = "title", text: str = "prompt_text", summary: str = "summary", chunk: str | None = None, **taxonomy: str) -> Column:
    """What the scorer reads: title, summary unless the text holds it, taxonomy lines, then the matched chunk whole or the text within the budget."""
    line = lambda label, value: F.when(F.length(value) > 0, F.concat(F.lit(f"{label}: "), value))
    body = F.coalesce(F.col(text), F.lit(""))
    short = F.coalesce(F.col(summary), F.lit(""))
    lines = [line("Title", F.col(title)), F.when((short != "") & ~body.contains(short), F.concat(F.lit("Summary: "), short))]
    lines += [line(label.replace("_", " ").capitalize(), F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")) for label, c in taxonomy.items()]
    head = F.concat_ws("\n", *lines)
    cut = F.substring(body, F.lit(1), F.greatest(F.lit(0), F.lit(V.MAX_DOC_CHARS) - F.length(head) - 1))
    return F.concat_ws("\n", head, F.coalesce(F.col(chunk), cut) if chunk else cut)


def overlap_scorer(pairs: pd.DataFrame) -> pd.Series:
    """The offline scorer: six times the share of the query's words that the document has, less three."""
    q = pairs["query"].str.lower().str.split().map(set)
    d = pairs["document"].str.lower().str.split().map(set)
    return pd.Series([6.0 * len(a & b) / len(a) - 3.0 if a else -3.0 for a, b in zip(q, d, strict=True)])


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series] = overlap_scorer, out: str = "raw") -> DataFrame:
    """pairs with a score from a plug-in, a batch at a time; it gets the first 500 characters of the query and the document."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for query, document in batches:
            yield scorer(pd.DataFrame({"query": query.fillna(""), "document": document.fillna("")})).astype(float)

    return pairs.withColumn(out, run(F.left("query", F.lit(V.MAX_QUERY_CHARS)), "document"))


def remote_scorer(remote: Callable[[list[tuple[str, str]]], list[float]], fallback: Callable[[pd.DataFrame], pd.Series] = overlap_scorer, batch: int = 20) -> Callable[[pd.DataFrame], pd.Series]:
    """A scorer that asks a service for a batch of pairs at a time; an error or a wrong count of scores sends its whole Arrow batch to the fallback, and those after it too.

    The state is the task's: a new task asks the service again.
    """
    down = False

    def run(pairs: pd.DataFrame) -> pd.Series:
        nonlocal down
        if not down:
            rows, scores = list(zip(pairs["query"], pairs["document"], strict=True)), []
            try:
                for at in range(0, len(rows), batch):
                    got = remote(rows[at : at + batch])
                    if len(got) != len(rows[at : at + batch]):
                        raise ValueError("a wrong number of scores came back")
                    scores += got
                return pd.Series(scores, dtype=float)
            except Exception:  # noqa: BLE001  whatever the service does, the batch is to be scored
                down = True
        return fallback(pairs)

    return run


def score_lists(pairs: DataFrame, remote: Callable[[list[tuple[str, str]]], list[float]], fallback: Callable[[pd.DataFrame], pd.Series] = overlap_scorer, batch: int = 20, by: str = "query_id", out: str = "raw") -> DataFrame:
    """pairs with raw and scorer ("remote" or "fallback"): a query's whole list is scored by one of them.

    A list of which the service failed to score a pair is scored again by the fallback, so that no list mixes two scales.
    """
    nothing = lambda rows: pd.Series([float("nan")] * len(rows))
    asked = settled(score_pairs(pairs, remote_scorer(remote, nothing, batch), out).withColumn(out, F.nanvl(out, F.lit(None).cast("double"))))
    broken = asked.filter(F.col(out).isNull()).select(by).distinct()
    good = asked.join(bounded(broken), by, "left_anti").withColumn("scorer", F.lit("remote"))
    again = score_pairs(asked.join(bounded(broken), by, "left_semi").drop(out), fallback, out).withColumn("scorer", F.lit("fallback"))
    return good.unionByName(again)


def length_penalty(chars: Column | str) -> Column:
    over = F.greatest(F.lit(0.0), (X.col(chars) - V.LENGTH_FROM) / V.LENGTH_FROM)
    return V.LENGTH_STRENGTH * F.pow(over, F.lit(V.LENGTH_CURVE))


def shaped_score(raw: Column | str, chars: Column | str) -> Column:
    """The raw score through a clamped sigmoid, less the length penalty of the parent's text."""
    return X.sigmoid(X.col(raw)) - length_penalty(chars)


def lower_all(array: Column | str) -> Column:
    return F.transform(F.coalesce(X.col(array), F.array().cast("array<string>")), F.lower)


def context_rescore(ranked: DataFrame, active_domains: list[str], recurring_domains: list[str], intents: list[str], insights: list[str], unused: dict[int, float]) -> DataFrame:
    """ranked with context_adjustment, reasons and final_score. unused: relevance of prior retrievals by id; below .4 they count against."""
    has = lambda c, values: F.arrays_overlap(lower_all(c), X.array_of([v.lower() for v in values])) if values else F.lit(False)
    active = has("domain", active_domains)
    recurring = ~active & has("domain", recurring_domains)
    intent = has("intent", intents) if "intent" in ranked.columns else F.lit(False)
    insight = F.lower("title").rlike("|".join(insights)) if insights else F.lit(False)
    prior = F.col("id").isin([i for i, r in unused.items() if r < V.PRIOR_UNUSED_BELOW])
    parts = [("domain", active), ("recurring", recurring), ("intent", intent), ("insight", insight), ("prior", prior)]
    change = sum((F.when(c, V.BOOSTS[n]).otherwise(0.0) for n, c in parts), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in parts]))
    out = ranked.withColumn("context_adjustment", change).withColumn("reasons", reasons)
    return out.withColumn("final_score", F.col("rerank_score") + F.col("context_adjustment"))


def coverage(ranked: DataFrame, steps: DataFrame, window: int = V.TOP_WINDOW, least: int = V.MIN_MATCHED_STEPS) -> DataFrame:
    """query_id, skill_id, score, hits, coverage, top_is_step: skills whose steps are among the first candidates. steps: skill_id, id, distinct."""
    size = steps.groupBy("skill_id").agg(F.count_distinct("id").alias("n_steps"))
    first = ranked.filter(F.col("rank") <= window)
    hits = first.join(steps.select("skill_id", "id").distinct(), "id").groupBy("query_id", "skill_id").agg(F.max("score").alias("score"), F.count_distinct("id").alias("hits"), F.min("rank").alias("best"))
    return hits.filter(F.col("hits") >= least).join(size, "skill_id").select("query_id", "skill_id", "score", "hits", (F.col("hits") / F.col("n_steps")).alias("coverage"), (F.col("best") == 1).alias("top_is_step"))


def winner(ranked: DataFrame, covered: DataFrame | None = None, prefer: str = "auto", floor: float = V.MIN_CONFIDENCE) -> DataFrame:
    """query_id, mode (skill, single or none), served_id, score.

    ranked: query_id, id, kind, n_steps, score, arrival. The first servable row
    wins: a skill needs steps and coverage, else the best prompt is taken.
    ``prefer`` skips one kind. Below the floor nothing is served, and the score is what was turned down.
    """
    rows = ranked.filter((F.col("kind") != "skill") | (F.coalesce(F.col("n_steps"), F.lit(0)) > 0))
    if covered is not None:
        rows = rows.join(covered.select("query_id", F.col("skill_id").alias("id"), F.lit(True).alias("ok")), ["query_id", "id"], "left").filter((F.col("kind") != "skill") | F.col("ok"))
    if prefer in ("single", "skill"):
        rows = rows.filter(F.col("kind") == ("prompt" if prefer == "single" else "skill"))
    kind = F.when(F.col("kind") == "skill", "skill").otherwise("single")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "arrival"))).filter("n = 1")
    served = F.col("score") >= floor
    return first.select("query_id", F.when(served, kind).otherwise("none").alias("mode"), F.when(served, F.col("id")).alias("served_id"), "score")


def expansion_text(messages: Column, insights: Column, most: int = 1000) -> Column:
    """The last three messages and up to three insights of confidence .5 or more, within the budget. insights: array of (text, confidence)."""
    sure = F.slice(F.filter(insights, lambda x: x["confidence"] >= 0.5), 1, 3)
    return F.left(F.concat_ws(" ", F.slice(messages, F.greatest(F.size(messages) - 2, F.lit(1)), F.lit(3)), F.transform(sure, lambda x: x["text"])), F.lit(most))


def boost_ids(retrievals: Column, least: float = 0.7, most: int = 5) -> Column:
    """Ids of prior retrievals of that relevance or more, best first. retrievals: array of (id, relevance)."""
    good = F.filter(retrievals, lambda x: x["relevance"] >= least)
    order = F.array_sort(F.transform(good, lambda x, i: F.struct((-x["relevance"]).alias("r"), i.alias("i"), x["id"].alias("id"))))
    return F.transform(F.slice(order, 1, most), lambda x: x["id"])


def z_margin(ranked: DataFrame, window: int = 30) -> DataFrame:
    """query_id, z (how far the first stands out, in deviations), margin (first less second)."""
    rows = ranked.filter(F.col("rank") <= window).groupBy("query_id").agg(F.max("score").alias("a"), F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    return rows.select("query_id", F.try_divide(F.col("a") - F.col("m"), F.col("s")).alias("z"), (F.col("a") - F.col("b")).alias("margin"))


def rollup_bonus(chunks: DataFrame, bonus: float = 0.05, most: float = 0.10) -> DataFrame:
    """query_id, id, score: the best chunk's score and .05 for each further one, .10 at most."""
    own = chunks.groupBy("query_id", "id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    return own.select("query_id", "id", (F.col("best") + F.least(F.lit(most), bonus * (F.col("n") - 1))).alias("score"))
