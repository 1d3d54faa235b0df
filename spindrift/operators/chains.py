"""Chains of prompts over stages: the best of each stage, chain scores, beam search, and the checks around serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import settled
from ..streaming import refresh
from . import retrieval

BEAM, LONGEST = 10, 5
STAGE_FLOOR = -3.0


def stage_best(scored: DataFrame, floor: float = STAGE_FLOOR) -> DataFrame:
    """scored (query_id, stage, id, score): the best prompt of each stage with how many others it had; stages at the floor or below go."""
    w = Window.partitionBy("query_id", "stage")
    best = scored.withColumns({"n": F.row_number().over(w.orderBy(F.desc("score"), "id")), "alternatives": F.count("*").over(w) - 1})
    return best.filter((F.col("n") == 1) & (F.col("score") > floor)).drop("n")


def beam_search(scored: DataFrame, pairs: DataFrame, width: int = BEAM, longest: int = LONGEST) -> DataFrame:
    """query_id, path (ids), score: the best chains of up to ``longest`` prompts, ``width`` of them kept after each step.

    scored: query_id, id, score; pairs: prev, id, fit, which prompts may follow which. A step
    adds the prompt's score and the fit; no prompt comes twice. Each step joins a beam of at most width rows a query.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    keep = lambda df: df.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= width).drop("n")
    beam = keep(scored.select("query_id", F.array("id").alias("path"), F.col("score").cast("double").alias("score")))
    found = beam
    steps = scored.select("query_id", "id", F.col("score").alias("own"))
    for _ in range(longest - 1):
        ends = beam.withColumn("prev", F.element_at("path", -1))
        grown = ends.join(pairs, "prev").join(steps, ["query_id", "id"]).filter(~F.array_contains("path", F.col("id")))
        beam = keep(grown.select("query_id", F.concat("path", F.array("id")).alias("path"), (F.col("score") + F.col("own") + F.col("fit")).alias("score")))
        found = found.unionByName(beam)
    return keep(found)


def taxonomy_skew(rows: DataFrame, field: str, most: float = 0.4) -> DataFrame:
    """value, share: values of an array field on more than that share of the rows."""
    total = rows.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    own = rows.select(F.explode(F.array_distinct(field)).alias("value")).groupBy("value").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return own.join(F.broadcast(total), "one").select("value", (F.col("n") / F.col("total")).alias("share")).filter(F.col("share") > most)


def fill_problems(template: Column | str, filled: Column | str, change: float = 0.4) -> Column:
    """What is wrong with a filled template: slots left, fences changed, length off by more than the share, empty."""
    template, filled = F.coalesce(X.col(template), F.lit("")), F.coalesce(X.col(filled), F.lit(""))
    off = F.abs(F.length(filled) - F.length(template)) > change * F.length(template)
    return F.array_compact(F.array(F.when(F.size(X.slots(filled)) > 0, "slots left"), F.when(~X.same_fences(template, filled), "fences changed"), F.when(off, "length"), F.when(F.trim(filled) == "", "empty")))


def serving_outcome(served: DataFrame, used: DataFrame, rewards: DataFrame, seconds: int = 60) -> DataFrame:
    """served (episode_id, ts, text and columns of its own, which stay and decide between equal times) with used, edited, edit_distance, requeried and reward. used: episode_id, final_text; rewards: episode_id, value."""
    own = [c for c in served.columns if c not in ("episode_id", "ts", "text")]
    after = F.lead("ts").over(Window.partitionBy("episode_id").orderBy("ts", *own))
    again = F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= seconds * 1_000_000
    rows = served.withColumn("requeried", F.coalesce(again, F.lit(False))).join(used, "episode_id", "left").join(rewards.groupBy("episode_id").agg(F.sum("value").alias("reward")), "episode_id", "left")
    distance = F.levenshtein("text", "final_text")
    return rows.select("episode_id", "ts", *own, F.col("final_text").isNotNull().alias("used"), F.coalesce(distance > 0, F.lit(False)).alias("edited"), distance.alias("edit_distance"), "requeried", F.coalesce("reward", F.lit(0.0)).alias("reward"))


def pair_counts(steps: DataFrame) -> DataFrame:
    """prev, id, n: in how many skills a prompt comes with a later one (by id). steps: skill_id, id, each once."""
    return steps.select("skill_id", F.col("id").alias("prev")).join(steps.select("skill_id", "id"), "skill_id").filter("prev < id").groupBy("prev", "id").agg(F.count("*").alias("n"))


def add_day(steps: DataFrame, path: str, day: int) -> None:
    """Adds the pairs of a day's new skills to the pair cache at path, once for each day, also if it is run again. Days come in order."""
    refresh.merge(pair_counts(steps), day, path, ["prev", "id"], ["n"])


def successors(counts: DataFrame, k: int = 20) -> DataFrame:
    """prev, id, fit: of each prompt the k that most often follow; fit is the share of the most frequent one's count. It bounds what a hub brings to a step of a beam."""
    w = Window.partitionBy("prev")
    ranked = counts.withColumns({"k": F.row_number().over(w.orderBy(F.desc("n"), "id")), "most": F.max("n").over(w)})
    return ranked.filter(F.col("k") <= k).select("prev", "id", (F.col("n") / F.col("most")).alias("fit"))


def cluster_labels(vectors: DataFrame, labels: DataFrame, k: int = 8, seed: int = 7) -> DataFrame:
    """id, cluster, label: k-means clusters, each with the label of its labelled member nearest the centre. vectors: id, embedding; labels: id, label."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed).fit(points)
    rows = [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]
    centres = F.broadcast(vectors.sparkSession.createDataFrame(rows, "cluster int, centre array<double>"))
    placed = model.transform(points).select("id", F.col("prediction").alias("cluster"), vector_to_array("features").alias("v")).join(centres, "cluster")
    far = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = placed.join(labels, "id").groupBy("cluster").agg(F.min_by("label", F.struct(far, "id")).alias("label"))
    return placed.select("id", "cluster").join(F.broadcast(near), "cluster", "left").select("id", "cluster", "label")


#: Weights and thresholds of the specified scores.
PROMPT_WEIGHTS = {"dense_sim": 0.35, "lexical_sim": 0.25, "metadata_match": 0.15, "stage_fit": 0.10, "quality_prior": 0.10, "freshness": 0.05}
CHAIN_WEIGHTS = {"avg_prompt_score": 0.45, "workflow_coverage": 0.25, "transition_coherence": 0.15, "non_redundancy": 0.10, "confidence_margin": 0.05}
T_SINGLE, T_CHAIN, DELTA = 0.76, 0.72, 0.06


def weighted_score(weights: dict[str, float], penalty: Column | float = 0.0) -> Column:
    """The weighted sum of the columns named, less a penalty; a null column counts as 0."""
    total = sum((w * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return total - (F.lit(penalty) if isinstance(penalty, float) else penalty)


def best_chains(chains: DataFrame) -> DataFrame:
    """The best chain of each query (query_id, chain_id, chain_score, workflow_coverage, quality_prior, redundancy, last_updated): ties by coverage, prior, less redundancy, then the latest."""
    order = [F.desc("chain_score"), F.desc("workflow_coverage"), F.desc("quality_prior"), F.asc("redundancy"), F.desc("last_updated"), F.asc("chain_id")]
    return chains.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter("__n = 1").drop("__n")


def select_mode(single: Column, chain: Column, t_single: float = T_SINGLE, t_chain: float = T_CHAIN, delta: float = DELTA) -> Column:
    """single, chain or clarify from the best scores of each; a missing one never wins."""
    s, c = F.coalesce(single, F.lit(float("-inf"))), F.coalesce(chain, F.lit(float("-inf")))
    return F.when((s >= t_single) & ~(c - s >= delta), "single").when(c >= t_chain, "chain").otherwise("clarify")


def copies(items: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, copy_of: for each item the least id among those whose text is the same but for case and white space."""
    key = X.content_hash(X.normalize(text_col))
    first = items.groupBy(key.alias("__h")).agg(F.min(id_col).alias("copy_of"))
    return items.select(F.col(id_col).alias("id"), key.alias("__h")).join(first, "__h").select("id", "copy_of")


def expand_neighbours(pool: DataFrame, vectors: DataFrame, threshold: float = 0.9, k: int = 10) -> DataFrame:
    """query_id, id, via: candidates, and the items of a cosine of the threshold or more to one of them (the k nearest of each), each once; via is null for the pool's own.

    pool: query_id, id, which is small beside vectors: id, embedding. Its distinct items are searched for exactly.
    """
    pool = settled(pool)
    own = pool.select("query_id", "id", F.lit(None).cast(pool.schema["id"].dataType).alias("via"))
    asked = vectors.join(retrieval.bounded(pool.select("id").distinct()), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")
    near = retrieval.dense_topk(vectors, asked, k, skip_self=True).filter(F.col("score") >= threshold).select(F.col("query_id").alias("via"), "id")
    more = pool.select("query_id", F.col("id").alias("via")).join(near, "via").join(own.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return own.unionByName(more.groupBy("query_id", "id").agg(F.min("via").alias("via")))


def dedupe_pool(pool: DataFrame, threshold: float = 0.95) -> DataFrame:
    """pool (query_id, id, arrival, content_hash, embedding) without rows that an earlier one of their query equals in hash, or meets in cosine.

    A pool is capped for each query, so its rows are compared within the query.
    """
    pool = settled(pool)
    a = pool.select("query_id", F.col("arrival").alias("__a"), F.col("content_hash").alias("__h"), F.col("embedding").alias("__v"))
    earlier = (F.col("__a") < F.col("arrival")) & ((F.col("__h") == F.col("content_hash")) | (retrieval.cosine("__v", "embedding") >= threshold))
    gone = pool.join(a, "query_id").filter(earlier).select("query_id", "arrival").distinct()
    return pool.join(gone, ["query_id", "arrival"], "left_anti")
