"""Rule engines: inference, the retrieval gate, taxonomy repair, promotion gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def _keyword_scores(text: Column, table: dict[str, list[str]]) -> Column:
    """Structs (-score, place, name) of the names with a hit, best first; ties in the table's order."""
    rows = [F.struct((-sum((text.contains(w).cast("int") for w in words), F.lit(0))).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(table.items())]
    return F.array_sort(F.filter(F.array(*rows), lambda x: x["s"] < 0))


def infer_domain(text: Column | str) -> Column:
    """The best domain, and the next if it has 70 % of its hits; technical if none has any."""

    def pick(found: Column) -> Column:
        near = (F.size(found) > 1) & (F.get(found, F.lit(1))["s"] <= F.get(found, F.lit(0))["s"] * 0.7)
        names = F.transform(F.slice(found, F.lit(1), F.when(near, 2).otherwise(1)), lambda x: x["name"])
        return F.when(F.size(found) == 0, F.array(F.lit("technical"))).otherwise(names)

    return X.let(F.lower(X.col(text)), lambda low: X.let(_keyword_scores(low, V.DOMAIN_KEYWORDS), pick))


def infer_intent(text: Column | str) -> Column:
    """The two best intents; build if none has a hit."""
    pick = lambda found: F.when(F.size(found) == 0, F.array(F.lit("build"))).otherwise(F.transform(F.slice(found, 1, 2), lambda x: x["name"]))
    return X.let(F.lower(X.col(text)), lambda low: X.let(_keyword_scores(low, V.INTENT_KEYWORDS), pick))


def heuristic_gate(message: Column | str, has_recent: Column | bool = False) -> Column:
    """struct(search, confidence, reason) where a first look settles the message, else null."""
    message = X.col(message)
    out = lambda c, r: F.struct(F.lit(False).alias("search"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    brief = (X.word_count(message) < 5) & ~X.has_workflow_verb(message)
    return F.when(X.is_greeting(message), out(0.95, "casual greeting")).when(X.is_followup(message, has_recent), out(0.90, "conversational followup")).when(brief, out(0.80, "too brief, no action signal"))


def band_gate(sim: Column, words: Column, density: Column, threshold: Column | float = V.GATE_SIMILARITY) -> Column:
    """struct(search, confidence, reason): similar enough, neither too short nor too long, not already specified; a miss names each failing part."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    two = lambda x: F.format_string("%.2f", x)
    low, high = V.GATE_WORDS
    fails = F.array_compact(
        F.array(
            F.when(sim < threshold, F.concat(F.lit("no semantic match (sim="), two(sim), F.lit("<"), two(threshold), F.lit(")"))),
            F.when(words < low, F.concat(F.lit("too simple ("), words.cast("string"), F.lit(f"w<{low})"))),
            F.when(words > high, F.concat(F.lit("too long ("), words.cast("string"), F.lit(f"w>{high})"))),
            F.when(density > V.GATE_DENSITY, F.concat(F.lit("already specified (density="), two(density), F.lit(f">{V.GATE_DENSITY:.2f})"))),
        )
    )
    opens = F.size(fails) == 0
    reason = F.when(opens, F.concat(F.lit("semantic match (sim="), two(sim), F.lit("), in complexity band"))).otherwise(F.array_join(fails, "; "))
    return F.struct(opens.alias("search"), F.round(F.when(opens, sim).otherwise(1 - sim), 3).alias("confidence"), reason.alias("reason"))


def cached_gate(message: Column | str, cached: Column) -> Column:
    """True if a cached retrieval (struct id, situation, relevance, score) covers the message."""
    return F.exists(cached, lambda c: (c["relevance"] > 0.75) & (c["score"] > 0.7) & X.situation_overlaps(message, c["situation"]))


def full_gate(message: Column | str, sim: Column, has_recent: Column, active_match: Column, drift: Column, cached: Column) -> Column:
    """Heuristics, then cached retrievals, then the band with its threshold eased by .05 for an active domain and .03 for drift; no similarity: closed."""
    message = X.col(message)
    threshold = F.lit(V.GATE_SIMILARITY) - F.when(active_match, V.DOMAIN_RELAX).otherwise(0.0) - F.when(drift >= V.DRIFT_HIGH, V.DRIFT_RELAX).otherwise(0.0)
    closed = lambda c, r: F.struct(F.lit(False).alias("search"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    return F.coalesce(
        heuristic_gate(message, has_recent),
        F.when(cached_gate(message, cached), closed(0.75, "cached retrieval covers this")),
        F.when(sim.isNull(), closed(0.5, "similarity unavailable")),
        band_gate(sim, X.word_count(message), X.spec_density(message), threshold),
    )


def repair_taxonomy(rows: DataFrame, valid: dict[str, list[str]]) -> DataFrame:
    """rows with each field's array: values that belong to another field move there, unknown ones go. valid: field -> its values."""
    empty = F.array().cast("array<string>")
    own = lambda c: F.coalesce(F.col(c), empty)
    fixed = {f: F.array_distinct(F.array_intersect(F.concat(own(f), *[own(g) for g in valid if g != f]), X.array_of(v))) for f, v in valid.items()}
    return rows.withColumns(fixed)


def backfill_status(confidence: Column, threshold: float = V.CLASSIFIER_CONFIDENCE) -> Column:
    """classified if every field is confident enough, else low_confidence; without any, pending. confidence: map to double."""
    values = F.map_values(confidence)
    return F.when(F.size(values) <= 0, "pending").when(F.forall(values, lambda v: v >= threshold), "classified").otherwise("low_confidence")


def ab_gate(baseline: Column, candidate: Column, n_examples: Column, fences_kept: Column, margin: float = V.MIN_IMPROVEMENT) -> Column:
    """struct(promoted, reason): examples, then a gain of the margin or more, then the same code fences."""
    no = lambda r: F.struct(F.lit(False).alias("promoted"), F.lit(r).alias("reason"))
    return F.when(n_examples == 0, no("no examples")).when(F.round(candidate - baseline, 9) < margin, no("below margin")).when(~fences_kept, no("fences changed")).otherwise(F.struct(F.lit(True).alias("promoted"), F.lit("improved").alias("reason")))


def run_allowed(n_examples: Column, n_external: Column, least: int = 5, ratio: float = 0.20) -> Column:
    """ok, or why an optimiser run may not start; warn from .20 up to .30 of external examples."""
    share = F.try_divide(n_external.cast("double"), n_examples)
    return F.when(n_examples < least, "too few examples").when(F.coalesce(share, F.lit(0.0)) < ratio, "too few external examples").when(share < 0.30, "warn").otherwise("ok")


#: The keys that each context field may come under, first wins.
CONTEXT_KEYS = {
    "cli": ["cli"],
    "agent_id": ["agent_id", "agentId"],
    "parent_agent_id": ["parent_agent_id", "parentAgentId"],
    "agent_role": ["agent_role", "agentRole", "role"],
    "session_id": ["session_id", "sessionId"],
    "cwd": ["cwd"],
    "episode_id": ["episode_id", "episodeId"],
    "turn_id": ["turn_id", "turnId"],
}


def context_fields(raw: Column) -> Column:
    """A struct of the context fields from a map with snake or camel keys; blanks are null."""
    pick = lambda keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at(raw, F.lit(k))), F.lit("")) for k in keys])
    return F.struct(*[pick(keys).alias(name) for name, keys in CONTEXT_KEYS.items()])


def classify(rows: DataFrame, model, valid: dict[str, list[str]], retries: int = 3, batch: int = 16) -> DataFrame:
    """rows (id, text) with the fields of ``valid``, confidence and status from a plug-in, asked for a batch of texts at a time.

    model(texts) gives a dict of fields and confidence for each text. A batch that raises or comes back with
    another number is asked again, ``retries`` times in all, and then failed. Values are repaired (see repair_taxonomy);
    a row with none left in a field is failed too.
    """
    kind = ", ".join([*(f"{f}: array<string>" for f in valid), "confidence: map<string,double>", "ok: boolean"])

    @F.pandas_udf(f"struct<{kind}>")
    def ask(texts: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(texts), batch):
            own = texts.iloc[at : at + batch].fillna("").tolist()
            for _ in range(retries):
                try:
                    got = model(own)
                    if len(got) != len(own):
                        raise ValueError("a wrong number of results came back")
                    out += [{**{f: list(g.get(f) or []) for f in valid}, "confidence": {k: float(v) for k, v in (g.get("confidence") or {}).items()}, "ok": True} for g in got]
                    break
                except Exception:  # noqa: BLE001  whatever the model does, its batch is failed, not the job
                    continue
            else:
                out += [{**{f: [] for f in valid}, "confidence": {}, "ok": False}] * len(own)
        return pd.DataFrame(out, columns=[*valid, "confidence", "ok"])

    raw = rows.withColumn("__c", ask("text")).select(*rows.columns, *[F.col(f"__c.{f}").alias(f) for f in valid], F.col("__c.confidence").alias("confidence"), F.col("__c.ok").alias("__ok"))
    fixed = repair_taxonomy(raw, valid)
    whole = F.col("__ok")
    for f in valid:
        whole = whole & (F.size(f) > 0)
    return fixed.withColumn("status", F.when(whole, backfill_status(F.col("confidence"))).otherwise("failed")).drop("__ok")


def classify_stats(classified: DataFrame) -> DataFrame:
    """One row: total, successful, failed, low_confidence."""
    return classified.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "failed").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "low_confidence").alias("low_confidence"))
