"""A typed slot registry and the ladder that fills slots from base information.

Rungs in order: the caller's context, the exact key in the scopes given (the first scope
wins), an alias, a close description, an inference. Each rung is a join; a slot takes the
first rung that has a value. Artifacts are never filled but by the context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..session import settled
from .retrieval import bounded, dense_topk

#: A description is close at this cosine, and the closest is taken if it leads the next by the gap; inferences count from this confidence.
CLOSE, GAP, SURE = 0.75, 0.05, 0.7


def slot_kind(name: Column, slot_type: Column) -> Column:
    """artifact for what the user must paste, choice for alternatives, derived for what the situation says, else fact."""
    return F.when(slot_type == "paste", "artifact").when(slot_type == "choice", "choice").when(F.lower(name).rlike(r"problem|goal|situation|context|task|question"), "derived").otherwise("fact")


def registry(prompts: DataFrame, id_col: str = "id", text_col: str = "prompt_text") -> DataFrame:
    """id, raw, slot_key, kind, choices, occurrences, place: a row for each slot of each prompt."""
    rows = prompts.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), F.posexplode(X.slots(text_col)).alias("place", "s"))
    kind = slot_kind(F.col("s.name"), F.col("s.slot_type"))
    raw = F.col("s.original")
    count = (F.length("__text") - F.length(F.replace(F.col("__text"), raw, F.lit("")))) / F.length(raw)
    options = F.transform(F.split("s.name", r"[/|]"), lambda x: F.trim(x))
    return rows.select("id", raw.alias("raw"), X.slot_key(F.col("s.name")).alias("slot_key"), kind.alias("kind"), F.when(kind == "choice", options).alias("choices"), count.cast("int").alias("occurrences"), "place")


def fill(slots: DataFrame, context: DataFrame, base: DataFrame, scopes: list[str], as_of: Column, inferred: DataFrame | None = None) -> DataFrame:
    """id, raw, slot_key, value, rung, need: each slot with its value and the rung it came from, or why it has none.

    slots: registry's columns and description (a vector, may be null); context: id,
    slot_key, value; base: key, value, aliases, scope, valid_until, embedding; inferred: id, slot_key, value, confidence.
    A choice takes only a value that is one of its choices. Stale base rows don't count.
    """
    fresh = base.filter(F.col("valid_until").isNull() | (F.col("valid_until") >= as_of)).withColumn("__scope", F.array_position(X.array_of(scopes), F.col("scope"))).filter("__scope > 0")
    order = Window.partitionBy("__key").orderBy("__scope", "key")
    exact = fresh.withColumn("__key", F.col("key")).withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(F.col("__key").alias("slot_key"), F.col("value").alias("__exact"))
    alias = fresh.select("key", "__scope", "value", F.explode("aliases").alias("__key")).withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(F.col("__key").alias("slot_key"), F.col("value").alias("__alias"))
    rows = slots.join(context.select("id", "slot_key", F.col("value").alias("__context")), ["id", "slot_key"], "left").join(exact, "slot_key", "left").join(alias, "slot_key", "left")
    # What the rungs above left open is searched for among the base rows, by slot key; each row has a number, as a key may be there once in each scope.
    open_ = rows.filter(F.coalesce("__context", "__exact", "__alias").isNull() & (F.col("kind") != "artifact") & F.col("description").isNotNull())
    asked = settled(open_.select(F.xxhash64("slot_key").alias("query_id"), "slot_key", F.col("description").alias("embedding")).dropDuplicates(["slot_key"]))
    known = settled(fresh.filter(F.col("embedding").isNotNull()).select(F.xxhash64("key", "scope", "value").alias("id"), "key", "value", "embedding"))
    found = dense_topk(known, asked, 2).filter(F.col("score") >= CLOSE).select("query_id", "id", F.col("score").alias("__s"))
    near = found.join(bounded(asked.select("query_id", "slot_key")), "query_id").join(known.select("id", "key", "value"), "id")
    w = Window.partitionBy("slot_key").orderBy(F.desc("__s"), "key")
    lead = near.withColumns({"__n": F.row_number().over(w), "__next": F.lead("__s").over(w)}).filter("__n = 1")
    close = lead.select("slot_key", F.when(F.col("__next").isNull() | (F.col("__s") - F.col("__next") >= GAP), F.col("value")).alias("__close"), (F.col("__next").isNotNull() & (F.col("__s") - F.col("__next") < GAP)).alias("__unsure"))
    rows = rows.join(close, "slot_key", "left")
    if inferred is None:
        rows = rows.withColumn("__inferred", F.lit(None).cast("string"))
    else:
        rows = rows.join(inferred.filter(F.col("confidence") >= SURE).select("id", "slot_key", F.col("value").alias("__inferred")), ["id", "slot_key"], "left")
    fits = lambda c: F.when((F.col("kind") != "choice") | F.array_contains("choices", F.col(c)), F.col(c))
    store = lambda c: F.when(F.col("kind") != "artifact", fits(c))
    close_ = F.when(~F.coalesce("__unsure", F.lit(False)), store("__close"))
    guess = F.when(F.col("kind") == "derived", F.when(~F.coalesce("__unsure", F.lit(False)), F.col("__inferred")))
    rungs = [("context", F.col("__context")), ("exact", store("__exact")), ("alias", store("__alias")), ("close", close_), ("inferred", guess)]
    value = F.coalesce(*[v for _, v in rungs])
    rung = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in rungs])
    need = F.when(value.isNull(), F.when(F.col("kind") == "artifact", "user must supply").when(F.coalesce("__unsure", F.lit(False)), "ambiguous").otherwise("unfilled"))
    return rows.select("id", "raw", "slot_key", value.alias("value"), rung.alias("rung"), need.alias("need"))


def split_query(query: Column | str) -> Column:
    """struct(prose, spec): the query without specification tokens, and those tokens in order."""
    query = F.coalesce(X.col(query), F.lit(""))
    prose = F.trim(F.regexp_replace(F.regexp_replace(query, V.SPEC_TOKEN, " "), r"\s+", " "))
    return F.struct(prose.alias("prose"), F.regexp_extract_all(query, F.lit(V.SPEC_TOKEN), F.lit(0)).alias("spec"))
