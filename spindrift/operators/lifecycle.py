"""Steps, dependents, staleness, quality and review reports.

Every relation names its key columns, and "now" is always an argument.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def resolve_steps(steps: DataFrame, prompts: DataFrame, variants: DataFrame) -> DataFrame:
    """skill_id, step_order, id, title, text: each step with its current variant's text, else its own, else empty; missing prompts keep the step."""
    current = variants.filter("is_current").select(F.col("id"), F.col("variant_text"))
    joined = steps.join(prompts.select("id", "title", "base_text"), "id", "left").join(current, "id", "left")
    return joined.select("skill_id", "step_order", "id", "title", F.coalesce("variant_text", "base_text", F.lit("")).alias("text"))


def dependents(steps: DataFrame) -> DataFrame:
    """id, n_skills: how many skills use each prompt."""
    return steps.groupBy("id").agg(F.count_distinct("skill_id").alias("n_skills"))


def orphans(steps: DataFrame, skill_id) -> DataFrame:
    """Prompts of one skill that no other skill uses."""
    own = steps.filter(F.col("skill_id") == skill_id).select("id").distinct()
    return own.join(steps.filter(F.col("skill_id") != skill_id).select("id"), "id", "left_anti")


def stale(items: DataFrame, usage: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Items (id) without usage (id, at) in the months before as_of."""
    recent = usage.filter(F.col("at") >= F.add_months(F.to_date(F.lit(as_of)), -months).cast("timestamp_ntz")).select("id")
    return items.join(recent, "id", "left_anti")


def quality_prior(feedback: DataFrame, key: str = "prompt_id") -> DataFrame:
    """key, n, avg_outcome, success_rate, prior: outcomes shrunk towards one half as by five more ratings; skipped ones don't count."""
    value = F.when(F.col("outcome") == "success", 1.0).when(F.col("outcome") == "partial", 0.5).when(F.col("outcome") == "failure", 0.0)
    own = feedback.filter(F.col("outcome") != "skipped").groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("avg_outcome"), F.avg((F.col("outcome") == "success").cast("double")).alias("success_rate"))
    return own.withColumn("prior", prior(F.col("n"), F.col("n") * F.col("avg_outcome")))


def prior(n: Column, total: Column) -> Column:
    """The mean of n ratings of that total, shrunk towards one half as by five more ratings."""
    return (total + V.PRIOR_WEIGHT * V.PRIOR_MEAN) / (n + V.PRIOR_WEIGHT)


def success_rate(items: DataFrame, feedback: DataFrame) -> DataFrame:
    """items (id, total_runs, success_rate) with counts from feedback (id, outcome) where there is any."""
    own = feedback.groupBy("id").agg(F.count("*").alias("n"), F.avg((F.col("outcome") == "success").cast("double")).alias("r"))
    joined = items.join(own, "id", "left")
    return joined.select("id", F.coalesce("n", "total_runs").alias("total_runs"), F.coalesce("r", "success_rate").alias("success_rate"))


def current_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with is_current: the first of each key in the order."""
    return rows.withColumn("is_current", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def upsert(old: DataFrame, new: DataFrame, key: str = "title") -> DataFrame:
    """The table after new rows (key, tag, text) met old ones (key, tag, text, status): old tags stay, status turns pending where the text's hash changes."""
    o = old.select(F.col(key), F.col("tag").alias("ot"), F.col("text").alias("ox"), F.col("status").alias("os"), F.lit(True).alias("oh"))
    n = new.select(F.col(key), F.col("tag").alias("nt"), F.col("text").alias("nx"), F.lit(True).alias("nh"))
    changed = ~X.content_hash("nx").eqNullSafe(X.content_hash("ox"))
    status = F.when(F.col("nh").isNull(), F.col("os")).when(F.col("oh").isNull() | changed, "pending").otherwise(F.col("os"))
    text = F.when(F.col("nh").isNotNull(), F.col("nx")).otherwise(F.col("ox"))
    return o.join(n, key, "full").select(key, F.coalesce("ot", "nt").alias("tag"), text.alias("text"), status.alias("status"))


#: The published namespace of version-5 ids made from addresses, in hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def named_id(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version-5 id of a name: the same in every run and on every machine."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def upsert_named(old: DataFrame, new: DataFrame, key: str, kind: str, source: str = "public") -> DataFrame:
    """key, id, version, source, content_hash, change: the table after new rows of one source, with what became of each row.

    old: key, id, version, source, content_hash; new: key, text, keys all different. A key
    that is there keeps its id and goes up a version (updated, or same where its text's hash is the
    same); a new one has the id of "kind:key" and version 1 (inserted); a row of that source without a
    new one is pruned, and has a null version; rows of other sources are kept.
    """
    o = old.select(F.col(key), F.col("id").alias("oi"), F.col("version").alias("ov"), F.col("source").alias("os"), F.col("content_hash").alias("oh"), F.lit(True).alias("__old"))
    n = new.select(F.col(key), X.content_hash("text").alias("nh"), F.lit(True).alias("__new"))
    fresh = F.col("__old").isNull()
    change = F.when(fresh, "inserted").when(F.col("__new") & F.col("nh").eqNullSafe(F.col("oh")), "same").when(F.col("__new"), "updated").when(F.col("os") == source, "pruned").otherwise("kept")
    return o.join(n, key, "full").select(
        key,
        F.coalesce("oi", named_id(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")))).alias("id"),
        F.when(fresh, F.lit(1).cast("long")).when(F.col("__new"), F.col("ov") + 1).when(change != "pruned", F.col("ov")).cast("long").alias("version"),
        F.when(F.col("__new"), source).otherwise(F.col("os")).alias("source"),
        F.when(F.col("__new"), F.col("nh")).otherwise(F.col("oh")).alias("content_hash"),
        change.alias("change"),
    )


def prune(table: DataFrame, kept: DataFrame, key: str, scope: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, what went): rows in the scope whose key isn't kept go."""
    gone = table.filter(scope).join(kept.select(key), key, "left_anti")
    return table.filter(~F.coalesce(scope, F.lit(False))).unionByName(table.filter(scope).join(kept.select(key), key, "left_semi")), gone


def decollide(rows: DataFrame, slug: str, order: list[Column]) -> DataFrame:
    """rows with tag: the slug, then slug-2, slug-3 in order; one that meets a slug of that very name moves on past all."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    numbered = rows.withColumn("__n", n).withColumn("tag", F.when(F.col("__n") == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), F.col("__n"))))
    taken = numbered.filter("__n = 1").select(F.col("tag").alias("__t")).distinct()
    total = numbered.groupBy(slug).agg(F.max("__n").alias("__max"))
    met = numbered.join(taken, (F.col("tag") == F.col("__t")) & (F.col("__n") > 1), "left").join(total, slug)
    return met.withColumn("tag", F.when(F.col("__t").isNotNull(), F.concat(F.col(slug), F.lit("-"), F.col("__max") + F.col("__n"))).otherwise(F.col("tag"))).drop("__n", "__t", "__max")


def insert_step(steps: Column, step: Column, at: int) -> Column:
    """An array of (id, rationale) with a step put in at a place from 1; later ones move up."""
    return F.concat(F.slice(steps, 1, at - 1), F.array(step), F.slice(steps, F.lit(at), F.greatest(F.size(steps) - (at - 1), F.lit(0))))


def remove_step(steps: Column, at: int) -> Column:
    return F.filter(steps, lambda _, i: i != at - 1)


def _in_order(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """key, part, at, values: the values of each key in the order of by, which begins with the key, a batch of them in a row; part and at are the order of these."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch in enumerate(batches):
            if batch.num_rows:
                named = batch["key"].dictionary_encode(null_encoding="encode").indices.to_numpy()
                first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]])).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(np.append(first, batch.num_rows).astype(np.int32)), batch["value"])
                yield pa.record_batch([batch["key"].take(first), batch["part"].take(first), pa.array(np.full(len(first), at, np.int64)), values], names=["key", "part", "at", "values"])

    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col(key).alias("key"), F.spark_partition_id().alias("part"), F.col(value).alias("value"))
    return sorted_rows.mapInArrow(runs, f"key {kinds[key]}, part int, at long, values array<{kinds[value]}>")


def promote(chain: DataFrame, prompts: DataFrame, versions: DataFrame) -> DataFrame:
    """tag, version, steps, steps_text, domain, content_hash: a skill from rows (tag, ord, id), with the union of its prompts' domains and the next version of its tag.

    steps_text is the ids joined by commas. A skill's steps are put in order over all tasks and come together as long
    pieces, so that the one task that puts out a skill holds little more than what it puts out.
    """
    joined = chain.join(prompts.select("id", "domain"), "id", "left")
    pieces = _in_order(joined.select("tag", "ord", "id"), ["tag", "ord", "id"], "tag", "id")
    text = F.concat_ws(",", F.transform("values", lambda x: x.cast("string")))
    told = pieces.withColumn("text", F.when(F.exists("values", lambda x: x.isNotNull()), text))
    ordered = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("part", "at", name))), lambda x: x[name])
    made = told.groupBy(F.col("key").alias("tag")).agg(F.flatten(ordered("values")).alias("steps"), F.array_join(ordered("text"), ",").alias("steps_text"))
    parts = joined.select("tag", F.explode("domain").alias("domain")).distinct()
    domains = parts.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("domain").isNull().alias("none"), "domain"))), lambda x: x["domain"]).alias("domain"))
    last = versions.groupBy("tag").agg(F.max("version").alias("last"))
    whole = made.join(domains.withColumnRenamed("tag", "__tag"), F.col("tag").eqNullSafe(F.col("__tag")), "left").join(last, "tag", "left")
    return whole.select("tag", (F.coalesce("last", F.lit(0)) + 1).alias("version"), "steps", "steps_text", F.coalesce("domain", F.array().cast("array<string>")).alias("domain"), X.content_hash("steps_text").alias("content_hash"))


def pending(prompts: DataFrame, status_col: str = "backfill_status", at: str = "last_updated") -> DataFrame:
    """Prompts still to be classified, the newest first."""
    return prompts.filter(F.coalesce(status_col, F.lit("pending")) == "pending").orderBy(F.desc_nulls_last(at), "id")


def classified(prompts: DataFrame, status_col: str = "backfill_status", at: str = "last_classified", statuses: tuple[str, ...] = ("classified", "synced")) -> DataFrame:
    """Prompts to be written back: of those statuses, with a time of classification."""
    return prompts.filter(F.col(status_col).isin(*statuses) & F.col(at).isNotNull())


def by_title(prompts: DataFrame, title: str) -> DataFrame:
    return prompts.filter(F.col("title") == title)


def list_skills(skills: DataFrame, status: str | None = "active") -> DataFrame:
    """Skills (tag, version, status, created_at, ...) of a status, or of any, newest first."""
    rows = skills if status is None else skills.filter(F.col("status") == status)
    return rows.orderBy(F.desc_nulls_last("created_at"), "tag", "version")


#: What a skill's status may change to.
TRANSITIONS = {"draft": ["active", "inactive"], "active": ["inactive"], "inactive": ["active"]}


def set_status(skills: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skills with the statuses wanted, refused requests with the status they met). wanted: tag, version, status; one request a skill."""
    ask = wanted.select("tag", "version", F.col("status").alias("__to"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs])
    joined = skills.join(ask, ["tag", "version"], "left").withColumn("__ok", F.array_contains(allowed, F.concat_ws(">", "status", "__to")))
    done = joined.select(*[F.when(F.col("__ok"), F.col("__to")).otherwise(F.col("status")).alias(c) if c == "status" else F.col(c) for c in skills.columns])
    return done, joined.filter(F.col("__to").isNotNull() & ~F.col("__ok")).select("tag", "version", "status", F.col("__to").alias("wanted"))


def ordered_steps(steps: Column) -> Column:
    """Steps (array of structs with step_order) in order; a step without one has its place in the array."""
    numbered = F.transform(steps, lambda s, i: s.withField("step_order", F.coalesce(s["step_order"], i + 1)))
    return F.array_sort(numbered, lambda a, b: F.when(a["step_order"] < b["step_order"], -1).when(a["step_order"] > b["step_order"], 1).otherwise(0))


def open_sessions(routed: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """session_id, skill_id, trace_id, status, current_step, expires_at: a fresh session for each routed skill (session_id, skill_id, trace_id)."""
    return routed.filter(F.col("skill_id").isNotNull()).select("session_id", "skill_id", "trace_id", F.lit("active").alias("status"), F.lit(0).alias("current_step"), (as_of + F.expr(f"INTERVAL {hours} HOURS")).alias("expires_at"))


def log_runs(skills: DataFrame, log: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log with the fresh runs, skills with total_runs, last_run_at and success_rate counted from it). Runs: skill_id, status, started_at."""
    whole = log.unionByName(fresh)
    own = whole.groupBy("skill_id").agg(F.count("*").alias("n"), F.max("started_at").alias("last"), F.avg((F.col("status") == "success").cast("double")).alias("r"))
    fields = {"total_runs": F.coalesce("n", "total_runs"), "last_run_at": F.coalesce("last", "last_run_at"), "success_rate": F.coalesce("r", "success_rate")}
    return whole, skills.join(own, "skill_id", "left").select(*[fields[c].alias(c) if c in fields else F.col(c) for c in skills.columns])


def repair_paths(table: DataFrame, there: DataFrame) -> DataFrame:
    """table (title, file_path) with repaired, true where a missing path was replaced by its name without quotes and brackets, which is there. there: path."""
    paths = there.select(F.col("path").alias("__p"))
    stem, folder = F.regexp_extract("file_path", r"([^/]*)\.[^./]*\z", 1), F.regexp_extract("file_path", r"\A(.*/)?", 0)
    clean = F.trim(F.regexp_replace(F.regexp_replace(stem, "[()\"\u201c\u201d\u2018\u2019']", ""), r"\s+", " "))
    rows = table.withColumn("__try", F.concat(folder, clean, F.lit(".md")))
    rows = rows.join(paths.withColumn("__own", F.lit(True)), F.col("file_path") == F.col("__p"), "left").drop("__p")
    rows = rows.join(paths.withColumn("__other", F.lit(True)), F.col("__try") == F.col("__p"), "left").drop("__p")
    mends = F.col("__own").isNull() & F.col("__other").isNotNull()
    return rows.select(*[F.when(mends, F.col("__try")).otherwise(F.col(c)).alias(c) if c == "file_path" else F.col(c) for c in table.columns], mends.alias("repaired"))


def refresh_own(old: DataFrame, new: DataFrame, key: str = "title") -> DataFrame:
    """old (key, text, content_hash, embedding) after new rows (key, text): the vector goes where the hash is distinct, and stays where it isn't."""
    n = new.select(key, F.col("text").alias("__text"), X.content_hash("text").alias("__hash"))
    joined = old.join(n, key, "full")
    same = F.col("__hash").isNull() | F.col("__hash").eqNullSafe(F.col("content_hash"))
    return joined.select(key, F.coalesce("__text", "text").alias("text"), F.coalesce("__hash", "content_hash").alias("content_hash"), F.when(same, F.col("embedding")).alias("embedding"))
