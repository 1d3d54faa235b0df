"""Queries over what is stored and kept in step: search vectors, tables by version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import lifecycle, retrieval, search_vectors
from ..session import remove_path, settled, shared_path
from ..sources import snapshots, vault
from . import views as W
from .registry import query
from .retrieval_queries import P

FIELDS = {"title": "A", "prompt_text": "D"}


def _kept_in_step(spark, d, path: str, config: str) -> None:
    """Search vectors of all prompts: first with stale texts here and there, which are replaced; then summaries go in front, and some rows go."""
    p = W.prompts(spark, d).select("id", "title", "prompt_text", F.concat_ws(" ", "source", F.col("domain")[0]).alias("summary"))
    stale = p.withColumn("prompt_text", F.when(F.col("id") % 7 == 0, "stale words").otherwise(F.col("prompt_text")))
    search_vectors.write(search_vectors.vectors(stale, FIELDS, config), path)
    search_vectors.write(search_vectors.vectors(p.filter("id % 7 = 0"), FIELDS, config), path)
    search_vectors.put_before(p.filter("id % 5 = 0").select("id", "summary"), path, "summary", "B", config)
    search_vectors.delete(p.filter("id % 11 = 0"), path)


_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
STORED = f"""{P}, w AS (SELECT id, list_concat(list_transform(CASE WHEN id % 5 = 0 THEN {_TOKENS.format("source || ' ' || domain[1]")} ELSE [] END, lambda t: {{'t': t, 'w': 0.4::DOUBLE}}), list_transform({_TOKENS.format('title')}, lambda t: {{'t': t, 'w': 1.0::DOUBLE}}), list_transform({_TOKENS.format('prompt_text')}, lambda t: {{'t': t, 'w': 0.1::DOUBLE}})) AS ws FROM prompts WHERE id % 11 <> 0),
x AS (SELECT id, len(ws) AS n, unnest(ws).t AS lexeme, unnest(ws).w AS weight, generate_subscripts(ws, 1) AS place FROM w)"""


@query(f"WITH {STORED}, f AS (SELECT id, lexeme, count(*) AS n, min(place) AS first, sum(weight) AS weight FROM x GROUP BY ALL) SELECT lexeme, count(*) AS docs, sum(n)::BIGINT AS places, sum(first)::BIGINT AS firsts, round(sum(weight), 4) AS weights FROM f GROUP BY lexeme")
def stored_words(spark, d):
    """What is stored after replacements, summaries put in front and deletions, by lexeme."""
    path = shared_path(spark, "words")
    _kept_in_step(spark, d, path, "simple")
    rows = search_vectors.read(spark, path).select("lexeme", F.size("places").alias("n"), F.array_min("places").alias("first"), F.aggregate("weights", F.lit(0.0), lambda s, w: s + w).alias("w"))
    out = settled(rows.groupBy("lexeme").agg(F.count("*").alias("docs"), F.sum("n").alias("places"), F.sum("first").alias("firsts"), F.round(F.sum("w"), 4).alias("weights")))
    remove_path(spark, path)
    return out


@query(f"""WITH {STORED}, word_queries AS ({W.WORD_QUERIES}), q AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('query')}) AS lexeme FROM word_queries),
hits AS (SELECT query_id, id, n, weight, place, lag(place) OVER (PARTITION BY query_id, id ORDER BY place) AS before FROM x JOIN q USING (lexeme)),
s AS (SELECT query_id, id, sum(weight) / ln(any_value(n) + 1.0) AS r, sum(1.0::DOUBLE / (place - before)) AS d, count(*) AS c FROM hits GROUP BY query_id, id),
t AS (SELECT query_id, id, CASE WHEN d > 0 THEN r * d / c ELSE r END AS r FROM s), u AS (SELECT query_id, id, round(r / (r + 1), 9) AS score FROM t)
SELECT query_id, id, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20""")
def stored_search(spark, d):
    """Cover density from the stored vectors alone, words as they are."""
    path = shared_path(spark, "words")
    _kept_in_step(spark, d, path, "simple")
    found = search_vectors.search(spark, path, W.word_queries(spark, d), 200, "simple").withColumn("score", F.round("score", 9))
    out = settled(retrieval.top(found.drop("rank"), 20))
    remove_path(spark, path)
    return out.select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def stored_stems(spark, d):
    """Stemmed search from stored vectors."""
    path = shared_path(spark, "stems")
    _kept_in_step(spark, d, path, "english")
    out = settled(search_vectors.search(spark, path, W.word_queries(spark, d), 50))
    remove_path(spark, path)
    return out


_HASH = "substr(sha256({0}), 1, 16)"
_UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('part:' || p_partkey))"
CHANGES = f"""WITH o AS (SELECT p_partkey, 'old-' || p_partkey AS id, CAST(p_size AS BIGINT) AS version, CASE WHEN p_partkey % 3 = 0 THEN 'private' ELSE 'public' END AS source, {_HASH.format("p_name")} AS content_hash FROM part WHERE p_partkey % 5 <> 0),
n AS (SELECT p_partkey, {_HASH.format("CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_name || ' again' END")} AS content_hash FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, coalesce(o.id, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab', ('0x' || substr(u, 17, 1))::INT % 4 + 1, 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12)) AS id,
CASE WHEN o.id IS NULL THEN 1 WHEN n.content_hash IS NOT NULL THEN o.version + 1 WHEN o.source = 'public' THEN NULL ELSE o.version END AS version, CASE WHEN n.content_hash IS NOT NULL THEN 'public' ELSE o.source END AS source, coalesce(n.content_hash, o.content_hash) AS content_hash,
CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.content_hash = o.content_hash THEN 'same' WHEN n.content_hash IS NOT NULL THEN 'updated' WHEN o.source = 'public' THEN 'pruned' ELSE 'kept' END AS change
FROM (SELECT p_partkey, {_UUID} AS u FROM part) LEFT JOIN o USING (p_partkey) LEFT JOIN n USING (p_partkey) WHERE o.id IS NOT NULL OR n.content_hash IS NOT NULL"""


def _changes(spark, d) -> DataFrame:
    part, n = W.table(spark, d, "part"), F.col("p_partkey")
    old = part.filter(n % 5 != 0).select("p_partkey", F.concat(F.lit("old-"), n).alias("id"), F.col("p_size").cast("long").alias("version"), F.when(n % 3 == 0, "private").otherwise("public").alias("source"), content_hash("p_name").alias("content_hash"))
    new = part.filter(n % 2 == 0).select("p_partkey", F.when(n % 4 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" again"))).alias("text"))
    return lifecycle.upsert_named(old, new, "p_partkey", "part")


@query(CHANGES)
def upsert_changes(spark, d):
    return _changes(spark, d)


@query(f"SELECT p_partkey, id, version FROM ({CHANGES}) WHERE change <> 'pruned'")
def upsert_snapshot(spark, d):
    """The table after the changes, committed as a version and read from there."""
    path = shared_path(spark, "table")
    snapshots.commit(_changes(spark, d).filter("change <> 'pruned'").select("p_partkey", "id", "version"), path, 0)
    out = settled(snapshots.read(spark, path))
    remove_path(spark, path)
    return out


def _file(path, content) -> list:
    return [path.alias("path"), F.lit(None).cast("timestamp").alias("modified"), content.cast("binary").alias("content")]


@query("SELECT lang AS department, lang || '/doc-' || doc_id || '.md' AS path, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE '' END AS domain, substr(sha256(trim(text, ' ')), 1, 16) AS content_hash, CASE WHEN doc_id % 6 = 0 THEN 'repeated key: domain' END AS fault FROM documents WHERE doc_id % 5 <> 0 AND trim(text, ' ') <> '' UNION ALL SELECT NULL, lang || '/doc-' || doc_id || '.md', NULL, NULL, NULL, CASE WHEN doc_id % 10 = 0 THEN 'no body' ELSE 'not text' END FROM documents WHERE doc_id % 5 = 0")
def vault_prompts(spark, d):
    """Documents as files of a vault, every fifth of them broken, with what was wrong."""
    n, t = F.col("doc_id"), F.col("text")
    front = F.when(n % 6 == 0, "---\ndomain: xx\ndomain: En, zz\n---\n").when(n % 2 == 0, "---\ndomain: En, zz\n---\n").otherwise("")
    content = F.when(n % 10 == 0, F.lit("---\nk: v\n---\n").cast("binary")).when(n % 5 == 0, F.unhex(F.lit("fffe41"))).otherwise(F.concat(front, t).cast("binary"))
    files = W.table(spark, d, "documents").filter((n % 5 == 0) | (F.trim(t) != "")).select(*_file(F.concat("lang", F.lit("/doc-"), n, F.lit(".md")), content))
    rows, faults = vault.prompts(files, {"domain": ["en"]})
    both = rows.select("department", "path", "title", F.array_join("domain", ",").alias("domain"), "content_hash").join(faults, "path", "full")
    return both.select("department", "path", "title", "domain", "content_hash", "fault")


_FILES = """f AS (SELECT source AS folder, doc_id, text, doc_id % 6 = 0 AS listed, 'd' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.yml' ELSE '.txt' END AS path FROM documents WHERE source <> 'src3')"""


@query(f"""WITH {_FILES} SELECT folder, path, CASE WHEN listed THEN 'template' WHEN doc_id % 4 = 0 THEN 'prompt' WHEN doc_id % 4 = 1 THEN 'code' ELSE 'config' END AS type, CASE WHEN listed THEN 'own' WHEN doc_id % 4 = 1 THEN 'python' WHEN doc_id % 4 = 2 THEN 'yaml' END AS language, listed, substr(sha256(CASE WHEN doc_id % 4 = 0 THEN trim(text, ' ') ELSE text END), 1, 16) AS content_hash, NULL AS fault FROM f
UNION ALL SELECT DISTINCT NULL, folder || '/gone.md', NULL, NULL, NULL::BOOLEAN, NULL, 'listed, not there' FROM f UNION ALL SELECT DISTINCT NULL, source, NULL, NULL, NULL, NULL, 'no index' FROM documents WHERE source = 'src3'""")
def skill_files(spark, d):
    """Documents as files of skills, a folder for each source, whose index lists some of them and one that isn't there."""
    n = F.col("doc_id")
    name = F.concat(F.lit("d"), n, F.when(n % 4 == 0, ".md").when(n % 4 == 1, ".py").when(n % 4 == 2, ".yml").otherwise(".txt"))
    docs = W.table(spark, d, "documents").select("source", "text", name.alias("name"), n.alias("doc_id"))
    entry = F.when(n % 6 == 0, F.concat(F.lit("  - path: "), "name", F.lit("\n    type: template\n    language: own\n")))
    index = docs.filter("source <> 'src3'").groupBy("source").agg(F.concat(F.lit("---\nname: S\nfiles:\n  - path: gone.md\n"), F.array_join(F.collect_list(entry), ""), F.lit("---\n## Overview\nx\n")).alias("text"))
    files = docs.select(*_file(F.concat_ws("/", "source", "name"), F.col("text"))).unionByName(index.select(*_file(F.concat("source", F.lit("/index.md")), F.col("text"))))
    _, rows, faults = vault.skills(files)
    told = rows.select("folder", "path", "type", "language", "listed", content_hash("content").alias("content_hash"), F.lit(None).cast("string").alias("fault"))
    none = {"folder": "string", "type": "string", "language": "string", "listed": "boolean", "content_hash": "string"}
    return told.unionByName(faults.select("path", "fault", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]))
