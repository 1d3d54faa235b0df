"""Queries over the optimiser, slots, skills and their upkeep, profiler reports and further evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import plugins, vocabulary
from ..functions import text as X
from ..operators import assets, chains, evaluation, fusion, lifecycle, maintenance, optimizer, rerank, retrieval, rules
from ..operators import slots as slot_ops
from ..sources import markdown
from . import views as W
from .registry import query
from .retrieval_queries import DENSE, OR_HITS, RANKED, RERANK, P, _dense, _lexical
from .text_queries import _BAG, SLOTS_SQL, TEMPLATES, _list, _once, _quoted, _templates


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return W.table(spark, d, "documents")


# --- corpora and skills -----------------------------------------------------------------------

_TAXONOMY = "[lang, 'AI', CASE WHEN doc_id % 2 = 0 THEN 'bogus' ELSE 'fr' END]"
_VALID = f"list_filter({_TAXONOMY}, lambda v: v IN ('en', 'fr', 'AI'))"


@query(f"SELECT doc_id, array_to_string({_once(_VALID)}, ',') AS domain FROM documents")
def valid_corpus(spark, d):
    rows = _docs(spark, d).select("doc_id", F.array("lang", F.lit("AI"), F.when(F.col("doc_id") % 2 == 0, "bogus").otherwise("fr")).alias("domain"))
    return markdown.valid_only(rows, {"domain": ["en", "fr", "AI"]}).select("doc_id", F.array_join("domain", ",").alias("domain"))


@query("SELECT doc_id, source || ' and more' AS overview, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS \"when\", 'step one' || chr(10) || 'step two' AS how FROM documents")
def skill_sections(spark, d):
    raw = F.concat(F.lit("# Title\n\n## Overview of it\n\n"), "source", F.lit(" and more\n\n"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("## When to use\n"), "lang", F.lit("\n\n"))), F.lit("## How\nstep one\nstep two\n"))
    return _docs(spark, d).select("doc_id", markdown.sections(raw, ["Overview", "When", "How"]).alias("s")).select("doc_id", "s.*")


_NUMBERED = f"numbered AS (SELECT skill_id, id, row_number() OVER (PARTITION BY skill_id ORDER BY id) AS step_order FROM ({W.STEPS}))"


def _numbered(spark, d) -> DataFrame:
    return W.steps(spark, d).withColumn("step_order", F.row_number().over(Window.partitionBy("skill_id").orderBy("id")))


@query(f"WITH {_NUMBERED} SELECT 'o' || skill_id AS tag, CAST(step_order AS INTEGER) AS step_order, CAST(id AS VARCHAR) AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'as ' || p_type END AS rationale FROM numbered JOIN part ON p_partkey = id")
def skill_vault(spark, d):
    """Skills rendered as files and parsed again."""
    part = W.table(spark, d, "part")
    rows = _numbered(spark, d).join(part, part["p_partkey"] == F.col("id"))
    step = F.struct("step_order", F.col("id").cast("string").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("as "), "p_type")).alias("rationale"))
    skills = rows.groupBy(F.concat(F.lit("o"), "skill_id").alias("tag")).agg(F.lit("Name").alias("name"), F.lit("About it.").alias("summary"), F.array_sort(F.collect_list(step)).alias("steps"))
    files = markdown.render_skill(skills)
    return files.select("tag", F.explode(markdown.skill_steps("text")).alias("s")).select("tag", "s.step_order", "s.id", "s.title", "s.rationale")


@query("""WITH o AS (SELECT doc_id AS title, text, substr(sha256(text), 1, 16) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id AS title, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 2 = 0)
SELECT title, coalesce(n.text, o.text) AS text, substr(sha256(coalesce(n.text, o.text)), 1, 16) AS content_hash, o.h IS NOT NULL AND substr(sha256(coalesce(n.text, o.text)), 1, 16) = o.h AS has_vector FROM o FULL JOIN n USING (title)""")
def own_ingest(spark, d):
    t = _docs(spark, d).select(F.col("doc_id").alias("title"), "text")
    old = t.filter("title % 3 <> 0").select("title", "text", X.content_hash("text").alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"))
    new = t.filter("title % 2 = 0").withColumn("text", F.when(F.col("title") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return lifecycle.refresh_own(old, new).select("title", "text", "content_hash", F.col("embedding").isNotNull().alias("has_vector"))


@query(f"""WITH {P}, {DENSE}, best AS (SELECT query_id, chunk_id // 5 AS id, score, chunk_id, row_number() OVER (PARTITION BY query_id, chunk_id // 5 ORDER BY score DESC, chunk_id) AS n FROM (SELECT query_id, id AS chunk_id, score FROM dense WHERE rank <= 50)),
r AS (SELECT query_id, id, chunk_id, {RANKED} FROM best WHERE n = 1) SELECT query_id, id, r.chunk_id, title, prompt_text, domain_ AS matched_chunk_text FROM r JOIN (SELECT id, title, prompt_text FROM prompts) USING (id) LEFT JOIN (SELECT vec_id AS chunk_id, 'chunk ' || vec_id AS domain_ FROM embeddings WHERE vec_id % 3 <> 0) c ON c.chunk_id = r.chunk_id WHERE rank <= 10""")
def fill_text(spark, d):
    dense = _dense(spark, d).select("query_id", F.floor(F.col("id") / 5).alias("id"), F.col("id").alias("chunk_id"), "score")
    pool = retrieval.rollup(dense, 10).select("query_id", "id", "chunk_id")
    chunks = W.table(spark, d, "embeddings").filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("chunk "), "vec_id").alias("chunk_text"))
    return retrieval.fill_text(pool, W.prompts(spark, d), chunks)


@query(f"WITH {P} SELECT id, status FROM prompts WHERE title = (SELECT min(title) FROM prompts WHERE title LIKE 'The %')")
def title_lookup(spark, d):
    p = W.prompts(spark, d)
    return lifecycle.by_title(p, p.filter(F.col("title").startswith("The ")).agg(F.min("title")).first()[0]).select("id", "status")


_STAGES = "CASE WHEN doc_id % 4 = 0 THEN 'classified' WHEN doc_id % 4 = 1 THEN 'pending' WHEN doc_id % 4 = 2 THEN 'synced' END"


def _staged(spark, d) -> DataFrame:
    n = F.col("doc_id")
    stage = F.when(n % 4 == 0, "classified").when(n % 4 == 1, "pending").when(n % 4 == 2, "synced")
    return _docs(spark, d).select(n.alias("id"), stage.alias("backfill_status"), (n % 100).alias("last_updated"), F.when(n % 5 != 0, n % 7).alias("last_classified"))


@query(f"SELECT doc_id AS id FROM documents WHERE coalesce({_STAGES}, 'pending') = 'pending'")
def pending_prompts(spark, d):
    return lifecycle.pending(_staged(spark, d)).select("id")


@query(f"SELECT doc_id AS id, {_STAGES} AS backfill_status FROM documents WHERE {_STAGES} IN ('classified', 'synced') AND doc_id % 5 <> 0")
def classified_export(spark, d):
    return lifecycle.classified(_staged(spark, d)).select("id", "backfill_status")


_PATH = "'/v/' || source || '/' || CASE doc_id % 3 WHEN 0 THEN '\"Note  (' || doc_id || ')\".md' ELSE 'Note ' || doc_id || '.md' END"


@query(f"""SELECT doc_id AS title, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN '/v/' || source || '/Note ' || doc_id || '.md' ELSE {_PATH} END AS file_path, doc_id % 3 = 0 AND doc_id % 2 = 0 AS repaired FROM documents""")
def path_repair(spark, d):
    docs = _docs(spark, d)
    plain = F.concat(F.lit("/v/"), "source", F.lit("/Note "), "doc_id", F.lit(".md"))
    odd = F.concat(F.lit("/v/"), "source", F.lit('/"Note  ('), "doc_id", F.lit(')".md'))
    table = docs.select(F.col("doc_id").alias("title"), F.when(F.col("doc_id") % 3 == 0, odd).otherwise(plain).alias("file_path"))
    return lifecycle.repair_paths(table, docs.filter("doc_id % 2 = 0").select(plain.alias("path")))


@query("""SELECT id, total_runs, last_run_at, round(success_rate, 6) AS success_rate FROM (SELECT c_custkey AS id, coalesce(n, 2) AS total_runs, last AS last_run_at, coalesce(r, 0.5) AS success_rate FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last, avg(CAST(o_orderstatus = 'F' AS INT)) AS r FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)""")
def run_log(spark, d):
    skills = W.table(spark, d, "customer").select(F.col("c_custkey").alias("skill_id"), F.lit(2).cast("long").alias("total_runs"), F.lit(None).cast("timestamp_ntz").alias("last_run_at"), F.lit(0.5).alias("success_rate"))
    runs = W.table(spark, d, "orders").select(F.col("o_custkey").alias("skill_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failure").alias("status"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("k"))
    _, out = lifecycle.log_runs(skills, runs.filter("k % 2 = 0").drop("k"), runs.filter("k % 2 <> 0").drop("k"))
    return out.select(F.col("skill_id").alias("id"), "total_runs", "last_run_at", F.round("success_rate", 6).alias("success_rate"))


@query("SELECT 'o' || o_orderkey AS tag, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'O' THEN 'active' WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'inactive' ELSE CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'active' ELSE 'inactive' END END AS status FROM orders")
def set_status(spark, d):
    done, _ = lifecycle.set_status(*_status_requests(spark, d))
    return done.select("tag", "status")


def _status_requests(spark, d) -> tuple[DataFrame, DataFrame]:
    o = W.table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "active").otherwise("inactive")
    skills = o.select(F.concat(F.lit("o"), "o_orderkey").alias("tag"), F.lit(1).alias("version"), state.alias("status"), F.col("o_orderdate").alias("created_at"))
    to = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "inactive").otherwise("draft")
    return skills, o.filter("o_orderkey % 3 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("tag"), F.lit(1).alias("version"), to.alias("status"))


@query("SELECT 'o' || o_orderkey AS tag, 'inactive' AS status, 'draft' AS wanted FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus NOT IN ('O', 'F')")
def status_refused(spark, d):
    _, refused = lifecycle.set_status(*_status_requests(spark, d))
    return refused.select("tag", "status", "wanted")


@query("SELECT 'o' || o_orderkey AS tag, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F'")
def skill_list(spark, d):
    return lifecycle.list_skills(_status_requests(spark, d)[0], "active").select("tag", "created_at")


@query(f"WITH {_NUMBERED} SELECT skill_id, array_to_string(list(id ORDER BY CASE WHEN id % 2 = 0 THEN step_order ELSE step_order END), ',') AS steps FROM numbered GROUP BY skill_id")
def default_order(spark, d):
    """Steps in the order of their places, of which those of odd prompts aren't stated."""
    own = W.steps(spark, d).groupBy("skill_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    steps = F.transform("ids", lambda x, i: F.struct(F.when(x % 2 == 0, i + 1).alias("step_order"), x.alias("id")))
    return own.select("skill_id", F.array_join(F.transform(lifecycle.ordered_steps(steps), lambda s: s["id"]), ",").alias("steps"))


@query("SELECT event_id AS session_id, user_id AS skill_id, 'active' AS status, CAST(0 AS INTEGER) AS current_step, TIMESTAMP '2024-02-02 00:00:00' AS expires_at FROM events WHERE event_type <> 'view'")
def open_sessions(spark, d):
    e = W.table(spark, d, "events").select(F.col("event_id").alias("session_id"), F.when(F.col("event_type") != "view", F.col("user_id")).alias("skill_id"), F.lit("t").alias("trace_id"))
    return lifecycle.open_sessions(e, F.lit("2024-02-01").cast("timestamp_ntz")).drop("trace_id")


@query("SELECT p_partkey AS id, p_size % 3 <> 0 AND p_partkey % 4 <> 0 OR p_partkey % 5 = 0 AS embedded, CASE WHEN p_size % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN 'v2' WHEN p_partkey % 5 = 0 THEN 'v1' END AS embedding_version FROM part")
def embed_skills(spark, d):
    n = F.col("p_partkey")
    old = F.when(n % 5 == 0, F.array(F.lit(1.0).cast("float")))
    skills = W.table(spark, d, "part").select(n.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("summary"), F.when((F.col("p_size") % 3 != 0) & (n % 4 != 0), "active").otherwise("inactive").alias("status"), old.alias("routing_embedding"), F.when(n % 5 == 0, "v1").alias("embedding_version"))
    return maintenance.embed_skills(skills, "v2").select("id", F.col("routing_embedding").isNotNull().alias("embedded"), "embedding_version")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE array_to_string(string_split(text, ' ')[1:5], ' ') END AS summary FROM documents")
def add_summaries(spark, d):
    p = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("prompt_text"), F.when(F.col("doc_id") % 2 == 0, "own").alias("summary"))
    return maintenance.add_summaries(p, lambda texts: [" ".join(t.split(" ")[:5]) for t in texts]).select("id", "summary")


@query("SELECT d.doc_id FROM documents d JOIN embeddings ON vec_id = d.doc_id WHERE trim(text) <> '' AND d.doc_id % 3 <> 0")
def embeddable(spark, d):
    v = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = _docs(spark, d).join(v, "doc_id", "left").withColumn("embedding", F.when(F.col("doc_id") % 3 != 0, F.col("embedding")))
    return retrieval.embeddable(rows, "text", "embedding").select("doc_id")


@query("SELECT count(*) AS n, count(vec_id) AS embedded, count(*) - count(vec_id) AS missing, count(*) - count(DISTINCT text) AS repeated FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def population(spark, d):
    v = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return evaluation.population(_docs(spark, d).join(v, "doc_id", "left"), "embedding", "text")


# --- optimiser --------------------------------------------------------------------------------

_RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS prompt_id, o_orderpriority AS model, o_orderstatus AS metric_type, o_orderdate AS started_at, done AS completed_at, baseline, optimized, optimized - baseline AS improvement, CASE WHEN done IS NULL THEN 'running' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS done, min(l_discount) AS baseline, max(l_tax) AS optimized FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def _runs(spark, d) -> DataFrame:
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    o = W.table(spark, d, "orders")
    start = o.select(F.col("o_orderkey").alias("run_id"), F.lit("start").alias("kind"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("prompt_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("metric_type"), none("baseline", "double"), none("optimized", "double"), none("status", "string"))
    own = W.table(spark, d, "lineitem").filter("l_orderkey % 4 <> 0").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.max("l_shipdate").alias("ts"), F.min("l_discount").alias("baseline"), F.max("l_tax").alias("optimized"))
    own = own.join(o.select(F.col("o_orderkey").alias("run_id")), "run_id", "left_semi")
    done = own.select("run_id", F.lit("complete").alias("kind"), "ts", none("prompt_id", "long"), none("model", "string"), none("metric_type", "string"), "baseline", "optimized", F.when(F.col("run_id") % 5 == 0, "failed").otherwise("completed").alias("status"))
    return optimizer.run_states(start.unionByName(done))


@query(f"WITH {_RUNS} SELECT run_id, prompt_id, model, metric_type, started_at, completed_at, round(improvement, 6) AS improvement, status FROM runs")
def optimizer_runs(spark, d):
    return _runs(spark, d).select("run_id", "prompt_id", "model", "metric_type", "started_at", "completed_at", F.round("improvement", 6).alias("improvement"), "status")


_VARIANTS = """variants AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, model ORDER BY created_at DESC, content_hash DESC) = 1 AS is_current FROM (SELECT o_custkey AS prompt_id, o_orderpriority AS model, o_orderstatus AS prompt_text, substr(sha256(o_orderstatus), 1, 16) AS content_hash, min(o_totalprice) AS metric_score, min(o_orderdate) AS created_at FROM orders GROUP BY ALL))"""


def _variants(spark, d) -> DataFrame:
    o = W.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("prompt_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("prompt_text")).agg(F.min("o_totalprice").alias("metric_score"), F.min("o_orderdate").alias("created_at"))
    return lifecycle.current_rows(o.withColumn("content_hash", X.content_hash("prompt_text")), ["prompt_id", "model"], [F.desc("created_at"), F.desc("content_hash")])


_FRESH = """fresh AS (SELECT prompt_id, model, prompt_text, substr(sha256(prompt_text), 1, 16) AS content_hash, metric_score, created_at, row_number() OVER (PARTITION BY prompt_id, model ORDER BY created_at DESC, substr(sha256(prompt_text), 1, 16) DESC) = 1 AS last FROM (SELECT o_custkey AS prompt_id, o_orderpriority AS model, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'new' || (o_orderkey % 9) END AS prompt_text, max(o_totalprice) AS metric_score, max(o_orderdate) + INTERVAL 10 YEAR AS created_at FROM orders WHERE o_orderkey % 7 = 0 GROUP BY ALL))"""


@query(f"""WITH {_VARIANTS}, {_FRESH} SELECT prompt_id, model, content_hash, coalesce(v.prompt_text, f.prompt_text) AS prompt_text, coalesce(f.metric_score, v.metric_score) AS metric_score, coalesce(v.created_at, f.created_at) AS created_at,
CASE WHEN (prompt_id, model) IN (SELECT (prompt_id, model) FROM fresh) THEN coalesce(f.last, false) ELSE v.is_current END AS is_current FROM variants v FULL JOIN fresh f USING (prompt_id, model, content_hash)""")
def write_variants(spark, d):
    o = W.table(spark, d, "orders").filter("o_orderkey % 7 = 0")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.concat(F.lit("new"), F.col("o_orderkey") % 9))
    fresh = o.groupBy(F.col("o_custkey").alias("prompt_id"), F.col("o_orderpriority").alias("model"), text.alias("prompt_text")).agg(F.max("o_totalprice").alias("metric_score"), (F.max("o_orderdate") + F.expr("INTERVAL 10 YEARS")).alias("created_at"))
    return optimizer.write_variants(_variants(spark, d), fresh)


_EXAMPLES = "examples AS (SELECT doc_id AS example_id, doc_id % 50 AS prompt_id, CASE doc_id % 4 WHEN 0 THEN 'memory_project' WHEN 1 THEN 'external' WHEN 2 THEN 'contrastive' ELSE 'manual' END AS source, lang AS model, doc_id % 11 = 0 AS is_negative, n_chars AS created_at, text FROM documents)"


def _examples(spark, d) -> DataFrame:
    n = F.col("doc_id")
    source = F.when(n % 4 == 0, "memory_project").when(n % 4 == 1, "external").when(n % 4 == 2, "contrastive").otherwise("manual")
    return _docs(spark, d).select(n.alias("example_id"), (n % 50).alias("prompt_id"), source.alias("source"), F.col("lang").alias("model"), (n % 11 == 0).alias("is_negative"), F.col("n_chars").alias("created_at"), F.col("text").alias("input_text"), F.col("text").alias("output_text"))


@query(f"""WITH {_RUNS}, {_VARIANTS}, {_EXAMPLES}, m AS (SELECT prompt_id, array_to_string(list(model ORDER BY created_at DESC, model), ',') AS models FROM variants WHERE is_current GROUP BY prompt_id),
r AS (SELECT prompt_id, array_to_string(list(run_id ORDER BY started_at DESC, run_id)[1:10], ',') AS runs FROM runs GROUP BY prompt_id),
e AS (SELECT prompt_id, count(*) AS n_examples, round(count(*) FILTER (source <> 'memory_project') / count(*), 2) AS external_ratio FROM examples WHERE NOT is_negative GROUP BY prompt_id)
SELECT prompt_id, models, runs, coalesce(n_examples, 0) AS n_examples, external_ratio FROM m FULL JOIN r USING (prompt_id) FULL JOIN e USING (prompt_id)""")
def optimizer_status(spark, d):
    out = optimizer.status_report(_variants(spark, d), _runs(spark, d), _examples(spark, d))
    return out.select("prompt_id", F.array_join("models", ",").alias("models"), F.array_join("runs", ",").alias("runs"), "n_examples", "external_ratio")


@query(f"""WITH {_VARIANTS}, base AS (SELECT c_custkey AS prompt_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE c_name END AS text FROM customer WHERE c_custkey IN (SELECT prompt_id FROM variants))
SELECT prompt_id, model, prompt_text, metric_score, prompt_text = text AS same_as_canonical FROM variants JOIN base USING (prompt_id) WHERE is_current UNION ALL SELECT prompt_id, NULL, text, NULL, true FROM base""")
def optimizer_compare(spark, d):
    base = W.table(spark, d, "customer").select(F.col("c_custkey").alias("prompt_id"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise(F.col("c_name")).alias("prompt_text"))
    return optimizer.compare_report(base, _variants(spark, d))


@query(f"WITH {_EXAMPLES} SELECT prompt_id, row_number() OVER (PARTITION BY prompt_id ORDER BY created_at DESC, example_id) AS place, example_id, source, left(text, 100) AS input_preview FROM examples")
def examples_list(spark, d):
    return optimizer.list_examples(_examples(spark, d)).select("prompt_id", "place", "example_id", "source", "input_preview")


_TURNS = "SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id HAVING count(*) >= 2"
_JUDGE = f"(CASE WHEN len(list_distinct(list_concat({_BAG.format('{0}')}, {_BAG.format('{1}')}))) = 0 THEN 0 ELSE len(list_intersect({_BAG.format('{0}')}, {_BAG.format('{1}')})) / len(list_distinct(list_concat({_BAG.format('{0}')}, {_BAG.format('{1}')}))) END)"


@query(f"""WITH c AS ({_TURNS}), e AS (SELECT conv_id, t[1] AS a, t[2] AS b, unnest(t[3:]) AS o FROM c), s AS (SELECT conv_id, avg({_JUDGE.format('o', 'a')}) AS x, avg({_JUDGE.format('o', 'b')}) AS y, count(*) AS n FROM e GROUP BY conv_id)
SELECT c.conv_id AS prompt_id, round(x, 6) AS baseline_score, round(y, 6) AS candidate_score, coalesce(n, 0) AS n_examples, coalesce(n, 0) > 0 AND round(y - x, 9) >= 0.05 AS promoted, CASE WHEN coalesce(n, 0) = 0 THEN 'no examples' WHEN round(y - x, 9) < 0.05 THEN 'below margin' ELSE 'improved' END AS reason FROM c LEFT JOIN s USING (conv_id)""")
def ab_gate_scored(spark, d):
    turns = W.messages(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t")).filter(F.size("t") >= 2)
    candidates = turns.select(F.col("conv_id").alias("prompt_id"), F.col("t")[0].alias("canonical"), F.col("t")[1].alias("candidate"))
    examples = turns.select(F.col("conv_id").alias("prompt_id"), F.explode(F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0)))).alias("output_text"))
    out = optimizer.ab_gate_scored(candidates, examples, plugins.METRICS["judge"])
    return out.select("prompt_id", F.round("baseline_score", 6).alias("baseline_score"), F.round("candidate_score", 6).alias("candidate_score"), "n_examples", "promoted", "reason")


@query("SELECT doc_id AS prompt_id, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS prompt_text, CASE WHEN doc_id % 3 = 0 THEN substr(sha256(text || '!'), 1, 16) ELSE 'old' END AS content_hash, doc_id % 3 <> 0 AS has_vector FROM documents")
def canonical_update(spark, d):
    n = F.col("doc_id")
    p = _docs(spark, d).select(n.alias("prompt_id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("prompt_text"), F.lit("old").alias("content_hash"), F.lit("2020-01-01").cast("timestamp_ntz").alias("last_updated"), F.array(F.lit(1.0)).alias("embedding"), F.lit("v1").alias("embedding_version"))
    promoted = _docs(spark, d).filter("doc_id % 3 = 0 OR doc_id % 7 = 0").select(n.alias("prompt_id"), F.when(n % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("candidate"))
    out = optimizer.update_canonical(p, promoted, F.lit("2024-01-01").cast("timestamp_ntz"))
    return out.select("prompt_id", "prompt_text", "content_hash", F.col("embedding").isNotNull().alias("has_vector"))


def _model(texts: list[str]) -> list[dict]:
    """A stand-in for a classifying model: it misplaces a value, makes one up, and refuses batches with a very short text."""
    return [{"domain": ["finance", "build"] if "the" in t.split() else ["nonsense"], "intent": ["debug"], "confidence": {"domain": 0.9 if len(t) > 500 else 0.5, "intent": 0.85}} for t in texts]


_CLASSIFIED = "CASE WHEN NOT list_contains(string_split_regex(text, '\\s+'), 'the') THEN 'failed' WHEN length(text) > 500 THEN 'classified' ELSE 'low_confidence' END"


@query(f"SELECT doc_id AS id, CASE WHEN list_contains(string_split_regex(text, '\\s+'), 'the') THEN 'finance' ELSE '' END AS domain, CASE WHEN list_contains(string_split_regex(text, '\\s+'), 'the') THEN 'debug,build' ELSE 'debug' END AS intent, {_CLASSIFIED} AS status FROM documents")
def classify_batches(spark, d):
    return _classified(spark, d).select("id", F.array_join("domain", ",").alias("domain"), F.array_join("intent", ",").alias("intent"), "status")


def _classified(spark, d) -> DataFrame:
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    return rules.classify(rows, _model, {"domain": vocabulary.DOMAINS, "intent": list(vocabulary.INTENT_KEYWORDS)})


@query(f"SELECT count(*) AS total, count(*) FILTER (s <> 'failed') AS successful, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'low_confidence') AS low_confidence FROM (SELECT {_CLASSIFIED} AS s FROM documents)")
def classify_stats(spark, d):
    return rules.classify_stats(_classified(spark, d))


# --- profiler reports -------------------------------------------------------------------------


@query("""SELECT * FROM (SELECT p_partkey AS query, p_size AS calls, p_partkey % 500 AS reads, p_partkey % 97 * 10 AS hits, round((p_partkey % 97 * 10)::DOUBLE / (p_partkey % 97 * 10 + p_partkey % 500) * 100, 1) AS cache_hit_pct, round(p_retailprice / p_size, 2) AS mean FROM part
WHERE p_partkey % 500 > 100 AND (p_partkey % 97 * 10)::DOUBLE / (p_partkey % 97 * 10 + p_partkey % 500) < 0.9) ORDER BY reads DESC, query LIMIT 20""")
def profile_low_cache(spark, d):
    n = F.col("p_partkey")
    return assets.low_cache(W.table(spark, d, "part").select(n.alias("query"), F.col("p_size").alias("calls"), F.col("p_retailprice").alias("total"), (n % 97 * 10).alias("hits"), (n % 500).alias("reads")))


_TABLES = "tables AS (SELECT c_custkey AS \"table\", c_custkey % 170 AS seq_scan, c_custkey * 1009 % 999983 AS seq_read, CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 40 END AS idx_scan, c_custkey * 37 % 30011 AS live, c_custkey * 53 % 5003 AS dead FROM customer)"


def _tables(spark, d) -> DataFrame:
    n = F.col("c_custkey")
    return W.table(spark, d, "customer").select(n.alias("table"), (n % 170).alias("seq_scan"), (n * 1009 % 999983).alias("seq_read"), F.when(n % 9 > 0, n % 40).alias("idx_scan"), (n * 37 % 30011).alias("live"), (n * 53 % 5003).alias("dead"))


@query(f'WITH {_TABLES} SELECT "table", seq_scan, seq_read, idx_scan, live, CASE WHEN idx_scan > 0 THEN round(seq_scan * 100 / (seq_scan + idx_scan), 1) ELSE 100 END AS seq_scan_pct FROM tables WHERE seq_scan > 50 AND live > 10000 ORDER BY seq_read DESC, "table" LIMIT 20')
def profile_full_scans(spark, d):
    return assets.full_scans(_tables(spark, d))


@query(f'WITH {_TABLES} SELECT "table", seq_scan, seq_read, idx_scan, live, round(seq_read / seq_scan, 0) AS rows_per_scan FROM tables WHERE seq_scan > 100 AND seq_read > 100000 AND (idx_scan IS NULL OR idx_scan < seq_scan * 0.1) ORDER BY seq_read DESC, "table" LIMIT 15')
def profile_missing_indexes(spark, d):
    return assets.missing_indexes(_tables(spark, d))


@query(f'WITH {_TABLES} SELECT "table", live, dead, CASE WHEN live > 0 THEN round(dead * 100 / live, 1) ELSE 0 END AS dead_pct FROM tables WHERE dead > 1000 ORDER BY dead DESC, "table" LIMIT 20')
def profile_bloat(spark, d):
    return assets.bloat(_tables(spark, d))


@query("""SELECT * FROM (SELECT 'i' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '_pkey' WHEN 1 THEN '_unique' ELSE '_idx' END AS "index", p_brand AS "table", p_size % 20 AS idx_scan, p_partkey * 7919 % 100003 AS size FROM part) WHERE idx_scan < 10 AND "index" LIKE '%_idx' ORDER BY size DESC, "index" LIMIT 20""")
def profile_unused_indexes(spark, d):
    n = F.col("p_partkey")
    end = F.when(n % 4 == 0, "_pkey").when(n % 4 == 1, "_unique").otherwise("_idx")
    return assets.unused_indexes(W.table(spark, d, "part").select(F.concat(F.lit("i"), n, end).alias("index"), F.col("p_brand").alias("table"), (F.col("p_size") % 20).alias("idx_scan"), (n * 7919 % 100003).alias("size")))


@query("SELECT event_id AS pid, event_type AS state, props AS query, round(epoch_us(TIMESTAMP '2024-01-20' - ts) / 1e6, 3) AS seconds FROM (SELECT *, TIMESTAMP '2024-01-20' AS now FROM events) WHERE epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) > 300000000 AND event_type <> 'idle'".replace("epoch_us(TIMESTAMP '2024-01-20' - ts)", "(epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts))"))
def profile_long_running(spark, d):
    e = W.table(spark, d, "events").select(F.col("event_id").alias("pid"), F.col("event_type").alias("state"), F.col("props").alias("query"), F.col("ts").alias("started"))
    return assets.long_running(e, F.lit("2024-01-20").cast("timestamp_ntz")).withColumn("seconds", F.round("seconds", 3))


# --- retrieval and evaluation -----------------------------------------------------------------

_WIDE = "wide AS (SELECT item_id AS query_id, trim(array_to_string(string_split(text, ' ')[1:6], ' ') || ' ' || array_to_string(string_split(text, ' ')[7:9], ' ')) AS query FROM benchmark WHERE trim(array_to_string(string_split(text, ' ')[7:9], ' ')) <> '')"


@query(f"""WITH {OR_HITS}, {_WIDE}, wterms AS ({W.query_terms_sql('wide')}), wm AS (SELECT query_id, id, count(*) AS score FROM post JOIN wterms USING (term) GROUP BY query_id, id), wr AS (SELECT query_id, id, rank FROM (SELECT *, {RANKED} FROM wm) WHERE rank <= 10),
p AS (SELECT query_id, id, rank AS arrival FROM lexical WHERE rank <= 10), fresh AS (SELECT * FROM wr ANTI JOIN p USING (query_id, id))
SELECT query_id, id, arrival FROM p UNION ALL SELECT query_id, id, coalesce(last, 0) + row_number() OVER (PARTITION BY query_id ORDER BY rank, id) FROM fresh LEFT JOIN (SELECT query_id, max(arrival) AS last FROM p GROUP BY query_id) USING (query_id)""")
def expand_pool(spark, d):
    """A second search with three more words of the item."""
    active = retrieval.eligible(W.prompts(spark, d))
    words = F.split("text", " ")
    queries = W.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring_index("text", " ", 6).alias("query"), F.array_join(F.slice(words, 7, 3), " ").alias("expansion"))
    search = lambda q: retrieval.exact_search(active, q, False, 10, "id", "prompt_text").withColumnRenamed("rank", "arrival")
    pool = search(queries).select("query_id", "id", "arrival")
    return fusion.expanded_pool(pool, search, queries)


@query()
def skill_candidates(spark, d):
    """Parts as skills, with the vectors of their numbers."""
    part, v = W.table(spark, d, "part"), W.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("routing_embedding"))
    skills = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_name").alias("summary"), F.array("p_brand").alias("domain"), F.when(F.col("p_size") % 10 == 0, "inactive").otherwise("active").alias("status")).join(v, "id", "left")
    queries = part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("query")).join(v.select(F.col("id").alias("query_id"), F.col("routing_embedding").alias("embedding")), "query_id", "left")
    return retrieval.skill_candidates(skills, queries, {"domain": ["Brand#11", "Brand#12"]})


def _overlap(pairs) -> list[float]:
    import pandas as pd

    return rerank.overlap_scorer(pd.DataFrame(pairs, columns=["query", "document"])).tolist()


@query(RERANK)
def remote_rerank(spark, d):
    """The offline scorer behind the interface of a service."""
    pairs = _lexical(spark, d).join(retrieval.bounded(W.word_queries(spark, d)), "query_id").join(W.prompts(spark, d).withColumn("summary", F.lit(None).cast("string")), "id")
    scored = rerank.score_lists(pairs.withColumn("document", rerank.rerank_document(domain="domain", task_type="task_type")), _overlap)
    best = retrieval.top(scored.select("query_id", "id", rerank.shaped_score("raw", "n_chars").alias("score")), 10)
    return best.withColumn("score", F.round("score", 6))


@query(f"WITH {OR_HITS} SELECT query_id, CASE WHEN rank = 0 THEN '== ' || query || ' ==' ELSE printf('%3d. %.4f  %s', CAST(rank AS INT), CAST(score AS DOUBLE), title) END AS line, rank FROM (SELECT query_id, 0 AS rank, 0 AS score, query, '' AS title FROM word_queries UNION ALL SELECT query_id, rank, score, '', title FROM lexical l JOIN prompts p ON p.id = l.id WHERE rank <= 3) UNION ALL SELECT query_id, '  (no results)', 1 FROM word_queries WHERE query_id NOT IN (SELECT query_id FROM lexical)")
def text_report(spark, d):
    found = _lexical(spark, d, 3).join(W.prompts(spark, d).select("id", "title"), "id")
    return evaluation.text_report(found, W.word_queries(spark, d))


_PROBES = "probes AS (SELECT doc_id AS query_id, array_to_string(string_split(text, ' ')[4:12], ' ') AS query FROM documents WHERE doc_id % 20 = 0)"


@query(f"""WITH {P}, {_PROBES}, post AS (SELECT id, unnest({W.doc_terms_sql('prompt_text')}) AS term FROM prompts), pterms AS ({W.query_terms_sql('probes')}), m AS (SELECT query_id, id, count(*) AS score FROM post JOIN pterms USING (term) GROUP BY query_id, id), r AS (SELECT query_id, id, {RANKED} FROM m),
own AS (SELECT p.query_id, rank FROM probes p LEFT JOIN r ON r.query_id = p.query_id AND r.id = p.query_id AND rank <= 10) SELECT count(*) AS n, count(*) FILTER (coalesce(rank <= 1, false)) AS within_1, count(*) FILTER (coalesce(rank <= 10, false)) AS within_10 FROM own""")
def self_retrieval(spark, d):
    """Nine words of a document, looked for among all of them.

    A document holds all terms of its own words, so nothing comes before it but others that hold them all: its rank by number of terms is its rank among these.
    """
    probes = _docs(spark, d).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 4, 9), " ").alias("query"))
    hits = retrieval.holding_all(W.prompts(spark, d), probes, 10, "id", "prompt_text")
    ranks = evaluation.gold_ranks(probes.select("query_id", F.col("query_id").alias("gold_id")), hits)
    return evaluation.self_retrieval(ranks)


@query(f"WITH {OR_HITS}, golden AS ({W.GOLDEN}) SELECT l.query_id, count(gold_id) / 10 AS precision FROM lexical l LEFT JOIN (SELECT DISTINCT query_id, gold_id FROM golden) g ON g.query_id = l.query_id AND g.gold_id = l.id WHERE l.rank <= 10 GROUP BY l.query_id")
def precision_10(spark, d):
    return evaluation.precision(_lexical(spark, d, 10), W.golden(spark, d).select("query_id", "gold_id"), 10)


@query(f"""WITH {_NUMBERED}, got AS (SELECT skill_id AS query_id, step_order AS place, CASE WHEN skill_id % 3 = 0 AND step_order = 2 THEN -1 ELSE id END AS id FROM numbered WHERE NOT (skill_id % 5 = 0 AND step_order = 1)),
b AS (SELECT coalesce(w.skill_id, g.query_id) AS q, count(w.id) AS n, count(*) FILTER (w.id = g.id) AS met, count(*) FILTER (w.id IS DISTINCT FROM g.id) AS miss FROM numbered w FULL JOIN got g ON g.query_id = w.skill_id AND g.place = w.step_order GROUP BY ALL)
SELECT count(*) AS n, round(avg(CAST(miss = 0 AS INT)), 6) AS exact, round(avg(met / n), 6) AS places FROM b WHERE n > 0""")
def sequence_accuracy(spark, d):
    want = _numbered(spark, d).select(F.col("skill_id").alias("query_id"), F.col("step_order").alias("place"), "id")
    got = want.filter(~((F.col("query_id") % 5 == 0) & (F.col("place") == 1))).withColumn("id", F.when((F.col("query_id") % 3 == 0) & (F.col("place") == 2), -1).otherwise(F.col("id")))
    out = evaluation.sequence_accuracy(got, want)
    return out.select("n", F.round("exact", 6).alias("exact"), F.round("places", 6).alias("places"))


@query("SELECT round(count(*) FILTER (quality = 0 AND toxic = 1) / nullif(count(*) FILTER (quality = 0), 0), 6) AS precision, round(count(*) FILTER (quality = 0 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 6) AS recall, round(avg(CAST(quality = 0 AS INT)), 6) AS rate FROM labels")
def abstain_quality(spark, d):
    out = evaluation.abstain_quality(W.table(spark, d, "labels").select((F.col("quality") == 0).alias("abstained"), (F.col("toxic") == 0).alias("answerable")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_report(spark, d):
    out = evaluation.latency(W.table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


_SCORED = """chains AS (SELECT p_size AS query_id, p_partkey AS chain_id, round(0.45 * (p_partkey % 100) / 100 + 0.25 * (p_partkey % 7) / 6 + 0.15 * (p_partkey % 3) / 2 + 0.1, 9) AS chain_score, (p_partkey % 7) / 6 AS workflow_coverage, (p_partkey % 5) / 4 AS quality_prior, (p_partkey % 2)::DOUBLE AS redundancy, p_partkey AS last_updated FROM part),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chain_score DESC, workflow_coverage DESC, quality_prior DESC, redundancy, last_updated DESC, chain_id) AS n FROM chains) WHERE n = 1), one AS (SELECT p_size AS query_id, max(round((p_partkey % 83) / 100, 9)) AS single FROM part GROUP BY p_size)"""


@query(f"WITH {_SCORED} SELECT query_id, chain_id, round(chain_score, 6) AS chain_score, CASE WHEN single >= 0.76 AND chain_score - single < 0.06 THEN 'single' WHEN chain_score >= 0.72 THEN 'chain' ELSE 'clarify' END AS mode FROM best JOIN one USING (query_id)")
def chain_select(spark, d):
    n = F.col("p_partkey")
    parts = W.table(spark, d, "part").select(F.col("p_size").alias("query_id"), n.alias("chain_id"), ((n % 100) / 100).alias("avg_prompt_score"), ((n % 7) / 6).alias("workflow_coverage"), ((n % 3) / 2).alias("transition_coherence"), F.lit(1.0).alias("non_redundancy"), F.lit(None).cast("double").alias("confidence_margin"), ((n % 5) / 4).alias("quality_prior"), (n % 2).cast("double").alias("redundancy"), n.alias("last_updated"))
    best = chains.best_chains(parts.withColumn("chain_score", F.round(chains.weighted_score(chains.CHAIN_WEIGHTS), 9)))
    one = W.table(spark, d, "part").groupBy(F.col("p_size").alias("query_id")).agg(F.max(F.round((n % 83) / 100, 9)).alias("single"))
    return best.join(one, "query_id").select("query_id", "chain_id", F.round("chain_score", 6).alias("chain_score"), chains.select_mode(F.col("single"), F.col("chain_score")).alias("mode"))


@query(f"WITH {DENSE}, pool AS (SELECT query_id, id FROM dense WHERE rank <= 5), near AS (SELECT a.chunk_id AS via, b.chunk_id AS id, row_number() OVER (PARTITION BY a.chunk_id ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC, b.chunk_id) AS n, list_cosine_similarity(a.embedding, b.embedding) AS s FROM chunks a, chunks b WHERE a.chunk_id <> b.chunk_id AND a.chunk_id IN (SELECT id FROM pool)), more AS (SELECT p.query_id, near.id, min(via) AS via FROM pool p JOIN near ON near.via = p.id WHERE n <= 10 AND s >= 0.3 GROUP BY ALL) SELECT query_id, id, CAST(NULL AS BIGINT) AS via FROM pool UNION ALL SELECT * FROM more ANTI JOIN pool USING (query_id, id)")
def neighbour_expansion(spark, d):
    vectors = W.chunk_vecs(spark, d).select(F.col("chunk_id").alias("id"), "embedding")
    return chains.expand_neighbours(_dense(spark, d, 5).select("query_id", "id"), vectors, 0.3)


@query(f"WITH {DENSE}, pool AS (SELECT query_id, dense.id AS id, rank AS arrival, chunks.embedding AS embedding, dense.id % 4 AS h FROM dense JOIN chunks ON chunk_id = dense.id WHERE rank <= 20) SELECT query_id, id, arrival FROM pool p WHERE NOT EXISTS (SELECT 1 FROM pool e WHERE e.query_id = p.query_id AND e.arrival < p.arrival AND (e.h = p.h AND p.id % 3 = 0 AND e.id % 3 = 0 OR list_cosine_similarity(e.embedding, p.embedding) >= 0.3))")
def dedupe_pool(spark, d):
    v = W.chunk_vecs(spark, d).select(F.col("chunk_id").alias("id"), "embedding")
    content = F.when(F.col("id") % 3 == 0, (F.col("id") % 4).cast("string")).otherwise(F.concat(F.lit("own"), "id"))
    pool = _dense(spark, d, 20).select("query_id", "id", F.col("rank").alias("arrival")).join(v, "id").withColumn("content_hash", content)
    return chains.dedupe_pool(pool, 0.3).select("query_id", "id", "arrival")


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')) AS copy_of FROM documents")
def copies(spark, d):
    return chains.copies(_docs(spark, d), "doc_id")


# --- slots ------------------------------------------------------------------------------------

_KEY = "trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_')"
_KIND = "CASE kind WHEN 'paste' THEN 'artifact' WHEN 'choice' THEN 'choice' ELSE CASE WHEN regexp_matches(lower(name), 'problem|goal|situation|context|task|question') THEN 'derived' ELSE 'fact' END END"
_REGISTRY = f"""t AS ({TEMPLATES}), s AS (SELECT id, text, unnest({_once('l')}) AS x, generate_subscripts({_once('l')}, 1) - 1 AS place FROM (SELECT id, text, {SLOTS_SQL} AS l FROM t)),
named AS (SELECT id, text, place, string_split(x, ':')[1] AS name, string_split(x, ':')[2] AS kind FROM s), reg AS (SELECT id, CASE WHEN contains(text, '{{{{' || name || '}}}}') THEN '{{{{' || name || '}}}}' ELSE '[' || name || ']' END AS raw, {_KEY} AS slot_key, {_KIND} AS kind, CASE WHEN kind = 'choice' THEN string_split_regex(name, '[/|]') END AS choices, text, place FROM named)"""


@query(f"WITH {_REGISTRY} SELECT id, raw, slot_key, kind, array_to_string(choices, ',') AS choices, CAST((length(text) - length(replace(text, raw, ''))) / length(raw) AS INTEGER) AS occurrences, CAST(place AS INTEGER) AS place FROM reg")
def slot_registry(spark, d):
    return slot_ops.registry(_templates(spark, d), text_col="text").withColumn("choices", F.array_join("choices", ","))


BASE = [
    ("lang", "Basque", [], "global", None, [1.0, 0.0]),
    ("lang", "Breton", [], "project", "2000-01-01", [1.0, 0.0]),
    ("cost", "COST", ["price_cost"], "global", None, [0.0, 1.0]),
    ("first_source", "one", ["src0"], "domain", None, [0.6, 0.8]),
    ("second_source", "two", ["src0"], "global", None, [0.62, 0.78]),
    ("paste_notes", "never", [], "global", None, [0.0, 1.0]),
]


@query(f"""WITH {_REGISTRY}, base AS (SELECT * FROM (VALUES {', '.join(f"({_quoted(k)}, {_quoted(v)}, {_list(a) if a else 'CAST([] AS VARCHAR[])'}, {_quoted(s)}, {'NULL' if u is None else _quoted(u)}, {e})" for k, v, a, s, u, e in BASE)}) b(key, value, aliases, scope, valid_until, embedding) WHERE valid_until IS NULL),
scoped AS (SELECT *, list_position(['project', 'domain', 'global'], scope) AS o FROM base), exact AS (SELECT key, arg_min(value, (o, key)) AS v FROM scoped GROUP BY key), alias AS (SELECT a, arg_min(value, (o, key)) AS v FROM (SELECT key, o, value, unnest(aliases) AS a FROM scoped) GROUP BY a),
near AS (SELECT slot_key, value, s, lead(s) OVER w AS next, row_number() OVER w AS n FROM (SELECT slot_key, key, value, list_cosine_similarity(CASE WHEN slot_key = 'src1' THEN [0.0, 1.0] ELSE [0.61, 0.79] END, embedding) AS s FROM (SELECT DISTINCT slot_key FROM reg WHERE slot_key IN ('src1', 'src2')), scoped) WHERE s >= 0.75 WINDOW w AS (PARTITION BY slot_key ORDER BY s DESC, key)), lead1 AS (SELECT slot_key, CASE WHEN next IS NULL OR s - next >= 0.05 THEN value END AS v, next IS NOT NULL AND s - next < 0.05 AS unsure FROM near WHERE n = 1),
f AS (SELECT r.id, r.raw, r.slot_key, r.kind, CASE WHEN r.slot_key = 'lang' AND r.id % 4 = 0 THEN 'said' WHEN r.slot_key = 'paste_notes' AND r.id % 5 = 0 THEN 'notes' END AS c, CASE WHEN r.kind <> 'artifact' THEN e.v END AS e, CASE WHEN r.kind <> 'artifact' THEN a.v END AS a, CASE WHEN NOT coalesce(l.unsure, false) THEN l.v END AS l, coalesce(l.unsure, false) AS unsure FROM reg r LEFT JOIN exact e ON e.key = r.slot_key LEFT JOIN alias a ON a.a = r.slot_key LEFT JOIN lead1 l ON l.slot_key = r.slot_key)
SELECT id, raw, slot_key, coalesce(c, e, a, l) AS value, CASE WHEN c IS NOT NULL THEN 'context' WHEN e IS NOT NULL THEN 'exact' WHEN a IS NOT NULL THEN 'alias' WHEN l IS NOT NULL THEN 'close' END AS rung, CASE WHEN coalesce(c, e, a, l) IS NULL THEN CASE WHEN kind = 'artifact' THEN 'user must supply' WHEN unsure THEN 'ambiguous' ELSE 'unfilled' END END AS need FROM f""")
def slot_ladder(spark, d):
    slots = slot_ops.registry(_templates(spark, d), text_col="text")
    vector = F.when(F.col("slot_key") == "src1", F.array(F.lit(0.0), F.lit(1.0))).when(F.col("slot_key") == "src2", F.array(F.lit(0.61), F.lit(0.79)))
    context = slots.filter(((F.col("slot_key") == "lang") & (F.col("id") % 4 == 0)) | ((F.col("slot_key") == "paste_notes") & (F.col("id") % 5 == 0))).select("id", "slot_key", F.when(F.col("slot_key") == "lang", "said").otherwise("notes").alias("value"))
    base = spark.createDataFrame(BASE, "key string, value string, aliases array<string>, scope string, valid_until string, embedding array<double>")
    return slot_ops.fill(slots.withColumn("description", vector), context, base, ["project", "domain", "global"], F.lit("2024-01-01"))


_SPEC = f"regexp_extract_all(text, {_quoted(vocabulary.SPEC_TOKEN)})"


@query(f"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, {_quoted(vocabulary.SPEC_TOKEN)}, ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS prose, array_to_string({_SPEC}, '|') AS spec FROM (SELECT conv_id, turn, text || ' see src/app_' || turn || '.py or call run(x) == 3' AS text FROM conversations)")
def split_query(spark, d):
    rows = W.messages(spark, d).withColumn("text", F.concat("text", F.lit(" see src/app_"), "turn", F.lit(".py or call run(x) == 3")))
    return rows.select("conv_id", "turn", slot_ops.split_query("text").alias("q")).select("conv_id", "turn", "q.prose", F.array_join("q.spec", "|").alias("spec"))
