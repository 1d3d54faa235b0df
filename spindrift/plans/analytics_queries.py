"""Queries over lifecycle, feedback, windows, assets and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assets, chains, chunking, evaluation, lifecycle, maintenance, rules, search_vectors
from ..session import remove_path, settled, shared_path
from ..sources import events as logs
from ..streaming import events as streams
from ..streaming import refresh
from . import views as W
from .registry import query

P = f"prompts AS ({W.PROMPTS})"
FB = f"feedback AS ({W.FEEDBACK})"
ST = f"steps AS ({W.STEPS})"


def _r(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name or c)


# --- catalog tables ---------------------------------------------------------------------------


@query(f"""WITH {P}, o AS (SELECT id AS title, 'old-' || id AS tag, prompt_text AS text, 'active' AS status FROM prompts WHERE id % 3 <> 0),
n AS (SELECT id AS title, 'new-' || id AS tag, CASE WHEN id % 4 = 0 THEN prompt_text || '!' ELSE prompt_text END AS text FROM prompts WHERE id % 2 = 0)
SELECT title, coalesce(o.tag, n.tag) AS tag, CASE WHEN n.title IS NOT NULL THEN n.text ELSE o.text END AS text, CASE WHEN n.title IS NULL THEN o.status WHEN o.title IS NULL OR sha256(n.text) IS DISTINCT FROM sha256(o.text) THEN 'pending' ELSE o.status END AS status
FROM o FULL JOIN n USING (title)""")
def upsert_conditional(spark, d):
    p = W.prompts(spark, d).select(F.col("id").alias("title"), "prompt_text")
    old = p.filter("title % 3 <> 0").select("title", F.concat(F.lit("old-"), "title").alias("tag"), F.col("prompt_text").alias("text"), F.lit("active").alias("status"))
    new = p.filter("title % 2 = 0").select("title", F.concat(F.lit("new-"), "title").alias("tag"), F.when(F.col("title") % 4 == 0, F.concat("prompt_text", F.lit("!"))).otherwise(F.col("prompt_text")).alias("text"))
    return lifecycle.upsert(old, new)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN version + 1 ELSE version END AS version FROM (SELECT p_partkey, p_size AS version FROM part) WHERE p_partkey % 5 <> 0 OR p_partkey % 2 = 0")
def upsert_public(spark, d):
    part = W.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("version"))
    old, new = part.filter("p_partkey % 5 <> 0"), part.filter("p_partkey % 2 = 0").withColumn("fresh", F.lit(True))
    joined = old.join(new.withColumnRenamed("version", "nv"), "p_partkey", "full")
    return joined.select("p_partkey", F.when(F.col("fresh"), F.coalesce("version", "nv") + 1).otherwise(F.col("version")).alias("version"))


@query(f"WITH {P} SELECT id, source FROM prompts WHERE NOT (source = 'src0' AND id % 3 = 0)")
def prune_orphans(spark, d):
    p = W.prompts(spark, d).select("id", "source")
    kept, _ = lifecycle.prune(p, p.filter("id % 3 <> 0"), "id", F.col("source") == "src0")
    return kept


@query("""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type)), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g') AS slug FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s) SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS tag FROM n""")
def slug_decollide(spark, d):
    rows = W.table(spark, d, "part").select("p_partkey", X.slugify("p_type").alias("slug"))
    return lifecycle.decollide(rows, "slug", [F.asc("p_partkey")]).select("p_partkey", "tag")


@query(f"""WITH {ST}, numbered AS (SELECT skill_id, id, row_number() OVER (PARTITION BY skill_id ORDER BY id) AS step_order FROM steps),
v AS (SELECT p_partkey AS id, p_brand AS variant_text FROM part WHERE p_partkey % 3 = 0)
SELECT skill_id, CAST(step_order AS INTEGER) AS step_order, n.id, p_name AS title, coalesce(variant_text, CASE WHEN p_partkey % 5 <> 0 THEN p_type END, '') AS text FROM numbered n LEFT JOIN part ON p_partkey = n.id LEFT JOIN v ON v.id = n.id""")
def resolve_steps(spark, d):
    part = W.table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    prompts = part.select("id", F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("base_text"))
    variants = part.select("id", F.col("p_brand").alias("variant_text"), (F.col("p_partkey") % 3 == 0).alias("is_current"))
    steps = W.steps(spark, d).withColumn("step_order", F.row_number().over(Window.partitionBy("skill_id").orderBy("id")))
    return lifecycle.resolve_steps(steps, prompts, variants)


@query(f"WITH {ST} SELECT id, count(DISTINCT skill_id) AS n_skills FROM steps GROUP BY id")
def dependents(spark, d):
    return lifecycle.dependents(W.steps(spark, d))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def orphans(spark, d):
    steps = W.table(spark, d, "orders").select(F.col("o_custkey").alias("skill_id"), F.col("o_orderkey").alias("id"))
    return lifecycle.orphans(steps, steps.agg(F.min("skill_id")).first()[0])


@query("""SELECT p_partkey, coalesce(n, 0) AS n_lines, coalesce(q, 0) AS quantity, last AS last_ship FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q, max(l_shipdate) AS last FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE p_size % 2 = 0""")
def review_inactive(spark, d):
    use = W.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max("l_shipdate").alias("last_ship"))
    part = W.table(spark, d, "part").filter("p_size % 2 = 0")
    rows = part.join(use, part["p_partkey"] == use["l_partkey"], "left")
    return rows.select("p_partkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("q", F.lit(0.0)).alias("quantity"), "last_ship").orderBy(F.asc_nulls_first("last_ship"), "p_partkey")


@query(f"WITH {ST} SELECT skill_id, count(*) FILTER (p_size % 2 = 0) AS n_inactive FROM steps LEFT JOIN part ON p_partkey = id WHERE skill_id % 4 = 0 GROUP BY skill_id")
def review_skills(spark, d):
    part = W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return W.steps(spark, d).filter("skill_id % 4 = 0").join(part, "id", "left").groupBy("skill_id").agg(F.count_if(F.col("p_size") % 2 == 0).alias("n_inactive"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-08-01' - INTERVAL 6 MONTH)")
def stale_items(spark, d):
    items = W.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    usage = W.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"))
    return lifecycle.stale(items, usage, "2001-08-01").select(F.col("id").alias("c_custkey"))


@query(f"WITH {P} SELECT domain, count(*) AS n, count(*) FILTER (status = 'active') AS n_active FROM (SELECT unnest(domain) AS domain, status FROM prompts) GROUP BY domain")
def domain_counts(spark, d):
    return W.prompts(spark, d).select(F.explode("domain").alias("domain"), "status").groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("n_active"))


# --- feedback ---------------------------------------------------------------------------------


@query(f"""WITH {FB}, v AS (SELECT *, CASE outcome WHEN 'success' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'failure' THEN 0.0 END AS v FROM feedback WHERE outcome <> 'skipped')
SELECT prompt_id, count(*) AS n, round(avg(v), 6) AS avg_outcome, round(avg(CAST(outcome = 'success' AS INT)), 6) AS success_rate, round((count(*) * avg(v) + 2.5) / (count(*) + 5), 6) AS prior FROM v GROUP BY prompt_id""")
def quality_prior(spark, d):
    return lifecycle.quality_prior(W.feedback(spark, d)).select("prompt_id", "n", _r("avg_outcome"), _r("success_rate"), _r("prior"))


@query(f"WITH {FB} SELECT i AS id, coalesce(n, 3) AS total_runs, round(coalesce(r, 0.25), 6) AS success_rate FROM (SELECT unnest(range(0, 10)) AS i) LEFT JOIN (SELECT prompt_id, count(*) AS n, avg(CAST(outcome = 'success' AS INT)) AS r FROM feedback GROUP BY prompt_id) ON prompt_id = i")
def success_rate(spark, d):
    items = spark.range(10).select("id", F.lit(3).cast("bigint").alias("total_runs"), F.lit(0.25).alias("success_rate"))
    return lifecycle.success_rate(items, W.feedback(spark, d).select(F.col("prompt_id").alias("id"), "outcome")).select("id", "total_runs", _r("success_rate"))


@query(f"WITH {P} SELECT count(*) AS n, count(*) FILTER (status = 'active') AS n_active, count(*) FILTER (n_chars > 1600) AS n_long, count(*) FILTER (domain[1] = 'en') AS n_en, round(100.0 * count(*) FILTER (status = 'active') / nullif(count(*), 0), 2) AS active_pct FROM prompts")
def corpus_stats(spark, d):
    active = F.count_if(F.col("status") == "active")
    return W.prompts(spark, d, texts=False).agg(F.count("*").alias("n"), active.alias("n_active"), F.count_if(F.col("n_chars") > 1600).alias("n_long"), F.count_if(F.col("domain")[0] == "en").alias("n_en"), F.round(F.try_divide(100.0 * active, F.count("*")), 2).alias("active_pct"))


@query(f"WITH {P} SELECT id, CASE WHEN len(domain) > 0 AND n_chars > 1600 THEN 0.8::DOUBLE WHEN len(domain) > 0 THEN 0.4 ELSE 0.1 END AS confidence, n_chars <= 1600 AS needs_classification FROM prompts")
def confidence_ladder(spark, d):
    c = F.when((F.size("domain") > 0) & (F.col("n_chars") > 1600), 0.8).when(F.size("domain") > 0, 0.4).otherwise(0.1)
    return W.prompts(spark, d).select("id", c.alias("confidence"), (c < 0.8).alias("needs_classification"))


@query("SELECT lang, count(*) FILTER (source = 'src0') AS own, count(*) FILTER (source = 'src1') AS manual, count(*) FILTER (source NOT IN ('src0', 'src1')) AS external, round(count(*) FILTER (source NOT IN ('src0', 'src1')) / count(*), 2) AS external_ratio FROM documents GROUP BY lang")
def source_dist(spark, d):
    ext = F.count_if(~F.col("source").isin("src0", "src1"))
    return W.table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.col("source") == "src0").alias("own"), F.count_if(F.col("source") == "src1").alias("manual"), ext.alias("external"), F.round(F.try_divide(ext, F.count("*")), 2).alias("external_ratio"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, count(*) + 1 AS next_version FROM orders GROUP BY o_custkey")
def latest_version(spark, d):
    return W.table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), (F.count("*") + 1).alias("next_version"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders")
def current_variant(spark, d):
    rows = lifecycle.current_rows(W.table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return rows.select("o_orderkey", "is_current")


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS models FROM lineitem GROUP BY l_partkey")
def distinct_models(spark, d):
    return W.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("models"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 4000) AS n_atomic, list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS INT) + 1] AS median, max(n_chars) AS longest FROM documents GROUP BY lang")
def chunk_stats(spark, d):
    return W.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 4000).alias("n_atomic"), evaluation.upper_median("n_chars").alias("median"), F.max("n_chars").alias("longest"))


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS tn, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn FROM labels")
def gate_confusion(spark, d):
    return evaluation.confusion(W.table(spark, d, "labels").select((F.col("quality") == 1).alias("w"), (F.col("toxic") == 0).alias("g")), "w", "g")


# --- windows and assets -----------------------------------------------------------------------


@query("SELECT event_id, user_id, gap_seconds FROM (SELECT event_id, user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER w / 1e6 AS g, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 3) AS gap_seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap_seconds > 86400")
def gaps(spark, d):
    return assets.gaps(W.table(spark, d, "events"), ["user_id"], 86400, ("ts", "event_id")).select("event_id", "user_id", _r("gap_seconds", digits=3))


POINTS = "points AS (SELECT p_brand AS brand, p_size AS price, sum(l_quantity) AS units FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


def _points(spark, d):
    part = W.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("price"))
    return W.table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("brand", "price").agg(F.sum("l_quantity").alias("units"))


@query(f"WITH {POINTS}, l AS (SELECT *, lag(price) OVER w AS p0, lag(units) OVER w AS u0 FROM points WINDOW w AS (PARTITION BY brand ORDER BY price)) SELECT brand, price, CASE WHEN p0 IS NOT NULL THEN round(coalesce(((units - u0) / nullif(u0, 0)) / nullif((price - p0) / nullif(p0, 0), 0), 0), 3) END AS elasticity FROM l")
def elasticity(spark, d):
    return assets.elasticity(_points(spark, d), ["brand"]).select("brand", "price", "elasticity")


VAR = "b AS (SELECT p_brand AS metric, round(sum(p_retailprice * 10), 2) AS value FROM part GROUP BY ALL), a AS (SELECT p_brand AS metric, round(sum(l_extendedprice) / 100, 2) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), v AS (SELECT metric, b.value AS budget, a.value AS actual, a.value - b.value AS abs_var, (a.value - b.value) / abs(b.value) * 100 AS pct_var FROM b JOIN a USING (metric) WHERE b.value <> 0)"


def _variance(spark, d):
    part = W.table(spark, d, "part")
    budget = part.groupBy(F.col("p_brand").alias("metric")).agg(F.round(F.sum(F.col("p_retailprice") * 10), 2).alias("value"))
    joined = W.table(spark, d, "lineitem").select("l_partkey", "l_extendedprice").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    actual = joined.groupBy(F.col("p_brand").alias("metric")).agg(F.round(F.sum("l_extendedprice") / 100, 2).alias("value"))
    return assets.variance(budget, actual)


@query(f"WITH {VAR} SELECT metric, round(budget, 1) AS budget, round(actual, 1) AS actual, round(abs_var, 1) AS abs_var, round(pct_var, 3) AS pct_var, abs_var > 0 AS favorable, abs(pct_var) >= 10 AS flagged FROM v")
def variance(spark, d):
    return _variance(spark, d).select("metric", _r("budget", digits=1), _r("actual", digits=1), _r("abs_var", digits=1), _r("pct_var", digits=3), "favorable", "flagged")


@query(f"WITH {VAR} SELECT round(avg(abs(pct_var)), 3) AS mean_pct, round(max(abs(pct_var)), 3) AS max_pct FROM v")
def variance_summary(spark, d):
    return _variance(spark, d).agg(F.round(F.avg(F.abs("pct_var")), 3).alias("mean_pct"), F.round(F.max(F.abs("pct_var")), 3).alias("max_pct"))


PNL = f"{POINTS}, pnl AS (SELECT brand, price, round(price * units, 2) AS revenue, round(price * units - 12 * units - 5000, 2) AS net_profit, round(coalesce(100 * round(price * units - 12 * units - 5000, 2) / nullif(round(price * units, 2), 0), 0), 1) AS net_margin FROM points)"


def _pnl(spark, d):
    return assets.price_points(_points(spark, d).withColumns({"unit_cost": F.lit(12.0), "fixed_costs": F.lit(5000.0)}))


@query(f"WITH {PNL} SELECT * FROM pnl")
def price_points(spark, d):
    return _pnl(spark, d).select("brand", "price", "revenue", "net_profit", "net_margin")


@query(f"""WITH {PNL}, r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY net_margin >= 20 DESC, net_profit DESC, price) AS n FROM pnl), g AS (SELECT brand, count(*) FILTER (net_profit > 0) AS k, min(price) FILTER (net_profit > 0) AS lo, max(price) FILTER (net_profit > 0) AS hi FROM pnl GROUP BY brand)
SELECT brand, price, net_profit, CASE WHEN k >= 2 THEN lo END AS low, CASE WHEN k >= 2 THEN hi END AS high FROM r JOIN g USING (brand) WHERE n = 1""")
def recommend(spark, d):
    return assets.recommend_price(_pnl(spark, d), group=["brand"])


#: Parts as columns of a catalog: brands as tables, with ids, ill-formed names, repeated and unknown ones; every third of them a key.
COLUMNS = """cols AS (SELECT lower(p_brand) AS t, CASE WHEN p_partkey % 29 = 0 AND p_brand <> 'Brand#11' THEN 'id' WHEN p_partkey % 13 = 0 THEN p_name ELSE 'c' || p_size END AS c, CASE p_partkey % 5 WHEN 0 THEN 'Text' WHEN 1 THEN 'when' ELSE 'int' END AS k, p_partkey % 4 = 0 AS n FROM part),
keys AS (SELECT DISTINCT lower(p_brand) AS t, 'c' || p_size AS c, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE 'brand#11' END AS rt, CASE WHEN p_partkey % 3 = 0 THEN 'id' ELSE 'c' || (p_partkey % 50) END AS rc FROM part WHERE p_partkey % 3 <> 1)"""


def _catalog(spark, d) -> tuple[DataFrame, DataFrame]:
    n, brand = F.col("p_partkey"), F.lower("p_brand")
    part = W.table(spark, d, "part")
    name = F.when((n % 29 == 0) & (F.col("p_brand") != "Brand#11"), "id").when(n % 13 == 0, F.col("p_name")).otherwise(F.concat(F.lit("c"), "p_size"))
    cols = part.select(brand.alias("table"), name.alias("column"), F.when(n % 5 == 0, "Text").when(n % 5 == 1, "when").otherwise("int").alias("type"), (n % 4 == 0).alias("nullable"))
    ref = F.when(n % 3 == 0, "id").otherwise(F.concat(F.lit("c"), n % 50))
    keys = part.filter("p_partkey % 3 <> 1").select(brand.alias("table"), F.concat(F.lit("c"), "p_size").alias("column"), F.when(n % 2 == 0, brand).otherwise("brand#11").alias("ref_table"), ref.alias("ref_column")).distinct()
    return cols, keys


@query(f"""WITH {COLUMNS}, bad AS (SELECT t, c, 'naming' AS i FROM cols WHERE NOT regexp_matches(c, '^[a-z][a-z0-9_]*$') UNION SELECT t, c, 'duplicate' FROM cols GROUP BY t, c HAVING count(*) > 1 UNION SELECT t, c, 'unknown type' FROM cols WHERE lower(k) NOT IN ('int', 'text', 'boolean', 'timestamp')
UNION SELECT t, 'id', 'missing id' FROM cols GROUP BY t HAVING count(*) FILTER (c = 'id') = 0 UNION SELECT keys.t, keys.c, 'orphan reference' FROM keys LEFT JOIN cols r ON r.t = rt AND r.c = rc WHERE r.k IS NULL UNION SELECT keys.t, keys.c, 'reference type' FROM keys JOIN cols r ON r.t = rt AND r.c = rc JOIN cols o ON o.t = keys.t AND o.c = keys.c WHERE r.k <> o.k)
SELECT t AS "table", c AS "column", i AS issue FROM bad""")
def schema_check(spark, d):
    return assets.validate_schema(*_catalog(spark, d), ["int", "text", "boolean", "timestamp"]).distinct()


@query(f'WITH {COLUMNS} SELECT t AS "table", c AS "column", rt AS ref_table, rc AS ref_column FROM keys WHERE NOT EXISTS (SELECT 1 FROM cols WHERE cols.t = rt AND cols.c = rc)')
def fk_orphans(spark, d):
    cols, keys = _catalog(spark, d)
    there = cols.select(F.col("table").alias("ref_table"), F.col("column").alias("ref_column")).distinct()
    return keys.join(there, ["ref_table", "ref_column"], "left_anti").select("table", "column", "ref_table", "ref_column")


@query(f'WITH {COLUMNS} SELECT t AS "table", round(avg(CAST(n AS INT)) * 100, 1) AS nullable_pct FROM cols GROUP BY t')
def nullable_share(spark, d):
    return assets.nullable_share(_catalog(spark, d)[0])


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, round(min(value), 6) AS low FROM events GROUP BY ALL HAVING min(value) > 20")
def alert_windows(spark, d):
    e = W.table(spark, d, "events").select("ts", "value")
    return assets.persistent_alerts(e, 20, "30 minutes").select("start", _r("low"))


@query("WITH s AS (SELECT date_trunc('day', ts) AS day, avg(value) AS value FROM events GROUP BY ALL) SELECT CAST(a.day AS DATE) AS day, round(avg(b.value), 6) AS avg_over, round(quantile_cont(b.value, 0.95), 6) AS p95_over FROM s a JOIN s b ON b.day BETWEEN a.day - INTERVAL 6 DAY AND a.day GROUP BY a.day")
def baseline(spark, d):
    days = W.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return assets.baseline(days).select("day", _r("avg_over"), _r("p95_over"))


@query("SELECT l_partkey, round(sum(l_extendedprice), 1) AS total, count(*) AS calls, round(sum(l_extendedprice) / nullif(count(*), 0), 1) AS mean FROM lineitem GROUP BY l_partkey ORDER BY round(sum(l_extendedprice), 1) DESC, l_partkey LIMIT 10")
def top_slow(spark, d):
    own = W.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 1).alias("t"), F.count("*").alias("c"))
    return assets.top_slow(own.select("l_partkey", "t", "c"), F.col("t"), F.col("c")).select("l_partkey", "total", "calls", _r("mean", digits=1))


@query("SELECT (SELECT count(*) FROM events) AS used, (SELECT count(*) FROM orders) AS most, round((SELECT count(*) FROM events) / nullif((SELECT count(*) FROM orders), 0), 4) AS ratio")
def utilisation(spark, d):
    used = W.table(spark, d, "events").agg(F.count("*").alias("used")).withColumn("one", F.lit(1))
    most = W.table(spark, d, "orders").agg(F.count("*").alias("most")).withColumn("one", F.lit(1))
    return used.join(most, "one").select("used", "most", F.round(F.try_divide("used", "most"), 4).alias("ratio"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def source_counts(spark, d):
    return W.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(epoch_us(lead(ts) OVER w) - epoch_us(ts) <= 3600000000, false) AS requeried FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def requery_60s(spark, d):
    return streams.requeried(W.table(spark, d, "events"), 3600).select("event_id", "requeried")


# --- logs and streams -------------------------------------------------------------------------

EV = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, d, streaming: bool = False) -> DataFrame:
    rows = W.stream(spark, d, "events", EV) if streaming else W.table(spark, d, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there and gives what it wrote to the shared folder."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    write = "overwrite" if mode == "complete" else "append"
    done = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    done.foreachBatch(lambda rows, _: rows.write.mode(write).parquet(out)).start().awaitTermination()
    remove_path(spark, f"{out}-state")  # all there is has been read
    return spark.read.parquet(out)


@query("SELECT s.event_id AS serving_id, r.event_id AS reward_id, r.value FROM events s JOIN events r ON s.user_id = r.user_id AND s.event_type = 'view' AND r.event_type = 'purchase' AND r.ts BETWEEN s.ts AND s.ts + INTERVAL 1 HOUR")
def serving_reward_join(spark, d):
    e = _events(spark, d)
    serving = e.filter("event_type = 'view'").select(F.col("user_id").alias("episode_id"), "ts", F.col("event_id").alias("serving_id"))
    rewards = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("episode_id"), "ts", F.struct("event_id", "value").alias("value"))
    return streams.reward_join(serving, rewards).select("serving_id", F.col("value.event_id").alias("reward_id"), F.col("value.value").alias("value"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumble(spark, d):
    out = _drain(streams.windowed(_events(spark, d, True)), "tumble", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", _r("total", digits=4))


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start, event_type, value FROM events) GROUP BY ALL")
def stream_slide(spark, d):
    out = _drain(streams.windowed(_events(spark, d, True), "2 hours", "1 hour"), "slide", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", _r("total", digits=4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    out = _drain(streams.sessions(_events(spark, d, True)), "session", "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedupe(spark, d):
    e = _events(spark, d, True)
    return _drain(streams.deduplicated(e.union(e), "40 days"), "dedupe", "append").select("event_id", "user_id")


@query("SELECT s.event_id AS serving_id, r.value FROM events s JOIN events r ON s.user_id = r.user_id AND s.event_type = 'view' AND r.event_type = 'purchase' AND r.ts BETWEEN s.ts AND s.ts + INTERVAL 1 HOUR")
def stream_join(spark, d):
    serving = _events(spark, d, True).filter("event_type = 'view'").select(F.col("user_id").alias("episode_id"), "ts", F.col("event_id").alias("serving_id"))
    rewards = _events(spark, d, True).filter("event_type = 'purchase'").select(F.col("user_id").alias("episode_id"), "ts", "value")
    return _drain(streams.reward_join(serving, rewards), "join", "append").select("serving_id", "value")


@query()
def session_state(spark, d):
    e = _events(spark, d, True)
    action = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "logout", "abort").otherwise("step")
    rows = e.select(F.col("user_id").alias("session_id"), "ts", action.alias("action"), (F.col("event_id") % 7).cast("int").alias("step_order"), F.col("event_type").alias("output"))
    return _drain(streams.step_sessions(rows), "state", "update")


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_export_roundtrip(spark, d):
    path = shared_path(spark, "spool")
    logs.emit(_events(spark, d).select("event_id", "ts", "event_type", "props"), path)
    back = logs.read_spool(spark, path, "event_id long, event_type string, props string")
    return back.select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 = 0")
def log_append(spark, d):
    path, own = shared_path(spark, "log"), W.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    logs.append(own, path)
    logs.append(own.filter("doc_id % 2 = 0"), path)
    return spark.read.parquet(path)


@query("SELECT conv_id, array_to_string(list(turn ORDER BY turn)[1:10], ',') AS candidates FROM conversations GROUP BY conv_id")
def serving_log(spark, d):
    served = W.messages(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("candidates"))
    return logs.serving_rows(served).select("conv_id", F.array_join("candidates", ",").alias("candidates"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice > 0 AS ok FROM orders WHERE o_totalprice > 0 AND o_orderstatus IN ('F', 'O')")
def guard_checks(spark, d):
    good, _ = logs.check_constraints(W.table(spark, d, "orders"), price=F.col("o_totalprice") > 0, status=F.col("o_orderstatus").isin("F", "O"))
    return good.select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") > 0).alias("ok"))


# --- mutations --------------------------------------------------------------------------------


_PROMOTE = f"""WITH {ST}, c AS (SELECT 'tag' || (skill_id % 50) AS tag, id, skill_id FROM steps), f AS (SELECT tag, list(id ORDER BY skill_id, id) AS ids, list_sort(list(DISTINCT p_brand)) AS domain FROM c JOIN part ON p_partkey = id GROUP BY tag)
SELECT tag, CASE WHEN CAST(substr(tag, 4) AS INT) % 2 = 0 THEN 4 ELSE 1 END AS version, array_to_string(ids, ',') AS steps, array_to_string(domain, ',') AS domain, substr(sha256(array_to_string(ids, ',')), 1, 16) AS content_hash FROM f"""


def _promote(spark: SparkSession, d: str, steps: DataFrame) -> DataFrame:
    part = W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("domain"))
    chain = steps.select(F.concat(F.lit("tag"), F.col("skill_id") % 50).alias("tag"), F.struct("skill_id", "id").alias("ord"), "id").join(part.select("id"), "id", "left_semi")
    versions = spark.range(50).filter("id % 2 = 0").select(F.concat(F.lit("tag"), F.col("id")).alias("tag"), F.lit(3).alias("version"))
    out = lifecycle.promote(chain, part, versions)
    return out.select("tag", "version", F.col("steps_text").alias("steps"), F.array_join("domain", ",").alias("domain"), "content_hash")


@query(_PROMOTE)
def promote_chain(spark, d):
    return _promote(spark, d, W.steps(spark, d))


@query(f"WITH {ST}, a AS (SELECT skill_id, list(id ORDER BY id) AS s FROM steps GROUP BY skill_id) SELECT skill_id, array_to_string(list_concat(list_concat(s[1:1], [0]), s[2:]), ',') AS added, array_to_string(s[2:], ',') AS removed FROM a")
def edit_steps(spark, d):
    own = W.steps(spark, d).groupBy("skill_id").agg(F.array_sort(F.collect_list("id")).alias("s"))
    return own.select("skill_id", F.array_join(lifecycle.insert_step(F.col("s"), F.lit(0).cast("bigint"), 2), ",").alias("added"), F.array_join(lifecycle.remove_step(F.col("s"), 1), ",").alias("removed"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, substr(sha256(CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END), 1, 16) AS content_hash FROM customer")
def partial_update(spark, d):
    rows = W.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")).withColumn("content_hash", X.content_hash("name"))
    changes = rows.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("name")).unionByName(rows.filter("c_custkey % 3 = 1").select("c_custkey", F.lit(None).cast("string").alias("name")))
    return search_vectors.update_rows(rows, changes, None, {"name": "A"}, "name", key="c_custkey")


@query(f"WITH {P} SELECT id, 'inactive' AS status FROM prompts WHERE status = 'active' AND id NOT IN (SELECT doc_id FROM labels)")
def inactivate_stale(spark, d):
    used = W.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return W.prompts(spark, d).filter("status = 'active'").join(used, "id", "left_anti").select("id", F.lit("inactive").alias("status"))


@query("SELECT len(embedding) AS width, count(*) AS n, CASE WHEN len(embedding) = 64 THEN 'ok' ELSE 'resize' END AS action FROM embeddings GROUP BY ALL")
def width_audit(spark, d):
    width = F.size("embedding")
    return W.table(spark, d, "embeddings").groupBy(width.alias("width")).agg(F.count("*").alias("n")).withColumn("action", F.when(F.col("width") == 64, "ok").otherwise("resize"))


@query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0")
def set_ops(spark, d):
    c = W.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = W.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.union(o).distinct().subtract(c.filter("k % 7 = 0"))


@query("SELECT doc_id, quality, toxic, CASE WHEN promoted THEN 'improved' WHEN n = 0 THEN 'no examples' WHEN gain < 0.05 THEN 'below margin' ELSE 'fences changed' END AS reason, promoted FROM (SELECT *, doc_id % 3 AS n, round((doc_id % 11) / 100, 9) AS gain, doc_id % 3 > 0 AND round((doc_id % 11) / 100, 9) >= 0.05 AND quality = 1 AS promoted FROM labels)")
def ab_gate(spark, d):
    rows = W.table(spark, d, "labels")
    g = rules.ab_gate(F.lit(0.0), F.round((F.col("doc_id") % 11) / 100, 9), F.col("doc_id") % 3, F.col("quality") == 1)
    return rows.select("doc_id", "quality", "toxic", g["reason"].alias("reason"), g["promoted"].alias("promoted"))


@query("SELECT doc_id, CASE WHEN doc_id % 20 < 5 THEN 'too few examples' WHEN (doc_id % 7) / (doc_id % 20) < 0.2 THEN 'too few external examples' WHEN (doc_id % 7) / (doc_id % 20) < 0.3 THEN 'warn' ELSE 'ok' END AS state FROM labels")
def run_report(spark, d):
    return W.table(spark, d, "labels").select("doc_id", rules.run_allowed(F.col("doc_id") % 20, F.col("doc_id") % 7).alias("state"))


# --- chains and upkeep ------------------------------------------------------------------------


@query("SELECT value, round(n / total, 6) AS share FROM (SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang), (SELECT count(*) AS total FROM documents) WHERE n / total > 0.4")
def taxonomy_skew(spark, d):
    return chains.taxonomy_skew(W.prompts(spark, d), "domain").select("value", _r("share"))


@query("SELECT query_id, stage, id, round(score, 4) AS score, n - 1 AS alternatives FROM (SELECT *, row_number() OVER (PARTITION BY query_id, stage ORDER BY score DESC, id) AS k, count(*) OVER (PARTITION BY query_id, stage) AS n FROM (SELECT p_size % 5 AS query_id, p_brand AS stage, p_partkey AS id, p_retailprice / 5 - 201 AS score FROM part)) WHERE k = 1 AND score > -3")
def stage_chain(spark, d):
    rows = W.table(spark, d, "part").select((F.col("p_size") % 5).alias("query_id"), F.col("p_brand").alias("stage"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 5 - 201).alias("score"))
    return chains.stage_best(rows).select("query_id", "stage", "id", _r("score", digits=4), "alternatives")


@query()
def beam_chains(spark, d):
    scored = W.table(spark, d, "part").select((F.col("p_size") % 5).alias("query_id"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2000).alias("score"))
    steps = W.steps(spark, d)
    pairs = steps.select("skill_id", F.col("id").alias("prev")).join(steps, "skill_id").filter("prev < id").groupBy("prev", "id").agg((F.count("*") / 10).alias("fit"))
    return chains.beam_search(scored, pairs)


_PAIRS = f"WITH {ST}, c AS (SELECT a.id AS prev, b.id AS id, count(*) AS n FROM steps a JOIN steps b ON a.skill_id = b.skill_id AND a.id < b.id GROUP BY ALL)"


def _cached_pairs(spark, d) -> DataFrame:
    """The pair cache after three days of new skills, the second of which is run twice."""
    steps, path = W.steps(spark, d), shared_path(spark, "pairs")
    for day in (0, 1, 1, 2):
        chains.add_day(steps.filter(F.col("skill_id") % 3 == day), path, day)
    held = settled(refresh.current(spark, path))
    remove_path(spark, path)
    return held


@query(f"{_PAIRS} SELECT prev, id, round(n / max(n) OVER (PARTITION BY prev), 6) AS fit FROM c QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, id) <= 5")
def pair_cache(spark, d):
    return chains.successors(_cached_pairs(spark, d), 5).select("prev", "id", _r("fit"))


@query()
def cached_chains(spark, d):
    scored = W.table(spark, d, "part").select((F.col("p_size") % 5).alias("query_id"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2000).alias("score"))
    return chains.beam_search(scored, settled(chains.successors(_cached_pairs(spark, d))))


@query("SELECT e.event_id, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) <= 60000000, false) AS requeried, o.o_custkey IS NOT NULL AS used, levenshtein(event_type, o_orderstatus) AS edit_distance FROM events e LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey) o ON o_custkey = user_id")
def serving_outcome(spark, d):
    e = W.table(spark, d, "events").select(F.col("user_id").alias("episode_id"), "ts", F.col("event_type").alias("text"), "event_id")
    used = W.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("episode_id")).agg(F.min("o_orderstatus").alias("final_text"))
    out = chains.serving_outcome(e, used, e.select("episode_id", F.lit(1.0).alias("value")))
    return out.select("event_id", "requeried", "used", "edit_distance")


_FILL = "SELECT doc_id, 'Plan [ITEM NAME] ' || left(text, 200) AS a, CASE doc_id % 5 WHEN 0 THEN 'Plan the launch ' || left(text, 200) WHEN 1 THEN 'Plan [ITEM NAME] ' || left(text, 200) WHEN 2 THEN left(text, 40) WHEN 3 THEN ' ' ELSE 'Plan it ' || left(text, 200) || chr(10) || '```' || chr(10) || 'x' || chr(10) || '```' END AS b FROM documents"
_FENCED_PARTS = "regexp_extract_all({0}, '(?ms)^```.*?\\n.*?\\n```[ \\t]*$')"


@query(f"SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(b, '[ITEM NAME]') THEN 'slots left' END, CASE WHEN {_FENCED_PARTS.format('a')} <> {_FENCED_PARTS.format('b')} THEN 'fences changed' END, CASE WHEN abs(length(b) - length(a)) > 0.4 * length(a) THEN 'length' END, CASE WHEN trim(b, ' ') = '' THEN 'empty' END], lambda x: x IS NOT NULL), ',') AS problems FROM ({_FILL})")
def fill_check(spark, d):
    n, cut = F.col("doc_id") % 5, F.left("text", F.lit(200))
    filled = F.when(n == 0, F.concat(F.lit("Plan the launch "), cut)).when(n == 1, F.concat(F.lit("Plan [ITEM NAME] "), cut)).when(n == 2, F.left("text", F.lit(40))).when(n == 3, " ").otherwise(F.concat(F.lit("Plan it "), cut, F.lit("\n```\nx\n```")))
    rows = W.table(spark, d, "documents").select("doc_id", F.concat(F.lit("Plan [ITEM NAME] "), cut).alias("template"), filled.alias("filled"))
    return rows.select("doc_id", F.array_join(chains.fill_problems("template", "filled"), ",").alias("problems"))


@query()
def kmeans_labels(spark, d):
    v = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return chains.cluster_labels(v.select("id", "embedding"), v.filter("id % 10 = 0").select("id", "label"))


@query()
def chunk_backfill(spark, d):
    return maintenance.backfill_chunks(W.prompts(spark, d), "hash-64").select("id", "chunk_index", "label", "is_atomic", "embedding", "embedding_version")


@query()
def embed_missing(spark, d):
    p = W.prompts(spark, d).select("id", "title", "prompt_text", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_version"))
    return maintenance.embed_missing(p, "hash-64").select("id", "embedding", "embedding_version")


def _chunk_vectors(p: DataFrame) -> DataFrame:
    """id, chunk_id, embedding: a vector for each chunk of the whole text."""
    from ..functions import plugins

    cut = chunking.chunks(p, "id", "prompt_text")
    return cut.select("id", (F.col("id") * 1_000_000 + F.col("chunk_index")).alias("chunk_id"), plugins.embed(64)("chunk_text").alias("embedding"))


@query()
def engine_find(spark, d):
    from ..functions import plugins
    from .engine import Engine

    p = W.prompts(spark, d)
    engine = Engine(p, _chunk_vectors(p), embedder=plugins.embed(64))
    return engine.find(W.word_queries(spark, d))
