"""Queries over text functions, rule engines, chunking and markdown sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import plugins, vocabulary
from ..functions import text as X
from ..operators import chunking, fusion, rerank, retrieval, rules
from ..sources import markdown
from . import views as W
from .registry import ORACLE_SQL, query
from .retrieval_queries import _BAG


#: Documents as templates: acronyms, slots of each kind, a black-listed one in every third.
TEMPLATES = "SELECT doc_id AS id, 'GTM plan: [' || upper(source) || '] or [PRICE/COST] in {{lang}}, AI/ML and ML. [paste notes]' || CASE WHEN doc_id % 3 = 0 THEN ' [YOUR] {{lang}} ' ELSE ' ' END || text AS text FROM documents"
PLAIN = "SELECT doc_id AS id, text FROM documents"


def _templates(spark: SparkSession, d: str) -> DataFrame:
    docs = W.table(spark, d, "documents")
    head = F.concat(F.lit("GTM plan: ["), F.upper("source"), F.lit("] or [PRICE/COST] in {{lang}}, AI/ML and ML. [paste notes]"), F.when(F.col("doc_id") % 3 == 0, " [YOUR] {{lang}} ").otherwise(" "))
    return docs.select(F.col("doc_id").alias("id"), F.concat(head, F.col("text")).alias("text"))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return W.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


def _once(items: str) -> str:
    """SQL: a list with each value at its first place."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def over_templates(sql: str):
    """Registers fn over the templates, and as NAME_all over the documents as they are. ``sql`` reads t(id, text)."""

    def register(fn):
        def every(spark: SparkSession, d: str) -> DataFrame:
            return fn(spark, d, _plain(spark, d)).withColumnRenamed("id", "doc_id")

        every.__name__ = f"{fn.__name__}_all"
        query(f"WITH t AS ({PLAIN}) SELECT id AS doc_id, * EXCLUDE (id) FROM ({sql})")(every)
        return query(f"WITH t AS ({TEMPLATES}) {sql}")(lambda spark, d: fn(spark, d, _templates(spark, d)), fn.__name__)

    return register


_PATTERN = "\\b(?:" + "|".join(re.sub(r"([^\w])", r"\\\1", x) for x in sorted(vocabulary.ACRONYMS, key=len, reverse=True)) + ")\\b"
_NAMES = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in vocabulary.ACRONYMS.items()) + "}"


@over_templates(f"SELECT id, array_to_string(list_transform(list_zip(string_split_regex(text, {_quoted(_PATTERN)}), regexp_extract_all(text, {_quoted(_PATTERN)})), lambda x: x[1] || coalesce(x[2] || ' (' || {_NAMES}[x[2]] || ')', '')), '') AS text FROM t")
def acronyms(spark, d, rows):
    return rows.select("id", X.expand_acronyms("text").alias("text"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_mktsegment || ' & ' || c_name || '#')), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g') AS slug FROM customer")
def slugs(spark, d):
    name = F.concat("c_mktsegment", F.lit(" & "), "c_name", F.lit("#"))
    return W.table(spark, d, "customer").select("c_custkey", X.slugify(name).alias("slug"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash, trim(regexp_replace(lower(left(text, 200)), '\\s+', ' ', 'g')) AS norm, left(text, 4000) AS embed, left(text, 100) AS preview FROM documents")
def truncate(spark, d):
    return W.table(spark, d, "documents").select("doc_id", X.content_hash("text").alias("hash"), X.normalize(F.left("text", F.lit(200))).alias("norm"), F.left("text", F.lit(4000)).alias("embed"), F.left("text", F.lit(100)).alias("preview"))


_REAL = f"lambda n: length(n) >= 2 AND NOT list_contains({_list(vocabulary.SLOT_BLACKLIST)}, trim(n))"


def _kind(pattern: str, mustache: bool = False) -> str:
    what = "'fill'" if mustache else f"CASE WHEN regexp_matches(lower(n), '{'|'.join(vocabulary.PASTE_WORDS)}') THEN 'paste' WHEN regexp_matches(n, '[/|]') THEN 'choice' ELSE 'fill' END"
    return f"list_transform(list_filter(regexp_extract_all(text, {_quoted(pattern)}, 1), {_REAL}), lambda n: n || ':' || {what})"


SLOTS_SQL = f"list_concat({_kind(r'[[]([A-Z][A-Z0-9 /_&' + chr(39) + r'\",.()-]+)[]]')}, {_kind(r'(?i)[[](paste[_ ][a-zA-Z0-9_ ]+)[]]')}, {_kind(r'[{][{]([a-zA-Z0-9_]+)[}][}]', True)})"


@over_templates(f"SELECT id, array_to_string({_once('s')}, ',') AS slots FROM (SELECT id, {SLOTS_SQL} AS s FROM t)")
def slots(spark, d, rows):
    one = lambda s: F.concat(s["name"], F.lit(":"), s["slot_type"])
    return rows.select("id", F.array_join(F.transform(X.slots("text"), one), ",").alias("slots"))


#: What slot_fill's context fills: {{lang}} by its name, [PRICE/COST] by a key inside it; an empty value fills nothing.
FILLED = "replace(replace(text, '{{lang}}', 'EU'), '[PRICE/COST]', '5')"
OPEN = f"list_filter({_once('s')}, lambda x: x NOT IN ('lang:fill', 'PRICE/COST:choice'))"


def _filled(rows: DataFrame) -> DataFrame:
    context = F.create_map(F.lit("Lang"), F.lit("EU"), F.lit("cost"), F.lit("5"), F.lit("paste_notes"), F.lit(""))
    return rows.select("id", X.fill_slots("text", context).alias("f"))


@over_templates(f"SELECT id, {FILLED} AS text, array_to_string(list_transform({OPEN}, lambda x: string_split(x, ':')[1]), ',') AS unfilled FROM (SELECT id, text, {SLOTS_SQL} AS s FROM t)")
def slot_fill(spark, d, rows):
    return _filled(rows).select("id", F.col("f.text").alias("text"), F.array_join("f.unfilled", ",").alias("unfilled"))


@query(f"WITH t AS ({TEMPLATES}) SELECT id, {FILLED} AS prompt_text, len({OPEN}) > 0 AS needs_context FROM (SELECT id, text, {SLOTS_SQL} AS s FROM t)")
def route_response(spark, d):
    return _filled(_templates(spark, d)).select("id", F.col("f.text").alias("prompt_text"), (F.size("f.unfilled") > 0).alias("needs_context"))


_MARK = "regexp_extract_all(text, '[[][^]\n[]{1,120}[]]')"


@over_templates(f"SELECT id, array_to_string({_once(_MARK)}, ',') AS found FROM t")
def placeholders(spark, d, rows):
    return rows.select("id", F.array_join(X.placeholders("text"), ",").alias("found"))


def _words_sql(column: str) -> str:
    return f"len(list_filter(string_split_regex({column}, '\\s+'), lambda w: w <> ''))"


def _density_sql(column: str) -> str:
    return f"CASE WHEN {_words_sql(column)} = 0 THEN 0.0 ELSE len(regexp_extract_all({column}, {_quoted(vocabulary.SPEC_TOKEN)})) / {_words_sql(column)} END"


@over_templates(f"SELECT id, round({_density_sql('text')}, 6) AS density, {_words_sql('text')} AS words FROM t")
def density(spark, d, rows):
    return rows.select("id", F.round(X.spec_density("text"), 6).alias("density"), X.word_count("text").alias("words"))


PREVIOUS = "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations"
CONTENT = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z]{{3,}}')), lambda w: NOT list_contains([" + ",".join(f"'{w}'" for w in vocabulary.OVERLAP_STOPWORDS) + "], w))"
JACCARD = f"SELECT conv_id, turn, len(list_intersect(a, b)) AS shared, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0) AS j FROM (SELECT conv_id, turn, {CONTENT.format('text')} AS a, {CONTENT.format('prev')} AS b FROM ({PREVIOUS}))"


def _previous(spark, d) -> DataFrame:
    return W.messages(spark, d).withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))


@query(f"SELECT conv_id, turn, round(j, 6) AS jaccard, shared >= 2 AND j >= 0.4 AS overlaps FROM ({JACCARD})")
def jaccard(spark, d):
    return _previous(spark, d).select("conv_id", "turn", F.round(X.jaccard("text", "prev"), 6).alias("jaccard"), X.situation_overlaps("text", "prev").alias("overlaps"))


_BARE = "regexp_replace(lower(trim(text)), '[!?.,]+$', '')"
_VERB = f"len(list_intersect(regexp_extract_all(lower(text), '[a-z]+'), {_list(vocabulary.WORKFLOW_VERBS)})) > 0"
_FIRST_LOOK = f"CASE WHEN regexp_matches(trim(text), {_quoted(vocabulary.GREETING)}) THEN 'casual greeting' WHEN {_BARE} IN ({', '.join(map(_quoted, vocabulary.FOLLOWUPS))}) THEN 'conversational followup' WHEN {_words_sql('text')} < 5 AND NOT {_VERB} THEN 'too brief, no action signal' END"


def _short(spark, d) -> DataFrame:
    """Messages cut to their first words, some of them greetings and follow-ups, so that each rule of the gate has rows."""
    n, cut = F.col("conv_id") * 7 + F.col("turn"), F.expr("substring_index(text, ' ', CAST((conv_id + turn) % 9 + 1 AS INT))")
    said = F.when(n % 11 == 0, "hello there friend").when(n % 11 == 1, "Sounds good!").when(n % 11 == 2, F.concat(F.lit("please fix "), cut)).otherwise(cut)
    return W.messages(spark, d).select("conv_id", "turn", said.alias("text"))


SHORT = "SELECT conv_id, turn, CASE (conv_id * 7 + turn) % 11 WHEN 0 THEN 'hello there friend' WHEN 1 THEN 'Sounds good!' WHEN 2 THEN 'please fix ' || cut ELSE cut END AS text FROM (SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:(conv_id + turn) % 9 + 1], ' ') AS cut FROM conversations)"


@query(f"SELECT conv_id, turn, {_FIRST_LOOK} AS reason FROM ({SHORT})")
def gate_rules(spark, d):
    return _short(spark, d).select("conv_id", "turn", rules.heuristic_gate("text")["reason"].alias("reason"))


@query(f"SELECT conv_id, turn, {_FIRST_LOOK} AS reason FROM conversations")
def gate_rules_all(spark, d):
    return W.messages(spark, d).select("conv_id", "turn", rules.heuristic_gate("text")["reason"].alias("reason"))


def _band_sql(sim: str, words: str, density: str, threshold: str) -> str:
    """SQL for the struct (search, confidence, reason) of the band."""
    low, high = vocabulary.GATE_WORDS
    two = lambda x: f"printf('%.2f', CAST({x} AS DOUBLE))"
    fails = f"""list_filter([CASE WHEN {sim} < {threshold} THEN 'no semantic match (sim=' || {two(sim)} || '<' || {two(threshold)} || ')' END, CASE WHEN {words} < {low} THEN 'too simple (' || {words} || 'w<{low})' END, CASE WHEN {words} > {high} THEN 'too long (' || {words} || 'w>{high})' END,
    CASE WHEN {density} > {vocabulary.GATE_DENSITY} THEN 'already specified (density=' || {two(density)} || '>{vocabulary.GATE_DENSITY:.2f})' END], lambda x: x IS NOT NULL)"""
    opens = f"len({fails}) = 0"
    return f"{{'search': {opens}, 'confidence': round(CASE WHEN {opens} THEN {sim} ELSE 1 - {sim} END, 3), 'reason': CASE WHEN {opens} THEN 'semantic match (sim=' || {two(sim)} || '), in complexity band' ELSE array_to_string({fails}, '; ') END}}"


@query(f"SELECT id, g.search AS search, g.confidence AS confidence, g.reason AS reason FROM (SELECT doc_id AS id, {_band_sql('sim', 'words', 'dens', '0.58::DOUBLE')} AS g FROM (SELECT doc_id, (doc_id % 100) / 100 AS sim, doc_id % 75 AS words, (doc_id % 17) / 100 AS dens FROM documents))")
def gate_band(spark, d):
    n = F.col("doc_id")
    gate = rules.band_gate((n % 100) / 100, (n % 75).cast("int"), (n % 17) / 100)
    return W.table(spark, d, "documents").select(n.alias("id"), gate.alias("g")).select("id", "g.search", "g.confidence", "g.reason")


@query(f"SELECT conv_id, turn, (turn % 5) / 4 > 0.75 AND (conv_id % 10) / 10 > 0.7 AND shared >= 2 AND j >= 0.4 AS covered FROM (SELECT * FROM ({JACCARD}))")
def gate_cached(spark, d):
    cached = F.array(F.struct(F.col("prev").alias("situation"), ((F.col("turn") % 5) / 4).alias("relevance"), ((F.col("conv_id") % 10) / 10).alias("score")))
    return _previous(spark, d).select("conv_id", "turn", rules.cached_gate("text", cached).alias("covered"))


_SIM = "CASE WHEN turn % 13 = 0 THEN NULL ELSE ((conv_id * 7 + turn * 3) % 100) / 100 END"
_EASED = "0.58::DOUBLE - CASE WHEN turn % 2 = 0 THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN conv_id % 10 >= 6 THEN 0.03::DOUBLE ELSE 0 END"


def _full_sql(source: str) -> str:
    return f"""SELECT conv_id, turn, CASE WHEN look IS NOT NULL OR sim IS NULL THEN false ELSE g.search END AS search, CASE WHEN look IS NOT NULL THEN look WHEN sim IS NULL THEN 'similarity unavailable' ELSE g.reason END AS reason
FROM (SELECT *, {_FIRST_LOOK} AS look, {_band_sql('sim', 'words', 'dens', 'eased')} AS g FROM (SELECT *, {_SIM} AS sim, {_EASED} AS eased, {_words_sql('text')} AS words, {_density_sql('text')} AS dens FROM {source}))"""


def _full_gate(messages: DataFrame) -> DataFrame:
    n, turn = F.col("conv_id"), F.col("turn")
    sim = F.when(turn % 13 != 0, ((n * 7 + turn * 3) % 100) / 100)
    none = F.array(F.struct(F.lit("x").alias("situation"), F.lit(0.0).alias("relevance"), F.lit(0.0).alias("score")))
    gate = rules.full_gate("text", sim, F.lit(False), turn % 2 == 0, (n % 10) / 10, none)
    return messages.select("conv_id", "turn", gate.alias("g")).select("conv_id", "turn", "g.search", "g.reason")


@query(_full_sql(f"({SHORT})"))
def gate_full(spark, d):
    return _full_gate(_short(spark, d))


@query(_full_sql("conversations"))
def gate_full_all(spark, d):
    return _full_gate(W.messages(spark, d))


def _scores_sql(table: dict[str, list[str]]) -> str:
    rows = ", ".join(f"({i}, '{n}', {' + '.join(f'''CAST(contains(low, '{w}') AS INT)''' for w in ws)})" for i, (n, ws) in enumerate(table.items()))
    return f"SELECT doc_id, i, name, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS n FROM (SELECT doc_id, lower(text) AS low FROM documents) d, LATERAL (SELECT * FROM (VALUES {rows}) t(i, name, s)) WHERE s > 0"


@query(f"WITH s AS ({_scores_sql(vocabulary.DOMAIN_KEYWORDS)}), f AS (SELECT a.doc_id, a.name || CASE WHEN b.s >= a.s * 0.7 THEN ',' || b.name ELSE '' END AS domain FROM s a LEFT JOIN s b ON b.doc_id = a.doc_id AND b.n = 2 WHERE a.n = 1) SELECT doc_id, coalesce(domain, 'technical') AS domain FROM documents LEFT JOIN f USING (doc_id)")
def infer_domain(spark, d):
    return W.table(spark, d, "documents").select("doc_id", F.array_join(rules.infer_domain("text"), ",").alias("domain"))


@query(f"WITH s AS ({_scores_sql(vocabulary.INTENT_KEYWORDS)}), f AS (SELECT doc_id, string_agg(name, ',' ORDER BY n) AS intent FROM s WHERE n <= 2 GROUP BY doc_id) SELECT doc_id, coalesce(intent, 'build') AS intent FROM documents LEFT JOIN f USING (doc_id)")
def infer_intent(spark, d):
    return W.table(spark, d, "documents").select("doc_id", F.array_join(rules.infer_intent("text"), ",").alias("intent"))


@query(f"SELECT doc_id, domain, intent FROM ({ORACLE_SQL['infer_domain']}) JOIN ({ORACLE_SQL['infer_intent']}) USING (doc_id)")
def classify_plugin(spark, d):
    return W.table(spark, d, "documents").select("doc_id", F.array_join(rules.infer_domain("text"), ",").alias("domain"), F.array_join(rules.infer_intent("text"), ",").alias("intent"))


@query("SELECT doc_id, lang || ',AI' AS hints FROM documents WHERE lang <> 'AI'")
def merge_hints(spark, d):
    docs = W.table(spark, d, "documents").withColumns({"a": F.array("lang", F.lit("AI")), "b": F.array(F.lit("AI"), "lang"), "c": F.lit(None).cast("array<string>")})
    return docs.select("doc_id", F.array_join(fusion.merge_hints("a", "c", "b"), ",").alias("hints"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'finance,AI' ELSE 'finance' END AS domain, CASE WHEN toxic = 1 THEN 'build,debug' ELSE 'debug' END AS intent FROM labels")
def repair_taxonomy(spark, d):
    rows = W.table(spark, d, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.array(F.lit("finance"), F.lit("debug"), F.lit("nonsense"))).otherwise(F.array(F.lit("finance"))).alias("domain"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 1), F.array(F.lit("build"), F.lit("AI"))).when(F.col("quality") == 1, F.array(F.lit("debug"), F.lit("AI"))).when(F.col("toxic") == 1, F.array(F.lit("build"))).otherwise(F.array(F.lit("debug"))).alias("intent"),
    )
    out = rules.repair_taxonomy(rows, {"domain": vocabulary.DOMAINS, "intent": list(vocabulary.INTENT_KEYWORDS)})
    return out.select("doc_id", F.array_join("domain", ",").alias("domain"), F.array_join("intent", ",").alias("intent"))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'classified' ELSE 'low_confidence' END AS status FROM labels")
def backfill_status(spark, d):
    conf = F.create_map(F.lit("q"), F.when(F.col("quality") == 1, 0.9).otherwise(0.5), F.lit("t"), F.when(F.col("toxic") == 0, 0.8).otherwise(0.1))
    return W.table(spark, d, "labels").select("doc_id", rules.backfill_status(conf).alias("status"))


_ASKED = "CASE (conv_id + turn) % 4 WHEN 0 THEN 'generate a bright product image: ' WHEN 1 THEN 'Video editing tips ' WHEN 2 THEN 'edit the ' ELSE '' END || text"


def _image_filter(rows: DataFrame) -> DataFrame:
    titles = F.array(F.lit("image gen basics"), F.lit("plan"))
    kept = F.filter(titles, lambda t: X.wants_image("text") | ~F.lower(t).startswith(vocabulary.IMAGE_TITLE))
    return rows.select("conv_id", "turn", X.wants_image("text").alias("wants"), F.array_join(kept, "|").alias("kept"))


def _image_sql(text: str) -> str:
    return f"SELECT conv_id, turn, wants, CASE WHEN wants THEN 'image gen basics|plan' ELSE 'plan' END AS kept FROM (SELECT conv_id, turn, regexp_matches({text}, {_quoted(vocabulary.IMAGE_QUERY)}) AS wants FROM conversations)"


@query(_image_sql(_ASKED))
def image_filter(spark, d):
    n = (F.col("conv_id") + F.col("turn")) % 4
    return _image_filter(W.messages(spark, d).withColumn("text", F.concat(F.when(n == 0, "generate a bright product image: ").when(n == 1, "Video editing tips ").when(n == 2, "edit the ").otherwise(""), F.col("text"))))


@query(_image_sql("text"))
def image_filter_all(spark, d):
    return _image_filter(W.messages(spark, d))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN '1970-01-01 ' || strftime(ts, '%H:%M:%S') END AS ts,
CASE WHEN event_id % 5 IN (0, 2) THEN event_type ELSE 'unknown' END AS source, CASE event_id % 5 WHEN 4 THEN 'no time at all' WHEN 3 THEN strftime(ts, '%b %d %H:%M:%S') || ' down' ELSE 'user ' || user_id || ' came' END AS message FROM events""")
def parse_ts(spark, d):
    from ..operators.assets import parse_log

    n, at = F.col("event_id") % 5, lambda f: F.date_format("ts", f)
    message = F.concat(F.lit("user "), "user_id", F.lit(" came"))
    raw = (
        F.when(n == 0, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit(" ["), "event_type", F.lit("] "), message))
        .when(n == 1, F.concat(at("yyyy/MM/dd HH:mm:ss"), F.lit(" "), message))
        .when(n == 2, F.concat(F.lit("["), at("HH:mm:ss"), F.lit("] ["), "event_type", F.lit("] "), message))
        .when(n == 3, F.concat(at("MMM dd HH:mm:ss"), F.lit(" down")))
        .otherwise("no time at all")
    )
    out = parse_log(W.table(spark, d, "events").select("event_id", raw.alias("raw")))
    return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "source", "message")


_SHOWN = "CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice * 100 WHEN 2 THEN o_totalprice / 1000 ELSE 0 END"


@query(f"SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs(v) >= 1e6 THEN printf('%.2fM', abs(v) / 1e6) WHEN abs(v) >= 1e3 THEN printf('%.1fK', abs(v) / 1e3) ELSE format('{{:,}}', CAST(round(abs(v)) AS BIGINT)) END AS shown FROM (SELECT o_orderkey, round({_SHOWN}, 1) + 0.07 AS v FROM orders)")
def format_num(spark, d):
    n, price = F.col("o_orderkey") % 4, F.col("o_totalprice")
    v = F.when(n == 0, price).when(n == 1, -price * 100).when(n == 2, price / 1000).otherwise(0.0)
    return W.table(spark, d, "orders").select("o_orderkey", (F.round(v, 1) + 0.07).alias("v")).select("o_orderkey", X.format_value("v").alias("shown"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ',k' || (event_id % 7) WHEN 1 THEN '' END AS items FROM events")
def json_extract(spark, d):
    n = F.col("event_id") % 3
    said = F.when(n == 0, F.concat(F.lit('Sure! ["'), "event_type", F.lit('", "k'), F.col("event_id") % 7, F.lit('"] as asked.'))).when(n == 1, "Nothing: []").otherwise("no list")
    return W.table(spark, d, "events").select("event_id", F.array_join(X.json_array(said), ",").alias("items"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'a' || user_id END AS agent_id, CASE WHEN event_id % 3 = 1 THEN event_type END AS agent_role, CASE WHEN event_id % 3 = 0 THEN 's' || (event_id % 9) END AS session_id, CAST(NULL AS VARCHAR) AS cwd FROM events")
def ctx_aliases(spark, d):
    n, agent = F.col("event_id") % 3, F.concat(F.lit("a"), "user_id")
    camel = F.create_map(F.lit("agentId"), agent, F.lit("session_id"), F.concat(F.lit("s"), F.col("event_id") % 9))
    both = F.create_map(F.lit("agent_id"), agent, F.lit("agentId"), F.lit("x"), F.lit("role"), F.col("event_type"), F.lit("cwd"), F.lit(" "))
    rows = W.table(spark, d, "events").withColumn("m", F.when(n == 0, camel).when(n == 1, both).otherwise(F.create_map().cast("map<string,string>")))
    return rows.select("event_id", rules.context_fields(F.col("m")).alias("c")).select("event_id", "c.agent_id", "c.agent_role", "c.session_id", "c.cwd")


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, 0.0::DOUBLE AS drift FROM events")
def frame_parse(spark, d):
    frame = F.from_json("props", "k long, drift double")
    return W.table(spark, d, "events").select("event_id", F.coalesce(frame["k"], F.lit(0)).alias("k"), F.coalesce(frame["drift"], F.lit(0.0)).alias("drift"))


@query("SELECT vec_id, round(1 / (1 + exp(-least(30, greatest(-30, embedding[1] * 100)))), 5) AS squashed, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm FROM embeddings")
def math_shape(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return W.table(spark, d, "embeddings").select("vec_id", F.round(X.sigmoid(F.col("embedding")[0].cast("double") * 100), 5).alias("squashed"), F.round(norm, 5).alias("norm"))


#: Documents with front matter and two fences, one of which begins inside a line, and what a rewriting makes of them.
_BEFORE = "'---' || chr(10) || 'title: ' || (doc_id % 5) || chr(10) || '---' || chr(10) || text || ' ```py' || chr(10) || 'x = ' || (doc_id % 7) || chr(10) || '``` and' || chr(10) || '```' || chr(10) || 'y' || chr(10) || '```' || chr(10) || 'end'"
_AFTER = """CASE doc_id % 6 WHEN 0 THEN replace(b, text, 'New words.') WHEN 1 THEN replace(b, 'title: ', 'title: T') WHEN 2 THEN replace(b, 'x = ', 'x = 1') WHEN 3 THEN b || chr(10) || '```' || chr(10) || 'z' || chr(10) || '```' WHEN 4 THEN replace(b, '---' || chr(10), '') ELSE b || ' more' END"""
_REST = "substr({0}, length(regexp_extract({0}, '^---\\n(?s:.*?)\\n---\\n?')) + 1)"
_PROTECTED = f"list_filter(list_concat([regexp_extract({{0}}, '^---\\n(?s:.*?)\\n---\\n?')], regexp_extract_all({_REST}, '(?s)```.*?\\n.*?\\n```')), lambda s: s <> '')"


def _rewritten(spark, d) -> DataFrame:
    n = F.col("doc_id")
    before = F.concat(F.lit("---\ntitle: "), n % 5, F.lit("\n---\n"), "text", F.lit(" ```py\nx = "), n % 7, F.lit("\n``` and\n```\ny\n```\nend"))
    rows = W.table(spark, d, "documents").select("doc_id", "text", before.alias("before"))
    b, put = F.col("before"), lambda old, new: F.replace(F.col("before"), F.lit(old), F.lit(new))
    after = F.when(n % 6 == 0, F.replace(b, F.col("text"), F.lit("New words."))).when(n % 6 == 1, put("title: ", "title: T")).when(n % 6 == 2, put("x = ", "x = 1"))
    return rows.select("doc_id", "before", after.when(n % 6 == 3, F.concat(b, F.lit("\n```\nz\n```"))).when(n % 6 == 4, put("---\n", "")).otherwise(F.concat(b, F.lit(" more"))).alias("after"))


@query(f"SELECT doc_id, {_PROTECTED.format('b')} = {_PROTECTED.format('a')} AS same FROM (SELECT doc_id, b, {_AFTER} AS a FROM (SELECT doc_id, text, {_BEFORE} AS b FROM documents))")
def fence_check(spark, d):
    return _rewritten(spark, d).select("doc_id", X.same_fences("before", "after").alias("same"))


@query(f"""WITH b AS (SELECT doc_id, {_BEFORE} AS b FROM documents), a AS (SELECT doc_id, b, {_AFTER.replace("text,", "x,")} AS a FROM (SELECT doc_id, text AS x, {_BEFORE} AS b FROM documents)),
p AS (SELECT doc_id, a, regexp_extract(a, '^---\\n(?s:.*?)\\n---\\n?') AS front, regexp_split_to_array({_REST.format('a')}, '(?s)```.*?\\n.*?\\n```') AS prose, regexp_extract_all({_REST.format('a')}, '(?s)```.*?\\n.*?\\n```') AS fences FROM a)
SELECT doc_id, CASE WHEN front <> '' THEN 'frontmatter,' ELSE '' END || array_to_string(flatten(list_transform(range(1, len(prose) + 1), lambda i: list_concat(CASE WHEN prose[i] <> '' THEN ['prose'] ELSE [] END, CASE WHEN i <= len(fences) THEN ['fence'] ELSE [] END))), ',') AS kinds, TRUE AS whole FROM p""")
def fence_segments(spark, d):
    """Kinds of segments in order, and that their texts put together are the text."""
    parts = _rewritten(spark, d).select("doc_id", "after", X.segments("after").alias("s"))
    whole = F.array_join(F.transform("s", lambda x: x["text"]), "") == F.col("after")
    return parts.select("doc_id", F.array_join(F.transform("s", lambda x: x["kind"]), ",").alias("kinds"), whole.alias("whole"))


@query("SELECT conv_id, left(array_to_string(list(text ORDER BY turn)[-3:], ' ') || ' sure', 1000) AS expansion FROM conversations GROUP BY conv_id")
def expansion_text(spark, d):
    conv = W.messages(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("m"))
    insights = F.array(F.struct(F.lit("sure").alias("text"), F.lit(0.5).alias("confidence")), F.struct(F.lit("weak").alias("text"), F.lit(0.4).alias("confidence")))
    return conv.select("conv_id", rerank.expansion_text(F.col("m"), insights).alias("expansion"))


@query("SELECT conv_id, array_to_string(list(turn ORDER BY r DESC, turn)[1:5], ',') AS ids FROM (SELECT conv_id, turn, (turn * 7 % 10) / 10 AS r FROM conversations WHERE (turn * 7 % 10) / 10 >= 0.7) GROUP BY conv_id")
def boost_ids(spark, d):
    conv = W.messages(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("id"), ((F.col("turn") * 7 % 10) / 10).alias("relevance")))).alias("r"))
    return conv.select("conv_id", F.array_join(rerank.boost_ids(F.col("r")), ",").alias("ids")).filter("ids <> ''")


@query("SELECT doc_id, CASE WHEN upper(lang) = 'AI' THEN 'AI' ELSE upper(lang[1]) || lower(lang[2:]) END AS domain, 'Src' || substr(source, 4) AS task_type FROM documents")
def writeback_merge(spark, d):
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("title"), F.array("lang").alias("domain"), F.array("source").alias("task_type"))
    files = docs.select("title", F.array().cast("array<string>").alias("domain"), F.lit(None).cast("array<string>").alias("task_type"))
    out = markdown.write_back(files, docs)
    return out.select(F.col("title").alias("doc_id"), F.array_join("domain", ",").alias("domain"), F.array_join("task_type", ",").alias("task_type"))


@query("SELECT doc_id AS id, CAST(0 AS INTEGER) AS chunk_index, trim(text, E' \\t\\n\\r') AS chunk_text, CAST(NULL AS VARCHAR) AS label, CAST(length(text) - length(ltrim(text, E' \\t\\n\\r')) AS INTEGER) AS char_start, CAST(length(rtrim(text, E' \\t\\n\\r')) AS INTEGER) AS char_end, length(trim(text, E' \\t\\n\\r')) > 4000 AS is_atomic FROM documents WHERE trim(text, E' \\t\\n\\r') <> ''")
def chunk_docs(spark, d):
    """The documents have no headings, tags, rules or blank lines, so each is a chunk."""
    return chunking.chunks(W.table(spark, d, "documents"), "doc_id", "text")


_PARAGRAPHS = """RECURSIVE marked AS (SELECT doc_id AS id, regexp_replace(text, '[.] ', E'.\\n\\n', 'g') AS text FROM documents),
split AS (SELECT id, text, CASE WHEN length(text) <= 1600 THEN [text] ELSE string_split(text, E'\\n\\n') END AS ps FROM marked),
para AS (SELECT id, p, i, sum(length(p) + 2) OVER (PARTITION BY id ORDER BY i) - length(p) - 2 AS pos FROM (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM split)),
span AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS n, pos + length(p) - length(ltrim(p, E' \\t\\n')) AS a, pos + length(rtrim(p, E' \\t\\n')) AS b FROM para WHERE trim(p, E' \\t\\n') <> ''),
walk AS (SELECT id, n, a AS a, b, 0 AS k FROM span WHERE n = 1 UNION ALL SELECT s.id, s.n, CASE WHEN w.b - w.a < 1600 THEN w.a ELSE s.a END, s.b, CASE WHEN w.b - w.a < 1600 THEN w.k ELSE w.k + 1 END FROM walk w JOIN span s ON s.id = w.id AND s.n = w.n + 1),
packed AS (SELECT id, k, min(a) AS a, max(b) AS b FROM walk GROUP BY id, k), ends AS (SELECT id, max(k) AS last FROM packed GROUP BY id),
moved AS (SELECT p.id, CASE WHEN k = last AND k > 0 AND b - a < 320 THEN k - 1 ELSE k END AS k, a, b FROM packed p JOIN ends USING (id)),
chunk AS (SELECT m.id, min(m.a) AS a, max(m.b) AS b, any_value(t.text) AS text FROM moved m JOIN marked t USING (id) GROUP BY m.id, k),
once AS (SELECT *, row_number() OVER (PARTITION BY id, regexp_replace(text[CAST(a AS INT) + 1:CAST(b AS INT)], '\\s+', ' ', 'g') ORDER BY a) AS again FROM chunk)"""


@query(f"WITH {_PARAGRAPHS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS char_start, CAST(b AS INTEGER) AS char_end, b - a > 4000 AS is_atomic FROM once WHERE again = 1")
def chunk_paragraphs(spark, d):
    """The documents with a blank line after each sentence, so that there is something to pack."""
    marked = W.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[.] ", ".\n\n").alias("text"))
    return chunking.chunks(marked, "doc_id", "text").select("id", "chunk_index", "char_start", "char_end", "is_atomic")


@query(f"WITH {_PARAGRAPHS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS char_start, CAST(b AS INTEGER) AS char_end, text[CAST(a AS INT) + 1:CAST(b AS INT)] AS chunk_text FROM once WHERE again = 1")
def chunk_lateral(spark, d):
    """The chunker as a table function in SQL."""
    chunking.register_chunks(spark)
    W.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[.] ", ".\n\n").alias("text")).createOrReplaceTempView("marked_documents")
    return spark.sql("SELECT id, c.chunk_index, c.char_start, c.char_end, c.chunk_text FROM marked_documents, LATERAL chunks(text) c")


@query(f"SELECT role, round(avg(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END), 6) AS mean_score FROM (SELECT c.role, {_BAG.format('c.text')} AS a, {_BAG.format('p.prev')} AS b FROM ({PREVIOUS}) p JOIN conversations c USING (conv_id, turn) WHERE p.prev IS NOT NULL) GROUP BY role")
def metric_mean(spark, d):
    pairs = _previous(spark, d).filter("prev IS NOT NULL")
    return pairs.groupBy("role").agg(F.round(F.avg(F.coalesce(plugins.score_metric("judge", "text", "prev"), F.lit(0.0))), 6).alias("mean_score"))


@query()
def similarity_ratio(spark, d):
    pairs = _previous(spark, d).filter("prev IS NOT NULL").withColumn("ratio", plugins.score_metric("exact", "prev", "text"))
    return pairs.select("conv_id", "turn", "ratio", (F.col("ratio") >= 0.85).alias("hit"))


@query()
def analyze_text(spark, d):
    return retrieval.lexeme_counts(W.prompts(spark, d), {"title": "A", "prompt_text": "D"})


@query("""SELECT doc_id AS title, fault FROM (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN ['no body', 'repeated key: domain'] WHEN 1 THEN ['front matter without an end'] WHEN 2 THEN ['repeated key: domain', 'repeated key: task_type'] ELSE [] END) AS fault FROM documents WHERE trim(text, E' \\n') <> '')""")
def markdown_faults(spark, d):
    """Files that break the rules, each in its own way; the others have no row here, and these don't stop the reading of any."""
    n = F.col("doc_id")
    twice = F.concat(F.lit("---\ndomain: a\nDomain: b\n---\n"), F.when(n % 4 == 0, "").otherwise(F.col("text")))
    raw = F.when(n % 4 == 0, twice).when(n % 4 == 1, F.concat(F.lit("---\ndomain: a\n"), "text")).when(n % 4 == 2, F.concat(F.lit("---\ntask type: x\ndomain: a\ntask_type: y\ndomain: z\n---\n"), "text")).otherwise(F.concat(F.lit("---\ndomain: a\n---\n"), "text"))
    files = W.table(spark, d, "documents").filter(F.trim(F.col("text"), F.lit(" \n")) != "").select(n.alias("title"), raw.alias("raw"))
    return markdown.faults(files)


@query("SELECT doc_id AS title, trim(text, ' ') AS prompt_text, 'finance,AI,' || lang AS domain, CASE WHEN doc_id % 2 = 0 THEN 'analyze' ELSE source END AS task_type, CASE WHEN doc_id % 3 = 0 THEN 'draft' ELSE 'active' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'public' ELSE 'private' END AS source, substr(sha256(trim(text, ' ')), 1, 16) AS content_hash FROM documents WHERE trim(text, ' ') <> ''")
def parse_frontmatter(spark, d):
    n = F.col("doc_id")
    raw = F.concat(F.lit("---\ndomain: Finance, AI, "), "lang", F.lit("\ntask type: "), F.when(n % 2 == 0, "Evaluate").otherwise(F.col("source")), F.lit("\nstatus: "), F.when(n % 3 == 0, "Draft").otherwise("odd"), F.when(n % 5 == 0, "\nsource: public").otherwise(""), F.lit("\n---\n"), F.col("text"))
    out = markdown.parse(W.table(spark, d, "documents").select(n.cast("string").alias("title"), raw.alias("raw")))
    return out.select(F.col("title").cast("long").alias("title"), "prompt_text", F.array_join("domain", ",").alias("domain"), F.array_join("task_type", ",").alias("task_type"), "status", "source", "content_hash")


@query("SELECT l_orderkey AS skill_id, 'skill' AS kind, count(DISTINCT l_partkey) AS n_steps FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 0 UNION ALL SELECT vec_id, 'prompt', 0 FROM embeddings")
def skill_pool(spark, d):
    skills = W.steps(spark, d).groupBy("skill_id").agg(F.count("*").alias("n_steps")).filter("n_steps > 0").select("skill_id", F.lit("skill").alias("kind"), "n_steps")
    return skills.unionByName(W.table(spark, d, "embeddings").select(F.col("vec_id").alias("skill_id"), F.lit("prompt").alias("kind"), F.lit(0).cast("long").alias("n_steps")))
