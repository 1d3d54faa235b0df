"""Queries over retrieval, fusion, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains, evaluation, fusion, graph_index, rerank, retrieval, tree_index
from ..session import remove_path, settled, shared_path
from . import views as W
from .registry import query

P = f"prompts AS ({W.PROMPTS})"
ACTIVE = f"{P}, active AS (SELECT * FROM prompts WHERE status = 'active')"
VQ = f"chunks AS ({W.CHUNKS}), vq AS ({W.VEC_QUERIES})"
DENSE = f"{VQ}, dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, chunk_id AS id, list_cosine_similarity(q.embedding, c.embedding) AS score FROM vq q, chunks c))"
WQ = f"word_queries AS ({W.WORD_QUERIES}), terms AS ({W.query_terms_sql()})"
POST = f"{ACTIVE}, post AS (SELECT id, unnest({W.doc_terms_sql('prompt_text')}) AS term FROM active), {WQ}"
HITS = f"{POST}, matched AS (SELECT query_id, id, count(*) AS score FROM post JOIN terms USING (term) GROUP BY query_id, id), wanted AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY query_id)"
RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"
OR_HITS = f"{HITS}, lexical AS (SELECT query_id, id, score, rank FROM (SELECT *, {RANKED} FROM matched) WHERE rank <= 50)"
# documents as chunks of parents: the vector of a document is that of its number, modulo the vectors
PAIRS = "dense50 AS (SELECT query_id, id, score, rank FROM dense WHERE rank <= 50)"
LEX_VEC = "lexv AS (SELECT query_id, id, score, rank FROM lexical)"


def _active(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.eligible(W.prompts(spark, d))


def _dense(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    return retrieval.dense_topk(W.chunk_vecs(spark, d), W.vec_queries(spark, d), k, "chunk_id")


def _lexical(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    return retrieval.exact_search(_active(spark, d), W.word_queries(spark, d), False, k, "id", "prompt_text")


def _round(c: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(c)


@query(f"WITH {P} SELECT id, title, source FROM prompts WHERE status = 'active' AND list_has_any(domain, ['fr', 'de'])")
def scan_filter_any(spark, d):
    return retrieval.eligible(W.prompts(spark, d), domain=["fr", "de"], intent=[], colour=["red"]).select("id", "title", "source")


@query(f"WITH {DENSE} SELECT query_id, id, round(score, 6) AS score, rank FROM dense WHERE rank <= 50")
def dense_topk(spark, d):
    return _dense(spark, d).select("query_id", "id", _round("score"), "rank")


@query(f"WITH {DENSE} SELECT query_id, id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10")
def dense_topk_batch(spark, d):
    return _dense(spark, d, 10).select("query_id", "id", _round("score"), "rank")


@query(f"""WITH {DENSE}, best AS (SELECT query_id, chunk_id // 5 AS id, score, chunk_id, row_number() OVER (PARTITION BY query_id, chunk_id // 5 ORDER BY score DESC, chunk_id) AS n FROM (SELECT query_id, id AS chunk_id, score, rank FROM dense WHERE rank <= 50)),
r AS (SELECT query_id, id, chunk_id, score, {RANKED} FROM best WHERE n = 1) SELECT query_id, id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def chunk_rollup(spark, d):
    chunks = _dense(spark, d).select("query_id", F.floor(F.col("id") / 5).alias("id"), F.col("id").alias("chunk_id"), "score")
    return retrieval.rollup(chunks, 10).select("query_id", "id", "chunk_id", _round("score"), "rank")


@query(f"WITH {VQ}, s AS (SELECT q.chunk_id AS query_id, c.chunk_id AS id, list_cosine_similarity(q.embedding, c.embedding) AS score FROM chunks q, chunks c WHERE q.chunk_id % 20 = 0 AND c.chunk_id <> q.chunk_id) SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, {RANKED} FROM s) WHERE rank <= 10")
def similar_items(spark, d):
    return retrieval.similar_items(W.chunk_vecs(spark, d), F.col("chunk_id") % 20 == 0, 10, "chunk_id").select("query_id", "id", _round("score"), "rank")


@query()
def ann_lsh(spark, d):
    return retrieval.ann_lsh(W.chunk_vecs(spark, d), W.vec_queries(spark, d), 10, id_col="chunk_id")


@query()
def ann_cells(spark, d):
    return retrieval.ann_cells(W.chunk_vecs(spark, d), W.vec_queries(spark, d), 10, id_col="chunk_id")


@query()
def ann_tree(spark, d):
    """A stored tree index over nine tenths of the vectors, the rest filed afterwards, then searched."""
    v, path = W.chunk_vecs(spark, d), shared_path(spark, "tree")
    tree = tree_index.build(v.filter("chunk_id % 10 <> 3"), path, "chunk_id")
    tree_index.insert(v.filter("chunk_id % 10 = 3"), path, "chunk_id", tree=tree)
    found = settled(tree_index.search(spark, path, W.vec_queries(spark, d), 10, tree=tree))
    remove_path(spark, path)
    return found


@query()
def ann_graph(spark, d):
    """A stored graph of near neighbours, searched over its links."""
    path = shared_path(spark, "graph")
    graph_index.build(W.chunk_vecs(spark, d), path, id_col="chunk_id")
    found = settled(graph_index.search(spark, path, W.vec_queries(spark, d), 10))
    remove_path(spark, path)
    return found


@query(f"WITH {HITS} SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, {RANKED} FROM matched JOIN wanted USING (query_id) WHERE score = n_terms) WHERE rank <= 10")
def exact_and(spark, d):
    return retrieval.exact_search(_active(spark, d), W.word_queries(spark, d), True, 10, "id", "prompt_text")


@query(f"WITH {OR_HITS} SELECT * FROM lexical WHERE rank <= 10")
def exact_or(spark, d):
    return _lexical(spark, d, 10)


KEY_TERMS = f"""{P}, allpost AS (SELECT id, unnest({W.doc_terms_sql('prompt_text')}) AS term FROM prompts), {WQ},
freq AS (SELECT term, count(*) / (SELECT count(*) FROM prompts WHERE status = 'active') AS df FROM allpost WHERE term IN (SELECT term FROM terms) GROUP BY term),
keyed AS (SELECT * FROM (SELECT query_id, term, df, row_number() OVER (PARTITION BY query_id ORDER BY df, ord) AS place FROM terms JOIN freq USING (term) WHERE df <= 0.15) WHERE place <= 4)"""


@query(f"WITH {KEY_TERMS} SELECT query_id, term, round(df, 6) AS df, place FROM keyed")
def key_terms_df(spark, d):
    p = W.prompts(spark, d)
    return retrieval.key_terms(p, W.word_queries(spark, d), F.col("status") == "active", id_col="id", text_col="prompt_text").select("query_id", "term", _round("df"), "place")


@query(f"""WITH {KEY_TERMS}, post AS (SELECT a.id, term FROM allpost a JOIN prompts p ON p.id = a.id AND p.status = 'active'),
wanted AS (SELECT query_id, count(*) AS n FROM keyed GROUP BY query_id),
m AS (SELECT query_id, id, count(*) AS score, count(*) FILTER (place <= 2) AS n_top FROM post JOIN keyed USING (term) GROUP BY query_id, id),
t AS (SELECT m.query_id, id, score, CASE WHEN score = n THEN 1 WHEN n_top = least(2, n) THEN 2 ELSE 3 END AS tier FROM m JOIN wanted USING (query_id)),
b AS (SELECT query_id, min(tier) AS best FROM t GROUP BY query_id)
SELECT query_id, id, tier, score, rank FROM (SELECT t.*, row_number() OVER (PARTITION BY t.query_id ORDER BY score DESC, id) AS rank FROM t JOIN b ON b.query_id = t.query_id AND best = tier) WHERE rank <= 10""")
def keyword_tiers(spark, d):
    return retrieval.keyword_search(W.prompts(spark, d), W.word_queries(spark, d), F.col("status") == "active", k=10, id_col="id", text_col="prompt_text")


@query()
def sparse_stemmed(spark, d):
    return retrieval.sparse_search(_active(spark, d), W.word_queries(spark, d), {"title": "A", "prompt_text": "D"}, 50)


@query(f"""WITH {OR_HITS}, b AS (SELECT query_id, l.id, l.score::DOUBLE + CASE WHEN list_has_any(domain, ['fr', 'es']) THEN 0.05 ELSE 0 END + CASE WHEN list_has_any(task_type, ['src0', 'src1']) THEN 0.05 ELSE 0 END AS score FROM lexical l JOIN prompts p ON p.id = l.id)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, {RANKED} FROM b) WHERE rank <= 10""")
def skill_boost(spark, d):
    return retrieval.skill_search(W.prompts(spark, d), _lexical(spark, d), {"domain": ["fr", "es"], "task_type": ["src0", "src1"]}, 10).select("query_id", "id", _round("score"), "rank")


FUSE = f"{DENSE}, {OR_HITS}, {PAIRS}, {LEX_VEC}"


@query(f"""WITH {FUSE}, f AS (SELECT query_id, id, coalesce(0.5 / (50 + d.rank), 0) + coalesce(0.5 / (50 + l.rank), 0) AS score, d.rank AS dense_rank, l.rank AS sparse_rank FROM dense50 d FULL JOIN lexv l USING (query_id, id))
SELECT query_id, id, round(score, 8) AS score, dense_rank, sparse_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM f) WHERE rank <= 10""")
def rrf_fuse(spark, d):
    fused = fusion.rrf(_dense(spark, d), _lexical(spark, d), 20)
    exact = retrieval.top(fused.drop("rank").withColumn("score", F.round("score", 12)), 10)
    return exact.select("query_id", "id", _round("score", 8), "dense_rank", "sparse_rank", "rank")


UNION = f"{FUSE}, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_rank NULLS LAST, sparse_rank NULLS LAST, id) AS arrival FROM (SELECT query_id, id, d.rank AS dense_rank, l.rank AS sparse_rank FROM (SELECT * FROM dense50 WHERE rank <= 20) d FULL JOIN lexv l USING (query_id, id)))"


@query(f"WITH {UNION} SELECT * FROM pool WHERE arrival <= 40")
def union_cap(spark, d):
    return fusion.union_capped(_dense(spark, d, 20), _lexical(spark, d)).select("query_id", "id", "dense_rank", "sparse_rank", "arrival")


@query(f"WITH {FUSE} SELECT query_id, id, d.rank AS dense_rank, l.rank AS sparse_rank FROM (SELECT * FROM dense50 WHERE rank <= 10) d FULL JOIN (SELECT * FROM lexv WHERE rank <= 10) l USING (query_id, id)")
def union_plain(spark, d):
    return fusion.union_capped(_dense(spark, d, 10), _lexical(spark, d, 10), None).select("query_id", "id", "dense_rank", "sparse_rank")


@query(f"""WITH {UNION}, p AS (SELECT query_id, id, arrival FROM pool WHERE arrival <= 40), more AS (SELECT query_id, id, rank FROM dense50 WHERE rank > 15), fresh AS (SELECT * FROM more ANTI JOIN p USING (query_id, id))
SELECT query_id, id, arrival FROM p UNION ALL SELECT query_id, id, last + row_number() OVER (PARTITION BY query_id ORDER BY rank, id) FROM fresh JOIN (SELECT query_id, max(arrival) AS last FROM p GROUP BY query_id) USING (query_id)""")
def pool_extend(spark, d):
    dense = settled(_dense(spark, d))
    pool = settled(fusion.union_capped(dense.filter("rank <= 20"), _lexical(spark, d)).select("query_id", "id", "arrival"))
    return fusion.extend_pool(pool, dense.filter("rank > 15"))


SHAPE = "1 / (1 + exp(-greatest(-30, least(30, (doc_id % 13) - 6)))) - 0.02 * pow(greatest(0, (n_chars - 2200) / 2200), 0.5)"


@query(f"SELECT doc_id, round({SHAPE}, 6) AS score FROM documents")
def score_shape(spark, d):
    docs = W.table(spark, d, "documents", texts=False)
    return docs.select("doc_id", F.round(rerank.shaped_score((F.col("doc_id") % 13 - 6).cast("double"), "n_chars"), 6).alias("score"))


_BAG = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> ''))"
_HEAD = "'Title: ' || title || chr(10) || 'Domain: ' || domain[1] || chr(10) || 'Task type: ' || task_type[1]"
_DOCUMENT = f"{_HEAD} || chr(10) || left(prompt_text, CAST(greatest(0, 4000 - length({_HEAD}) - 1) AS INT))"
RERANK = f"""WITH {OR_HITS}, pairs AS (SELECT query_id, l.id, n_chars, {_BAG.format('query')} AS a, {_BAG.format(_DOCUMENT)} AS b FROM lexical l JOIN word_queries USING (query_id) JOIN prompts p ON p.id = l.id),
s AS (SELECT query_id, id, 1 / (1 + exp(-(CASE WHEN len(a) = 0 THEN -3 ELSE 6.0::DOUBLE * len(list_intersect(a, b)) / len(a) - 3 END))) - 0.02 * pow(greatest(0, (n_chars - 2200) / 2200), 0.5) AS score FROM pairs)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT query_id, id, score, {RANKED} FROM s) WHERE rank <= 10"""


@query(RERANK)
def rerank_stub(spark, d):
    pairs = _lexical(spark, d).join(retrieval.bounded(W.word_queries(spark, d)), "query_id").join(W.prompts(spark, d).withColumn("summary", F.lit(None).cast("string")), "id")
    scored = rerank.score_pairs(pairs.withColumn("document", rerank.rerank_document(domain="domain", task_type="task_type")))
    best = retrieval.top(scored.select("query_id", "id", rerank.shaped_score("raw", "n_chars").alias("score")), 10)
    return best.withColumn("score", F.round("score", 6))


_DOC_HEAD = "'Title: ' || title || CASE WHEN contains(prompt_text, 'Of the') THEN '' ELSE chr(10) || 'Summary: Of the' END || chr(10) || 'Domain: ' || domain[1] || chr(10) || 'Task type: ' || task_type[1]"


@query(f"WITH {P}, h AS (SELECT id, prompt_text, {_DOC_HEAD} AS head FROM prompts WHERE length(title) > 0) SELECT id, head || chr(10) || CASE WHEN id % 3 = 0 THEN 'chunk ' || id ELSE left(prompt_text, CAST(greatest(0, 4000 - length(head) - 1) AS INT)) END AS document FROM h")
def rerank_doc(spark, d):
    """Head, then the matched chunk whole where there is one (every third), else the text within the budget."""
    p = W.prompts(spark, d).filter(F.length("title") > 0).withColumn("summary", F.lit("Of the")).withColumn("matched", F.when(F.col("id") % 3 == 0, F.concat(F.lit("chunk "), "id")))
    return p.select("id", rerank.rerank_document(domain="domain", task_type="task_type", chunk="matched").alias("document"))


@query(f"""WITH {P} SELECT id, round(CASE WHEN domain[1] = 'en' THEN 0.06::DOUBLE WHEN domain[1] = 'fr' THEN 0.03 ELSE 0 END + CASE WHEN regexp_matches(lower(title), 'the|de') THEN 0.02 ELSE 0 END + CASE WHEN id IN (3, 4) THEN -0.1::DOUBLE ELSE 0 END, 6) AS context_adjustment,
array_to_string(list_filter([CASE WHEN domain[1] = 'en' THEN 'domain' END, CASE WHEN domain[1] = 'fr' THEN 'recurring' END, CASE WHEN regexp_matches(lower(title), 'the|de') THEN 'insight' END, CASE WHEN id IN (3, 4) THEN 'prior' END], lambda x: x IS NOT NULL), ',') AS reasons FROM prompts""")
def context_rescore(spark, d):
    ranked = W.prompts(spark, d).withColumn("rerank_score", F.lit(0.5))
    out = rerank.context_rescore(ranked, ["EN"], ["en", "fr"], [], ["the", "de"], {3: 0.1, 4: 0.39, 5: 0.4})
    return out.select("id", F.round("context_adjustment", 6).alias("context_adjustment"), F.array_join("reasons", ",").alias("reasons"))


# parts as prompts: the first parts by price are a query's ranked list
PARTS = "ranked AS (SELECT q AS query_id, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (SELECT q, p_partkey AS id, round(p_retailprice / 2200, 4) AS score FROM part, (SELECT unnest(range(0, 8)) AS q) WHERE p_size % 8 = q))"
COVER = f"""{PARTS}, steps AS ({W.STEPS}), sizes AS (SELECT skill_id, count(*) AS n FROM steps GROUP BY skill_id), hits AS (SELECT query_id, skill_id, max(score) AS score, count(DISTINCT id) AS hits, min(rank) AS best FROM ranked JOIN steps USING (id) WHERE rank <= 200 GROUP BY query_id, skill_id HAVING count(DISTINCT id) >= 2),
covered AS (SELECT query_id, skill_id, score, hits, hits / n AS coverage, best = 1 AS top_is_step FROM hits JOIN sizes USING (skill_id))"""


def _parts(spark, d):
    rows = W.table(spark, d, "part").select((F.col("p_size") % 8).cast("long").alias("query_id"), F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") / 2200, 4).alias("score"))
    return retrieval.top(rows, 200)


@query(f"WITH {COVER} SELECT query_id, skill_id, score, hits, round(coverage, 6) AS coverage, top_is_step FROM covered")
def coverage_skills(spark, d):
    return rerank.coverage(_parts(spark, d), W.steps(spark, d), 200).select("query_id", "skill_id", "score", "hits", _round("coverage"), "top_is_step")


CANDS = f"""{COVER}, cands AS (SELECT query_id, id, 'prompt' AS kind, 0 AS n_steps, score, rank AS arrival FROM ranked WHERE rank <= 20 UNION ALL SELECT query_id, skill_id, 'skill', hits, score + 0.01, 100 + skill_id FROM covered WHERE hits >= 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arrival) AS n FROM cands)"""


def _cands(spark, d):
    covered = rerank.coverage(_parts(spark, d), W.steps(spark, d), 200)
    prompts = _parts(spark, d).filter("rank <= 20").select("query_id", "id", F.lit("prompt").alias("kind"), F.lit(0).alias("n_steps"), "score", F.col("rank").alias("arrival"))
    skills = covered.select("query_id", F.col("skill_id").alias("id"), F.lit("skill").alias("kind"), F.col("hits").alias("n_steps"), (F.col("score") + 0.01).alias("score"), (100 + F.col("skill_id")).alias("arrival"))
    return prompts.unionByName(skills), covered


@query(f"WITH {CANDS} SELECT query_id, CASE WHEN score < 0.9 THEN 'none' WHEN kind = 'skill' THEN 'skill' ELSE 'single' END AS mode, CASE WHEN score >= 0.9 THEN id END AS served_id, round(score, 4) AS score FROM best WHERE n = 1")
def winner_decision(spark, d):
    cands, covered = _cands(spark, d)
    return rerank.winner(cands, covered, floor=0.9).withColumn("score", F.round("score", 4))


@query(f"WITH {DENSE} SELECT query_id, round((max(score) - avg(score)) / stddev_pop(score), 5) AS z, round(max(score) - max(score) FILTER (rank = 2), 6) AS margin FROM dense WHERE rank <= 30 GROUP BY query_id")
def z_margin(spark, d):
    return rerank.z_margin(_dense(spark, d)).select("query_id", _round("z", 5), _round("margin"))


@query(f"WITH {DENSE} SELECT query_id, id // 5 AS id, round(max(score) + least(0.1, 0.05 * (count(*) - 1)), 6) AS score FROM dense WHERE rank <= 50 GROUP BY ALL")
def rollup_bonus(spark, d):
    return rerank.rollup_bonus(_dense(spark, d).withColumn("id", F.floor(F.col("id") / 5))).select("query_id", "id", _round("score"))


@query(f"WITH {DENSE} SELECT query_id, id, round(0.7 * score + 0.3 / rank, 6) AS score, 0.7 * score + 0.3 / rank >= 0.65 AS accepted FROM dense WHERE rank <= 10")
def weighted_score(spark, d):
    s = chains.weighted_score({"score": 0.7, "place": 0.3})
    return _dense(spark, d, 10).withColumn("place", 1 / F.col("rank")).select("query_id", "id", F.round(s, 6).alias("score"), (s >= 0.65).alias("accepted"))


@query(f"WITH {DENSE} SELECT query_id, id, round(score, 6) AS score FROM dense WHERE rank = 1")
def proximity_top1(spark, d):
    return _dense(spark, d, 1).select("query_id", "id", _round("score"))


@query(f"WITH {P} SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(n_chars / 1000.0, 6) AS score FROM prompts WHERE status = 'active')) WHERE rank <= 25")
def rank_all(spark, d):
    rows = _active(spark, d).select(F.lit(0).alias("query_id"), "id", F.round(F.col("n_chars") / 1000.0, 6).alias("score"))
    best = rows.orderBy(F.desc("score"), "id").limit(25)  # no window over all rows
    return retrieval.top(best, 25).select("id", "rank")


@query(f"WITH {P} SELECT id, title FROM prompts WHERE status = 'active' AND id IN (1, 2, 3, 10, 999999)")
def fetch_ids(spark, d):
    return _active(spark, d).filter(F.col("id").isin(1, 2, 3, 10, 999999)).select("id", "title")


@query(f"WITH {P} SELECT md5(title) AS h, min(id) AS id FROM prompts WHERE title ILIKE '%the%' GROUP BY title ORDER BY h LIMIT 300")
def bench_loader(spark, d):
    return W.prompts(spark, d).filter(F.col("title").ilike("%the%")).groupBy("title").agg(F.min("id").alias("id")).select(F.md5("title").alias("h"), "id").orderBy("h").limit(300)


EVAL = f"{OR_HITS}, golden AS ({W.GOLDEN}), ranks AS (SELECT query_id, min(l.rank) AS rank FROM golden g LEFT JOIN lexical l ON l.query_id = g.query_id AND l.id = g.gold_id AND l.rank <= 10 GROUP BY ALL)".replace("SELECT query_id, min(l.rank)", "SELECT g.query_id, min(l.rank)")


@query(f"WITH {EVAL} SELECT count(*) AS n, round(avg(CAST(coalesce(rank <= 1, false) AS INT)), 6) AS recall_1, round(avg(CAST(coalesce(rank <= 5, false) AS INT)), 6) AS recall_5, round(avg(CAST(coalesce(rank <= 10, false) AS INT)), 6) AS recall_10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr_10, round(avg(CAST(query_id NOT IN (SELECT query_id FROM lexical) AS INT)), 6) AS empty_rate FROM ranks")
def recall_mrr(spark, d):
    hits = _lexical(spark, d, 10)
    ranks = evaluation.gold_ranks(W.golden(spark, d).select("query_id", "gold_id"), hits)
    out = evaluation.recall_mrr(ranks, hits)
    return out.select("n", *[_round(c) for c in out.columns if c != "n"])


@query(f"""WITH {EVAL}, andranks AS (SELECT g.query_id, min(a.rank) AS rank FROM golden g LEFT JOIN (SELECT query_id, id, {RANKED} FROM matched JOIN wanted USING (query_id) WHERE score = n_terms) a ON a.query_id = g.query_id AND a.id = g.gold_id AND a.rank <= 10 GROUP BY ALL),
j AS (SELECT coalesce(r.rank <= 5, false) AS x, coalesce(a.rank <= 5, false) AS y FROM ranks r JOIN andranks a USING (query_id))
SELECT round(avg(CAST(x AND y AS INT)), 6) AS "both", round(avg(CAST(x AND NOT y AS INT)), 6) AS a_only, round(avg(CAST(y AND NOT x AS INT)), 6) AS b_only, round(avg(CAST(NOT x AND NOT y AS INT)), 6) AS neither, round(avg(CAST(x OR y AS INT)), 6) AS oracle FROM j""")
def channel_overlap(spark, d):
    gold = W.golden(spark, d).select("query_id", "gold_id")
    every = retrieval.exact_search(_active(spark, d), W.word_queries(spark, d), True, 10, "id", "prompt_text")
    out = evaluation.overlap(evaluation.gold_ranks(gold, _lexical(spark, d, 10)), evaluation.gold_ranks(gold, every), 5)
    return out.select(*[_round(c) for c in out.columns])


@query(f"WITH {EVAL} SELECT round(avg(coalesce(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END, 0)), 6) AS ndcg FROM ranks")
def ndcg_10(spark, d):
    gold = W.golden(spark, d).select("query_id", "gold_id")
    return evaluation.ndcg(evaluation.gold_ranks(gold, _lexical(spark, d, 10))).select(_round("ndcg"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Dense and lexical top-k for a batch of queries, their capped union, shaped scores and the decision."""
    pool = fusion.union_capped(_dense(spark, d, 20), _lexical(spark, d))
    scored = pool.join(W.prompts(spark, d).select("id", "n_chars"), "id").withColumn("score", rerank.shaped_score(4 * F.coalesce("dense_sim", F.lit(0.0)) + F.coalesce(F.col("sparse_sim").cast("double"), F.lit(0.0)) / 4, "n_chars"))
    return rerank.winner(scored.select("query_id", "id", F.lit("prompt").alias("kind"), F.lit(0).alias("n_steps"), "score", "arrival"))


@query(f"""WITH {UNION}, s AS (SELECT query_id, p.id, arrival, 1 / (1 + exp(-greatest(-30, least(30, 4 * coalesce(x.score, 0) + coalesce(y.score, 0) / 4)))) - 0.02 * pow(greatest(0, (n_chars - 2200) / 2200), 0.5) AS score
FROM pool p JOIN documents ON doc_id = p.id LEFT JOIN (SELECT query_id AS q, id AS i, score FROM dense50 WHERE rank <= 20) x ON x.q = query_id AND x.i = p.id LEFT JOIN (SELECT query_id AS q, id AS i, score FROM lexv) y ON y.q = query_id AND y.i = p.id WHERE arrival <= 40),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arrival) AS n FROM s)
SELECT query_id, CASE WHEN score >= 0.8 THEN 'single' ELSE 'none' END AS mode, CASE WHEN score >= 0.8 THEN id END AS served_id, round(score, 6) AS score FROM b WHERE n = 1""")
def find_batch(spark, d):
    return flagship(spark, d).withColumn("score", F.round("score", 6))


@query()
def embed_plugin(spark, d):
    from ..functions.plugins import embed

    return W.table(spark, d, "documents").select("doc_id", embed(64)("text").alias("embedding"))
