import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import plugins, stemmer, vocabulary
from spindrift.operators import assets, chunking, evaluation, lifecycle, optimizer, rerank, retrieval, rules
from spindrift.operators import slots as slot_ops
from spindrift.sources import events, markdown


def _texts(text):
    return [text[c.begin : c.end] for c in chunking.chunk(text)]


def test_chunks_cover_the_text_and_keep_fences():
    fence = "```\n" + "x = 1\n\n# not a heading\n" * 120 + "```"
    text = "# One\n\n" + "Words here. " * 150 + "\n\n# Two\n\n" + fence + "\n\n" + "End. " * 100
    got = _texts(text)
    assert sum(fence in c for c in got) == 1
    assert "".join("".join(c.split()) for c in got) == "".join(text.split())
    assert [c.label for c in chunking.chunk(text)][:2] == [None, "Two"]  # an opening at the very start labels nothing


def test_chunks_of_blank_whole_and_repeated_texts(spark):
    assert chunking.chunk("") == [] == chunking.chunk(None) == chunking.chunk("  \n\n ")
    rows = spark.createDataFrame([(1, "word " * 2000), (2, "short"), (3, None)], "id long, text string")
    assert {(r["id"], r["char_end"], r["is_atomic"]) for r in chunking.chunks(rows).collect()} == {(1, 9999, True), (2, 5, False)}
    same = ("same text " * 170).strip()
    assert len(_texts(f"{same}\n\n{same}")) == 1


def test_openings_by_strength():
    text = "<role>\nText.\n\n## Plan ##x \n---\n**Bold head**:\n| a |\n|---|\n# no table row\n```\n# no heading\n\n```\n#hashtag\n\n\nEnd <b>"
    got = [(o.strength, o.label) for o in chunking.openings(text)]
    assert got == [(chunking.TAG, "role"), (chunking.GAP, None), (chunking.HEADING, "Plan ##x"), (chunking.RULE, None), (chunking.BOLD, "Bold head"), (chunking.HEADING, "no table row"), (chunking.GAP, None)]
    assert all(text[o.at :].startswith(("<role>", "## Plan", "---", "**Bold", "# no table", "\n")) for o in chunking.openings(text))


def test_strong_openings_cut_first_and_label():
    body = "Some prose that goes on. " * 40
    text = f"<role>\n{body}\n\n{body}\n</role>\n\n<rules>\n{body}\n{body}\n</rules>\n"
    spans = chunking.spans(text)
    assert [s.label for s in spans] == [None] * 3 + ["rules"] * 2  # an opening at the very start cuts nothing off
    assert spans[0].begin == 0 and spans[-1].end == len(text) and all(a.end == b.begin for a, b in zip(spans, spans[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# Head\n", "word " * 60, "\n\n", "---\n", "```\ncode\n\n# x\n```\n", "| a |\n| b |\n", "**Bold**\n", "<tag>\n", "end.\n"]), max_size=60))
def test_chunk_invariants(parts):
    text = "".join(parts)
    got = chunking.chunk(text)
    assert all(a.end <= b.begin for a, b in zip(got, got[1:])) and all(text[c.begin : c.end].strip() == text[c.begin : c.end] != "" for c in got)
    bodies = [" ".join(x.split()) for x in _texts(text)]
    assert len(bodies) == len(set(bodies))
    # each but the last was closed by reaching the target, and the last isn't a scrap
    assert all(c.end - c.begin >= vocabulary.CHUNK_TARGET for c in got[:-1])
    assert set(" ".join(text.split()).split()) == set(" ".join(bodies).split())


def test_dense_topk_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 8))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, embedding array<double>").repartition(7)
    queries = spark.createDataFrame([(0, v[5].tolist()), (1, v[6].tolist())], "query_id long, embedding array<double>")
    got = retrieval.dense_topk(vectors, queries, 5).orderBy("query_id", "rank").collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, row in ((0, 5), (1, 6)):
        assert [r["id"] for r in got if r["query_id"] == q] == np.argsort(-(unit @ unit[row]), kind="stable")[:5].tolist()


def test_dense_topk_works_through_blocks_of_queries(spark, sf_dir, monkeypatch):
    from spindrift.plans import views as W

    vectors, queries = W.chunk_vecs(spark, sf_dir), W.vec_queries(spark, sf_dir)
    want = sorted(map(tuple, retrieval.dense_topk(vectors, queries, 5, "chunk_id").collect()))
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 10)
    got = sorted(map(tuple, retrieval.dense_topk(vectors, queries, 5, "chunk_id").collect()))
    assert len({q for q, *_ in got}) == 25
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]


def test_dense_topk_without_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    assert retrieval.dense_topk(vectors, vectors.limit(0).withColumnRenamed("id", "query_id"), 5).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["ann_lsh", "ann_cells"])
def test_recall_of_the_registered_indexes(spark, sf, name):
    from spindrift.plans import views as W
    from spindrift.plans.catalog import QUERIES

    d = f"/root/testdata/{sf}"
    rows = W.table(spark, d, "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["vec_id"] for r in rows])
    exact = {(int(q), int(i)) for q, v in zip(ids, x, strict=True) if q % 20 == 0 for i in ids[np.argsort(-(x @ v), kind="stable")[:10]]}
    near = {(r["query_id"], r["id"]) for r in QUERIES[name](spark, d).collect()}
    assert len(near) == len(exact) == 10 * sum(ids % 20 == 0)
    assert len(exact & near) / len(exact) >= 0.9


def test_indexes_give_k_rows_to_every_query(spark):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((200, 16)))], "id long, embedding array<double>")
    q = v.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    for found in (retrieval.ann_lsh(v, q, 10, bits=12, tables=1), retrieval.ann_cells(v, q, 10, cells=50, probes=1)):
        assert {r["n"] for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {10}


def test_queries_beyond_the_broadcast_bound_give_the_same(spark, sf_dir, monkeypatch):
    from spindrift.plans.catalog import QUERIES

    names = ["exact_and", "exact_or", "key_terms_df", "keyword_tiers", "sparse_stemmed", "recall_mrr"]
    few = {n: sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in names}
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)
    assert few == {n: sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in names}


def test_stemmed_search_against_plain_covers(spark):
    docs = [(1, "Running plans", "The plans for running were planned. Nothing else in here."), (2, "Other", "A runner runs; a planner plans, and plans again."), (3, "None", "quite unrelated")]
    df = spark.createDataFrame(docs, "id long, title string, prompt_text string")
    queries = spark.createDataFrame([(0, "the running plan"), (1, "!!! ???"), (2, "the and of")], "query_id long, query string")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.sparse_search(df, queries, {"title": "A", "prompt_text": "D"}).collect()}
    want = {}
    for i, title, text in docs:
        place, n, hits = 0, 0, []
        for field, weight in ((title, 1.0), (text, 0.1)):
            for token in re.findall(r"[a-z]+", field.lower()):
                place += 1
                if token not in stemmer.STOPWORDS:
                    n += 1
                    if stemmer.stem(token) in {"run", "plan"}:
                        hits.append((place, weight))
        if hits:
            r = sum(w for _, w in hits) / math.log(n + 1)
            gaps = sum(1 / (b[0] - a[0]) for a, b in zip(hits, hits[1:]))
            r = r / (len(hits) / gaps) if gaps else r
            want[0, i] = r / (r + 1)
    assert got == pytest.approx(want) and set(want) == {(0, 1), (0, 2)}


def test_golden_pairs_are_those_that_contain(spark, tmp_path):
    from spindrift.plans import views as W

    spark.createDataFrame([(1, "a bb ccc d"), (2, "bathe cats"), (3, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "za bb ccc dz"), (2, "a bb  ccc d"), (3, "we bathe cats"), (4, "oxen"), (5, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r["query_id"], r["gold_id"]) for r in W.golden(spark, str(tmp_path)).collect()} == {(1, 1), (2, 3), (3, 4)}


def test_baseline_counts_days_not_rows(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([(day(1), 10.0), (day(2), 20.0), (day(9), 30.0)], "day date, value double")
    got = {r["day"]: r["avg_over"] for r in assets.baseline(rows, 7).collect()}
    assert got == {day(1): 10.0, day(2): 15.0, day(9): 30.0}


@pytest.mark.parametrize("values", [[1], [2, 1], [3, 1, 2], [4, 4, 1, 2], [1, 1, 1, 9, 9, 9]])
def test_upper_median(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "v long").agg(evaluation.upper_median("v")).first()[0]
    assert got == sorted(values)[len(values) // 2]


def test_remote_scores_fall_back(spark):
    import pandas as pd

    pairs = pd.DataFrame({"query": ["a b"] * 45, "document": ["a"] * 45})
    local = rerank.overlap_scorer(pairs).tolist()
    calls = []

    def good(rows):
        calls.append(len(rows))
        return [1.0] * len(rows)

    assert rerank.remote_scorer(good)(pairs).tolist() == [1.0] * 45 and calls == [20, 20, 5]
    short = rerank.remote_scorer(lambda rows: [1.0] * (len(rows) - 1))
    assert short(pairs).tolist() == local

    def broken(rows):
        calls.append("asked")
        raise OSError

    down = rerank.remote_scorer(broken)
    assert down(pairs).tolist() == local == down(pairs).tolist() and calls.count("asked") == 1


def test_classifier_batches_are_asked_again(spark):
    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"text {i}") for i in range(8)], "id long, text string").coalesce(1)

    def model(texts):
        if "bad" in texts:
            raise OSError
        return [{"domain": ["finance"], "intent": ["build"], "confidence": {"domain": 0.9, "intent": 0.9}} for _ in texts]

    got = {r["id"]: r["status"] for r in rules.classify(rows, model, {"domain": ["finance"], "intent": ["build"]}, batch=2).collect()}
    assert {i for i, s in got.items() if s == "failed"} == {2, 3} and got[0] == "classified"


def test_a_metric_callable_decides_the_gate(spark):
    c = spark.createDataFrame([(1, "old", "new words"), (2, "old", "```\nx\n```"), (3, "old", "new")], "prompt_id long, canonical string, candidate string")
    e = spark.createDataFrame([(1, "new words"), (2, "```\nx\n```")], "prompt_id long, output_text string")

    def metric(expected, got):
        if got == "old":
            raise ValueError
        return float(expected == got)

    out = {r["prompt_id"]: (r["promoted"], r["reason"]) for r in optimizer.ab_gate_scored(c, e, metric).collect()}
    assert out == {1: (True, "improved"), 2: (False, "fences changed"), 3: (False, "no examples")}


def test_slot_ladder_rungs(spark):
    slots = spark.createDataFrame([(1, "[A]", "a", "fact", None, None), (1, "[B]", "b", "choice", ["x", "y"], None), (1, "[paste it]", "c", "artifact", None, [1.0, 0.0]), (1, "[GOAL]", "goal", "derived", None, None)], "id long, raw string, slot_key string, kind string, choices array<string>, description array<double>")
    base = spark.createDataFrame([("a", "stale", [], "global", "2000-01-01", None), ("b", "z", [], "global", None, None), ("c", "no", [], "global", None, [1.0, 0.0])], "key string, value string, aliases array<string>, scope string, valid_until string, embedding array<double>")
    context = spark.createDataFrame([], "id long, slot_key string, value string")
    guess = spark.createDataFrame([(1, "goal", "grow", 0.7), (1, "a", "no", 0.9)], "id long, slot_key string, value string, confidence double")
    got = {r["slot_key"]: (r["value"], r["rung"], r["need"]) for r in slot_ops.fill(slots, context, base, ["global"], F.lit("2024-01-01"), guess).collect()}
    assert got == {"a": (None, None, "unfilled"), "b": (None, None, "unfilled"), "c": (None, None, "user must supply"), "goal": ("grow", "inferred", None)}


def test_length_penalty_curve(spark):
    got = spark.createDataFrame([(2954, 0.01171), (10_000, 0.03766), (41_881, 0.08494), (100, 0.0)], "n int, want double").select(F.round(rerank.length_penalty("n"), 5), "want").collect()
    assert all(math.isclose(a, b, abs_tol=2e-5) for a, b in got)


@pytest.mark.parametrize("score, mode", [(0.95, "single"), (0.81, "single"), (0.79, "none"), (0.095, "none")])
def test_floor(spark, score, mode):
    row = spark.createDataFrame([(0, 1, "prompt", 0, score, 1)], "query_id long, id long, kind string, n_steps int, score double, arrival int")
    assert rerank.winner(row).first()["mode"] == mode


def test_a_skill_needs_steps_and_coverage(spark):
    rows = spark.createDataFrame([(0, 1, "skill", 0, 0.99, 1), (0, 2, "skill", 3, 0.98, 2), (0, 3, "prompt", 0, 0.9, 3)], "query_id long, id long, kind string, n_steps int, score double, arrival int")
    covered = spark.createDataFrame([], "query_id long, skill_id long")
    assert rerank.winner(rows, covered).first()["served_id"] == 3
    assert rerank.winner(rows).first()["served_id"] == 2


def test_upsert_and_constraints(spark):
    old = spark.createDataFrame([("a", "t1", "x", "active"), ("b", "t2", "y", "active")], "title string, tag string, text string, status string")
    new = spark.createDataFrame([("a", "t9", "x"), ("b", "t8", "changed"), ("c", "t7", "z")], "title string, tag string, text string")
    got = {r["title"]: (r["tag"], r["status"]) for r in lifecycle.upsert(old, new).collect()}
    assert got == {"a": ("t1", "active"), "b": ("t2", "pending"), "c": ("t7", "pending")}
    good, bad = events.check_constraints(old, status=F.col("status") == "active", tag=F.col("tag") == "t1")
    assert [r["title"] for r in good.collect()] == ["a"] and bad.first()["broken"] == ["tag"]


def test_slug_collision_with_a_literal_name(spark):
    rows = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x-2")], "id int, slug string")
    tags = [r["tag"] for r in lifecycle.decollide(rows, "slug", [F.asc("id")]).collect()]
    assert len(set(tags)) == 3 and {"x", "x-2"} <= set(tags)


def test_front_matter(spark, tmp_path):
    (tmp_path / "Clippings").mkdir()
    (tmp_path / "Clippings" / "no.md").write_text("skipped")
    (tmp_path / "Launch Plan.md").write_text("---\nDomain: [Finance, AI]\nTask Type:\n  - Evaluate\n  - plan\nStatus: odd\n---\nDo it.")
    (tmp_path / "empty.md").write_text("---\na: b\n---\n")
    (row,) = markdown.parse(markdown.read_files(spark, str(tmp_path))).collect()
    assert row["title"] == "Launch Plan" and row["tag"] == "launch-plan" and row["prompt_text"] == "Do it."
    assert row["domain"] == ["finance", "AI"] and row["task_type"] == ["analyze", "plan"] and row["status"] == "active"


def test_skill_round_trip(spark):
    steps = [(1, "p1", "First", "why not"), (2, "p2", "Second", None)]
    skills = spark.createDataFrame([("tag", "Name", "About", steps)], "tag string, name string, summary string, steps array<struct<step_order: int, id: string, title: string, rationale: string>>")
    back = markdown.render_skill(skills).select(markdown.skill_steps("text").alias("s")).first()["s"]
    assert [(s["step_order"], s["id"], s["title"], s["rationale"]) for s in back] == steps
    bad = spark.createDataFrame([("### Step 1 · only two\n",)], "t string").select(markdown.skill_steps("t").alias("s")).first()["s"]
    assert bad == []


def test_plan_csv(spark, tmp_path):
    (tmp_path / "plan.csv").write_text("# a comment\nweek,task\n1,Start\n# another\n2,Go\n")
    assert [r["task"] for r in events.read_plan(spark, str(tmp_path / "plan.csv")).collect()] == ["Start", "Go"]


def test_snapshots_and_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "h")], "id int, text string, content_hash string")
    first = events.replace_snapshot(rows, str(tmp_path), 1)
    events.replace_snapshot(rows.withColumn("id", F.lit(2)), str(tmp_path), 2)
    assert spark.read.parquet(first).first()["id"] == 1
    events.export_bundle(rows, str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle")).columns == ["id", "text"]


def test_embedder_checks_itself(spark):
    assert plugins.self_check(plugins.hash_embedder(256))
    got = spark.createDataFrame([("a b",), (None,)], "t string").select(plugins.embed(8)("t").alias("e")).collect()
    assert math.isclose(sum(x * x for x in got[0]["e"]), 1, abs_tol=1e-5) and not any(got[1]["e"])


def test_metric_errors_score_zero(spark):
    @plugins.metric("broken")
    def broken(a, b):
        raise ValueError

    rows = spark.createDataFrame([("a", "a")], "a string, b string")
    # plug-ins run on the executors, so what they raise is caught there
    assert rows.select(plugins.score_metric("broken", "a", "b")).first()[0] == 0.0
    assert rows.select(plugins.score_metric("exact", "a", "b")).first()[0] == 1.0


def test_stems():
    """Words and stems of the published sample."""
    pairs = "consigned consign consignment consign consistency consist consolatory consolatori consolingly consol conspicuously conspicu conspirators conspir constancy constanc knackeries knackeri knavish knavish knightly knight knitted knit generally general communication communic happy happi hopping hop hoping hope relational relat organization organ ties tie cries cri this this dying die proceed proceed".split()
    assert [stemmer.stem(w) for w in pairs[::2]] == pairs[1::2]
    assert stemmer.stem("größer") == "größer" and stemmer.stem("is") == "is"


def test_vocabulary_is_whole():
    assert len(vocabulary.ACRONYMS) > 80
    assert vocabulary.DOMAINS == sorted(vocabulary.DOMAINS, key=str.lower)


def test_chunks_as_a_table_function(spark):
    """In SQL the same as the operator, over texts with all kinds of openings; null and blank texts have no rows."""
    rng = np.random.default_rng(5)
    parts = ["# Head\n", "word " * 60, "\n\n", "---\n", "```\ncode\n\n# x\n```\n", "| a |\n| b |\n", "**Bold**\n", "<tag>\n", "end.\n", "é東 "]
    rows = [(k, "".join(rng.choice(parts, rng.integers(0, 60)))) for k in range(60)] + [(90, None), (91, "  \n")]
    docs = spark.createDataFrame(rows, "id long, text string")
    chunking.register_chunks(spark)
    docs.createOrReplaceTempView("chunk_docs_here")
    got = spark.sql("SELECT d.id, c.* FROM chunk_docs_here d, LATERAL chunks(d.text) c").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, chunking.chunks(docs).collect()), key=str) and len(got) > 60


def test_embedded_text_of_a_chunk(spark):
    """Breadcrumb, summary and the whole chunk, with blank lines between; what isn't there leaves no line."""
    rows = [("T", "L", " s \n", "x" * 9000), ("T", None, None, "b"), ("T", "", "  ", "b"), (None, "L", None, "b")]
    df = spark.createDataFrame(rows, "title string, label string, summary string, text string")
    got = [r["e"] for r in df.select(chunking.embed_text(F.col("title"), F.col("label"), F.col("text"), F.col("summary")).alias("e")).collect()]
    assert got == ["T > L\n\ns\n\n" + "x" * 9000, "T\n\nb", "T\n\nb", " > L\n\nb"]


def test_a_list_has_one_scorer(spark):
    """A pair that the service can't score sends its query's whole list to the fallback, in whatever batch its others were."""
    rows = [(q, i, "plan the launch", f"document {q} {i} plan") for q in range(4) for i in range(30)]
    pairs = spark.createDataFrame(rows, "query_id long, id long, query string, document string").repartition(5)

    def remote(batch):
        if any(" 2 " in d for _, d in batch):
            raise OSError("down")
        return [7.0] * len(batch)

    got = rerank.score_lists(pairs, remote).collect()
    by_query = {q: {(r["scorer"], r["raw"] == 7.0) for r in got if r["query_id"] == q} for q in range(4)}
    assert len(got) == 120 and all(len(kinds) == 1 for kinds in by_query.values()) and by_query[2] == {("fallback", False)}
    assert not any(r["raw"] is None or math.isnan(r["raw"]) for r in got)
