"""Tables in folders, long lists, repeated rows and many queries: what larger tables bring."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import assets, graph_index, metrics, retrieval, search_vectors
from spindrift.plans.catalog import ORACLE_SQL, QUERIES
from spindrift.sources import vault
from spindrift.streaming import alerts

from .oracle import plain, spark_rows, sql_rows, views


def test_a_long_list_of_files_is_read(spark):
    entries = "".join(f"  - path: f{i}.py\n    type: code\n" for i in range(20_000))
    rows = spark.createDataFrame([("s/index.md", f"---\nname: S\nfiles:\n{entries}---\n## Overview\nx\n"), ("s/f19999.py", "x = 1")], "path string, t string")
    _, files, faults = vault.skills(rows.select("path", F.lit(None).cast("timestamp").alias("modified"), F.col("t").cast("binary").alias("content")))
    assert [(r["path"], r["place"], r["type"], r["listed"]) for r in files.collect()] == [("f19999.py", 19_999, "code", True)]
    assert faults.filter("fault = 'listed, not there'").count() == 19_999


def test_streams_read_tables_that_are_folders(spark, sf_dir, tmp_path):
    for name in ("labels", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_priors", "stream_tumble"):
        got, want = (sorted(tuple(map(plain, r)) for r in QUERIES[name](spark, d).collect()) for d in (str(tmp_path), sf_dir))
        assert got == want and got


def test_repeated_columns_are_checked_once(spark):
    columns = spark.createDataFrame([("t", "c", "int", False), ("u", "id", "text", False), ("t", "id", "int", True)] * 50, "table string, column string, type string, nullable boolean")
    keys = spark.createDataFrame([("t", "c", "u", "id"), ("t", "c", "u", "gone")], "table string, column string, ref_table string, ref_column string")
    found = assets.validate_schema(columns, keys, ["int", "text"]).filter("issue LIKE '%reference%'").collect()
    assert sorted(r["issue"] for r in found) == ["orphan reference", "reference type"]


def test_acronyms_end_at_letters_beyond_ascii(spark):
    got = spark.createDataFrame([("ÓNRR, xNRR, NRRÓ NRR_",)], "t string").select(X.expand_acronyms("t")).first()[0]
    assert got == "ÓNRR (net revenue retention), xNRR, NRR (net revenue retention)Ó NRR_"


def test_quantiles_of_many_samples_are_exact(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    many = e.select((F.col("event_id") * 60).alias("event_id"), "ts", "user_id", "event_type", "value", "props", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i"))
    many.select((F.col("event_id") + F.col("i")).alias("event_id"), "ts", "user_id", "event_type", (F.col("value") * (1 + F.col("i") / 977)).alias("value"), "props").write.parquet(f"{tmp_path}/events.parquet")
    con = views(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("quantile_baseline", "unusual_samples"):
        assert spark_rows(QUERIES[name](spark, str(tmp_path))) == sql_rows(con, ORACLE_SQL[name])


def test_a_rank_outside_the_sketch_is_found(spark):
    rows = spark.createDataFrame([("a", f"2024-01-{1 + i % 9:02d}", float("nan") if i % 3 == 0 else float(i * 7919 % 1009)) for i in range(900)], "key string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = {str(r["day"]): r["quantile"] for r in metrics.exact_over_days(rows, ["key"], 0.5, 3, 8).collect()}
    for day in range(1, 10):
        own = sorted((float("inf") if i % 3 == 0 else i * 7919 % 1009) for i in range(900) if max(1, day - 2) <= 1 + i % 9 <= day)
        assert plain(got[f"2024-01-{day:02d}"]) == plain(own[-(-len(own) // 2) - 1]).replace("inf", "null")


def test_scores_of_many_queries_are_held_a_few_at_a_time():
    rng = np.random.default_rng(3)
    matrix, x, names = rng.standard_normal((6000, 4)), rng.standard_normal((4096, 4)), np.arange(4096)
    held = retrieval._Best(len(matrix), 2)
    tracemalloc.start()
    held.meet(np.arange(len(matrix)), names, matrix, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000 < matrix.shape[0] * len(names) * 8
    (got,) = held.batches(np.arange(len(matrix)))
    assert got["id"].to_pylist() == np.argsort(-(matrix @ x.T), axis=1, kind="stable")[:, :2].ravel().tolist()


def test_a_block_bounds_what_is_kept_of_the_next():
    """The k-th best of a block holds for later ones before anything is sorted; scores that aren't numbers are no hits, and take no place."""
    rng = np.random.default_rng(4)
    matrix, x = rng.standard_normal((40, 8)), rng.standard_normal((90, 8))
    held = retrieval._Best(40, 5)
    for at in (0, 30, 60):
        held.meet(np.arange(40), np.arange(at, at + 30), matrix / 10 ** (at // 30), x[at : at + 30])
    assert held.size < 2 * 40 * 5
    x[3] = np.nan
    held = retrieval._Best(40, 5)
    for at in range(0, 90, 4):
        held.meet(np.arange(40), np.arange(at, min(90, at + 4)), matrix, x[at : at + 4])
    (got,) = held.batches(np.arange(40))
    scores = np.nan_to_num(matrix @ x.T, nan=-np.inf)
    assert got["id"].to_pylist() == np.argsort(-scores, axis=1, kind="stable")[:, :5].ravel().tolist()


def test_copies_of_a_vector_go_by_their_ids_wherever_they_lie():
    """A matrix product adds up a vector in a small block another way than its copy in a large one."""
    rng = np.random.default_rng(6)
    once = rng.standard_normal((61, 64))
    once /= np.linalg.norm(once, axis=1, keepdims=True)
    x, names, queries = np.tile(once, (9, 1)), np.arange(549), np.arange(61)
    order = np.argsort(-(once @ once.T - 9 * np.eye(61)), axis=1)  # a query's other vectors; its own copies come before them
    for cuts in ((0, 549), (0, 300, 307, 320, 549), (0, 3, 20, 470, 549)):
        held = retrieval._Best(61, 20)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.meet(queries, names[a:b], once, x[a:b], lambda some, a=a, b=b: some[:, None] == names[None, a:b])
        (got,) = held.batches(queries)
        for q, ids in enumerate(got["id"].to_numpy().reshape(61, 20).tolist()):
            assert ids == [*range(q + 61, 549, 61), *range(order[q, 0], 549, 61), *range(order[q, 1], 183, 61)]


def test_a_pool_and_what_extends_it_come_from_one_search(spark, sf_dir, monkeypatch):
    real, calls = retrieval._dense_block, []
    monkeypatch.setattr(retrieval, "_dense_block", lambda *a: calls.append(a) or real(*a))
    assert spark_rows(QUERIES["pool_extend"](spark, sf_dir)) == sql_rows(views(sf_dir), ORACLE_SQL["pool_extend"])
    assert len(calls) == 1


def test_a_pool_is_worked_out_once_for_its_texts(spark):
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pool = spark.createDataFrame([(q, i, 5 * i) for q in range(3) for i in range(4)], "query_id long, id long, chunk_id long").mapInArrow(through, "query_id long, id long, chunk_id long")
    prompts = spark.createDataFrame([(i, f"t{i}", f"p{i}") for i in range(3)], "id long, title string, prompt_text string")
    chunks = spark.createDataFrame([(0, "c0"), (10, "c10"), (99, "c99")], "chunk_id long, chunk_text string")
    got = {(r["query_id"], r["id"], r["title"], r["matched_chunk_text"]) for r in retrieval.fill_text(pool, prompts, chunks).collect()}
    assert got == {(q, i, f"t{i}", {0: "c0", 2: "c10"}.get(i)) for q in range(3) for i in range(3)}
    assert seen.value == 12


def test_queries_alike_are_searched_for_once_and_tasks_keep_their_best(spark, monkeypatch):
    put = []
    docs = spark.createDataFrame([(f"d{i:03d}", "river bank plans"[: 5 + i % 12], "the river " * (i % 5)) for i in range(300)], "id string, title string, text string").repartition(3)
    asked = spark.createDataFrame([(i, ["river plans", "Rivers, planned", "bank"][i % 3]) for i in range(90)], "query_id long, query string")
    fields = {"title": "A", "text": "D"}
    real = retrieval._scored_in_place
    monkeypatch.setattr(retrieval, "_scored_in_place", lambda *a: put.append(real(*a)) or put[-1])
    got = sorted(map(tuple, retrieval.sparse_search(docs, asked, fields, 7).collect()))
    assert len(got) == 90 * 7 and put[0].select("query_id").distinct().count() == 2
    assert put[0].groupBy(F.spark_partition_id(), "query_id").count().agg(F.max("count")).first()[0] == 7
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 1)
    assert got == sorted(map(tuple, retrieval.sparse_search(docs, asked, fields, 7).collect()))


def test_documents_that_hold_all_terms_of_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 12, 9)) if i % 17 else None) for i in range(400)], "id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 13, 1 + i % 4)) if i % 9 else "the a") for i in range(60)], "query_id long, query string")
    want = sorted(map(tuple, retrieval.exact_search(docs, asked, True, 6).collect()))
    assert len(want) > 150 and want == sorted(map(tuple, retrieval.holding_all(docs, asked, 6).collect()))
    monkeypatch.setattr(retrieval, "TERM_QUERIES", 7)
    assert want == sorted(map(tuple, retrieval.holding_all(docs, asked, 6).collect()))
    assert retrieval.holding_all(docs, asked.filter("query_id = 0"), 6).count() == 0


def test_self_retrieval_makes_no_rows_of_single_terms(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(retrieval, "postings", None)
    assert QUERIES["self_retrieval"](spark, sf_dir).count() == 1


def test_a_segment_is_written_once_and_texts_come_a_few_at_a_time(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "a b a c"[: i % 8]) for i in range(50)], "id long, text string").repartition(2)
    rows = search_vectors.vectors(docs, {"text": "A"}, "simple")
    want = sorted(map(str, rows.collect()))
    monkeypatch.setattr(retrieval, "TEXTS", 3)
    assert want == sorted(map(str, search_vectors.vectors(docs, {"text": "A"}, "simple").collect()))
    monkeypatch.setattr(search_vectors, "settled", None)
    search_vectors.write(rows, str(tmp_path / "v"))
    assert sorted(map(str, search_vectors.read(spark, str(tmp_path / "v")).collect())) == sorted(map(str, rows.filter("lexeme IS NOT NULL").drop("n_places").collect()))
    assert spark.read.parquet(f"{tmp_path}/v/seg-000000/rows").count() == 50


def test_a_graph_is_built_and_searched_by_segments(spark, monkeypatch, tmp_path):
    """Links never leave a segment of bounded size; a task keeps its best over several segments; copies are found by the least ids."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16))
    x[1000:1300] = x[7]
    vectors = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>").repartition(5)
    monkeypatch.setattr(graph_index, "SEGMENT", 200)
    monkeypatch.setattr(graph_index, "TASKS", 3)
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 40)
    graph_index.build(vectors, str(tmp_path))
    graph = {r["id"]: r for r in spark.read.parquet(f"{tmp_path}/graph").collect()}
    assert len(graph) == 1500 and {r["segment"] for r in graph.values()} == set(range(8))
    assert all(graph[n]["segment"] == r["segment"] for r in graph.values() for n in r["links"])
    asked = vectors.filter("id < 'v0100'").withColumnRenamed("id", "query_id")
    found = graph_index.search(spark, str(tmp_path), asked, 10).collect()
    want = {(r["query_id"], r["id"]) for r in retrieval.dense_topk(vectors, asked, 10).collect()}
    assert len(found) == 1000 and len({(r["query_id"], r["id"]) for r in found} & want) >= 900
    assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == "v0007"] == ["v0007", *(f"v{i}" for i in range(1000, 1009))]


class _Kept:
    """A value and a map of a stateful processor, which count how often they are called."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: self.value is not None,
            "get": lambda: self.value,
            "update": lambda v: self.__dict__.update(value=v),
            "clear": lambda: self.__dict__.update(value=None),
            "containsKey": lambda k: k in self.map,
            "getValue": lambda k: self.map[k],
            "updateValue": lambda k, v: self.map.update({k: v}),
            "removeKey": lambda k: self.map.pop(k),
            "keys": lambda: list(self.map),
            "iterator": lambda: list(self.map.items()),
            "getValueState": lambda *_: self,
            "getMapState": lambda *_: self,
            "registerTimer": lambda *_: None,
        }[name]


def test_a_series_waits_in_few_pieces():
    """20,000 samples of six hours, in disorder: state is called by the hour, not by the sample, and a watermark in between loses nothing."""
    us = np.random.default_rng(2).permutation(20_000) * 1_080_000
    value = (us // 1_080_000 % 1000).astype(float)
    rows = pd.DataFrame({"us": us, "value": value, "breach": value >= 100})
    kept, at = _Kept(), lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    series = alerts._Alerts({"r": 60_000_000}, 30_000_000)
    series.init(kept)
    list(series.handleInputRows(("r", "k"), (rows[i : i + 3000] for i in range(0, 20_000, 3000)), at(0)))
    out = pd.concat([p for ms in (9_000_500, 30_000_000) for p in series.handleExpiredTimer(("r", "k"), at(ms), None)])
    assert kept.calls < 200 and not kept.map and kept.value is None
    ends = [min(n, 20_000) for n in range(1000, 20_001, 1000)]
    want = [("pending", (n - 900) * 1_080_000) for n in ends] + [("firing", (n - 900 + 56) * 1_080_000) for n in ends] + [("resolved", n * 1_080_000) for n in ends[:-1]] + [("resolved", 19_999 * 1_080_000 + 30_000_000)]
    assert sorted(zip(out["state"], out["us"])) == sorted(want)


def test_a_skill_s_steps_come_together_in_pieces(spark, monkeypatch):
    """Steps are put in order by many tasks, a few thousand at a time; what a skill's task gathers is pieces, not steps."""
    from spindrift.operators import lifecycle

    n = 60_000
    chain = spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("tag"), (F.col("id") * 7919 % n).alias("ord"), (F.col("id") % 500).alias("id"))
    prompts = spark.range(400).select("id", F.array(F.concat(F.lit("d"), F.col("id") % 4), F.lit("all")).alias("domain"))
    versions = spark.createDataFrame([("a", 3), ("a", 5)], "tag string, version int")
    want: dict = {}
    for r in chain.collect():
        want.setdefault(r["tag"], []).append((r["ord"], r["id"]))
    out = lifecycle.promote(chain, prompts, versions)
    got = {r["tag"]: r for r in out.collect()}
    assert set(got) == set(want) == {"a", "b", None}
    for tag, steps in want.items():
        ids = [i for _, i in sorted(steps)]
        assert got[tag]["steps"] == ids and got[tag]["steps_text"] == ",".join(map(str, ids)) and got[tag]["domain"] == ["all", "d0", "d1", "d2", "d3"]
        assert got[tag]["version"] == (6 if tag == "a" else 1)
    pieces = lifecycle._in_order(chain, ["tag", "ord", "id"], "tag", "id").collect()
    assert sum(len(r["values"]) for r in pieces) == n and max(len(r["values"]) for r in pieces) <= 10_000 and len(pieces) > 5


def test_lexemes_are_summed_where_they_are_read(spark, monkeypatch):
    """A task puts out sums, not places; ids that repeat, or are null, are still told apart."""
    monkeypatch.setattr(retrieval, "_HITS", 50)
    rows = [(i, f"plans word{i % 40}", f"the plan of {i % 7} rivers " * 5) for i in range(600)]
    rows += [(5, "plans again", None), (5, None, "plan"), (None, "nobody s plan", "river"), (None, None, "river")]
    docs = spark.createDataFrame(rows, "id long, title string, text string").repartition(3)
    fields = {"title": "A", "text": "D"}
    places = retrieval.lexeme_postings(docs, fields)
    want = {(r["lexeme"], r["weight"]): (r["n"], r["docs"]) for r in places.groupBy("lexeme", "weight").agg(F.count("*").alias("n"), F.count_distinct("id").alias("docs")).collect()}
    counted = retrieval.lexeme_counts(docs, fields)
    assert {(r["lexeme"], r["weight"]): (r["n"], r["docs"]) for r in counted.collect()} == want and want["plan", 0.1][1] == 600
    once = docs.filter("id IS NOT NULL AND id <> 5")
    plan = retrieval.lexeme_counts(once, fields)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan and "Join" not in plan
