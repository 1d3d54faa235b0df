"""Alerts, sketches, rates, counters kept by a stream, and the stored tree index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import graph_index, lifecycle, metrics, retrieval, tree_index
from spindrift.streaming import alerts, refresh

KIND = "key string, ts timestamp, value double"
STORE = "spark.sql.streaming.stateStore.providerClass"


def plain(samples, hold, stale, above, now):
    """Transitions of one series (time in seconds, value), told step by step."""
    out, since, fired, last = [], None, False, None
    once = {}
    for ts, v in samples:
        once[ts] = max(v, once.get(ts, v))
    for ts, v in [*sorted(once.items()), (now, None)]:
        if since is not None and ts - last > stale:
            out += [("resolved", last + stale)] if fired else []
            since, fired = None, False
        if v is None:
            break
        if v > above:
            if since is None:
                since = ts
                out += [("pending", ts)] if hold else []
            if not fired and ts - since >= hold:
                fired = True
                out.append(("firing", ts))
        else:
            out += [("resolved", ts)] if fired else []
            since, fired = None, False
        last = ts
    return out


def rows_of(seed, n=400):
    dice = random.Random(seed)
    return [(f"k{dice.randint(0, 2)}", 1_704_067_200 + dice.randint(0, 20_000), float(dice.randint(0, 10))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, s long, value double").select("key", F.timestamp_seconds("s").alias("ts"), "value")


RULES = [("now", 0, 6), ("short", 60, 4), ("long", 900, 2)]


def rules():
    return [alerts.Rule(name, F.col("value") > above, hold) for name, hold, above in RULES]


def wanted(rows, now, stale):
    return sorted((name, key, state, at) for name, hold, above in RULES for key in {k for k, _, _ in rows} for state, at in plain([(t, v) for k, t, v in rows if k == key], hold, stale, above, now))


def told(df):
    return sorted((r["rule"], r["key"], r["state"], r["s"]) for r in df.select("*", F.unix_seconds("ts").alias("s")).collect())


@pytest.mark.parametrize("seed, stale", [(1, 300), (2, 100), (3, 10_000)])
def test_transitions_against_a_plain_walk(spark, seed, stale):
    rows = rows_of(seed)
    now = max(t for _, t, _ in rows) + 50
    awkward = frame(spark, [*rows, rows[0], (None, rows[0][1], 9.0), ("k0", None, 9.0), ("k0", rows[0][1] + 1, None)])
    out = alerts.transitions(alerts.evaluated(awkward, rules()), stale, F.timestamp_seconds(F.lit(now)))
    assert told(out) == wanted(rows, now, stale)
    assert alerts.transitions(alerts.evaluated(frame(spark, []), rules()), stale).collect() == []


def test_a_breach_across_window_edges_fires(spark):
    rows = [("k", t, 9.0) for t in range(1_704_067_200 + 240, 1_704_067_200 + 421, 60)]
    got = told(alerts.transitions(alerts.evaluated(frame(spark, rows), [alerts.Rule("r", F.col("value") > 5, 180)]), 600))
    assert got == [("r", "k", "firing", rows[-1][1]), ("r", "k", "pending", rows[0][1])]


def test_stream_of_files_in_any_order(spark, tmp_path):
    """Samples in disorder over several files, and one too late, which changes nothing."""
    rows = sorted(rows_of(5, 200), key=lambda r: r[1])
    end = rows[-1][1]
    dice, parts = random.Random(5), [rows[k : k + 50] for k in range(0, 200, 50)]
    for k, part in enumerate([*parts, [("end", end + 5000, 0.0), ("k0", rows[3][1] + 1, 9.0)], [("end", end + 90_000, 0.0)]]):
        frame(spark, dice.sample(part, len(part))).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    kept = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = []
        out = alerts.stream_transitions(stream, rules(), 600, "10 minutes")
        done = out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        done.foreachBatch(lambda b, _: got.extend(told(b))).start().awaitTermination()
    finally:
        spark.conf.set(STORE, kept)
    assert sorted(x for x in got if x[1] != "end") == wanted(rows, end + 80_000, 600)


def test_sketches_of_days_bound_the_rank(spark):
    """Small sketches over many samples: the quantile's rank is within their error; values up to the size are exact."""
    rows = spark.range(70_000).select(F.lit("k").alias("key"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 10 * 86_400).alias("ts"), (F.col("id") * 7919 % 70_001).cast("double").alias("value"))
    exact = {r["day"]: sorted(r["v"]) for r in rows.groupBy(F.to_date("ts").alias("day")).agg(F.collect_list("value").alias("v")).collect()}
    for size, most in ((200, 0.03), (4096, 0.002)):
        for r in metrics.over_days(metrics.daily(rows, ["key"], size), ["key"]).collect():
            own = sorted(v for day, vs in exact.items() if 0 <= (r["day"] - day).days < 7 for v in vs)
            assert abs(np.searchsorted(own, r["quantile"], "right") / len(own) - 0.95) <= most
            assert abs(r["average"] - np.mean(own)) < 1e-6
    assert metrics.daily(rows.limit(0), ["key"]).collect() == []


def test_rates_across_windows_and_resets(spark):
    rows = [("a", 0, 5.0), ("a", 600, 8.0), ("a", 900, 10.0), ("a", 1000, 3.0), ("a", 5000, 4.0), ("b", 10, 1.0), ("b", 10, 2.0), ("b", 20, None)]
    got = {(r["key"], r["s"]): r["increase"] for r in metrics.rates(frame(spark, rows), ["key"]).select("*", F.unix_seconds("start").alias("s")).collect()}
    assert got == {("a", 0): 3.0, ("a", 900): 5.0, ("a", 4500): 1.0, ("b", 0): 0.0}


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "priors")
    batches = [spark.createDataFrame([(k % 3, 1, float(k % 2)) for k in range(n)], "id long, n long, total double") for n in (10, 7, 5, 9)]
    for number, rows in enumerate(batches):
        refresh.merge(rows, number, path, ["id"], ["n", "total"])
        refresh.merge(rows, number, path, ["id"], ["n", "total"])  # replayed after it was finished
    # A crash while the last one was written: no mark of success, and half of the rows.
    (tmp_path / "priors" / "v-3" / "_SUCCESS").unlink()
    refresh.merge(batches[3], 3, path, ["id"], ["n", "total"])
    want = batches[0].union(batches[1]).union(batches[2]).union(batches[3]).groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    assert sorted(refresh.current(spark, path).collect()) == sorted(want.collect())
    assert refresh._snapshots(spark, path) == [2, 3]
    own = want.select(lifecycle.prior(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(0 < r["p"] < 1 for r in own)


def test_counters_of_a_stream_that_stops_and_goes_on(spark, tmp_path):
    path, state = str(tmp_path / "c"), str(tmp_path / "state")
    kind = "id long, n long"
    for k in range(3):
        spark.createDataFrame([(1, 1), (k, 2)], kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*"))
        refresh.keep_counters(stream, path, ["id"], ["n"], state).awaitTermination()
    assert {r["id"]: r["n"] for r in refresh.current(spark, path).collect()} == {0: 2, 1: 5, 2: 2}
    assert refresh.current(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_tree_scores_few_and_finds_most(spark, sf):
    """The registered index: at most 15 % of the rows scored exactly, 90 % of the true neighbours found."""
    from spindrift.plans import views as W
    from spindrift.plans.catalog import QUERIES

    d = f"/root/testdata/{sf}"
    exact = {(r["query_id"], r["id"]): round(r["score"], 9) for r in retrieval.dense_topk(W.chunk_vecs(spark, d), W.vec_queries(spark, d), 10, "chunk_id").collect()}
    got = {(r["query_id"], r["id"]): round(r["score"], 9) for r in QUERIES["ann_tree"](spark, d).collect()}
    assert len(got) == len(exact) and len(set(got) & set(exact)) / len(exact) >= 0.9
    assert all(exact[p] == got[p] for p in set(got) & set(exact))
    assert 64 / W.chunk_vecs(spark, d).count() <= 0.15


def clustered(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, 32)) * 3
    return [(k, (centres[k % 40] + rng.standard_normal(32)).tolist()) for k in range(n)]


def test_tree_opens_the_files_of_few_leaves(spark, tmp_path):
    """In vectors that lie in clusters a query looks into few leaves, and only their files are read; what is inserted later is found."""
    rows, path = clustered(spark, 3000), str(tmp_path / "index")
    make = lambda some: spark.createDataFrame(some, "id long, embedding array<double>")
    tree = tree_index.build(make(rows[:2500]), path, k=10)
    tree_index.insert(make([*rows[2500:], (9999, None)]), path)
    assert tree.probes < len(tree.leaves) / 4 and len(tree.levels) == 3
    again = tree_index.load(spark, path)
    assert again.probes == tree.probes and all((a == b).all() for x, y in zip(again.levels, tree.levels) for a, b in zip(x, y)) and (again.books == tree.books).all()
    queries = make(rows[:1] + rows[2990:2992]).withColumnRenamed("id", "query_id")
    found = tree_index.search(spark, path, queries, 10, refine=100)
    brute = retrieval.dense_topk(make(rows), queries, 10)
    pairs = lambda df: {(r["query_id"], r["id"]) for r in df.collect()}
    assert len(pairs(found) & pairs(brute)) >= 27 and {(q, q) for q in (0, 2990, 2991)} <= pairs(found)
    near = tree_index.candidates(spark, path, queries, 100, tree)
    leaves = near.select("leaf").distinct().count()
    assert leaves <= 3 * tree.probes < len(tree.leaves)
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/rows").collect()) == list(range(3000))


def test_tree_of_few_and_of_no_vectors(spark, tmp_path):
    one = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None)], "id long, embedding array<double>")
    path = str(tmp_path / "one")
    tree = tree_index.build(one, path)
    asked = spark.createDataFrame([(7, [1.0, 0.1, 0.0]), (8, None)], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["id"], r["rank"]) for r in tree_index.search(spark, path, asked, 5, tree=tree).filter("score IS NOT NULL").collect()] == [(7, 1, 1)]
    assert tree_index.search(spark, path, asked.filter("query_id = 8"), 5).collect() == []
    with pytest.raises(ValueError):
        tree_index.fit(one.limit(0))


def test_graph_finds_neighbours_by_few_scores(spark, tmp_path):
    """Vectors in clusters: nine tenths of the true neighbours for a tenth of a scan's scores; links are nearly all true."""
    rows, path = clustered(spark, 2000), str(tmp_path / "graph")
    vectors = spark.createDataFrame([*rows, (9999, None)], "id long, embedding array<double>")
    graph_index.build(vectors, path)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    true = np.argsort(-cosine, axis=1)[:, :10]
    graph = {r["id"]: set(r["links"]) for r in spark.read.parquet(f"{path}/graph").collect()}
    assert set(graph) == set(range(2000)) and all(len(n) <= 2 * graph_index.LINKS and k not in n for k, n in graph.items())
    assert np.mean([len(graph[k] & set(true[k])) / 10 for k in range(2000)]) > 0.9
    asked = vectors.filter("id % 40 < 5 AND id < 400").withColumnRenamed("id", "query_id")
    seen = graph_index.visited(spark, path, asked.unionByName(asked.limit(1).selectExpr("-1L AS query_id", "CAST(NULL AS array<double>) AS embedding")), width=24)
    found = {(r["query_id"], r["id"]) for r in retrieval.top(seen, 11).collect()}
    want = {(r["query_id"], r["id"]) for r in retrieval.dense_topk(vectors, asked, 11).collect()}
    assert len(found & want) / len(want) >= 0.9
    assert seen.count() == seen.select("query_id", "id").distinct().count() <= 0.12 * 2000 * asked.count()


def test_recall_of_the_registered_graph(spark):
    from spindrift.plans import views as W
    from spindrift.plans.catalog import QUERIES

    d = "/root/testdata/sf0.1"
    exact = {(r["query_id"], r["id"]) for r in retrieval.dense_topk(W.chunk_vecs(spark, d), W.vec_queries(spark, d), 10, "chunk_id").collect()}
    got = {(r["query_id"], r["id"]) for r in QUERIES["ann_graph"](spark, d).collect()}
    assert len(got) == len(exact) and len(got & exact) / len(exact) >= 0.9


def test_graph_of_few_vectors(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "id long, embedding array<double>")
    for name, rows in (("one", [(1, [1.0, 0.0])]), ("same", [(k, [0.6, 0.8]) for k in range(40)]), ("zero", [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])])):
        graph_index.build(make(rows), str(tmp_path / name))
        asked = make(rows[:1]).withColumnRenamed("id", "query_id")
        got = graph_index.search(spark, str(tmp_path / name), asked, 5).collect()
        assert len(got) == min(5, len(rows)) and spark.read.parquet(str(tmp_path / name / "graph")).count() == len(rows)
