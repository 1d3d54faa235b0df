import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import common, decontaminate, line_dedup, queries, simhash

from ..oracle import spark_rows, sql_rows, views
from .helpers import LONG, TEXTS, awkward, empty

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, D)) == sql_rows(views(D), queries.ORACLE_SQL[name])


def test_stages(spark):
    docs = queries.read(spark, D, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D).cache()
        got = out.collect()
        assert {r["doc_id"] for r in got} <= set(rows) and len(got) == len({r["doc_id"] for r in got})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert all(r["n_chars"] == len(r["text"]) for r in got)
            rows, docs = {r["doc_id"]: r for r in got}, out
        else:
            assert len(got) == len(rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_repeated_ids_in_near_duplicates(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "quite another text here"), (2, "a b c d e"), (None, "lone text of null id"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(corpus_pipeline.near_duplicates(spark, docs, D).collect(), key=str)
    assert {(r["doc_id"], r["text"]) for r in got} == {(1, "a b c d e"), (1, "quite another text here"), (None, "lone text of null id"), (3, None)} and len(got) == 4


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name, stage):
    """Null, empty, very long and repeated rows, and columns that clash with a stage's own."""
    docs = awkward(spark).cache()
    out = stage(spark, docs, D)
    got = out.collect()
    assert len(stage(spark, empty(spark), D).collect()) == 0
    if name == "bpe":
        assert len(got) == len(TEXTS) + 3 and sum(r["n_tokens"] == 0 for r in got) == 2
        return
    assert out.columns == docs.columns and all(r["fp"] == "clash" for r in got)
    texts = [r["text"] for r in got]
    assert None in texts or name == "simhash near-dedup"
    if name == "line dedup":
        assert len(got) == len(TEXTS) + 3 and LONG in texts and all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    if name == "simhash near-dedup":
        assert len(got) == len({(r["doc_id"], r["text"]) for r in got}) and texts.count(TEXTS[0]) == 1 and LONG in texts
    if name == "benchmark decontamination":
        assert len(got) == len(TEXTS) + 3


def test_shuffled_sides_give_the_same(spark, monkeypatch):
    """What is broadcast while it is small, joined by shuffles."""
    docs = queries.read(spark, "/root/testdata/sf0.001", "documents")
    items = queries.read(spark, "/root/testdata/sf0.001", "benchmark")
    ways = {
        "lines": lambda: line_dedup.dedup(docs).select("doc_id", "text"),
        "documents": lambda: decontaminate.remove_documents(docs, items).select("doc_id"),
        "spans": lambda: decontaminate.remove_spans(docs, items).select("doc_id", "text"),
        "near": lambda: corpus_pipeline.near_duplicates(spark, docs, D).select("doc_id"),
        "groups": lambda: simhash.near_duplicates(docs),
    }
    near = {k: sorted(w().collect()) for k, w in ways.items()}
    for module in (common, line_dedup, decontaminate, simhash, corpus_pipeline):
        monkeypatch.setattr(module, "small", lambda df, rows=0: df)
    with_shuffles = {k: sorted(w().collect()) for k, w in ways.items()}
    assert near == with_shuffles


def test_stage_folders_go(spark):
    with common.stage_folder(spark, "t") as (folder, remove):
        spark.range(3).write.parquet(f"{folder}/0")
        remove(f"{folder}/0")
        with pytest.raises(Exception):
            spark.read.parquet(f"{folder}/0").count()
