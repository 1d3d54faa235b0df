import pytest
from pyspark.sql import functions as F

from spindrift.functions import plugins
from spindrift.operators import chains, evaluation, maintenance
from spindrift.plans.engine import Engine

PROMPTS = [
    (1, "Launch plan", "plan a product launch with milestones and owners for [PRODUCT NAME]", None, ["product"], "active"),
    (2, "Churn review", "review churn and retention by cohort", None, ["business"], "active"),
    (3, "Image gen art", "generate an image of a launch plan", None, ["product"], "active"),
    (4, "Old launch plan", "plan a product launch", None, ["product"], "inactive"),
]


@pytest.fixture(scope="module")
def engine(spark):
    p = spark.createDataFrame(PROMPTS, "id long, title string, prompt_text string, summary string, domain array<string>, status string")
    vectors = p.select("id", (F.col("id") * 10).alias("chunk_id"), plugins.embed(64)("prompt_text").alias("embedding"))
    steps = spark.createDataFrame([(100, 1), (100, 2), (200, 2)], "skill_id long, id long")
    return Engine(p, vectors, steps, embedder=plugins.embed(64))


def _queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_search_keeps_to_active_rows_and_hides_images(spark, engine):
    got = engine.search(_queries(spark, "plan a product launch", "generate a launch image"))
    rows = {(r["query_id"], r["id"]) for r in got.collect()}
    assert (0, 1) in rows and (0, 3) not in rows and (1, 3) in rows and not any(i == 4 for _, i in rows)
    only = engine.search(_queries(spark, "plan a product launch"), domain=["business"]).collect()
    assert {r["id"] for r in only} == {2}


def test_find_and_route(spark, engine):
    got = engine.find(_queries(spark, "plan a product launch"), floor=0.9).first()
    assert got["mode"] in ("single", "skill") and got["score"] >= 0.9
    single = engine.find(_queries(spark, "plan a product launch"), prefer="single", floor=0.9).first()
    assert (single["mode"], single["served_id"]) == ("single", 1)
    none = engine.find(_queries(spark, "zebra quantum violin"), floor=0.9).first()
    assert none["mode"] == "none" and none["served_id"] is None
    routed = engine.route(_queries(spark, "plan a product launch"), F.create_map(F.lit("product name"), F.lit("Rocket"))).first()
    assert routed["mode"] in ("skill", "single", "none")


def test_embedding_upkeep(spark):
    rows = [(1, "T", "some text", None, None), (2, "U", " ", None, None), (3, "V", "kept", [1.0], "old")]
    p = spark.createDataFrame(rows, "id long, title string, prompt_text string, embedding array<float>, embedding_version string")
    got = {r["id"]: r for r in maintenance.embed_missing(p, "new", size=4).collect()}
    assert len(got[1]["embedding"]) == 4 and got[2]["embedding"] is None and got[3]["embedding_version"] == "old"
    with pytest.raises(ValueError):
        maintenance.check_version(p, "new")
    maintenance.check_version(p.limit(0), "new")
    assert maintenance.change_width(p, 4).filter("embedding IS NOT NULL").count() == 0


def test_latest_version_of_a_tag(spark):
    skills = spark.createDataFrame([("00000000-0000-0000-0000-000000000001", "a", 1), ("00000000-0000-0000-0000-000000000002", "a", 2)], "skill_id string, tag string, version int")
    assert maintenance.by_id_or_tag(skills, "a").first()["version"] == 2
    assert maintenance.by_id_or_tag(skills, "00000000-0000-0000-0000-000000000001").first()["version"] == 1


def test_beam_search_is_best_first(spark):
    scored = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.9), (0, 3, 0.1)], "query_id long, id long, score double")
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 1, -2.0), (2, 3, 0.2), (3, 1, 0.0)], "prev long, id long, fit double")
    best = chains.beam_search(scored, pairs, longest=3).orderBy(F.desc("score")).first()
    assert best["path"] == [1, 2, 3] and best["score"] == pytest.approx(2.7)


def test_precision(spark):
    hits = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id long, id long, rank int")
    gold = spark.createDataFrame([(0, 2), (0, 9)], "query_id long, gold_id long")
    assert evaluation.precision(hits, gold, 2).first()["precision"] == 0.5
