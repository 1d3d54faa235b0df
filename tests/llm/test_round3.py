"""Importance draw, spelling variants, Lempel-Ziv fingerprints."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import common, phrases, queries, resampling, spelling

from .helpers import LONG, TEXTS, awkward, empty

D = "/root/testdata/sf0.001"
N = len(TEXTS) + 3


@given(st.lists(st.lists(st.integers(-9, 9)), max_size=9))
def test_tournament_is_a_merge(runs):
    assert list(resampling.tournament([iter(sorted(r)) for r in runs])) == sorted(x for r in runs for x in r)


@given(st.text())
def test_buckets_are_those_of_whole_features(text):
    words = "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text).split(" ")
    words = [w for w in words if w]
    n, at = resampling.buckets(text.encode())
    assert n == len(words) and at.tolist() == [crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain_draw(rows, percent, least):
    may = sorted((-r["score"], r["id"] is None, r["id"] or 0) for r in rows if r["n_words"] >= least)
    return may[: percent * len(may) // 100]


@pytest.mark.parametrize("percent", [0, 1, 25, 60, 100])
def test_draw_over_many_runs(spark, monkeypatch, percent):
    """Runs that a task cuts in several, blocks of few rows, many ranges, ties of score, null ids."""
    monkeypatch.setattr(resampling, "RUN_ROWS", 300)
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 7)
    monkeypatch.setattr(resampling, "RANGE_ROWS", 50)
    dice = random.Random(percent)
    rows = [(None if k % 50 == 7 else k, 2 * k, dice.randint(-5, 5), dice.randint(-20, 20), dice.randint(15, 40)) for k in range(3000)]
    scored = spark.createDataFrame(rows, "id long, n_features long, weight long, score long, n_words long").repartition(5)
    got = resampling.draw(scored, percent).collect()
    assert sorted(r["n_features"] for r in got) == [r[1] for r in rows]
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    want = plain_draw(scored.collect(), percent, 20)
    assert [r["rank"] for r in ranked] == list(range(1, len(want) + 1))
    assert [(-r["score"], r["id"] is None, r["id"] or 0) for r in ranked] == want


def test_rows_that_repeat_are_dealt_over_ranges(spark):
    """A third of the rows alike: no range holds them all, and each is drawn or not by itself."""
    rows = [(1, 3, 0, 50, 30)] * 2000 + [(k, 3, 0, k % 90, 30) for k in range(2, 4000)]
    scored = common.cut(spark.createDataFrame(rows, "id long, n_features long, weight long, score long, n_words long").repartition(8).withColumn("run", F.spark_partition_id()))
    bounds = resampling._bounds(scored, len(rows))
    sizes = resampling._runs(scored, bounds, 20).groupBy("range").agg(F.sum(F.size("score")).alias("n")).toPandas()["n"]
    assert sizes.sum() == len(rows) and sizes.max() < 2000
    got = resampling.draw(scored.drop("run"), 50).toPandas()
    assert sorted(got["rank"].dropna()) == list(range(1, len(rows) // 2 + 1)) and (got["id"] == 1).sum() == 2000


def test_draw_keeps_text_ids(spark):
    scored = spark.createDataFrame([("b", 1, 0, 5, 30), ("a", 1, 0, 5, 30), (None, 1, 0, 5, 30), ("c", 1, 0, 9, 3)], "id string, n_features long, weight long, score long, n_words long")
    assert {(r["id"], r["rank"]) for r in resampling.draw(scored, 100).collect()} == {("a", 1), ("b", 2), (None, 3), ("c", None)}


def test_the_draw_leans_to_the_target(spark, sf_dir):
    """Texts that hold passages of the target are drawn more often than others."""
    got = queries.op11_resampling(spark, sf_dir).toPandas().set_index("doc_id")
    held = queries.op8_decontaminate(spark, sf_dir).toPandas().set_index("doc_id")["contaminated"]
    assert got["weight"][held].mean() > got["weight"][~held].mean()


def test_draw_of_awkward_rows(spark):
    docs = awkward(spark)
    target = docs.select("text").limit(3)
    got = resampling.resample(docs, target, least=1, percent=100).toPandas()
    assert len(got) == N and list(got.columns) == ["doc_id", "n_features", "weight", "score", "rank"]
    none = got[got["n_features"] == 0]
    assert len(none) == sum(not resampling.buckets((t or "").encode())[0] for t in TEXTS) and (none["weight"] == 0).all() and none["rank"].isna().all()
    assert sorted(got["rank"].dropna()) == list(range(1, N - len(none) + 1))
    assert resampling.resample(docs, docs.limit(0)).count() == N
    assert resampling.resample(empty(spark), target).collect() == []


def edits(a, b):
    """Levenshtein distance, plainly."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_edit(a, b):
    if len(b) in (len(a), len(a) + 1):
        assert spelling.one_edit(a, b) == (edits(a, b) == 1)


@pytest.mark.parametrize("hot, few, shard", [(1000, 16, 50_000), (4, 2, 40), (8, 1000, 100)])
def test_near_words_against_all_pairs(spark, monkeypatch, hot, few, shard):
    """Also with halves that many words share, halved again and again, and with many shards."""
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "FEW", few)
    monkeypatch.setattr(spelling, "SHARD_ROWS", shard)
    dice = random.Random(hot)
    words = {"inter" + "".join(dice.choices("abé", k=dice.randint(1, 5))) for _ in range(150)}
    words |= {"".join(dice.choices("ab", k=dice.randint(5, 8))) for _ in range(60)} | {"aaaaa" + c for c in "abcdefghijklmnopqrstuvwxyz"}
    n = {w: dice.randint(3, 9) for w in sorted(words)}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in n}
    got = {r["word"]: r for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert set(got) == {w for w, v in near.items() if v}
    for w, r in got.items():
        assert r["n_near"] == len(near[w]) and (-r["best_n"], r["best"]) == min((-n[v], v) for v in near[w])


def test_roots_follow_forms(spark):
    forms = spark.createDataFrame([(str(k), str(k + 1) if k < 40 else None) for k in range(41)] + [("x", "y"), ("y", None)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {**{str(k): "40" for k in range(40)}, "x": "y"}


def test_variants(spark):
    docs = spark.createDataFrame([(1, "Colour colour COLOUR color colour, coloured? É École école"), (2, "colour colour color color"), (3, "x" * 4 + " étés " * 3), (4, None), (None, "color colours colours colours")], "doc_id long, text string")
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(docs, every=1 << 40).collect()}
    assert got == {"colour": (None, "colour", 6, 2, None), "color": (None, "color", 4, 1, None), "colours": ("colour", "colour", 3, 1, 6)}
    assert {r["word"] for r in spelling.variants(docs, every=1).collect()} <= {"colou", "color", "colur", "coour", "clour", "olour"} | {"colours"[:k] + "colours"[k + 1 :] for k in range(7)}


def test_variants_of_awkward_rows(spark):
    docs = awkward(spark).withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = {r["word"]: r["n"] for r in spelling.variants(docs, least=2).collect()}
    assert got["again"] == 2 * 4000 and got["river"] == 3
    assert spelling.variants(empty(spark)).collect() == []


def plain_fingerprint(text):
    known, piece = set(), b""
    for c in text.encode():
        piece += bytes([c])
        if piece not in known:
            known.add(piece)
            piece = b""
    return sorted(set(map(plain_hash, known)))[:64]


def plain_hash(phrase):
    h = 1
    for c in phrase:
        h = (h * 1_000_003 ^ c) % (1 << 40)
    h = h * 0x9E3779B97F4A7C15 % (1 << 64)
    return (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % (1 << 64) >> 32


def plain_likeness(a, b):
    both = sorted(set(a) | set(b))[:64]
    return 1.0 if a == b else sum(x in a and x in b for x in both) / len(both)


@pytest.mark.parametrize("parts", [1, 4, 200])
def test_fingerprints_against_a_plain_walk(spark, sf_dir, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["doc_id"]: r for r in queries.op13_phrases(spark, sf_dir).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    docs = sorted((r["doc_id"], r["text"]) for r in queries.read(spark, sf_dir, "documents").collect())
    assert len(got) == len(docs)
    for (key, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        q, r = len(text) // 4, got[key]
        edited = text[: len(text) - q] + after[:q]
        a, b, c = map(plain_fingerprint, (text, edited, after))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in a) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in b)
        assert (r["near_edited"], r["near_next"]) == (plain_likeness(a, b), plain_likeness(a, c))


def test_likeness_estimates_the_shared_part():
    dice = random.Random(3)
    off = []
    for _ in range(60):
        pool = dice.sample(range(1 << 32), 900)
        a, b = set(pool[:600]), set(pool[300:])
        off.append(phrases.likeness(*(phrases.signature(np.array(sorted(x)[:64])) for x in (a, b))) - 300 / 900)
    assert abs(np.mean(off)) < 0.03 and max(map(abs, off)) < 0.25
    assert phrases.likeness("", "") == 1.0 and phrases.likeness("", "00000001") == 0.0


def test_edited_copies_are_nearer_than_neighbours(spark):
    got = queries.op13_phrases(spark, "/root/testdata/sf0.01").toPandas()
    long = got[got["n_chars"] >= 200]
    assert (long["near_edited"] > long["near_next"]).mean() > 0.99


def test_fingerprints_of_awkward_rows(spark):
    docs = awkward(spark).withColumn("text_next", F.lit("clash")).withColumn("fingerprint", F.lit("clash")).withColumn("range", F.lit("clash"))
    got = phrases.compare(docs).toPandas()
    assert len(got) == N and list(got.columns) == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert (got["fingerprint"][got["n_chars"] == 0] == "").all() and len(LONG) in set(got["n_chars"])
    assert got.sort_values("n_chars").groupby(got["n_chars"])["fingerprint"].nunique()[len(TEXTS[0])] == 1
    assert phrases.compare(empty(spark)).collect() == []
    one = phrases.compare(spark.createDataFrame([("k", "a text that follows itself")], "doc_id string, text string")).first()
    assert one["doc_id"] == "k" and one["near_next"] == 1.0
    nulls = phrases.compare(spark.createDataFrame([(None, None), (None, None), (None, "abc")], "doc_id long, text string"))
    assert sorted(r["n_chars"] for r in nulls.collect()) == [0, 0, 3]
