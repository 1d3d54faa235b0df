"""Stored search vectors, versions of tables, changes by key."""

import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import lifecycle, retrieval, search_vectors
from spindrift.sources import markdown, snapshots

FIELDS = {"title": "A", "text": "D"}
WORDS = "plan plans planning river rivers the of and bank banks naïve café quick data".split()


def docs_of(seed, n=60):
    dice = random.Random(seed)
    say = lambda most: " ".join(dice.choices(WORDS, k=dice.randint(0, most)))
    return [(k, say(4), say(30)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, text string")


def held(df):
    return sorted((r["id"], r["lexeme"], tuple(r["places"]), tuple(r["weights"]), r["n_lexemes"]) for r in df.collect())


def built(spark, rows, config="english", fields=FIELDS):
    return sorted((r["id"], r["lexeme"], tuple(r["places"]), tuple(r["weights"]), r["n_lexemes"]) for r in search_vectors.vectors(rows, fields, config).filter("lexeme IS NOT NULL").collect())


@pytest.mark.parametrize("config", ["english", "simple"])
def test_updates_equal_a_rebuild(spark, tmp_path, config):
    path, rows = str(tmp_path / "v"), docs_of(1)
    search_vectors.write(search_vectors.vectors(frame(spark, rows), FIELDS, config), path)
    changed = [(k, t + " plan", None if k % 2 else x) for k, t, x in rows if k % 3 == 0]
    search_vectors.write(search_vectors.vectors(frame(spark, [*changed, (1000, "new rows", "banks")]), FIELDS, config), path)
    search_vectors.delete(spark.createDataFrame([(4,), (5,), (77,)], "id long"), path)
    now = {r[0]: r for r in [*rows, *changed, (1000, "new rows", "banks")] if r[0] not in (4, 5)}
    assert held(search_vectors.read(spark, path)) == built(spark, frame(spark, list(now.values())), config)
    search_vectors.compact(spark, path)
    assert search_vectors.segments(spark, path) == [3]
    assert held(search_vectors.read(spark, path)) == built(spark, frame(spark, list(now.values())), config)


def test_a_text_put_before_moves_places_on(spark, tmp_path):
    path, rows = str(tmp_path / "v"), docs_of(2, 30)
    search_vectors.write(search_vectors.vectors(frame(spark, rows), FIELDS), path)
    summaries = spark.createDataFrame([(k, "the data of a quick plan and" if k % 2 else "") for k in range(0, 40, 3)], "id long, summary string")
    search_vectors.put_before(summaries, path, "summary")
    told = {r["id"]: r["summary"] for r in summaries.collect()}
    both = spark.createDataFrame([(k, told.get(k), t, x) for k, t, x in rows] + [(k, s, None, None) for k, s in told.items() if k >= 30], "id long, summary string, title string, text string")
    assert held(search_vectors.read(spark, path)) == built(spark, both, fields={"summary": "B", **FIELDS})


def test_no_row_lacks_vectors_and_none_is_found_twice(spark, tmp_path):
    """Every row is spoken for, those without lexemes too, whichever way it came in."""
    path = str(tmp_path / "v")
    rows = [*docs_of(3, 20), (50, None, None), (51, "the of", "  ")]
    search_vectors.write(search_vectors.vectors(frame(spark, rows), FIELDS), path)
    spoken = sorted(r["id"] for n in search_vectors.segments(spark, path) for r in spark.read.parquet(f"{path}/seg-{n:06d}/rows").collect())
    assert spoken == sorted(r[0] for r in rows)
    search_vectors.write(search_vectors.vectors(frame(spark, [(50, "plan", None)]), FIELDS), path)
    asked = spark.createDataFrame([(1, "plan"), (2, "nothing here"), (3, None)], "query_id long, query string")
    got = [(r["query_id"], r["id"]) for r in search_vectors.search(spark, path, asked).collect()]
    assert (1, 50) in got and len(got) == len(set(got)) and {q for q, _ in got} == {1}


@pytest.mark.parametrize("few", [5000, 0])
def test_stored_search_finds_what_the_scan_finds(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(search_vectors, "_FEW", few)
    path, rows = str(tmp_path / "v"), frame(spark, docs_of(4, 200))
    search_vectors.write(search_vectors.vectors(rows, FIELDS), path)
    asked = spark.createDataFrame([(1, "the plan of a river"), (2, "naïve café"), (3, "quick banks data planning"), (4, "of the")], "query_id long, query string")
    want = sorted(retrieval.sparse_search(rows, asked, FIELDS, 25).collect())
    got = sorted(search_vectors.search(spark, path, asked, 25).collect())
    assert [(r["query_id"], r["id"], r["rank"]) for r in got] == [(r["query_id"], r["id"], r["rank"]) for r in want]
    assert all(abs(a["score"] - b["score"]) < 1e-9 for a, b in zip(got, want))


def test_only_the_buckets_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "v")
    search_vectors.write(search_vectors.vectors(frame(spark, docs_of(5)), FIELDS), path)
    plan = search_vectors.read(spark, path, ["plan"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("most", [500_000, 40, 8])
def test_summaries_go_in_front_block_by_block(spark, tmp_path, monkeypatch, most):
    """Whatever can be broadcast, the vectors equal a rebuild; rows that share an id stay together as before."""
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", most)
    path, rows = str(tmp_path / "v"), docs_of(9, 40)
    search_vectors.write(search_vectors.vectors(frame(spark, [*rows, (100, "river", "of"), (100, "river plan", "the")]), FIELDS), path)
    search_vectors.write(search_vectors.vectors(frame(spark, [r for r in rows if r[0] % 3 == 0]), FIELDS), path)
    told = {k: "the data of a plan" if k % 4 else "" for k in range(0, 50, 2)}
    search_vectors.put_before(spark.createDataFrame([*told.items(), (100, "plan")], "id long, summary string"), path, "summary")
    assert len(search_vectors.segments(spark, path)) == 3 if most > 40 else len(search_vectors.segments(spark, path)) > 3
    both = spark.createDataFrame([(k, told.get(k), t, x) for k, t, x in rows] + [(k, s, None, None) for k, s in told.items() if k >= 40], "id long, summary string, title string, text string")
    got = held(search_vectors.read(spark, path))
    assert [x for x in got if x[0] != 100] == built(spark, both, fields={"summary": "B", **FIELDS})
    assert [(x[1], x[2]) for x in got if x[0] == 100] == [("plan", (1, 3)), ("river", (2, 2))]


def test_postings_are_written_in_place_and_searched_by_one_shuffle(spark, tmp_path):
    """A task files what it makes; a search moves a posting once, not once for each query that asks for it."""
    path, rows = str(tmp_path / "v"), docs_of(10, 90)
    search_vectors.write(search_vectors.vectors(frame(spark, rows).repartition(3), FIELDS), path)
    search_vectors.write(search_vectors.vectors(frame(spark, [(k, "plan", None) for k in range(0, 90, 9)]), FIELDS), path)
    search_vectors.delete(spark.createDataFrame([(1,), (18,)], "id long"), path)
    files = [len(list(b.glob("*.parquet"))) for b in (tmp_path / "v/seg-000000/postings").iterdir() if b.is_dir()]
    assert max(files) == 3
    asked = spark.createDataFrame([(q, f"plan river {WORDS[q % len(WORDS)]} bank") for q in range(30)] + [(30, None), (31, "nowhere")], "query_id long, query string")
    found = search_vectors.search(spark, path, asked, 15)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "hashpartitioning(id#" in plan and "hashpartitioning(query_id#" in plan and plan.count("Exchange hashpartitioning") == 2
    now = {r[0]: r for r in [*rows, *((k, "plan", None) for k in range(0, 90, 9))] if r[0] not in (1, 18)}
    want = retrieval.sparse_search(frame(spark, list(now.values())), asked, FIELDS, 15)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect()) == sorted((r["query_id"], r["rank"], r["id"]) for r in want.collect())
    assert search_vectors.search(spark, path, asked.filter("query_id = 30"), 15).collect() == []


def test_an_unfinished_segment_is_not_read(spark, tmp_path):
    path, rows = str(tmp_path / "v"), frame(spark, docs_of(6, 10))
    search_vectors.write(search_vectors.vectors(rows, FIELDS), path)
    want = held(search_vectors.read(spark, path))
    search_vectors.write(search_vectors.vectors(frame(spark, [(1, "lost", "lost")]), FIELDS), path)
    (tmp_path / "v" / "seg-000001" / "rows" / "_SUCCESS").unlink()
    assert search_vectors.segments(spark, path) == [0] and held(search_vectors.read(spark, path)) == want
    search_vectors.write(search_vectors.vectors(frame(spark, [(1, "found", None)]), FIELDS), path)
    assert {x[1] for x in held(search_vectors.read(spark, path)) if x[0] == 1} == {"found"}


def test_partial_updates_keep_vectors_and_hash_in_step(spark, tmp_path):
    path, rows = str(tmp_path / "v"), frame(spark, docs_of(7, 12)).withColumn("content_hash", X.content_hash("text"))
    search_vectors.write(search_vectors.vectors(rows, FIELDS), path)
    changes = spark.createDataFrame([(1, "A new title", None), (2, None, "new text"), (3, None, None), (99, "nobody", None)], "id long, title string, text string")
    after = search_vectors.update_rows(rows, changes, path, FIELDS, "text")
    before, now = ({r["id"]: r for r in x.collect()} for x in (rows, after))
    assert set(now) == set(before) and now[1]["title"] == "A new title" and now[1]["text"] == before[1]["text"] and now[2]["text"] == "new text" and now[3] == before[3]
    assert all(r["content_hash"] == X_hash(r["text"]) for r in now.values())
    assert held(search_vectors.read(spark, path)) == built(spark, after)


def X_hash(text):
    import hashlib

    return hashlib.sha256((text or "").encode()).hexdigest()[:16]


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "table")
    assert snapshots.version(spark, path) == 0
    first = snapshots.commit(spark.range(3), path, 0)
    seen = snapshots.version(spark, path)
    assert snapshots.commit(spark.range(5), path, seen) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark.range(9), path, seen)
    assert snapshots.read(spark, path).count() == 5 and snapshots.read(spark, path, first).count() == 3
    with pytest.raises(ValueError):
        snapshots.read(spark, str(tmp_path / "none"))


def test_writers_that_meet_at_the_pointer(spark, tmp_path, monkeypatch):
    """Both have seen version 1 when they start to write: one gets on, the other's rows go."""
    path = str(tmp_path / "table")
    snapshots.commit(spark.range(1), path, 0)
    snapshots.commit(spark.range(2), path, 1)
    monkeypatch.setattr(snapshots, "version", lambda *_: 1)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark.range(9), path, 1)
    monkeypatch.undo()
    assert snapshots.read(spark, path).count() == 2
    assert len([x for x in (tmp_path / "table").iterdir() if x.name.startswith("data-")]) == 2


def test_named_ids_are_those_of_the_standard(spark):
    names = ["skill:a", "", "prompt:é 東京", "x" * 200]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", lifecycle.named_id(F.col("n")).alias("id")).collect()
    assert all(r["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in got)


def test_changes_by_key(spark):
    old = spark.createDataFrame([("a", "1", 3, "public", X_hash("same")), ("b", "2", 1, "public", "x"), ("c", "3", 1, "public", "x"), ("d", "4", 2, "private", "x"), ("e", "5", 2, "private", None)], "tag string, id string, version long, source string, content_hash string")
    new = spark.createDataFrame([("a", "same"), ("b", "other"), ("e", "taken over"), ("f", "fresh")], "tag string, text string")
    got = {r["tag"]: (r["change"], r["version"], r["source"]) for r in lifecycle.upsert_named(old, new, "tag", "skill").collect()}
    assert got == {"a": ("same", 4, "public"), "b": ("updated", 2, "public"), "c": ("pruned", None, "public"), "d": ("kept", 2, "private"), "e": ("updated", 3, "public"), "f": ("inserted", 1, "public")}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["---\n", "a: 1\n", "```", "```py\n", "\n```", "prose", "\n", "é", "`"]), max_size=14))
def test_segments_are_the_whole_text(spark, parts):
    import re

    text = "".join(parts)
    got = [(s["kind"], s["text"]) for s in spark.createDataFrame([(text,)], "t string").select(X.segments("t").alias("s")).first()["s"]]
    assert "".join(t for _, t in got) == text
    front = re.match(r"---\n.*?\n---\n?", text, re.S)
    fenced = re.findall(r"```.*?\n.*?\n```", text[front.end() if front else 0 :], re.S)
    assert [t for k, t in got if k != "prose"] == ([front[0]] if front else []) + fenced


def test_front_matter_is_protected(spark):
    pairs = [("---\ntitle: Foo\n---\nOne.\n", "---\ntitle: Bar\n---\nOne.\n"), ("---\ntitle: Foo\n---\nOne.\n", "---\ntitle: Foo\n---\nTwo.\n"), ("a ```x\n1\n``` b", "c ```x\n1\n``` d"), ("a ```x\n1\n``` b", "a ```x\n2\n``` b"), (None, None), ("---\na\n---\n", "")]
    got = spark.createDataFrame(pairs, "b string, a string").select(X.same_fences("b", "a").alias("same")).collect()
    assert [r["same"] for r in got] == [False, True, True, False, True, False]


def test_repeated_keys_and_faults(spark):
    raw = [("twice", "---\ndomain: a\nDomain: b\n---\nbody"), ("open", "---\ndomain: a\nbody"), ("empty", "---\ndomain: a\n---\n  "), ("good", "---\ntask type: x\n---\nbody"), ("none", None)]
    files = spark.createDataFrame(raw, "title string, raw string")
    assert {r["title"]: r["domain"] for r in markdown.parse(files).collect()} == {"twice": ["b"], "open": [], "good": []}
    assert {(r["title"], r["fault"]) for r in markdown.faults(files).collect()} == {("twice", "repeated key: domain"), ("open", "front matter without an end"), ("empty", "no body"), ("none", "no body")}


def test_a_vault_of_folders(spark, tmp_path):
    from spindrift.sources import vault

    def put(path, content):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else content.encode())

    put("finance/cash plan-b.md", "---\ndomain: finance, odd\n---\nPlan cash: 50% + more.")
    put("finance/notes.txt", "no markdown")
    put("finance/deep/x.md", "too deep")
    put("ops/empty.md", "---\ndomain: a\n---\n")
    put("ops/Clippings-x.md", "skipped")
    put("ops/bytes.md", b"\xff\xfe\x00")
    put("ops/twice.md", "---\ndomain: ops\ndomain: finance\n---\nBody.")
    put("skills/s/index.md", "not a department")
    files = vault.scan(spark, str(tmp_path))
    rows, faults = vault.prompts(files, {"domain": ["finance", "ops"]})
    got = {r["path"]: r for r in rows.collect()}
    assert set(got) == {"finance/cash plan-b.md", "ops/twice.md"}
    first = got["finance/cash plan-b.md"]
    assert (first["department"], first["title"], first["tag"], first["domain"], first["prompt_text"]) == ("finance", "Cash Plan B", "cash-plan-b", ["finance"], "Plan cash: 50% + more.")
    assert got["ops/twice.md"]["domain"] == ["finance"]
    assert {(r["path"], r["fault"]) for r in faults.collect()} == {("ops/empty.md", "no body"), ("ops/bytes.md", "not text"), ("ops/twice.md", "repeated key: domain")}


def test_skill_folders(spark, tmp_path):
    from spindrift.sources import vault

    index = "---\nname: Launch\nsummary: Do it\ndomain: [ops]\nfiles:\n  - path: b.py\n    type: code\n    language: python\n    description: runs\n  - path: gone.md\n  - path: sub/a.md\ntag: go\n---\n## Overview\nWhat it is.\n## When to Use\nNow.\n### Detail\n## Other\nx\n## How to Use\nSo.\n"
    for path, content in {"go-live/index.md": index, "go-live/b.py": "x = 1\n", "go-live/sub/a.md": "---\nk: v\n---\nInside.", "go-live/z.yml": "a: 1", "go-live/a.md": "Text.", "go-live/sub/unlisted.md": "no", "bare/x.md": "no index", "plain/index.md": "no front matter"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    skills, files, faults = vault.skills(vault.scan(spark, str(tmp_path)))
    got = {r["folder"]: r for r in skills.collect()}
    assert set(got) == {"go-live", "plain"}
    go = got["go-live"]
    assert (go["tag"], go["name"], go["overview"], go["when_to_use"], go["how_to_use"], go["domain"]) == ("go", "Launch", "What it is.", "Now.\n### Detail", "So.", ["ops"])
    assert (got["plain"]["tag"], got["plain"]["name"], got["plain"]["status"]) == ("plain", "Plain", "active")
    assert [(r["path"], r["type"], r["language"], r["description"], r["content"], r["listed"]) for r in files.orderBy(F.col("place").asc_nulls_last(), "path").collect()] == [
        ("b.py", "code", "python", "runs", "x = 1\n", True), ("sub/a.md", "prompt", None, "", "Inside.", True), ("a.md", "prompt", None, "", "Text.", False), ("z.yml", "config", "yaml", "", "a: 1", False),
    ]
    assert {(r["path"], r["fault"]) for r in faults.collect()} == {("bare", "no index"), ("go-live/gone.md", "listed, not there")}
    held = spark.createDataFrame([("go", "Old", "Do it", ["ops"], None, None), ("kept", "K", "S", None, None, None), ("plain", "Plain", "said", ["x"], [], [])], "tag string, name string, summary string, domain array<string>, intent array<string>, task_type array<string>")
    after = {r["tag"]: r for r in vault.import_skills(skills, held).collect()}
    assert {t: r["action"] for t, r in after.items()} == {"go": "updated", "kept": "kept", "plain": "same"}
    assert (after["go"]["name"], after["plain"]["summary"], after["plain"]["domain"]) == ("Launch", "said", ["x"])
