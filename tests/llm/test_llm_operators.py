"""Each operator on awkward rows, on empty tables, and against a plain version of itself."""

import html
import html.parser
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import bpe, decontaminate, html_text, language_id, line_dedup, quality_knn, quality_rules, queries, sharding, simhash, toxicity

from .helpers import TEXTS, awkward, empty

N = len(TEXTS) + 3


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


# --- sharding ---------------------------------------------------------------------------------


def brute_shard(key, weights):
    draw = lambda i: ((xxhash.xxh64_intdigest(f"{key}/{i}", 42) >> 11) + 0.5) / 2**53
    return max(range(len(weights)), key=lambda i: (-weights[i] / np.log(draw(i)), -i))


def test_sharding(spark, docs):
    rows = sharding.shard(docs).collect()
    assert len(rows) == N
    for r in rows:
        assert r["shard"] == brute_shard("" if r["doc_id"] is None else r["doc_id"], [1.0] * 16)
        assert r["grown_shard"] in (r["shard"], 16)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    one = next(r for r in rows if r["doc_id"] == 6)
    raw = TEXTS[6].encode()
    assert (one["size"], one["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert next(r["size"] for r in rows if r["doc_id"] == 3) == 1
    assert sharding.shard(empty(spark)).count() == 0


def test_rows_that_repeat_without_end(spark):
    hot = spark.range(0, 40_000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = sharding.shard(hot)
    assert got.agg(F.count_distinct("slot"), F.min("slot"), F.max("slot"), F.count_distinct("shard")).first() == (40_000, 0, 39_999, 1)
    items = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    scanned = decontaminate.scan(hot, items)
    assert scanned.count() == 40_000 and scanned.filter("n_words <> 0 OR contaminated").count() == 0
    judged = quality_rules.judge(hot)
    assert judged.count() == 40_000 and judged.filter("kept").count() == 0


def test_weighted_shards(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    share = {r["shard"]: r["count"] for r in sharding.shard(ids, (3.0, 1.0)).groupBy("shard").count().collect()}
    assert 0.7 < share[0] / 4000 < 0.8
    with pytest.raises(ValueError):
        sharding.shard(ids, (1.0, 0.0))


# --- simhash ----------------------------------------------------------------------------------


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    for r in simhash.near_duplicates(docs).collect():
        if r["doc_id"] is not None and r["doc_id"] not in (4, 5):
            assert r["fingerprint"] == f"{brute_fp(TEXTS[r['doc_id']]):016x}"


def test_near_duplicates_of_awkward_rows(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == N
    name = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] != 4}
    assert name[1] == 0 and name[2] == name[3] == 2
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("blocks, chunk", [(5, 512), (5, 8), (6, 16), (8, 512)])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, blocks, chunk):
    rng = np.random.default_rng(blocks * chunk)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    noise = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, (400, 3), dtype=np.uint64), axis=1)
    near = seeds[rng.integers(0, 8, 400)] ^ noise  # eight dense clusters
    codes = np.unique(np.concatenate([seeds, near, [np.uint64(0), ~np.uint64(0)]]))
    monkeypatch.setattr(simhash, "blocks_for", lambda n, distance=4: blocks)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "DENSE", 2)
    rows = [(int(c), i) for i, c in enumerate(codes.view(np.int64).tolist())]
    nodes = spark.createDataFrame([(c, i) for (c, i) in zip(codes.view(np.int64).tolist(), range(len(codes)))], "node long, label long")
    edges = simhash.links(nodes.select(F.col("node").alias("fp")))
    got = {r["node"]: r["label"] for r in simhash.components(nodes, edges).collect()}
    label = list(range(len(codes)))
    close = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    changed = True
    while changed:
        changed = False
        for i in range(len(codes)):
            low = min(label[j] for j in np.flatnonzero(close[i]))
            changed |= low < label[i]
            label[i] = low
    assert got == {int(c): label[i] for i, c in enumerate(codes.view(np.int64))}
    assert len(rows) == len(got)


def test_dense_roots_are_refined(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "DENSE", 2)
    rng = np.random.default_rng(11)
    low = rng.integers(0, 2**44, 1500, dtype=np.uint64)  # all under one root of five blocks
    codes = np.unique(np.concatenate([low, low[:300] ^ (np.uint64(1) << rng.integers(0, 44, 300, dtype=np.uint64))]))
    df = spark.createDataFrame([(c,) for c in codes.view(np.int64).tolist()], "fp long")
    pairs = {}
    monkeypatch.setattr(simhash, "_pairs", lambda rows, sizes, own=simhash._pairs: pairs.setdefault(len(pairs), own(rows, sizes)))
    got = {(min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in simhash.links(df).collect()}
    close = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    want = {tuple(sorted((int(codes[i].view(np.int64)), int(codes[j].view(np.int64))))) for i, j in zip(*np.nonzero(np.triu(close, 1)))}
    assert got <= want and len(pairs) > 1

    def parts(edges):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(x for x in root if find(x) == r) for r in {find(x) for x in root}}

    assert parts(got) == parts(want)


def test_gray_index_search():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 2**20, 700, dtype=np.uint64))
    q, hit = simhash.GrayIndex(codes).search(codes[:50], 3)
    want = {(i, j) for i in range(50) for j in range(len(codes)) if (int(codes[i]) ^ int(codes[j])).bit_count() <= 3}
    assert set(zip(q.tolist(), hit.tolist())) == want
    rank = simhash.gray_rank(np.arange(1024, dtype=np.uint64))
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in zip(np.argsort(rank), np.argsort(rank)[1:]))


def test_more_blocks_for_more_fingerprints():
    assert [simhash.blocks_for(n) for n in (1, 10**6, 10**8, 3 * 10**10)] == sorted(simhash.blocks_for(n) for n in (1, 10**6, 10**8, 3 * 10**10))
    assert simhash.blocks_for(10**12) == 8


# --- line dedup -------------------------------------------------------------------------------


def test_line_dedup(spark, docs):
    line = "This very line is on many of the sites."
    rows = [(i, f"own text number {i} is here\n{line}\n{line}", f"s{i % 4}") for i in range(8)] + [(8, None, None), (9, line, None), (10, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("place", F.lit("kept"))
    got = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    assert got[0]["text"] == f"own text number 0 is here\n{line}" and got[0]["__n_removed"] == 1
    assert all(got[i]["text"] == f"own text number {i} is here" for i in range(1, 8))
    assert got[8]["text"] is None and got[8]["__n_lines"] == 0
    assert got[9]["text"] == "" and got[10]["text"] == "" and got[10]["__n_lines"] == 1
    assert got[0]["place"] == "kept"
    assert line_dedup.dedup(docs).count() == N and line_dedup.dedup(empty(spark)).count() == 0


def test_sites_at_the_threshold_are_counted_exactly(spark):
    rows = [(i * 10 + j, f"line number {i} that is long enough", f"site{j}") for i in range(1, 7) for j in range(i)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = Counter(r["doc_id"] // 10 for r in line_dedup.dedup(df, min_sites=4).collect() if r["__n_removed"])
    assert gone == {4: 3, 5: 4, 6: 5}


# --- decontamination --------------------------------------------------------------------------


def brute_hits(text, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    w, hit, named = cut(text), set(), set()
    for k, t in items:
        x = cut(t)
        size = min(n, len(x))
        grams = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                named.add(k)
    return len(w), len(hit), sorted(named)


ITEMS = [(1, "Long words in a very long text, again and again. Long words in"), (2, "ONE"), (3, None), (4, "..."), (5, "the old hall and then"), (6, "cafÉ"), (1, "the river bank was")]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontamination(spark, docs, bound):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("gram", F.lit("clash"))
    rows = decontaminate.scan(docs, items, broadcast_windows=bound).collect()
    assert len(rows) == N
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 4:
            want = brute_hits(TEXTS[r["doc_id"]], ITEMS)
            assert (r["n_words"], r["n_hit"], sorted(r["items"])) == want
            assert r["contaminated"] == (want[1] > 0)
    assert decontaminate.scan(empty(spark), items).count() == 0
    assert decontaminate.scan(docs, items.limit(0)).filter("contaminated").count() == 0


def test_a_window_of_thousands_of_items(spark):
    """What hits carry doesn't grow with the items that share a window; a text names each of them once."""
    items = spark.createDataFrame([(k, "n/a") for k in range(3000)] + [(9000, "n a other")], "item_id long, text string")
    docs = spark.createDataFrame([(k, "n a; and n/a again" if k % 2 else "nothing") for k in range(200)], "doc_id long, text string")
    windows, held = decontaminate.numbered(decontaminate.grams(items))
    assert windows.count() == 2 and held.count() == 3001
    assert "items" not in decontaminate._hits(docs, windows, "doc_id", "text", 10**6).columns
    got = decontaminate.scan(docs, items).collect()
    assert len(got) == 200 and all(sorted(r["items"]) == (list(range(3000)) if r["doc_id"] % 2 else []) and r["n_hit"] == (4 if r["doc_id"] % 2 else 0) for r in got)


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two THREE four, and keep that."), (2, "clean"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.remove_documents(docs, items).collect()} == {2, 3}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut == {1: "Keep this, and keep that.", 2: "clean", 3: None}


# --- quality rules ----------------------------------------------------------------------------


def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_quality_rules(spark, docs):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == N
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 4:
            n, chars, symbols, dup, again = brute_base(TEXTS[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, again)
            assert r["base_failed"] == (n < 20 or 100 * again > 30 * n) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty(spark)).count() == 0


def test_quality_rules_tell_junk(spark, sf_dir):
    rows = quality_rules.judge(queries.read(spark, sf_dir, "documents")).join(queries.read(spark, sf_dir, "labels"), "doc_id").filter("NOT base_failed")
    kept = {r["quality"]: r["k"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.98 and kept.get(0, 0) < 0.1


def test_quality_rules_against_a_plain_ratio(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.read(spark, "/root/testdata/sf0.001", "documents").filter("doc_id % 3 = 0").collect()] + [(-1, None), (-2, ""), (-3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    target = F.col("id") % 2 == 0
    got = {r["doc_id"]: r for r in quality_rules.judge(df, target=target).collect()}
    hash_of = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed)
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        hashes = [hash_of(x) for x in w]
        return [signed(h) % quality_rules.BUCKETS for h in hashes] + [signed(hash_of(b, h)) % quality_rules.BUCKETS for h, b in zip(hashes, w[1:])]

    raw, trusted = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i % 2 == 0:
            trusted.update(grams(t))
    share = trusted.total() / raw.total()
    for i, t in rows:
        own = grams(t)
        score = sum(np.log((trusted[g] + 10 * share) / (share * (raw[g] + 10))) for g in own) / len(own) if own else 0
        assert got[i]["score"] == pytest.approx(score, abs=1e-6)
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["score"] >= -0.1)


# --- tokens -----------------------------------------------------------------------------------

ODD = ["  a  <|endoftext|>  b<|endoftext|>", "x <|endoftext|> ..<|endoftext|>!", "don't we'll I'M '", "　　x\n\n  y\t", "1١½", "\n", "a\x85b \x1c d᠎​e", "a" * 3000]


@pytest.mark.parametrize("bound", [1 << 28, 0])
def test_bpe_is_the_library_s(spark, docs, bound):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(spark)
    own = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate([*TEXTS, *ODD])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = bpe.encode(df, path, broadcast_bytes=bound, decoded="back")
    for r in bpe.decode(coded, path).collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == r["back"] == own.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs, path, broadcast_bytes=bound).count() == N
    assert bpe.encode(empty(spark), path, broadcast_bytes=bound).count() == 0


def test_words_that_share_a_hash(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(spark)
    own = Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "_hash", lambda word: F.pmod(F.xxhash64(word), F.lit(13)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, *ODD])], "doc_id long, text string")
    for r in bpe.encode(df, path, broadcast_bytes=0).collect():
        assert r["ids"] == own.encode(r["text"] or "", add_special_tokens=False).ids


def test_a_word_table_above_the_bound_moves_no_positions(spark, monkeypatch):
    """Frequent words come from the table, the others are encoded where they are: no row for each word of each text."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(spark)
    own = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate([*TEXTS, *ODD, *(f" often again number{i * 7919}" for i in range(40)), "apart"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # a word of the table has the hash of one that isn't in it
    monkeypatch.setattr(bpe, "_hash", lambda word: F.xxhash64(F.when(word == " again", "apart").otherwise(word)))
    table = bpe.word_table(df, bpe.Vocabulary(path))
    held = {r["class"]: (r["n"], r["n_ids"]) for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids")).collect()}
    bound = sum(12 * n + 2 * m for k, (n, m) in held.items() if k >= 3)
    assert 0 in held and max(held) > 3 and bpe._fitting(table, bpe.Vocabulary(path), bound) == (3, False)
    coded = bpe.encode(df, path, broadcast_bytes=bound)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: own.encode(t or "", add_special_tokens=False).ids for i, t in rows}


def test_bytes_that_are_not_text(spark):
    path = queries.tokenizer_path(spark)
    half = spark.createDataFrame([([222],), (None,)], "ids array<int>")
    from tokenizers import Tokenizer

    assert [r["decoded"] for r in bpe.decode(half, path).collect()] == [Tokenizer.from_file(path).decode([222], skip_special_tokens=False), ""]


# --- learned scores ---------------------------------------------------------------------------


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("name, label, least", [("op2_quality_knn", "quality", 0.97), ("op1_toxicity", "toxic", 0.8)])
def test_held_out_scores(spark, name, label, least):
    d = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, d).filter("held_out").join(queries.read(spark, d, "labels"), "doc_id").toPandas()
    assert auc(got[label].to_numpy(), got["score"].to_numpy()) > least
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()


def test_quality_of_awkward_rows(spark, docs):
    space = quality_knn.Space(["good words in a row", "*** *** ###", "more fine words"], [1, 0, 1])
    rows = quality_knn.score(docs, space).collect()
    assert len(rows) == N and all(0 <= r["score"] <= 1 for r in rows)
    assert next(r["score"] for r in rows if r["doc_id"] == 3) == pytest.approx(space.prior)
    assert quality_knn.score(docs, None).first()["score"] == 0.5
    assert quality_knn.score(empty(spark), space).count() == 0
    assert quality_knn.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_votes_are_exact_neighbours():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["aa", "Bb", "cc!!", "dd***", "ee|"], 30)) for _ in range(80)]
    space = quality_knn.Space(texts, rng.integers(0, 2, 80).tolist(), rank=4)
    v = space._unit(space._weighed(quality_knn.term_counts(texts[:5])) @ space.project)
    near = v @ space.vectors.T
    for i, s in enumerate(space.vote(texts[:5], 7)):
        top = np.argsort(-near[i])[:7]
        w = np.exp(20 * (near[i][top].astype(float) - 1))
        assert s == pytest.approx((w * space.labels[top]).sum() / w.sum(), abs=1e-3)


def test_votes_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["aa", "Bb", "cc!!", "dd***", "ee|", "ff", "gg."], 25)) for _ in range(300)]
    space = quality_knn.Space(texts[:200] + texts[:50], rng.integers(0, 2, 250).tolist(), rank=6)
    whole = space.vote(texts)
    assert whole.tolist() == [float(space.vote([t])[0]) for t in texts] == space.vote(texts[::-1])[::-1].tolist()


def test_ties_go_to_the_first_of_the_sample():
    space = quality_knn.Space(["one same text"] * 20 + ["Quite *** another ###"], [1] * 5 + [0] * 15 + [1], rank=2)
    assert space.vote(["one same text"], neighbours=5)[0] == pytest.approx(1, abs=1e-4)
    assert space.vote(["one same text"], neighbours=10)[0] == pytest.approx(0.5, abs=1e-4)


def test_samples_end_at_their_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    monkeypatch.setattr(quality_knn, "SAMPLE_BYTES", 1050)
    assert len(quality_knn.sample(docs, labels, "quality", F.lit(True))) == 10


def test_clauses_are_weighed():
    s = toxicity.Scorer({"stupid$": 5.0, "lout": 4.0})
    plain = s.score("That was stupid.")
    assert s.score("You are stupid.") > plain > s.score("That was not stupid.") and plain > s.score("She said that was stupid.")
    assert s.judge("He is a loutish man")[1] == 1 and s.judge("A flout. Stupidity is not in the list.") == (s.score(""), 0, None)
    assert s.clauses("") == [] and s.score(None) == s.score("")
    assert s.judge("A fine day. You stupid lout! Stupid.")[2] == "you stupid lout"


@pytest.mark.parametrize("text, hit", [("I will kill you", True), ("I'll kill you", True), ("I’m going to kill him", True), ("Ich werde dich töten", True), ("je vais te tuer", True), ("They kill time", False), ("They will beat the deadline", False), ("I won't kill you", False), ("I will not kill you", False), ("I'll say it beats you", False)])
def test_threats_have_intent_and_victim(text, hit):
    own = toxicity.Scorer({}).clauses(text)
    assert any(c.relations[3] for c in own) == hit


@pytest.mark.parametrize("text, negated", [("not stupid", 1), ("not, in any reasonable sense of it, stupid", 1), ("isn't stupid", 1), ("not good, stupid", 0), ("stupid, not good", 0), ("not so very much more stupid", 0)])
def test_negation_skips_what_stands_between_commas(text, negated):
    (clause,) = toxicity.Scorer({"stupid$": 5.0}).clauses(text)
    assert clause.relations[1] == negated


def test_composition_adds_relations():
    a, b = toxicity.negations(), toxicity.targets()
    both, state, x, y = a.compose(b), 0, 0, 0
    for s in "T-NI-I,--,IVI-HWI":
        state, out = both.step(state, s)
        (x, u), (y, v) = a.step(x, s), b.step(y, s)
        assert out == u + v


def _speech(rng, n):
    """Texts in which a word is toxic unless negated or reported, and twice as often beside a target."""
    texts, labels = [], []
    filler = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    for _ in range(n):
        start = " ".join(rng.choice(filler, 12))
        kind = rng.integers(0, 14)  # most texts lack the word
        said = ["you are a grubbl", "this is not grubbl", "he said it was grubbl", "so grubbl it is", "nothing at all"][min(kind, 4)]
        texts.append(f"{start}. {said}. {' '.join(rng.choice(filler, 6))}.")
        labels.append(int(kind in (0, 3)))
    return texts, labels


def test_the_grammar_matters():
    rng = np.random.default_rng(5)
    (texts, labels), (held, truth) = _speech(rng, 800), _speech(rng, 400)
    whole, flat = toxicity.fit_texts(texts, labels), toxicity.fit_texts(texts, labels, relations=False)
    got = [auc(np.array(truth), np.array([s.score(t) for t in held])) for s in (whole, flat)]
    assert got[0] > 0.97 and got[0] - got[1] > 0.03
    assert whole.weights[2] < 0 and whole.weights[3] < 0


def test_equal_texts_score_alike(spark):
    s = toxicity.Scorer({"stupid$": 5.0})
    df = spark.createDataFrame([(i, t) for i in range(4) for t in ("You stupid thing. You stupid thing.", "fine")], "doc_id long, text string")
    assert {(r["text"], r["toxicity"]) for r in toxicity.score(df, s).collect()}.__len__() == 2


def test_copies_teach_no_words():
    rng = np.random.default_rng(3)
    words = [f"w{''.join(rng.choice(list('abcdefgh'), 5))}" for _ in range(300)]
    text = lambda: " ".join(rng.choice(words, 30))
    clean = [text() for _ in range(300)]
    toxic = [f"{text()} vile{rng.integers(0, 9)} {text()}".replace("vile", "vilebad" + "xyz"[rng.integers(0, 3)]) for _ in range(40)]
    lexicon = toxicity.learn_lexicon(clean + toxic + [toxic[0]] * 30, [0] * 300 + [1] * 70)
    assert lexicon and all(e.startswith("vileb") or "vilebad".startswith(e) for e in lexicon)
    assert toxicity.learn_lexicon(clean, [0] * 300) == {}


def test_toxicity_of_awkward_rows(spark, docs):
    s = toxicity.Scorer({"stupid$": 5.0, "loser$": 5.0})
    rows = toxicity.score(docs, s).select("doc_id", "toxicity.*").collect()
    assert len(rows) == N and max(rows, key=lambda r: r["score"])["doc_id"] == 8
    assert next(r["worst"] for r in rows if r["doc_id"] == 3) is None
    assert toxicity.score(empty(spark), s).count() == 0


def test_language_id(spark, docs):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op6_language_id"](spark, d).join(queries.read(spark, d, "documents"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_of_awkward_rows(spark, docs):
    models = language_id.fit(docs)
    rows = language_id.predict(docs, models).select("doc_id", "language.*").collect()
    assert len(rows) == N
    assert all(r["lang"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 9))
    assert {r["lang"] for r in rows} <= {"en", "de", "und"}
    assert language_id.fit(empty(spark)) is None
    assert language_id.predict(docs, None).filter("language.lang <> 'und'").count() == 0


@pytest.mark.parametrize("source", ["awkward", "sf0.001"])
def test_language_models_past_the_broadcast_bound_agree(spark, docs, source):
    rows = docs if source == "awkward" else queries.read(spark, "/root/testdata/sf0.001", "documents")
    train = rows if source == "awkward" else rows.filter("doc_id % 3 <> 1")
    near, far = language_id.fit(train), language_id.fit(train, max_cells=0)
    assert far.order == near.order == language_id.ORDER and far.langs == near.langs
    assert far.mean == pytest.approx(near.mean, abs=1e-5) and far.dev == pytest.approx(near.dev, abs=1e-5)
    key = lambda r: (str(r["doc_id"]), r["lang"], round(r["cross_entropy"], 3))
    want, got = (sorted(language_id.predict(rows, m).select("doc_id", "language.*").collect(), key=key) for m in (near, far))
    assert len(got) == len(want)
    for a, b in zip(want, got, strict=True):
        assert (a["doc_id"], a["lang"], a["rejected"]) == (b["doc_id"], b["lang"], b["rejected"])
        assert (b["score"], b["cross_entropy"]) == pytest.approx((a["score"], a["cross_entropy"]), abs=1e-4)


def test_language_models_are_distributions(spark):
    df = spark.createDataFrame([("de", "das ist ein haus und noch ein haus"), ("en", "this is a house and another house")], "lang string, text string")
    models = language_id.fit(df)
    letters = models.tables[-1][0]
    for context in ("ein", "xqz", "   "):
        base = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context))
        p = np.exp(-models.cost(np.array([base | int(u) for u in letters] + [base | 0x3042], np.uint64)))
        assert p.sum(axis=0) == pytest.approx(1, abs=1e-3)


def plain_kneser_ney(train, order=4):
    """Cost of a letter after its context by language, from dictionaries; letters are folded ASCII."""
    fold_ = lambda t: " ".join(re.sub("[^a-z]+", " ", t.lower()).split())
    alphabet, models = set(), {}
    for lang in sorted({x for x, _ in train}):
        counts = Counter()
        for t in (fold_(t) + " " for x, t in train if x == lang):
            padded = " " * order + t
            counts.update(padded[i - order + 1 : i + 1] for i in range(order, len(padded)))
        levels = {order: counts}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        alphabet |= set(levels[1])
        models[lang] = levels

    def p(lang, gram):
        if not gram:
            return 1 / (len(alphabet) + 1)
        own = models[lang][len(gram)]
        once, twice = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = min(0.9, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))
        same = {g: v for g, v in own.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return p(lang, gram[1:])
        return max(own.get(gram, 0) - d, 0) / total + d * len(same) / total * p(lang, gram[1:])

    def cost(lang, text):
        padded = " " * order + fold_(text) + " "
        return np.mean([-np.log(p(lang, padded[i - order + 1 : i + 1])) for i in range(order, len(padded))])

    return cost


def test_language_against_plain_kneser_ney(spark):
    train = [("de", "das ist ein haus und noch ein haus"), ("en", "this is a house and another house"), ("en", "the bank of the river"), ("de", "die bank am fluss")]
    texts = ["ein haus am fluss", "another bank", "zzz qqq", "house"]
    df = spark.createDataFrame(train, "lang string, text string")
    plain = plain_kneser_ney(train)
    for cells in (10**6, 0):
        models = language_id.fit(df, max_cells=cells)
        got = language_id.predict(spark.createDataFrame([(t,) for t in texts], "text string"), models).collect()
        for r in got:
            want = {x: plain(x, r["text"]) for x in ("de", "en")}
            assert r["language"]["lang"] == min(want, key=want.get)
            assert r["language"]["cross_entropy"] == pytest.approx(min(want.values()), abs=1e-4)


# --- pages ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        (None, ""),
        ("<p>a<b>b</b>c <!-- gone", "abc"),
        ("x &lt; y &amp;amp; z", "x < y &amp; z"),
        ("<html><nav>menu</nav><article><h1>Title</h1><p>One  two.<p>Three<br>four.</article><footer>f</footer>", "Title One two. Three four."),
        ("<article><header><h1>T</h1></header><p>Body.</p><div class='comments'><p>Nice!</p></div><aside>x</aside></article>", "T Body."),
        ("<script>if (a < b) document.write('<p>no</p>')</script><main><p title='a > b'>Yes</p></main>", "Yes"),
        ("<div class=\"menu\"><a href=x>l</a></div><div><p>A long enough story, told here. It goes on; and ends.</p></div>", "A long enough story, told here. It goes on; and ends."),
        ("<article><p>a</p><form><label>n</label><button>b</button></form><style>p{}</style></article>", "a"),
        ("<p>unclosed <b title='x>y</p>", "unclosed y"),
        ("<p>only <a href='x'>a link</a></p><p>Words, and more words.</p>", "only a link Words, and more words."),
        ("<article><p>Text of the kind that goes on, and more.</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>", "Text of the kind that goes on, and more."),
        ("<article><p data-x=\"" + "y <p> > " * 1000 + "\">Only this.</p></article>", "Only this."),
        ("<p a=>x</p><p class= side>y</p><div/>z<p>t", "x z t"),
        ("a < b and <3 c", "a < b and <3 c"),
        ("<nav><a href=x>Home</a></nav>", ""),
        ("<p title='a < b > c'>t</p>", "t"),
    ],
)
def test_pages(page, want):
    assert html_text.extract(page) == want


def test_pages_of_the_test_data(spark, sf_dir):
    for r in html_text.main_text(queries.read(spark, sf_dir, "pages").withColumn("text", F.lit("clash")), out="text").collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())


def test_awkward_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>One.</p>"), (3, "<p>One.</p>"), (None, "<p>" + "Long words in it, and more. " * 20000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit("clash") for c in ("text", "path", "tag", "out")})
    got = html_text.main_text(df).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 0, 4, 4, 28 * 20000 - 1] and all(r["path"] == "clash" for r in got)
    assert html_text.main_text(df.limit(0)).count() == 0


class Plain(html.parser.HTMLParser):
    """Blocks of a well-formed page with their paths, read by the standard library."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.blocks, self.fresh, self.links, self.serial = [], [], True, 0, 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "b"):
            self.links += tag == "a"
        else:
            names = set(re.split(r"[\s_-]+", " ".join(v for k, v in attrs if k in ("class", "id", "role")).lower()))
            self.serial += 1
            self.stack.append((tag, bool(names & {"sidebar", "ad", "comments"}), self.serial))
            self.fresh = True

    def handle_endtag(self, tag):
        if tag in ("a", "b"):
            self.links -= tag == "a"
        else:
            self.stack.pop()
            self.fresh = True

    def handle_data(self, data):
        if self.fresh:
            self.blocks.append([tuple(self.stack), "", 0])
            self.fresh = False
        self.blocks[-1][1] += data
        self.blocks[-1][2] += len("".join(data.split())) * bool(self.links)


def plain_ratios(page):
    """The definition in the docstring, path by path with no arrays."""
    found = [(e, " ".join(t.split()), n) for e, t, n in Plain(page).blocks if t.strip()]
    blocks = [(tuple(x[:2] for x in e), t, n) for e, t, n in found]
    paths = list(dict.fromkeys(p for p, _, _ in blocks))
    of = {p: [(t, n) for q, t, n in blocks if q == p] for p in paths}
    size = lambda t: len(t.replace(" ", ""))
    whole = {p: sum(size(t) for t, _ in of[p]) for p in paths}
    marks = {p: sum(len(re.findall(r"[.,;:!?]", t)) for t, _ in of[p]) / len(of[p]) for p in paths}

    def smooth(values):
        row = [values[p] for p, _, _ in blocks]
        row = [row[0], *row, row[-1]]
        got = [0.25 * row[i] + 0.5 * row[i + 1] + 0.25 * row[i + 2] for i in range(len(blocks))]
        return {p: sum(x for x, (q, _, _) in zip(got, blocks) if q == p) / len(of[p]) for p in paths}

    length_s, marks_s, fused = smooth({p: whole[p] / len(of[p]) for p in paths}), smooth(marks), {}
    aside = lambda p: any(x[1] for x in p)
    inside = lambda p: any(x[0] in ("article", "main") for x in p) and not aside(p)
    for p in paths:
        share = sum(n for _, n in of[p]) / whole[p]
        outside = any(map(inside, paths)) and not inside(p)
        fused[p] = (length_s[p] * (1 + marks_s[p]) * whole[p]) ** 0.5 * (1 - share**2) * (0.02 if aside(p) else 0.3 if outside else 1)
    good = {p for p in paths if fused[p] > 0 and fused[p] >= 0.5 * max(fused.values())}
    chosen = [p in good for p, _, _ in blocks]
    text = sum(size(t) for (_, t, _), c in zip(found, chosen) if c)
    chains = {e[:k] for (e, _, _), c in zip(found, chosen) if c for k in range(len(e))}
    holds = {c: sum(size(t) for (e, t, _), g in zip(found, chosen) if g and e[: len(c)] == c) for c in chains}
    node = max((c for c in chains if holds[c] >= 0.8 * text), key=len)
    while node and inside(node[:-1]):
        node = node[:-1]
    along = lambda e: e[: len(node)] == node and all(x[0] in ("p", "h2", "section", "ul", "li") for x in e[len(node) :]) and not aside(e)
    chosen = [c and (e[: len(node)] == node or holds[e[:-1]] >= 0.1 * text) for (e, _, _), c in zip(found, chosen)]
    return " ".join(t for (e, t, n), c in zip(found, chosen) if c or (along(e) and n <= size(t) / 2))


def _page(rng, article):
    words = lambda n: " ".join(rng.choice(["river", "bank,", "plan.", "hall", "old;", "read", "then"], n))
    parts = [f"<div class='{rng.choice(['sidebar', 'box', 'ad'])}'>{words(rng.integers(1, 30))}</div>" for _ in range(2)]
    links = "<ul>" + "".join(f"<li><a href='x'>{words(2)}</a> {words(rng.integers(0, 3))}</li>" for _ in range(rng.integers(1, 6))) + "</ul>"
    body = "".join(f"<{t}>{words(rng.integers(1, 60))} <a href='y'>{words(1)}</a> <b>{words(2)}</b></{t}>" for t in rng.choice(["p", "h2", "section"], rng.integers(1, 7)))
    body = f"<article>{body}{links if rng.random() < 0.5 else ''}</article>" if article else f"<div>{body}</div>"
    return f"<body>{parts[0]}{links}{body}{parts[1]}<div>{words(rng.integers(1, 12))}</div></body>"


@pytest.mark.parametrize("article", [True, False])
def test_pages_against_plain_ratios(article):
    rng = np.random.default_rng(int(article))
    pages = [_page(rng, article) for _ in range(150)]
    assert [html_text.extract(p) for p in pages] == [plain_ratios(p) for p in pages]


def test_ratios_decide():
    """Smoothing, punctuation and the threshold each change what comes out."""
    rng = np.random.default_rng(9)
    pages = [_page(rng, False) for _ in range(400)]
    plain = [html_text.extract(p) for p in pages]
    for other in ({"smooth": (0.0, 1.0, 0.0)}, {"punctuation": 0.0}, {"threshold": 0.9}, {"ratios": False}):
        assert sum(html_text.extract(p, **other) != x for p, x in zip(pages, plain)) > 5


def test_ratios_decide_on_the_given_pages(spark):
    """Names of parts taken away (article, nav, footer ... are divisions, without class, id and role): adverts and footers go by the ratios alone, and without ratios they stay."""
    pages = [r["html"] for r in queries.read(spark, "/root/testdata/sf0.1", "pages").select("html").collect()]
    bare = [re.sub(r"(</?)(article|main|header|footer|aside|nav|section)\b", r"\1div", re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]*)", "", p)) for p in pages]
    whole = [html_text.extract(p) for p in pages]
    assert sum(html_text.extract(b) == w for b, w in zip(bare, whole)) >= 0.93 * len(pages)
    assert sum(html_text.extract(b, ratios=False) == w for b, w in zip(bare[:300], whole)) == 0


@pytest.mark.parametrize("name", ["c-thread", "x2", "zz"])
def test_threads_and_boxes_go_whatever_they_are_called(name):
    story = "".join(f"<p>{'A story that goes on, and on; with many words in it. ' * k}</p>" for k in (3, 1, 4, 2))
    said = f"<div class='{name}'><p>I agree with this, thanks.</p><p>So do I. It is so.</p></div>"
    box = f"<div class='{name}'>Buy nine words of something now, it is good.</div>"
    want = html_text.extract(f"<article>{story}</article>")
    assert html_text.extract(f"<article><h1>T</h1>{story}{said}</article>{box}") == f"T {want}"
    assert html_text.extract(f"<div><h1>T</h1>{story}</div>{box}{said}") == f"T {want}"


@pytest.mark.parametrize("page", ["<" * 50_000, "<a b='" * 20_000, "<p " * 100_000, "<div>" * 100_000 + "x", "<!--" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 20_000 + "<p>x" * 20_000, "<a href=x>y" * 50_000, "<td>" * 50_000, "<p a='" * 50_001 + ">", "<script>" * 50_000], ids=range(11))
def test_hostile_pages_take_linear_time_and_memory(page):
    import time
    import tracemalloc

    start = time.process_time()
    html_text.extract(page)
    assert time.process_time() - start < 4
    tracemalloc.start()
    html_text.extract(page)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6
