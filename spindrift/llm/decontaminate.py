"""Benchmark decontamination with a broadcast hash set of benchmark n-grams (DataFrame functions only).

Every window of ``n`` words of every benchmark item (an item of fewer words is
one window) goes, hashed, into a small table. Training texts are scanned window
by window in one pass: the hashes of a text's windows are exploded and probed
against the table in the same stage, a hit is verified word by word against the
benchmark's window, and only hits and one head row for each text are shuffled.

The table is broadcast while it has at most ``broadcast_windows`` rows and
``BROADCAST_BYTES`` of words, which is counted first; beyond that the
same join runs as a shuffled one. A hit carries its window's number; which items hold the window
is looked up afterwards, once for each text and window, as thousands of items may share one.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, small, text_of

N = 10
BROADCAST_WINDOWS = 2_000_000
BROADCAST_BYTES = 256 << 20
#: Items of texts with hits, in all, up to which they are joined with the texts by broadcast.
BROADCAST_ITEMS = 1_000_000

#: The words of the contract after A-Z have been lower-cased; on raw text A-Z are added.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else as it is; lower() does that, and faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _windowed(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows with, for each length k, a column __w<k>: the hashes of all windows of k of the words w; none in shorter texts.

    Hashes of runs of 1, 2, 4, 8 words are made each from two of half the length,
    and a window's from those that it is made of; a word is hashed once however many windows it is in.
    """
    size = 1
    rows = rows.withColumn("__h1", F.transform("w", lambda x: F.xxhash64(x)))
    both = lambda a, b: F.xxhash64(a, b)
    while 2 * size <= max(lengths, default=1):
        half = f"__h{size}"
        rows = rows.withColumn(f"__h{2 * size}", F.zip_with(half, F.slice(half, size + 1, F.size("w")), both))
        size *= 2
    for k in lengths:
        run, done, power = None, 0, size
        while done < k:
            if power <= k - done:
                part = F.slice(f"__h{power}", done + 1, F.greatest(F.size("w"), F.lit(0)))
                run, done = part if run is None else F.zip_with(run, part, both), done + power
            power //= 2
        rows = rows.withColumn(f"__w{k}", F.slice(run, F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(0))))
    return rows.drop(*[c for c in rows.columns if c.startswith("__h")])


def grams(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """gram (its words), item: which item holds which window, each once."""
    items = benchmark.select(F.col(id_col).alias("item"), words(text_of(text_col)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    spans = F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))
    return items.select("item", F.explode(spans).alias("gram")).distinct()


def numbered(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, number) of the different windows and (number, item) of rows as ``grams`` gives them. Hits carry numbers; the items of a window are looked up once for a text."""
    held = cut(held)
    windows = cut(held.select("gram").distinct())
    windows = windows.select("gram", F.monotonically_increasing_id().alias("number"))  # of what has been written, so a number stays
    return windows, held.join(windows, "gram").select("number", "item")


def _placed(scanned: DataFrame, lengths: list[int], *columns: str) -> DataFrame:
    """columns, at, n_words, and start, span and words of each window; the text's other words are dropped here."""
    start, span = F.col("at"), F.lit(0)
    for i, k in enumerate(lengths):
        before = reduce(lambda a, b: a + b, [F.greatest(F.size("w") - (x - 1), F.lit(0)) for x in lengths[:i]], F.lit(0))
        inside = (F.col("at") > before) & (F.col("at") <= before + F.greatest(F.size("w") - (k - 1), F.lit(0)))
        start, span = F.when(inside, F.col("at") - before).otherwise(start), F.when(inside, F.lit(k)).otherwise(span)
    placed = scanned.withColumns({"start": start, "span": span})
    return placed.select("__id", "__text", "id", "at", *columns, "start", "span", F.size("w").alias("n_words"), F.when(F.col("at") > 0, F.slice("w", F.greatest("start", F.lit(1)), F.col("span"))).alias("window"))


def _hits(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, broadcast_windows: int) -> DataFrame:
    """__id, __text, id, copies, n_words, spans (from, length) of hits, numbers of their windows: per distinct row of docs and task that reads it. table: gram, number."""
    lengths = sorted(r[0] for r in table.select(F.size("gram")).distinct().collect())  # n values at most
    own = _windowed(table.withColumn("w", F.col("gram")), lengths)
    hash_of = F.coalesce(*[F.when(F.size("gram") == k, F.get(f"__w{k}", F.lit(0))) for k in lengths], F.lit(None).cast("bigint"))
    table = own.select(hash_of.alias("hash"), "gram", "number")
    # Copies of a row are put together within a task of the scan alone, so a frequent row comes out of as many tasks.
    rows = docs.select(*row_key(id_col, text_col), F.spark_partition_id().alias("__task"), F.col(id_col).alias("id"), words(text_of(text_col)).alias("w"))
    # The exploding is outer, though no array is empty: from an inner one Spark infers a filter on the array's size, which
    # would compute the array a second time. Place 0 is the head row of a text; then all windows of the first length, of the second, ...
    rows = _windowed(rows, lengths)
    hashes = F.concat(F.array(F.lit(0).cast("bigint")), *[F.col(f"__w{k}") for k in lengths])
    first = F.col("at") == 0
    hit = F.struct("start", "span")
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("gram", " ")) + 64), F.lit(0))).first()
    if n <= broadcast_windows and size <= BROADCAST_BYTES:
        head = table.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("hash"), *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in ("gram", "number")])
        scanned = rows.select("*", F.posexplode_outer(hashes).alias("at", "hash")).join(F.broadcast(table.unionByName(head)), "hash")
        held = _placed(scanned.filter(first == F.col("gram").isNull()), lengths, "__task", "gram", "number").filter(first | (F.col("window") == F.col("gram")))
        return held.groupBy("__id", "__text", "__task").agg(
            F.first("id").alias("id"),
            F.count_if(first).alias("copies"),
            F.first("n_words").cast("long").alias("n_words"),
            F.sort_array(F.collect_set(F.when(~first, hit))).alias("spans"),
            F.collect_set(F.when(~first, F.col("number"))).alias("numbers"),
        ).drop("__task")
    # Windows are shuffled without their words; the words join their hits again, which are few. Rows come by one each.
    slim = rows.select("__id", "__text", F.posexplode_outer(hashes).alias("at", "hash")).filter(~first)
    found = slim.join(table.select("hash").distinct(), "hash", "left_semi").groupBy("__id", "__text").agg(F.collect_set(F.struct("at", "hash")).alias("hits"))
    words_of = rows.select("__id", "__text", "id", "w").join(small(cut(found)), ["__id", "__text"]).dropDuplicates(["__id", "__text"])
    hits = _placed(words_of.select("__id", "__text", "id", "w", F.inline("hits")), lengths, "hash").join(table, "hash").filter(F.col("window") == F.col("gram"))
    spans = hits.groupBy("__id", "__text").agg(F.sort_array(F.collect_set(hit)).alias("spans"), F.collect_set("number").alias("numbers"))
    heads = rows.select("__id", "__text", "id", F.lit(1).cast("bigint").alias("copies"), F.size("w").cast("long").alias("n_words"))
    none = [F.coalesce(c, F.array().cast(spans.schema[c].dataType)).alias(c) for c in ("spans", "numbers")]
    return heads.join(spans, ["__id", "__text"], "left").select("__id", "__text", "id", "copies", "n_words", *none)


def _covered(spans: Column) -> Column:
    """How many words lie in the union of sorted spans."""
    zero = F.struct(F.lit(1).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["span"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """id, n_words, n_hit, items (array of item ids), contaminated: one row for every row of docs.

    Null and empty texts have no words and no hits, and so do all texts where the
    benchmark is empty or has no words. Rows that repeat id and text come back as
    often as they came; an id with several texts has a row for each. Texts are
    scanned whole, however long; other columns don't matter.
    """
    windows, items = numbered(grams(benchmark, item_col, item_text_col, n))
    found = cut(_hits(docs, windows, id_col, text_col, broadcast_windows))
    hit = found.filter(F.size("numbers") > 0).select("__id", "__text", F.explode("numbers").alias("number")).distinct()
    named = cut(hit.join(small(cut(items)), "number").groupBy("__id", "__text").agg(F.collect_set("item").alias("items")))
    few = (named.agg(F.sum(F.size("items"))).first()[0] or 0) <= BROADCAST_ITEMS  # texts with hits are few, as a rule
    found = found.join(F.broadcast(named) if few else named, ["__id", "__text"], "left")
    found = found.withColumn("items", F.coalesce("items", F.array().cast(named.schema["items"].dataType)))
    rows = found.withColumn("n_hit", _covered(F.col("spans"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return rows.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no benchmark window, with their columns."""
    return _cleaned(docs, benchmark, id_col, text_col, whole=True, **options)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows of docs with their columns; words inside a benchmark window go from the text, each with the gap before it."""
    return _cleaned(docs, benchmark, id_col, text_col, whole=False, **options)


def _cleaned(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, whole: bool, n: int = N, broadcast_windows: int = BROADCAST_WINDOWS, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    columns = docs.columns
    hits = _hits(docs, numbered(grams(benchmark, item_col, item_text_col, n))[0], id_col, text_col, broadcast_windows).filter(F.size("spans") > 0)
    hits = small(cut(hits.select("__id", "__text", "spans").dropDuplicates(["__id", "__text"])))  # texts with hits are few, as a rule; then no text is shuffled
    keyed = docs.select("*", *row_key(id_col, text_col))
    if whole:
        return keyed.join(hits, ["__id", "__text"], "left_anti").select(*columns)
    text = text_of(text_col)
    pieces = F.regexp_extract_all(text, F.lit(f"{_RAW_GAP}{_RAW_WORD}"), F.lit(0))
    inside = lambda i: F.exists("spans", lambda s: (s["start"] <= i + 1) & (i + 1 < s["start"] + s["span"]))
    kept = F.concat(F.array_join(F.filter(pieces, lambda _, i: ~inside(i)), ""), F.regexp_extract(text, f"({_RAW_GAP})\\z", 1))
    joined = keyed.join(hits, ["__id", "__text"], "left")
    return joined.withColumn(text_col, F.when(F.col("spans").isNull(), F.col(text_col)).otherwise(kept)).select(*columns)


_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The digest of op8 in DuckDB SQL, by joining all windows of all texts.
SQL = f"""
WITH item AS (
  SELECT item_id, w, least(len(w), {N}) AS k FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0
), gram AS (
  SELECT DISTINCT item_id, k, w[i:i + k - 1] AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM item)
), doc AS (
  SELECT doc_id, {_WORDS_SQL} AS w FROM documents
), hit AS (
  SELECT doc_id, item_id, i, x.k FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM gram)) x JOIN gram ON gram.k = x.k AND gram.g = x.w[i:i + x.k - 1]
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
