"""Importance resampling towards a target: array-scored weights, then a draw by merging sorted runs.

Words and word pairs fall into hashed buckets. Each bucket has a gain, the log
ratio of its share of the target to its share of the corpus, and a text's weight
is the mean gain of its features: one lookup in an array of ``BUCKETS`` numbers
for each feature, which is all that the tasks are sent. A Gumbel draw hashed from
the record's id is added, so the highest scores are a sample without replacement
in proportion to exp(weight / 1000), the same in every run.

The draw never sorts the table in one place. Each task puts its eligible rows in
order (runs of at most ``RUN_ROWS``), cuts the run at bounds that all tasks share,
and writes the pieces as blocks to the shared folder. Counting the blocks tells
each range of scores its first rank and the last range that is needed. A task
then merges one range's pieces of all runs by a tournament tree, gives ranks and
stops at the exact draw count; ranges behind it are neither shuffled nor merged.

Bounds come from a sample of about ``SAMPLE`` keys. They decide how even the ranges are
and nothing else. The reading task's number ends each key, so rows that repeat
without end are dealt over ranges too.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SQL_CRC_TABLE, cut, small_batches, sql_crc, sql_lower, text_of

BUCKETS = 10_000
#: Rows of a sorted run and of a block of it at most; rows a range is meant to have; ranges at most; sampled keys, about.
RUN_ROWS, BLOCK_ROWS, RANGE_ROWS, RANGES, SAMPLE = 1 << 20, 4096, 100_000, 4096, 100_000

# Bytes of ASCII letters in lower case and digits stay, other ASCII separates words, bytes of longer characters stay.
_FOLD = bytes(x if x > 127 or chr(x).isdigit() or 97 <= x <= 122 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))
_ALL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def buckets(text: bytes) -> tuple[int, np.ndarray]:
    """The number of words of a UTF-8 text, and the bucket of each word and each pair of neighbours.

    A pair's crc32 goes on from its first word's, one space further.
    """
    words = text.translate(_FOLD).split()
    n = len(words)
    ones = np.fromiter(map(crc32, words), np.uint32, n)
    state = ones[:-1] ^ _ALL
    spaced = (_CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))) ^ _ALL
    twos = np.fromiter(map(crc32, words[1:], spaced.tolist()), np.uint32, max(n - 1, 0))
    return n, np.concatenate([ones, twos]) % np.uint32(BUCKETS)


def counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all texts: each task sums its own, so at most BUCKETS rows a task move."""
    small_batches(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(buckets(text)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(text_of(text_col).cast("binary").alias("t")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the corpus), by bucket."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def gumbel(key: str, seed: int) -> int:
    """The draw of a key in thousandths, from 32 bits of a SHA-256."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_features, weight, score, n_words of every row; a null id draws as the empty text, a text without words has weight 0."""
    small_batches(docs.sparkSession)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, at = buckets(text)
                weight = int(gain[at].sum()) // len(at) if n else 0
                rows.append((len(at), weight, weight + gumbel(key, seed), n))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "n_features", "weight", "score", "n_words"])

    source = docs.select(F.col(id_col).alias("id"), text_of(id_col).alias("k"), text_of(text_col).cast("binary").alias("t"))
    kind = source.schema["id"].dataType
    return source.mapInArrow(score, T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_features", "weight", "score", "n_words"))]))


_ROW = ("id", "n_features", "weight", "score")


def _key(score: int, key, run: int) -> tuple:
    """Higher scores first, then smaller ids, null ones last, then the run."""
    return (-score, key is None, 0 if key is None else key, run)


def _bounds(eligible: DataFrame, n: int) -> list[tuple]:
    """Keys at which runs are cut, in order, one fewer than there are ranges."""
    parts = int(eligible.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(RANGES, max(parts, n // RANGE_ROWS), max(1, n // 100))
    sample = eligible.select("score", "id", "run").filter(F.rand(7) * n < min(SAMPLE, 64 * ranges))
    keys = sorted(_key(*row) for row in sample.collect())
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def _runs(scored: DataFrame, bounds: list[tuple], least: int) -> DataFrame:
    """Blocks of sorted runs: range, run, at, and an array for each column of a row; rows that can't be drawn are in the range after the last."""
    last = len(bounds) + 1
    kind = scored.schema["id"].dataType

    def blocks(table: pa.Table, run: int, serial: int) -> Iterator[dict]:
        may = pc.greater_equal(table["n_words"], least)
        rest = table.filter(pc.invert(may))
        table = table.filter(may)
        table = table.take(pc.sort_indices(table, [("score", "descending"), ("id", "ascending"), ("weight", "ascending"), ("n_features", "ascending")], null_placement="at_end"))
        keys = [_key(s, i, run) for s, i in zip(table["score"].to_pylist(), table["id"].to_pylist())]
        cuts = [0, *(bisect_left(keys, b) for b in bounds), len(keys)]
        pieces = [(k, table.slice(a, b - a)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a] + [(last, rest)]
        for k, piece in pieces:
            for at in range(0, len(piece), BLOCK_ROWS):
                block = piece.slice(at, BLOCK_ROWS)
                yield {"range": k, "run": run, "serial": serial, "at": at, **{c: block[c].to_pylist() for c in _ROW}}

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, serial = [], 0, 0
        schema = None

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            for block in blocks(table, table["run"][0].as_py(), serial):
                yield pa.RecordBatch.from_pylist([block], schema)

        for batch in batches:
            schema = schema or pa.schema([("range", pa.int32()), ("run", pa.int32()), ("serial", pa.int32()), ("at", pa.int32()), ("id", pa.list_(batch.schema.field("id").type)), *((c, pa.list_(pa.int64())) for c in _ROW[1:])])
            held.append(batch)
            rows += len(batch)
            if rows >= RUN_ROWS:
                yield from flush()
                held, rows, serial = [], 0, serial + 1
        if rows:
            yield from flush()

    fields = [T.StructField(c, T.IntegerType()) for c in ("range", "run", "serial", "at")]
    fields += [T.StructField("id", T.ArrayType(kind)), *(T.StructField(c, T.ArrayType(T.LongType())) for c in _ROW[1:])]
    return scored.mapInArrow(runs, T.StructType(fields))


def tournament(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The items of sorted runs in one order: a tree of matches in which, after each winner, only its own path is played again."""
    leaves = 1 << max(0, len(runs) - 1).bit_length()
    heads: list = [next(run, None) for run in runs] + [None] * (leaves - len(runs))

    def play(a: int, b: int) -> int:
        return a if heads[b] is None or (heads[a] is not None and heads[a] <= heads[b]) else b

    tree = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        tree[node] = play(tree[2 * node], tree[2 * node + 1])
    while heads[winner := tree[1]] is not None:
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        node = (winner + leaves) >> 1
        while node:
            tree[node] = play(tree[2 * node], tree[2 * node + 1])
            node >>= 1


def _opened(blocks: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of one run's blocks with their keys; a block becomes Python objects only when the merge gets to it."""
    for block in blocks:
        run = block["run"][0].as_py()
        for row in zip(*(block[c][0].as_py() for c in _ROW)):
            yield (_key(row[3], row[0], run), row[2], row[1], row)


def draw(scored: DataFrame, percent: int = 25, least: int = 20) -> DataFrame:
    """id, n_features, weight, score, rank of every row of ``scores``: rank 1, 2, 3 ... by score for the floor of ``percent`` of those with ``least`` words, else null.

    Of equal scores the smaller id comes first, null ids last; rows alike in all columns are interchangeable. Every row comes back once.
    """
    scored = cut(scored.withColumn("run", F.spark_partition_id()))
    eligible = scored.filter(F.col("n_words") >= least)
    n = eligible.count()
    bounds = _bounds(eligible, n)
    blocks = cut(_runs(scored, bounds, least))
    sizes = dict(blocks.groupBy("range").agg(F.sum(F.size("score"))).collect())
    wanted, before, first, cut_at = percent * n // 100, 0, {}, -1
    for k in range(len(bounds) + 1):
        if before < wanted:
            first[k], cut_at = before, k
        before += sizes.get(k, 0)

    kind = scored.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in (*_ROW[1:], "rank"))])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles = (batch.slice(k, 1) for batch in batches for k in range(len(batch)))
        for k, pieces in groupby(singles, lambda b: b["range"][0].as_py()):
            runs = [list(g) for _, g in groupby(pieces, lambda b: (b["run"][0].as_py(), b["serial"][0].as_py()))]
            kind_of = runs[0][0].schema.field("id").type.value_type
            schema = pa.schema([("id", kind_of), *((c, pa.int64()) for c in (*_ROW[1:], "rank"))])
            rank, rows = first[k], []
            for *_, row in tournament([_opened(r) for r in runs]):
                rank += 1
                rows.append((*row, rank if rank <= wanted else None))
                if len(rows) == BLOCK_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    near = blocks.filter(F.col("range") <= cut_at).repartition(max(1, min(cut_at + 1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "range")
    drawn = near.sortWithinPartitions("range", "run", "serial", "at").mapInArrow(merge, out)
    rest = blocks.filter(F.col("range") > cut_at).select(F.explode(F.arrays_zip(*_ROW)).alias("r")).select("r.*", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id, n_features, weight, score, rank of every row of docs, drawn towards the texts of target.

    Null and empty texts have no features, weight 0 and no rank. An empty target
    makes every gain the smoothed log of its corpus share alone; empty docs give no rows. Rows that repeat are
    drawn each by itself, with the same score. A very long text is one row of bytes at a time. Other columns of docs play no part.
    """
    gain = gains(counts(docs, text_col), counts(target, target_col))
    return draw(scores(docs, gain, seed, id_col, text_col), percent, least).withColumnRenamed("id", id_col)


SQL = f"""WITH {SQL_CRC_TABLE},
texts AS (SELECT TRUE AS corpus, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT FALSE, NULL, coalesce(text, '') FROM benchmark),
worded AS (SELECT row_number() OVER () AS r, corpus, id, regexp_extract_all({sql_lower('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
features AS (
  SELECT r, corpus, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded
),
named AS (SELECT f, {sql_crc('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc_table),
placed AS (SELECT r, corpus, bucket FROM features JOIN named USING (f)),
totals AS (SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM placed GROUP BY 1),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM totals)::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM totals)::DOUBLE + 10000))))::BIGINT AS gain FROM totals
),
means AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight, count(*) AS n FROM placed JOIN gains USING (bucket) WHERE corpus GROUP BY r),
scored AS (
  SELECT id, coalesce(n, 0) AS n_features, len(w) AS n_words, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN means USING (r) WHERE corpus
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, id) AS k, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT id AS doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * n // 100 THEN k END AS rank FROM ranked
"""
