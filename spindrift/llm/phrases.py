"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed into phrases, each the shortest piece that isn't in the
dictionary yet. The phrase set is hashed and its ``SIZE`` least hashes are the
fingerprint. Two fingerprints share as large a part of the least hashes of their
union as the sets do of theirs: texts that would compress each other well are alike.

With edited copies (``compare``), a text's end is replaced by the start of the
next text by id. Texts move once: they are dealt into ranges of ids, at bounds
from a sample of about ``SAMPLE`` ids, and each range also gets the first text after it,
so a task walks its texts in order, one pair at a time. The edited text keeps the
parse of what it has in common with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of

#: Hashes in a fingerprint; sampled ids for the bounds, about; ranges of ids at most.
SIZE, SAMPLE, RANGES = 64, 50_000, 2048
_FACTOR, _MASK, _DIGITS = 1_000_003, (1 << 40) - 1, 8
_TYPES = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


class Phrases:
    """The dictionary of phrases as a tree: a phrase is a node, its number times 256 plus a byte names a child."""

    def __init__(self) -> None:
        self.children: dict[int, int] = {}
        self.hashes: list[int] = [1]  # by node; that of no phrase first
        self.at = 0  # the phrase begun, as its node's number times 256

    def read(self, text: bytes) -> list[int]:
        """Goes on with the text; returns the names of the phrases that are new."""
        children, hashes, node, new = self.children, self.hashes, self.at, []
        child, top = children.get, len(hashes) << 8
        for byte in text:
            name = node + byte
            node = child(name)
            if node is None:
                hashes.append((hashes[name >> 8] * _FACTOR ^ byte) & _MASK)
                children[name] = top
                new.append(name)
                top += 256
                node = 0
        self.at = node
        return new

    def forget(self, names: list[int], at: int) -> None:
        """Takes the last phrases back, and goes back to the phrase begun at that time."""
        for name in names:
            del self.children[name]
        del self.hashes[len(self.hashes) - len(names) :]
        self.at = at


def least(hashes: list[int], size: int = SIZE, low: np.ndarray | None = None) -> np.ndarray:
    """The ``size`` least different 32-bit values that phrases' hashes are mixed to, in order, together with low."""
    x = np.array(hashes, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    x = x if low is None else np.concatenate([low, x])
    if len(x) > 2 * size:
        few = np.unique(np.partition(x, size + 8)[: size + 8])
        if len(few) >= size:
            return few[:size]
    return np.unique(x)[:size]


def signature(values: np.ndarray) -> str:
    """Hex digits of the values in order, eight each; no phrases: the empty string."""
    return values.astype(">u4").tobytes().hex()


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def fingerprint(text: str, size: int = SIZE) -> str:
    known = Phrases()
    known.read(_bytes(text))
    return signature(least(known.hashes[1:], size))


def likeness(a: str, b: str, size: int = SIZE) -> float:
    """Estimate (0 to 1) of the shared part of two phrase sets: of the least hashes of both together, how many are in both. Two empty ones are alike."""
    if a == b:
        return 1.0
    one, two = ({x[k : k + _DIGITS] for k in range(0, len(x), _DIGITS)} for x in (a, b))
    low = sorted(one | two)[:size]
    return sum(x in one and x in two for x in low) / len(low)


def _pair(text: str, after: str, size: int) -> tuple[str, str, str]:
    """SHA-256 of the edited text, the text's fingerprint and the edited one's."""
    q = len(text) // 4
    keep, end, start = (_bytes(x) for x in (text[: len(text) - q], text[len(text) - q :], after[:q]))
    known = Phrases()
    shared = known.read(keep)
    low, begun = least(known.hashes[1:], size), known.at
    ends = known.read(end)
    whole = least(known.hashes[len(shared) + 1 :], size, low)
    known.forget(ends, begun)
    known.read(start)
    edited = least(known.hashes[len(shared) + 1 :], size, low)
    return hashlib.sha256(keep + start).hexdigest(), signature(whole), signature(edited)


def _place(key: Column, bounds: list) -> Column:
    """How many of the bounds, which are in order, the key has reached: by a coarse look, then a fine one."""
    if not bounds:
        return F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    reached = lambda some: F.size(F.filter(some, lambda b: b <= key))
    array = lambda values: F.array(*[F.lit(v) for v in values])
    coarse = reached(array(bounds[::step]))
    fine = F.transform(F.array(coarse), lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + reached(F.slice(array(bounds), (c - 1) * step + 1, step))))
    return F.when(key.isNull(), 0).otherwise(F.get(fine, F.lit(0)))


def _bounds(docs: DataFrame, ranges: int) -> list:
    """Ids that begin a range, in order."""
    ids = docs.select("id").filter("id IS NOT NULL")
    ids = ids.filter(F.rand(7) * ids.count() < min(SAMPLE, 32 * ranges))
    ids = sorted(r[0] for r in ids.collect())
    return sorted({ids[k * len(ids) // ranges] for k in range(1, ranges)}) if ids else []


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last quarter of its code points replaced by as many
    of the next text's first (or all of them). Texts follow each other by id, null
    ids first, then by a hash of the text; after the last comes the first, so a single row
    follows itself. Rows that share one id are walked by one task, one after the other. A null text is empty, with an empty fingerprint, and two
    empty ones are alike. Rows that repeat follow each other. A very long text
    is held with its neighbour, one pair at a time. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), *(T.StructField(c, t) for c, t in _TYPES)])
    ranges = min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(rows, ranges)

    at = _place(F.col("id"), bounds)
    order = F.struct(F.col("id").isNotNull().alias("some"), F.col("id").alias("id"), F.xxhash64("text").alias("h"))
    firsts = sorted(rows.select(at.alias("range"), order.alias("o")).groupBy("range").agg(F.min("o").alias("o")).collect())
    if not firsts:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    last = firsts[-1][0]
    before = {k: firsts[i - 1][0] if i else last for i, (k, _) in enumerate(firsts)}
    heads = spark.createDataFrame([(k, before[k], bool(o["some"]), o["id"], o["h"]) for k, o in firsts], T.StructType([T.StructField("range", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("some", T.BooleanType()), T.StructField("__head", kind), T.StructField("__h", T.LongType())]))
    placed = rows.withColumn("range", at).join(F.broadcast(heads), "range")
    head = F.col("id").eqNullSafe(F.col("__head")) & (F.xxhash64("text") == F.col("__h"))
    own = F.struct("range", F.lit(False).alias("after"))
    again = F.struct(F.col("before").alias("range"), F.lit(True).alias("after"))
    dealt = placed.select(F.explode(F.when(head, F.array(own, again)).otherwise(F.array(own))).alias("p"), F.col("id").isNotNull().alias("some"), "id", "text")
    dealt = dealt.select("p.*", "some", "id", F.xxhash64("text").alias("h"), "text").repartition(ranges, "range").sortWithinPartitions("range", "after", "some", "id", "h", "text")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = waiting = None  # a text without its next one yet, and the row before it, without that text's fingerprint yet
        for batch in batches:
            made = []
            for k, after, key, text in zip(*(batch.column(c).to_pylist() for c in ("range", "after", "id", "text"))):
                if held is not None and held[0] == k:
                    sha, whole, edited = _pair(held[2], text, size)
                    if waiting:
                        made.append((*waiting, likeness(waiting[3], whole, size)))
                    waiting = (held[1], len(held[2]), sha, whole, edited, likeness(whole, edited, size))
                    if after:
                        made.append((*waiting, likeness(whole, fingerprint(text, size), size)))
                        waiting = None
                held = None if after else (k, key, text)
            types = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*made) if made else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", *(c for c, _ in _TYPES)])

    return dealt.mapInArrow(walk, out).withColumnRenamed("id", id_col)
