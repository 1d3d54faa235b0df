"""SimHash near-duplicates by a Gray-order hierarchical index.

1. A fingerprint for every text (64 majority bits over the hashes of its shingles).
2. Distinct fingerprints are cut into ``m`` bit blocks. Two within ``distance``
   bits agree in at least ``m - distance`` whole blocks, so each choice of that
   many blocks, with their values, is a root of the index: a shared exact bit
   pattern. m grows with the number of distinct fingerprints, which keeps roots small.
3. Under a root the members stand in the order of their Gray rank, where
   neighbours differ in few bits. Runs of ``FANOUT`` form leaves, runs of leaves
   inner nodes. A node factors out the bits that its members share and its
   parent's don't. A search adds up, from the root down, the differences in the
   factored bits and drops a node with all its members once they exceed the distance.
4. Roots with more than ``CHUNK`` members are dealt into chunks, and each pair of
   chunks is a task of its own, so no task holds a large group. That copies a member
   once for each chunk, so a root of more than ``DENSE`` chunks is first put under finer
   roots, the same choice of blocks among the bits that it leaves open, wherever
   counting them shows that this makes less than half as many rows; at most ``LEVELS``
   times. Copies share one fingerprint and so one member.
5. A task returns a spanning forest of its links, not all pairs; minimum labels
   with pointer jumping join the forests in checkpointed rounds on the cluster.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, text_of

DISTANCE = 4
WORDS = 4
#: Members of a run that a node stands for.
FANOUT = 16
#: Members of a root in one task's half; larger roots are dealt into chunks of about this many.
CHUNK = 512
#: Chunks of a root from which on finer roots are tried, blocks of a finer choice, and how often roots may be refined.
DENSE, FINER, LEVELS = 8, 6, 3

#: Queries of a search at once.
QUERIES = 256

_word = re.compile(rb"[^\x20\x09-\x0D]+")
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The majority bits of the shingle hashes (XXH64, seed 42); no words: 0."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() is A-Z alone
    tokens = _word.findall(raw)
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    if len(tokens) <= words:
        spans = [joined]
    else:
        starts = [0, *(ends[:-words] + 1).tolist()]
        spans = [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in spans), np.uint64, len(spans))
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.where(2 * ones > len(hashes), np.uint64(1) << _SHIFTS, np.uint64(0))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id and fp (the 64 bits as a signed long) for every row of docs."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return docs.select(F.col(id_col), of(text_of(text_col)).alias("fp"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Members in Gray order under nodes that factor out the bits that they share."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.fanout = codes[self.order], fanout
        same = np.full(len(codes), ~np.uint64(0))
        levels = [(self.codes, same)]  # bottom: the members, all bits their own
        while len(levels[-1][0]) > 1:
            value, shared = levels[-1]
            cuts = np.arange(0, len(value), fanout)
            ones, zeros = np.bitwise_and.reduceat(value | ~shared, cuts), np.bitwise_or.reduceat(value & shared, cuts)
            shared = np.bitwise_and.reduceat(shared, cuts) & ~(ones ^ zeros)
            levels.append((ones & shared, shared))
        self.levels = levels[::-1]

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member): all within the distance, members as places in the codes given."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        gone = np.zeros(len(queries), np.int64)
        above = np.zeros(1, np.uint64)
        parent = node
        for depth, (value, shared) in enumerate(self.levels):
            if depth:
                first = node * self.fanout
                many = np.minimum(first + self.fanout, len(value)) - first
                parent = np.repeat(node, many)
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                node, q, gone = np.repeat(first, many) + inside, np.repeat(q, many), np.repeat(gone, many)
            fresh = shared[node] & ~above[parent]  # factored out here, not above
            gone = gone + np.bitwise_count((queries[q] ^ value[node]) & fresh)
            keep = gone <= distance
            q, node, gone, above = q[keep], node[keep], gone[keep], shared
        return q, self.order[node]


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """How many bit blocks: enough that roots have a few hundred members at n even fingerprints."""
    return next((m for m in range(distance + 1, 2 * distance + 1) if n <= 256 << (64 * (m - distance) // m)), 2 * distance)


def _roots(m: int, distance: int, fixed: int = 0) -> list[int]:
    """The masks of all choices of m - distance out of m blocks of the bits outside ``fixed``, with fixed itself."""
    free = [1 << i for i in range(64) if not fixed >> i & 1]
    edges = [len(free) * i // m for i in range(m + 1)]
    block = [sum(free[edges[i] : edges[i + 1]]) for i in range(m)]
    return [fixed | sum(block[i] for i in chosen) for chosen in itertools.combinations(range(m), m - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member of its part) for each of the codes that isn't the first itself.

    The pairs found by a block of queries lower the labels at once and are
    dropped, so a dense group takes memory by its members, not by its pairs.
    """
    index, label = GrayIndex(codes), np.arange(len(codes))
    while True:
        low = label.copy()
        for at in range(0, len(codes), QUERIES):
            q, hit = index.search(codes[at : at + QUERIES], distance)
            np.minimum.at(low, q + at, low[hit])
            np.minimum.at(low, hit, low[q + at])
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low, label):
            moved = np.flatnonzero(label != np.arange(len(codes)))
            return codes[moved], codes[label[moved]]
        label = low


def _chunks(n: str) -> Column:
    return F.ceil(F.col(n) / CHUNK).cast("long")


def _under(masks: list[int], first: int) -> Column:
    """Structs of root (numbered from first) and value for a fingerprint under each mask."""
    return F.array(*[F.struct(F.lit(first + i).alias("root"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value")) for i, mask in enumerate(masks)])


def _pairs(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """root, value, i, j, fp: a member of chunk c meets every chunk d as the pair (least, greatest) of c and d."""
    dealt = rows.join(sizes, ["root", "value"]).withColumn("k", _chunks("n")).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")))
    spread = dealt.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return spread.select("root", "value", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "fp")


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """src, dst: links among distinct fingerprints (column fp) whose parts are those of all links."""
    n = distinct.count()
    masks, first, pairs = _roots(blocks_for(n, distance), distance), 0, []
    rows = distinct.select("fp", F.explode(_under(masks, first)).alias("r")).select("fp", "r.root", "r.value")
    for level in range(LEVELS):
        sizes = cut(rows.groupBy("root", "value").agg(F.count("*").alias("n")).filter("n > 1"))
        dense = sizes.filter(_chunks("n") > DENSE)
        if level == LEVELS - 1 or dense.isEmpty():
            pairs.append(_pairs(rows, sizes))
            break
        finer = [_roots(FINER, distance, mask) for mask in masks]
        flat, after = [m for own in finer for m in own], first + len(masks)
        # The finer roots of root r are a slice of all of them; only dense roots' members come here.
        own = F.slice(F.array(*[F.lit(_signed(m)) for m in flat]), (F.col("root") - first) * len(finer[0]) + 1, F.lit(len(finer[0])))
        numbered = F.transform(own, lambda mask, i: F.struct((F.lit(after) + (F.col("root") - first) * len(finer[0]) + i).cast("int").alias("root"), F.col("fp").bitwiseAND(mask).alias("value")))
        split = rows.join(small(dense), ["root", "value"]).select("root", "value", "n", "fp", F.explode(numbered).alias("r"))
        cost = split.groupBy("root", "value", "n", "r").agg(F.count("*").alias("m")).groupBy("root", "value", "n").agg(F.sum(F.col("m") * _chunks("m")).alias("cost"))
        pays = cut(cost.filter(2 * F.col("cost") < F.col("n") * _chunks("n")).select("root", "value"))
        pairs.append(_pairs(rows, sizes.join(small(pays), ["root", "value"], "left_anti")))
        if pays.isEmpty():
            break
        rows = cut(split.join(small(pays), ["root", "value"], "left_semi").select("fp", "r.root", "r.value"))
        masks, first = flat, after
    keys = ["root", "value", "i", "j"]
    tasks = reduce(DataFrame.unionByName, pairs).repartition(*keys).sortWithinPartitions(*keys)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if held is None or not len(held):
                continue
            key = held[keys].to_numpy(np.int64)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            cuts = [0, *cuts.tolist()] + ([len(held)] if batch is None else [])  # the last group may go on in the next batch
            codes = held["fp"].to_numpy(np.int64).view(np.uint64)
            src, dst = [], []
            for x, y in itertools.pairwise(cuts):
                if y - x > 1:
                    member, first = _forest(codes[x:y], distance)
                    src.append(member)
                    dst.append(first)
            held = held.iloc[cuts[-1] :] if batch is not None else None
            if sum(map(len, src)):
                yield pd.DataFrame({"src": np.concatenate(src).view(np.int64), "dst": np.concatenate(dst).view(np.int64)})

    return tasks.mapInPandas(search, "src long, dst long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least label that each node can reach. nodes: node, label; edges: src, dst.

    Rounds of minimum over neighbours, then a jump to the label's own label, until none changes;
    each round is checkpointed. The work of a round follows the links, not the documents.
    """
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    linked = both.select(F.col("src").alias("node")).distinct()
    # Labels are node names at first (each node its own), so that a label can be followed like a node.
    at = cut(linked.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(at, both["dst"] == at["node"]).groupBy("src").agg(F.min("label").alias("least"))
        low = at.join(near, at["node"] == near["src"], "left").select("node", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        jump = at.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = cut(low.join(jump, "label").select("node", "was", F.least("label", "further").alias("label")))
        at = step.select("node", "label")
        if step.filter("was != label").isEmpty():
            break
    least = at.join(nodes, "node").groupBy(at["label"]).agg(F.min(nodes["label"]).alias("component"))
    found = at.join(least, "label").select("node", "component")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "label").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (least id that links of the distance reach), for every row.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other. Rows of one text share a component. A null id belongs to its
    component but doesn't name it; a component of null ids alone has a null name.
    Rows that repeat an id each come back. Empty tables give no rows. Whole texts
    are read, however long, and other columns don't matter.
    """
    prints = cut(fingerprints(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, words).select(F.col(id_col).alias("id"), "fp"))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    nodes = distinct.select(F.col("fp").alias("node"), F.col("least").alias("label"))
    # Written first, so that the last join has shuffles on both sides, which adaptive execution can split at frequent fingerprints.
    named = cut(components(nodes, links(distinct.select("fp"), distance)).select(F.col("node").alias("fp"), F.col("label").alias("component_id")))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
