"""A stored vector index: a tree of centres in three levels, vectors filed by leaf, codes for a first look.

The tree and the codebooks are fitted once, on a bounded sample. Every vector is
then filed under the leaf that greedy descent leads it to (``leaf=N`` folders),
beside a code of ``PARTS`` bytes: for each part of the vector the nearest of up to
256 codewords. A search lists the leaves its queries look into, so Spark opens the files of
those alone, reads ids and codes of them, and fetches whole vectors only for the
best ``refine`` candidates of each query, which it scores exactly.

How many leaves a query looks into is measured, not set: at fitting, sampled
vectors are taken as queries and their true neighbours among the sample looked
up, and ``probes`` is the least number of leaves that holds the wanted share of
them. Vectors in clusters need few, vectors without clusters many.

New vectors are filed by the stored tree; nothing is rebuilt. One index folder has
one writer at a time; readers see whole files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from . import retrieval as R

#: Children of a node on each level; rows that all is fitted on, at most, and a leaf's least share of them; bytes of a code.
BRANCHES, SAMPLE, LEAF_SAMPLE, PARTS = (8, 8, 8), 20_000, 8, 16
#: Rows scored at once, and ids whose leaves a task remembers beside its candidates'.
_ROWS, _LEAVES_HELD = 1024, 500_000


class Tree(NamedTuple):
    """levels: for each level its centres and the number of each one's parent; the last are the leaves. books: part, codeword, values."""

    levels: list[tuple[np.ndarray, np.ndarray]]
    books: np.ndarray
    probes: int

    @property
    def leaves(self) -> np.ndarray:
        return self.levels[-1][0]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: the nearest child, level by level."""
        at = np.zeros(len(x), np.int64)
        for centres, parent in self.levels:
            cosine = x @ centres.T
            cosine[at[:, None] != parent[None, :]] = -np.inf
            at = cosine.argmax(axis=1)
        return at

    def code(self, x: np.ndarray) -> np.ndarray:
        """A byte for each part of each unit vector."""
        parts = x.reshape(len(x), len(self.books), -1)
        far = (self.books**2).sum(axis=2)[None] - 2 * np.einsum("npd,pcd->npc", parts, self.books)
        return far.argmin(axis=2).astype(np.uint8)

    def near(self, q: np.ndarray) -> np.ndarray:
        """The leaves that each query looks into, nearest first."""
        return np.argsort(-(q @ self.leaves.T), axis=1, kind="stable")[:, : self.probes]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """query, part, codeword: what each codeword adds to the query's cosine."""
        return np.einsum("npd,pcd->npc", q.reshape(len(q), len(self.books), -1), self.books)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10, sphere: bool = True) -> np.ndarray:
    """k centres at most: of directions, or of points."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T - (0 if sphere else (centres**2).sum(axis=1) / 2)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, unit(sums) if sphere else sums / np.maximum(n, 1), centres)
    return centres


def fit(vectors: DataFrame, vector_col: str = "embedding", k: int = V.TOP_K, recall: float = 0.97, branches: tuple[int, ...] = BRANCHES, sample: int = SAMPLE, parts: int = PARTS, seed: int = 7) -> Tree:
    """The tree, from the rows whose vectors hash lowest, at most ``sample``; a node with too few of them has fewer children, at least one.

    recall: the share of true neighbours that the leaves looked into have to hold.
    """
    chosen = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64("v", F.lit(seed))).limit(sample).collect()
    if not chosen:
        raise ValueError("no vectors to fit a tree on")
    x, rng = unit(np.array([r["v"] for r in chosen], np.float64)), np.random.default_rng(seed)
    at, levels = np.zeros(len(x), np.int64), []
    for width in branches:
        centres, parents, own = [], [], np.empty(len(x), np.int64)
        for node in range(at.max() + 1):
            rows = np.flatnonzero(at == node)
            if not len(rows):  # nothing of the sample lies here: the node stays as it is
                found = levels[-1][0][node][None]
            else:
                found = _means(x[rows], max(1, min(width, len(rows) // LEAF_SAMPLE)), rng)
            own[rows] = len(parents) + (x[rows] @ found.T).argmax(axis=1)
            centres.append(found)
            parents += [node] * len(found)
        levels.append((np.concatenate(centres), np.array(parents)))
        at = own
    while x.shape[1] % parts:
        parts -= 1
    books = np.stack([np.pad(b := _means(p, 256, rng, sphere=False), ((0, 256 - len(b)), (0, 0)), constant_values=1e6) for p in np.moveaxis(x.reshape(len(x), parts, -1), 1, 0)])
    tree = Tree(levels, books, len(levels[-1][0]))
    return tree._replace(probes=_probes(tree, x, k, recall))


def _probes(tree: Tree, x: np.ndarray, k: int, recall: float) -> int:
    """The least number of leaves that hold the share of the k nearest others, over sampled vectors as queries."""
    asked = x[: min(len(x), 1000)]
    cosine = asked @ x.T
    cosine[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-cosine, axis=1)[:, : min(k, max(1, len(x) - 1))]
    place = np.argsort(np.argsort(-(asked @ tree.leaves.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, tree.leaf(x)[best], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def save(spark: SparkSession, tree: Tree, path: str) -> None:
    parts = [{"centres": c.tolist(), "parents": p.tolist()} for c, p in tree.levels]
    text = json.dumps({"levels": parts, "books": tree.books.tolist(), "probes": tree.probes})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/tree")


def load(spark: SparkSession, path: str) -> Tree:
    held = json.loads(spark.read.text(f"{path}/tree", wholetext=True).first()["value"])
    return Tree([(np.array(x["centres"]), np.array(x["parents"])) for x in held["levels"]], np.array(held["books"]), held["probes"])


def insert(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", tree: Tree | None = None) -> None:
    """Files vectors under the leaves of the index at path; null ones are left out. A leaf that is crowded in one insert is written by more than one task."""
    tree = tree or load(vectors.sparkSession, path)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    @F.arrow_udf("struct<leaf: int, code: binary>")
    def file(lists: pa.Array) -> pa.Array:
        x = unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)) if len(lists) else np.zeros((0, shared.value.leaves.shape[1]))
        codes = [c.tobytes() for c in shared.value.code(x)] if len(x) else []
        return pa.StructArray.from_arrays([pa.array(shared.value.leaf(x).astype(np.int32)), pa.array(codes, pa.binary())], names=["leaf", "code"])

    rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    rows.withColumn("f", file("v")).select("id", "v", "f.code", "f.leaf").hint("rebalance", "leaf").write.mode("append").partitionBy("leaf").parquet(f"{path}/rows")


def build(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", **how) -> Tree:
    """Fits a tree and files all vectors at path, a folder that isn't there yet. how: of ``fit``."""
    tree = fit(vectors, vector_col, **how)
    save(vectors.sparkSession, tree, path)
    insert(vectors, path, id_col, vector_col, tree)
    return tree


def candidates(spark: SparkSession, path: str, queries: DataFrame, refine: int, tree: Tree) -> DataFrame | None:
    """query_id, leaf, id of the ``refine`` best by their codes in each query's leaves; None without queries. Queries go to the tasks in blocks."""
    stored = spark.read.parquet(f"{path}/rows").select("id", "code", "leaf")
    kind, query_kind = dict(stored.dtypes)["id"], dict(queries.dtypes)["query_id"]
    found, rows = None, queries.filter("embedding IS NOT NULL").select("query_id", "embedding").toLocalIterator()
    while batch := list(islice(rows, R.MAX_QUERIES)):
        q = unit(np.array([r["embedding"] for r in batch], np.float64))
        near = tree.near(q)
        lookers = {int(leaf): np.flatnonzero((near == leaf).any(axis=1)) for leaf in np.unique(near)}
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in batch], tree.tables(q), lookers))

        def best(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, tables, lookers = shared.value
            held = R._Best(len(ids), refine)
            leaf_of: dict = {}
            for part in parts:
                leaves = part["leaf"].to_numpy()
                names = part["id"].to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
                for leaf in np.unique(leaves):
                    own, inside = lookers[int(leaf)], np.flatnonzero(leaves == leaf)
                    for rows in np.array_split(inside, -(-len(inside) // _ROWS)):
                        held.add(own, names[rows], sum(tables[own, p][:, codes[rows, p]] for p in range(codes.shape[1])))
                leaf_of.update(zip(names.tolist(), leaves.tolist()))
                if len(leaf_of) > _LEAVES_HELD + held.size:
                    leaf_of = {x: leaf_of[x] for _, held_names, _ in held.parts for x in held_names.tolist()}
            for out in held.batches(pa.array(ids).to_numpy(zero_copy_only=False)):
                leaf = pa.array([leaf_of[x] for x in out["id"].to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([*out.columns, leaf], names=["query_id", "id", "score", "leaf"])

        own = stored.filter(F.col("leaf").isin(sorted(lookers))).mapInArrow(best, f"query_id {query_kind}, id {kind}, score double, leaf int")
        found = own if found is None else found.unionByName(own)
    return None if found is None else R.top(found, refine).select("query_id", "leaf", "id")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = V.TOP_K, refine: int = 64, tree: Tree | None = None) -> DataFrame:
    """query_id, id, score, rank: the k best by exact cosine of the ``refine`` candidates of each query. queries: query_id, embedding; null ones find nothing.

    A query whose leaves hold fewer than k vectors gets what they hold. Ids filed more than once come back as often.
    """
    tree = tree or load(spark, path)
    near = candidates(spark, path, queries, max(refine, k), tree)
    stored = spark.read.parquet(f"{path}/rows")
    if near is None:
        kind, query_kind = dict(stored.dtypes)["id"], dict(queries.dtypes)["query_id"]
        return spark.createDataFrame([], f"query_id {query_kind}, id {kind}, score double, rank int")
    near = R.settled(near)
    asked = queries.select("query_id", F.col("embedding").alias("q"))
    pairs = stored.select("leaf", "id", "v").join(R.bounded(near), ["leaf", "id"]).join(R.bounded(asked), "query_id")
    return R.top(pairs.select("query_id", "id", R.cosine("q", "v").alias("score")), k)
