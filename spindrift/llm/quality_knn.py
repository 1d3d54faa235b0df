"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled texts (``SAMPLE`` at most) gives term weights and a
truncated singular value decomposition on the driver. Its vectors, ``SAMPLE`` x
``RANK`` floats, are broadcast. Every document is folded into the space and its
exact cosine with every labelled vector is computed, a block of documents
against all of them in one matrix product; the ``NEIGHBOURS`` nearest vote with
weights that fall with distance. Cosines are taken in double precision and to
nine digits, and of labelled vectors that tie the first in the sample is nearer,
so a text's neighbours don't depend on the texts it is scored with.

Terms are hashed: the shape of each word with its marks, pairs of shapes in
sequence, words said twice running, and short words as they are.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, text_of

#: Labelled texts that are sampled to fit: the bound of all that reaches the driver or is broadcast.
SAMPLE = 6000
#: Bytes of their texts; longer samples end before the text that exceeds it.
SAMPLE_BYTES = 96 << 20
TERMS = 2048
RANK = 48
NEIGHBOURS = 15
#: Rows of a block in a matrix product.
BLOCK = 256

_runs = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "0"))


def _shape(word: str) -> str:
    """Runs of letters by their case, of digits as one, marks as they are (no more than three alike)."""

    def letters(m: re.Match) -> str:
        run = m[0]
        return "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "x"

    out = _runs[1][0].sub("0", _runs[0][0].sub(letters, word))
    return re.sub(r"(\W)\1{3,}", r"\1\1\1", out)[:24]


def _slot(kind: str, term: str) -> int:
    return zlib.crc32(f"{kind}{term}".encode("utf-8", "surrogatepass")) % TERMS


_REPEATED = _slot("=", "")


def term_counts(texts: list[str]) -> np.ndarray:
    """texts x TERMS counts."""
    out = np.zeros((len(texts), TERMS), np.float32)
    lists = [t.split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    if not sizes.sum():
        return out
    coded = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    shapes: dict[str, int] = {}
    shape = np.array([shapes.setdefault(_shape(w), len(shapes)) for w in words])[code]
    one = np.array([_slot("s", s) for s in shapes])
    short = np.array([_slot("w", w.lower()) if len(w) < 5 else -1 for w in words])[code]
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[1:] == owner[:-1]
    pair, at = np.unique(shape[:-1][inside] * len(shapes) + shape[1:][inside], return_inverse=True)
    names = list(shapes)
    two = np.array([_slot("p", f"{names[p // len(names)]}\t{names[p % len(names)]}") for p in pair.tolist()], np.int64)[at]
    again = inside & (code[1:] == code[:-1])
    flat = out.reshape(-1)
    for own, slot in ((owner, one[shape]), (owner[short >= 0], short[short >= 0]), (owner[1:][inside], two), (owner[1:][again], np.full(again.sum(), _REPEATED))):
        flat += np.bincount(own * TERMS + slot, minlength=len(flat)).astype(np.float32)
    return out


class Space:
    """Term weights, the projection, and labelled unit vectors with their labels."""

    def __init__(self, texts: list[str], labels: list[int], rank: int = RANK):
        x = np.zeros((len(texts), TERMS), np.float32)
        for at in range(0, len(texts), BLOCK // 2):  # the words of all texts at once would take far more than their counts
            x[at : at + BLOCK // 2] = term_counts(texts[at : at + BLOCK // 2])
        self.weight = np.log((1 + len(texts)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        for at in range(0, len(texts), BLOCK):
            x[at : at + BLOCK] = self._weighed(x[at : at + BLOCK])
        self.project = self._right_vectors(x, rank).astype(np.float64)
        self.labels = np.array(labels, np.float32)
        self.vectors = self._unit(np.concatenate([x[at : at + BLOCK].astype(np.float64) @ self.project for at in range(0, len(x), BLOCK)]))
        self.prior = float(self.labels.mean()) if len(labels) else 0.5

    @staticmethod
    def _right_vectors(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
        """The first right singular vectors, by subspace iteration from a fixed start; no matrix of terms by terms is made."""
        basis = np.random.default_rng(0).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
        for _ in range(rounds):
            basis = np.linalg.qr(x.T @ np.linalg.qr(x @ basis)[0])[0]
        rotate = np.linalg.svd(x @ basis, full_matrices=False)[2]
        return np.ascontiguousarray((basis @ rotate.T)[:, :rank], dtype=np.float32)

    def _weighed(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts) * self.weight)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def vote(self, texts: list[str], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """For each text the share of label 1 among its neighbours, by weight."""
        out = np.full(len(texts), self.prior)
        k = min(neighbours, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            vectors = self._unit(self._weighed(term_counts(texts[at : at + BLOCK])).astype(np.float64) @ self.project)
            near = vectors @ self.vectors.T
            # All that may be among the k nearest once cosines are rounded; these few are put in order.
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            row, label = np.nonzero(near >= (least - 2e-9)[:, None])
            cosine = np.rint(near[row, label] * 1e9)
            order = np.lexsort((label, -cosine, row))
            row, label, cosine = row[order], label[order], cosine[order]
            first = np.searchsorted(row, np.arange(len(vectors)))
            top = first[:, None] + np.arange(k)  # each row has k or more
            weight = np.exp(20 * (cosine[top] / 1e9 - 1))
            voted = ((weight * self.labels[label[top]]).sum(axis=1) + 1e-6 * self.prior) / (weight.sum(axis=1) + 1e-6)
            blank = ~vectors.any(axis=1)
            out[at : at + BLOCK] = np.where(blank, self.prior, voted)
        return np.clip(out, 0, 1)


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Texts and labels of at most ``size`` labelled rows of the learning folds: those whose id hashes lowest, up to SAMPLE_BYTES of text."""
    chosen = labels.filter(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__key"), F.col(label_col).cast("int").alias("__label")).orderBy(F.xxhash64(F.col("__key"), F.lit(7)), "__key", "__label").limit(size)
    rows = cut(docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__key")).select(text_of(text_col).alias("text"), "__label", "__key", F.xxhash64(F.col("__key"), F.lit(7)).alias("__order")))
    order = ["__order", "__key", "text", "__label"]
    # Sizes first, then the texts that they leave room for.
    sizes = rows.select("__order", "__key", F.octet_length("text").alias("size")).orderBy("__order", "__key", "size").limit(size).collect()
    room = sum(1 for total in np.cumsum([r["size"] for r in sizes]) if total <= SAMPLE_BYTES)
    return [(r["text"], r["__label"]) for r in sorted(rows.orderBy(*order).limit(room).collect(), key=lambda r: (r["__key"], r["text"], r["__label"]))]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> Space | None:
    """The space of a sample of labelled rows; by default those whose crc32(id) mod 5 isn't 0. None if there are none."""
    rows = sample(docs, labels, label_col, fold(id_col, 5) != 0 if learn is None else learn, size, id_col, text_col)
    return Space([t for t, _ in rows], [y for _, y in rows]) if rows else None


def score(docs: DataFrame, space: Space | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score (0 to 1, higher: label 1 likelier) as a column; a column of that name is replaced.

    Null, empty and blank texts have the sample's share of label 1, and where
    nothing was learned every score is 0.5. Equal texts have equal scores. Whole
    texts are counted, however long, and other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    @F.arrow_udf("double")
    def vote(texts: pa.Array) -> pa.Array:
        held = [t or "" for t in texts.to_pylist()]
        return pa.array(shared.value.vote(held) if shared.value is not None else np.full(len(held), 0.5))

    return docs.select(*[c for c in docs.columns if c != out], vote(F.col(text_col).cast("string")).alias(out))
