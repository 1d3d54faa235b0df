"""Byte-level BPE by a distinct-word table.

Texts are split into the tokenizer's words inside Spark, the distinct words are
encoded once each on the cluster, and a text's ids are its words' ids joined
back by position. Decoding joins ids to pieces (their bytes) and glues them.

The word table grows more slowly than the corpus, but it grows. It is broadcast
as sorted hashes with offsets into the ids, and texts are encoded where they are,
without a shuffle. Its bytes are counted first: of a table above ``BROADCAST_BYTES``
the words that occur oftenest are broadcast, as many as fit, and a batch of texts encodes those of its
distinct words that aren't among them, which make up few places: a word of one place
costs no more there than in the table. Both give the same ids.
The id-to-piece table has one row for each id of the vocabulary.

The tokenizer file is read on the driver from the path given and sent along, so
executors need no copy of it. It must be byte-level BPE with the usual splitting pattern.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Bytes of the word table (hashes, offsets and ids) that are broadcast at most.
BROADCAST_BYTES = 128 << 20

# Unicode's White_Space, spelled out: in Java \s is ASCII alone.
_S = r"\t-\r \x85\xA0  -     　"


def pattern(specials: list[str]) -> str:
    """The words of byte-level BPE in Java's syntax; special tokens are words, and end the text before them."""
    marks = "|".join(re.sub(r"([^\w\s])", r"\\\1", s) for s in specials)
    stop, cut_off, first = (f"(?!{marks})", rf"|[{_S}]+(?={marks})", f"{marks}|") if specials else ("", "", "")
    return rf"{first}'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:{stop}[^{_S}\p{{L}}\p{{N}}])+{cut_off}|[{_S}]+(?![^{_S}])|[{_S}]+"


@lru_cache(maxsize=2)
def _tokenizer(source: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(source)
    own.no_truncation()
    own.no_padding()
    return own


class Vocabulary:
    """A tokenizer file: its text, its special tokens, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        held = json.loads(self.source)
        if held["model"]["type"] != "BPE" or (held["pre_tokenizer"] or {}).get("type") != "ByteLevel" or held["pre_tokenizer"].get("add_prefix_space") or held["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        added = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.specials = sorted(added, key=len, reverse=True)
        # Bytes that print stand for themselves, the others for the code points from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in held["model"]["vocab"].items()} | {i: s.encode() for s, i in added.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.width = np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32


def words(text: Column, specials: list[str]) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(specials)), F.lit(0))


def _hash(word: Column) -> Column:
    return F.xxhash64(word)


def distinct_words(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """word, n: how often each different word occurs."""
    # outer: an inner explode would split each text twice, once for a filter on the number of its words that Spark infers
    return docs.select(F.explode_outer(words(text_of(text_col), vocabulary.specials)).alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))


def word_table(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """The encoded distinct words of all texts, written to the checkpoint folder.

    A row holds the words of a batch that occur about as often: class (the power of two), n, n_ids, and packed the words' hashes
    (8 bytes each), how many ids each has (4 bytes) and the ids (2 bytes, 4 if
    the vocabulary needs them). That takes a quarter of the space of a row for each word.
    """
    source, width = docs.sparkSession.sparkContext.broadcast(vocabulary.source), vocabulary.width

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(source.value)
        for batch in batches:
            often = batch["class"].to_numpy()
            for k in np.unique(often):
                some = batch.filter(pa.array(often == k))
                lists = [e.ids for e in own.encode_batch_fast(some["word"].to_pylist(), add_special_tokens=False)]
                sizes = np.fromiter(map(len, lists), np.uint32, len(lists))
                ids = np.fromiter((i for x in lists for i in x), width, int(sizes.sum()))
                packed = [some["hash"].to_numpy().tobytes(), sizes.tobytes(), ids.tobytes()]
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([len(lists)]), pa.array([len(ids)]), *[pa.array([x], pa.binary()) for x in packed]], names=["class", "n", "n_ids", "hashes", "sizes", "ids"])
        del own
        _tokenizer.cache_clear()  # the worker goes on to other tasks, which may have no use for it

    distinct = distinct_words(docs, vocabulary, text_col)
    often = F.floor(F.log2("n")).cast("int")
    return cut(distinct.select("word", _hash(F.col("word")).alias("hash"), often.alias("class")).mapInArrow(encode, "class int, n long, n_ids long, hashes binary, sizes binary, ids binary"))


def _fitting(table: DataFrame, vocabulary: Vocabulary, most: int) -> tuple[int, bool]:
    """The least class of words that are broadcast, so that these take so many bytes at most, and whether that is all of them."""
    held = {r["class"]: 12 * r["n"] + np.dtype(vocabulary.width).itemsize * r["n_ids"] for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids")).collect()}
    total = 0
    for k in sorted(held, reverse=True):
        total += held[k]
        if total > most:
            return k + 1, False
    return 0, True


def _shared_hashes(table: DataFrame) -> np.ndarray:
    """Hashes that two words or more have."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes in batch["hashes"].to_pylist():
                yield pa.record_batch([pa.array(np.frombuffer(hashes, np.int64))], names=["hash"])

    found = table.select("hashes").mapInArrow(unpack, "hash long").groupBy("hash").count().filter("count > 1")
    return np.array([r["hash"] for r in found.collect()], np.int64).view(np.uint64)


def _packed(table: DataFrame, vocabulary: Vocabulary, shared: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, where the ids of each begin and end, and the ids; without those hashes that words share, looked for here unless they are given."""
    # A partition at a time, and each array freed once the next is made: the driver holds the table about twice at most.
    parts: tuple[list[bytes], list[bytes], list[bytes]] = ([], [], [])
    for row in table.select("hashes", "sizes", "ids").toLocalIterator():
        for held, got in zip(parts, row, strict=True):
            held.append(bytes(got))
    hashes, sizes = np.frombuffer(b"".join(parts[0]), np.uint64), np.frombuffer(b"".join(parts[1]), np.uint32).astype(np.int32)
    parts[0].clear()
    parts[1].clear()
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    hashes = hashes[order]
    if shared is None:
        shared = hashes[1:][hashes[1:] == hashes[:-1]]
    begin = (np.cumsum(sizes, dtype=np.int64) - sizes)[order]
    sizes = sizes[order]
    del order
    if len(shared):
        single = ~np.isin(hashes, shared)
        hashes, begin, sizes = hashes[single], begin[single], sizes[single]
    flat = np.frombuffer(b"".join(parts[2]), vocabulary.width)
    parts[2].clear()
    ids = _gather(flat, begin, sizes)
    del flat, begin
    return hashes, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.uint32), ids


def _gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """flat[begin:begin + length] for each, one after the other; in steps, which bounds the index arrays."""
    parts = []
    for i in range(0, len(begin), step):
        some, end = length[i : i + step], np.cumsum(length[i : i + step])
        parts.append(flat[np.arange(end[-1]) + np.repeat(begin[i : i + step] - (end - some), some)])
    return np.concatenate(parts) if parts else flat[:0]


def _offsets(owner_ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Offsets of the owners' joined parts: owner i has the parts up to owner_ends[i + 1]."""
    return np.concatenate([[0], np.cumsum(lengths)])[owner_ends]


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", out: str = "ids", broadcast_bytes: int = BROADCAST_BYTES, decoded: str | None = None) -> DataFrame:
    """docs with the ids of the text (array of int) as a column; a column of that name is replaced.

    With ``decoded`` the text that the ids decode to is a column too, as decode() gives
    it, but made in the same pass: a second one would need Python workers of its own.

    Null and empty texts have no ids. A special token's string in a text is that
    token. Rows that repeat are encoded alike, whatever their ids. Texts are encoded whole, however long, and an empty table gives no rows.
    """
    context, vocabulary = docs.sparkSession.sparkContext, Vocabulary(path)
    table = word_table(docs, vocabulary, text_col)
    least, whole = _fitting(table, vocabulary, broadcast_bytes)
    shared = None if whole else _shared_hashes(table)
    keep = [c for c in docs.columns if c not in (out, decoded)]
    pieces = words(text_of(text_col), vocabulary.specials)
    piece_table = _piece_table(vocabulary) if decoded else None
    packed, source = context.broadcast((*_packed(table.filter(F.col("class") >= least), vocabulary, shared), piece_table)), context.broadcast(vocabulary.source)

    def join(lists: pa.Array) -> pa.Array:
        hashes, starts, flat, _ = packed.value
        if not len(lists.flatten()):
            return pa.array([[]] * len(lists), pa.list_(pa.int32()))
        coded = lists.flatten().dictionary_encode()
        own = coded.dictionary.to_pylist()
        found = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in own), np.uint64, len(own))
        at = np.searchsorted(hashes, found)
        known = at < len(hashes)
        known[known] = hashes[at[known]] == found[known]
        begin = starts[at[known]].astype(np.int64)
        length = np.empty(len(own), np.int64)
        length[known] = starts[at[known] + 1] - begin
        ids = _gather(flat, begin, length[known])
        # words that the table doesn't have, or whose hash isn't theirs alone
        if len(other := np.flatnonzero(~known)):
            more = [e.ids for e in _tokenizer(source.value).encode_batch_fast([own[i] for i in other], add_special_tokens=False)]
            length[other] = [len(x) for x in more]
            ids = np.concatenate([ids, np.array([i for x in more for i in x], flat.dtype)])
        order = np.concatenate([np.flatnonzero(known), other])
        begin = np.empty(len(own), np.int64)
        begin[order] = np.cumsum(length[order]) - length[order]
        index = coded.indices.to_numpy()
        ends = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        ids, length = _gather(ids, begin[index], length[index]).astype(np.int32), length[index]
        return pa.ListArray.from_arrays(pa.array(_offsets(ends, length).astype(np.int32)), pa.array(ids))

    if not decoded:
        return docs.select(*keep, F.arrow_udf(join, "array<int>")(pieces).alias(out))

    @F.arrow_udf("struct<ids: array<int>, text: string>")
    def both(lists: pa.Array) -> pa.Array:
        ids = join(lists)
        return pa.StructArray.from_arrays([ids, _glue(ids, packed.value[-1])], names=["ids", "text"])

    return docs.select(*keep, both(pieces).alias("__bpe")).select(*keep, F.col("__bpe.ids").alias(out), F.col("__bpe.text").alias(decoded))


def _piece_table(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces' bytes, where each id's begin, and how many they are."""
    length = np.array([len(p) for p in vocabulary.pieces], np.int64)
    return np.frombuffer(b"".join(vocabulary.pieces), np.uint8), np.cumsum(length) - length, length


def _glue(lists: pa.Array, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The id-to-piece join: each id becomes its piece, and a list's pieces one text."""
    flat, begin, length = table
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    raw = _gather(flat, begin[ids], length[ids]).tobytes()
    at = _offsets(np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py(), length[ids]).tolist()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)], pa.string())


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of the ids as a column; a column of that name is replaced.

    Bytes that aren't UTF-8 become U+FFFD. No ids, or null, give the empty text; an id outside the vocabulary is an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(_piece_table(Vocabulary(path)))
    glue = F.arrow_udf(lambda lists: _glue(lists, shared.value), "string")
    return df.select(*[c for c in df.columns if c != out], glue(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))).alias(out))
