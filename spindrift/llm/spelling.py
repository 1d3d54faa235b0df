"""Spelling variants: words one edit apart, found by Aho-Corasick automata over halves.

One edit leaves one of a word's two halves as it is, at the start or at the end
of the other word, whose length is the same or one more. So a shard's automaton
holds halves, the words that could have one of them are scanned by it, a hit has
to lie at the start (or end) with a length that fits, and what is left of both
words has to be one edit apart.

A word goes to the shards of its own halves and, as the longer word of a pair, to
those of the halves that a word one shorter would have: four small rows a word,
whatever the vocabulary. A half that more than ``HOT`` words share is taken out
and what is left of these words is halved again, until no half is: a frequent
beginning costs rows, not pairs. A pair is counted in one place only, on the path
that takes the first half where both would do, and shards send on sums for each
word instead of pairs.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from operator import ne
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SQL_CRC_TABLE, cut, small, small_batches, sql_crc, sql_lower, text_of

#: Rows of a shard on average; words that share a half beyond which they are halved again for other shards, or in the shard; distinct words that a task counts before it sends them on.
SHARD_ROWS, HOT, FEW, HELD = 50_000, 1000, 16, 200_000

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_RUN = re.compile("[a-zÀ-ÿ]+")


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """word, n: runs of letters of all texts in lower case (A-Z only) with ``shortest`` letters and ``least`` occurrences overall.

    Where ``every`` divides the crc32 of "id:run", the run loses one letter first; a null id is the empty text there.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = crc32(f"{key}:".encode())
                for run, n in Counter(_RUN.findall(text.translate(_LOWER).decode("utf-8", "replace"))).items():
                    h = crc32(run.encode(), start)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= shortest:
                        held[run] += n
            if len(held) >= HELD:
                yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held.clear()
        yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(text_of(id_col).alias("k"), text_of(text_col).cast("binary").alias("t")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _halved(rows: DataFrame) -> DataFrame:
    """rows of (parent, path, text, gap, word, n), one for each side: side, key (of parent, side and half) and rest.

    gap is by how many letters text is longer than the texts whose halves are looked for.
    """
    own = F.char_length("text") - F.col("gap")
    half = F.floor(own / 2).cast("int")
    first = F.struct(F.lit("P").alias("side"), F.col("text").substr(F.lit(1), half).alias("half"), F.col("text").substr(half + 1, F.char_length("text")).alias("rest"))
    second = F.struct(F.lit("S").alias("side"), F.col("text").substr(half + F.col("gap") + 1, F.char_length("text")).alias("half"), F.col("text").substr(F.lit(1), half + F.col("gap")).alias("rest"))
    both = rows.select("*", F.explode(F.array(first, second)).alias("__s")).select(*rows.columns, "__s.*")
    return both.withColumn("key", F.xxhash64("parent", "side", "half")).drop("half")


def one_edit(a: str, b: str) -> bool:
    """Whether b, as long as a or one longer, is a with one letter replaced or put in."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def _here(a: str, b: str, path: str) -> bool:
    """Whether the path is the one on which the pair is counted: the first half wherever both words have it."""
    gap = len(b) - len(a)
    for side in path:
        half = len(a) // 2
        if (b[:half] == a[:half]) != (side == "P"):
            return False
        a, b = (a[half:], b[half:]) if side == "P" else (a[:half], b[: half + gap])
    return True


class _Sharing:
    """Words that share a half: (rest, word, n) of each, looked up by a half of the rest where they are more than a few."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int]] = []
        self.by_half: dict | None = None

    def like(self, rest: str, gap: int) -> Iterator[tuple[str, str, int]]:
        """Those whose rest could be one edit from this one, which is longer by gap; each once."""
        if len(self.rows) <= FEW:
            yield from self.rows
            return
        half = (len(rest) - gap) // 2
        if self.by_half is None:
            self.by_half = defaultdict(list)
            for row in self.rows:
                self.by_half["P", row[0][:half]].append(row)
                self.by_half["S", row[0][half:]].append(row)
        first = rest[:half]
        yield from self.by_half.get(("P", first), ())
        for row in self.by_half.get(("S", rest[half + gap :]), ()):
            if row[0][:half] != first:
                yield row


def _scan(table: pa.Table) -> pa.Table:
    """word, near, best_n, best of the words of one shard: how many words of it are one edit away, and the most frequent (then smallest) of them."""
    import ahocorasick

    rows = list(zip(*(table[c].to_pylist() for c in ("parent", "path", "side", "text", "gap", "word", "n"))))
    having: dict = defaultdict(_Sharing)
    for parent, _, side, text, gap, word, n in rows:
        if not gap:
            half = len(text) // 2
            first, second = text[:half], text[half:]
            if side == "P":
                having[parent, side, first].rows.append((second, word, n))
            else:
                having[parent, side, second].rows.append((first, word, n))
    automaton = ahocorasick.Automaton()
    for _, _, half in having:
        automaton.add_word(half, half)
    automaton.make_automaton()
    found: dict[str, list] = {}

    def add(word: str, n: int, near: str) -> None:
        have = found.get(word)
        if have is None:
            found[word] = [1, -n, near]
        else:
            have[0] += 1
            have[1:] = min((have[1], have[2]), (-n, near))

    for parent, path, side, text, gap, word, n in rows:
        half = (len(text) - gap) // 2
        size, rest = (half, text[half:]) if side == "P" else (len(text) - gap - half, text[: half + gap])
        # The segment has to be as long as that half and to lie at the text's start, or its end.
        ends_at = size - 1 if side == "P" else len(text) - 1
        for end, segment in automaton.iter(text):
            if end != ends_at or len(segment) != size or (parent, side, segment) not in having:
                continue
            for other, near, m in having[parent, side, segment].like(rest, gap):
                if len(other) + gap == len(rest) and one_edit(other, rest) and _here(near, word, path + side):
                    add(word, m, near)
                    if gap:
                        add(near, n, word)
    out = [(w, c, -n, best) for w, (c, n, best) in found.items()]
    columns = zip(*out) if out else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best_n, best for words (word, n, all different, two letters or more) that have others one edit away."""
    length = F.char_length("word")
    roles = F.explode(F.array(F.lit(0), F.lit(1))).alias("gap")
    rows = vocabulary.select("word", "n", roles).select((length - F.col("gap")).cast("long").alias("parent"), F.lit("").alias("path"), F.col("word").alias("text"), "gap", "word", "n")
    shards = []
    while True:
        rows = cut(_halved(rows))
        often = rows.groupBy("key").agg(F.count_if(F.col("gap") == 0).alias("__n"), F.max(F.char_length("rest")).alias("__rest")).filter((F.col("__n") > HOT) & (F.col("__rest") > 2)).select("key")
        often = cut(often)
        if often.isEmpty():
            shards.append(rows)
            break
        shards.append(rows.join(small(often), "key", "left_anti"))
        again = rows.join(small(often), "key", "left_semi")
        rows = again.select(F.col("key").alias("parent"), F.concat("path", "side").alias("path"), F.col("rest").alias("text"), "gap", "word", "n")
    every = shards[0]
    for more in shards[1:]:
        every = every.unionByName(more)
    count = max(1, 4 * vocabulary.count() // SHARD_ROWS)
    dealt = every.select(F.pmod("key", F.lit(count)).cast("int").alias("shard"), "parent", "path", "side", "text", "gap", "word", "n")
    found = dealt.groupBy("shard").applyInArrow(_scan, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("__b")).select("word", "n_near", (-F.col("__b.n")).alias("best_n"), F.col("__b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows (word, form): the last word that forms lead to, by jumps that double in length. n at least doubles with each form, so there are no rings."""
    jumps = cut(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("__on"))
        jumps = cut(jumps.join(onward, "root", "left").select("word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("__moved")))
        moved = not jumps.filter("__moved").isEmpty()
        jumps = jumps.drop("__moved")
        if not moved:
            return jumps


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    form: the near word of largest n, of those the smallest in code-point order,
    if it has ``ratio`` times the word's n. Null and empty texts have no words,
    and an empty table gives no rows; rows that repeat count each by itself; a
    very long text is one row of bytes at a time. Other columns of docs play no part.
    """
    if ratio < 2 or shortest < 2:
        raise ValueError("ratio and shortest must be at least 2")
    vocabulary = cut(words(docs, id_col, text_col, every, shortest, least))
    near = near_words(vocabulary)
    taken = F.col("best_n") >= ratio * F.col("n")
    joined = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")
    )
    joined = cut(joined)
    return joined.join(roots(joined), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""WITH RECURSIVE {SQL_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({sql_lower("coalesce(text, '')")}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {sql_crc("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM counted, crc_table),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
),
-- Words one edit apart have the same pieces around one place; what stands there is a letter of both, or of one.
cuts AS (
  SELECT word, n, unnest(range(length(word) + 1)) AS place FROM words
),
pieces AS (
  SELECT word, n, place, substring(word, 1, place) AS a, substring(word, place + 2) AS b FROM cuts WHERE place < length(word)
),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS m FROM pieces x JOIN pieces y USING (a, b) WHERE x.word <> y.word
  UNION SELECT p.word, w.word, w.n FROM pieces p JOIN words w ON w.word = p.a || p.b
  UNION SELECT w.word, p.word, p.n FROM pieces p JOIN words w ON w.word = p.a || p.b
),
best AS (SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND k = 1
),
steps AS (
  SELECT word, word AS reached, form AS onward FROM formed
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON f.word = s.onward
)
SELECT word, form, reached AS root, n, n_near, form_n FROM formed JOIN (SELECT word, reached FROM steps WHERE onward IS NULL) USING (word)
"""
