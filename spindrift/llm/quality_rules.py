"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio (DataFrame functions only).

Two multinomials over hashed n-grams (words as they are and pairs of words in
sequence), one of a trusted target and one of the raw corpus, are counted over
all documents. A document's score is the mean of log p_target - log p_raw over
its n-grams, so its length doesn't count, and it is kept at ``threshold`` or
more: the same text has the same verdict in every run.

The trusted target is a condition on the row itself (strict base rules unless
another is given), so the corpus is read twice and no text is ever shuffled.
The models are one table of ``BUCKETS`` rows, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, cut, row_key, text_of

BUCKETS = 1 << 18
#: Occurrences of raw corpus that a bucket of the target is smoothed by, so rare n-grams say little.
SMOOTHING = 10.0
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.1
_REPEAT = 8

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the words (__w); same-named columns are replaced."""
    text = text_of(text_col)
    keep = [c for c in docs.columns if c not in {*_BASE, "base_failed"}]
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(SPACED_WORD))
    out = docs.select(*keep, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "").alias("__w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("__lines"))
    n = F.size("__w")
    out = out.select(
        *keep,
        "__w",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
    )
    # Hashes of runs of 2, 4 and 8 words, each from two hashes of runs half as long.
    for half in (1, 2, 4):
        out = out.withColumn("__h", F.zip_with("__h", F.slice("__h", half + 1, F.size("__h")), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("__h", F.slice("__h", 1, F.greatest(F.size("__w") - (_REPEAT - 1), F.lit(0))))
    # Only texts that have a window twice go on: its places are neighbours in the sorted windows.
    twice = F.size("__h") > F.size(F.array_distinct("__h"))
    out = out.withColumn("__h", F.when(twice, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    equal = lambda t, a, b: F.get(t, a)["h"] == F.get(t, b)["h"]
    found = F.filter(F.sequence(F.lit(0), F.size("__h") - 1), lambda j: F.coalesce(equal(F.col("__h"), j, j - 1), F.lit(False)) | F.coalesce(equal(F.col("__h"), j, j + 1), F.lit(False)))
    out = out.withColumn("__p", F.when(F.col("__h").isNotNull(), F.array_sort(F.transform(found, lambda j: F.get("__h", j)["i"]))))
    steps = F.zip_with("__p", F.slice("__p", 2, F.size("__p")), lambda a, b: F.least(F.lit(_REPEAT), F.coalesce(b - a, F.lit(_REPEAT))))
    repeated = F.when(F.col("__p").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x)).cast("long")
    out = out.select(*keep, "__w", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def trusted(text_col: str = "text") -> Column:
    """The default target: enough words, few symbols and capitals, no repeated line, words not said again and again.

    It leaves out the repeated windows, which cost more than all the rest, so counting the models doesn't pay for them.
    """
    text = text_of(text_col)
    capitals = F.regexp_count(text, F.lit(r"\p{Lu}"))
    return (F.col("n_words") >= 20) & (50 * F.col("n_symbols") <= F.col("n_words")) & (F.col("n_dup_lines") == 0) & (4 * F.size(F.array_distinct("__w")) >= F.col("n_words")) & (8 * capitals <= F.length(text))


def _grams(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """columns, at, one and two for every word of a text (__w): the buckets of the word and of it with the next; null ones for a text without words.

    The last word has no second bucket.
    """
    word, after = F.col("__word"), F.get("__w", F.col("at") + 1)
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    spread = rows.select("__w", *columns, F.posexplode_outer("__w").alias("at", "__word"))
    return spread.select(*columns, "at", F.when(word.isNotNull(), bucket(word)).alias("one"), F.when(after.isNotNull(), bucket(word, after)).alias("two"))


def models(rows: DataFrame) -> DataFrame:
    """bucket, llr: from rows with __w and __trusted; BUCKETS rows at most."""
    grams = _grams(rows, "__trusted").select("__trusted", F.explode(F.array("one", "two")).alias("bucket")).filter("bucket IS NOT NULL")
    counts = cut(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("__trusted").alias("target")))
    total = counts.agg(F.sum("raw"), F.sum("target")).first()
    share = (total[1] or 0) / (total[0] or 1)
    if not share:
        return counts.select("bucket", F.lit(0.0).alias("llr"))
    return counts.select("bucket", F.log((F.col("target") + SMOOTHING * share) / (share * (F.col("raw") + SMOOTHING))).alias("llr"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """id, base counts, base_failed, score, kept: one row for every row of docs.

    Null and empty texts have no words and fail the base rules; a text without
    words has score 0. If no row is trusted, all scores are 0. Rows that repeat come back as often as they came; equal texts have
    equal scores (to nine digits). A very long text is one row of its words at a
    time, whatever other columns there are.
    """
    rows = base_counts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).withColumn("__trusted", F.coalesce(target if target is not None else trusted(), F.lit(False)))
    llr = cut(models(rows))
    key = row_key("id", "text")
    # Copies of a row are put together within a task of the scan alone, so a frequent row comes out of as many tasks.
    keyed = rows.withColumns({"__id": key[0], "__text": key[1], "__task": F.spark_partition_id()})
    scored = _grams(keyed, "__id", "__text", "__task", "id", *_BASE, "base_failed")
    for gram in ("one", "two"):
        scored = scored.join(F.broadcast(llr.select(F.col("bucket").alias(gram), F.col("llr").alias(f"__{gram}"))), gram, "left")
    firsts = [F.first(c).alias(c) for c in ("id", *_BASE, "base_failed")]
    mean = (F.sum("__one") + F.coalesce(F.sum("__two"), F.lit(0.0))) / (F.count("__one") + F.count("__two"))
    one = scored.groupBy("__id", "__text", "__task").agg(*firsts, F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("copies"), mean.alias("score"))
    out = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    return out.select(F.col("id").alias(id_col), *_BASE, "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
