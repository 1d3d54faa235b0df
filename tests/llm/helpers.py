from __future__ import annotations

from pyspark.sql import functions as F

LONG = "Long words in a very long text, again and again. " * 4000

TEXTS = [
    "The plan for the river bank was read aloud in the old hall.\nAnd then all went home.",
    "The plan for the river bank was read aloud in the old hall.\nAnd then all went home.",
    "",
    None,
    "   \n\t ",
    LONG,
    "Éléphants ÀÉ — naïve café 東京 \U0001f600 é end.",
    "one",
    "You are a stupid loser, they said!",
    "*** ### |||",
    "a\x00b   c d",
]


def awkward(spark, extra: bool = True):
    """Null and empty texts, a very long one, repeated rows, a null and a repeated id, and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "no id here", "en", None, 10), (4, "another text under id four", "de", "s1", 26)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("score", "fp", "label", "component_id", "ids", "decoded", "hash", "at", "w", "bucket", "shard", "size", "spans", "items", "toxicity", "language"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return awkward(spark).limit(0)
