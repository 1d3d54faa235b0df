"""Line dedup by distinct-site spread (DataFrame functions only).

A line that many sites share is boilerplate. For each line hash a HyperLogLog
sketch of its sites is built in each task and the sketches are merged by the
aggregation, so a line costs one small row a task however often it occurs.
Estimates within ``slack`` of the threshold aren't trusted: those lines, and
only those, get exact distinct counts. A boilerplate line stays in one place,
its home (the least row id, then the first place), and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, small, text_of

#: A line on this many sites or more is boilerplate.
MIN_SITES = 3
#: Shorter lines are never boilerplate.
MIN_CHARS = 20
#: The share of the threshold by which an estimate may be off before the exact count decides.
SLACK = 0.4
#: log2 of the registers of a sketch: a standard error of about 3 %.
REGISTERS = 10

#: Places of removed lines up to which their lists are broadcast with the texts they are of.
BROADCAST_PLACES = 2_000_000

_LINE = ["__hash", "__size"]


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """__id, __text, id, site, place, __hash, __size of every line that is long enough.

    The exploding is outer: from an inner one Spark infers a filter that splits each text once more.
    """
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode_outer(_split(text_of(text_col))).alias("place", "line"))
    return rows.filter(F.length(F.trim("line")) >= min_chars).select("__id", "__text", "id", "site", "place", F.xxhash64("line").alias("__hash"), F.octet_length("line").alias("__size"))


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """__hash, __size, home of the lines on min_sites sites or more, written to the checkpoint folder."""
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    home = F.struct("id", "__text", "place")
    spread = lines.groupBy(*_LINE).agg(F.hll_sketch_agg("site", REGISTERS).alias("sketch"), F.min(home).alias("home"))
    likely = cut(spread.withColumn("sites", F.hll_sketch_estimate("sketch")).filter(F.col("sites") >= min_sites * (1 - SLACK)).drop("sketch"))
    certain, near = likely.filter(F.col("sites") > min_sites * (1 + SLACK)), likely.filter(F.col("sites") <= min_sites * (1 + SLACK))
    # With the near lines broadcast, a frequent line's sites are counted in each task before they are shuffled.
    counted = lines.join(small(near.select(*_LINE)), _LINE, "left_semi").groupBy(*_LINE, "site").count().groupBy(*_LINE).agg(F.count("*").alias("exact")).filter(F.col("exact") >= min_sites)
    return cut(certain.select(*_LINE, "home").unionByName(near.join(counted, _LINE).select(*_LINE, "home")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows of docs with their columns; text without boilerplate lines away from home; __n_lines and __n_removed besides.

    A null site is a site of its own, equal to the empty one. Null texts stay
    null and have no lines; an empty text is one empty line. A text whose lines
    all go is empty. Rows alike in id and text are treated alike: each keeps
    what its home keeps. Lines are compared byte for byte, by a 64-bit hash and their length.
    """
    columns = docs.columns
    common = small(boilerplate(docs, id_col, text_col, site_col, min_sites, min_chars))
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    away = ~(F.col("id").eqNullSafe(F.col("home.id")) & (F.col("__text") == F.col("home.__text")) & (F.col("place") == F.col("home.place")))
    gone = lines.join(common, _LINE).filter(away).groupBy("__id", "__text").agg(F.collect_set("place").alias("__gone"))
    gone = cut(gone)
    places = gone.agg(F.coalesce(F.sum(F.size("__gone")), F.lit(0))).first()[0]
    gone = small(gone) if places <= BROADCAST_PLACES else gone
    joined = docs.select("*", *row_key(id_col, text_col)).join(gone, ["__id", "__text"], "left")
    kept = F.array_join(F.filter(_split(text_of(text_col)), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    return joined.select(
        *[F.when(F.col("__gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_split(text_of(text_col)))).alias("__n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("__n_removed"),
    )


#: The same in DuckDB SQL, counting sites exactly.
SQL = f"""
WITH line AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents WHERE text IS NOT NULL
), common AS (
  SELECT line, min(row(doc_id, place)) AS home FROM line WHERE length(trim(line, ' ')) >= {MIN_CHARS} GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) FILTER (NOT coalesce(row(doc_id, place) <> home, false)) AS text, count(*) AS n_lines,
    count(*) FILTER (coalesce(row(doc_id, place) <> home, false)) AS n_removed
  FROM line LEFT JOIN common USING (line) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
