"""Metrics over time: quantiles of many days from sketches of single days, averages, and rates of counters.

A day's samples become one sketch, which is small whatever the day held. Reports
over the last days merge sketches and never read samples again; a late sample
changes one day's sketch. ``exact_over_days`` reads the samples again, for the quantile itself.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

#: Size of a sketch: all values up to so many, and a rank error near 1.7 / SIZE beyond (0.05 %).
SIZE = 4096
#: Ranks, as parts of 1 / size, within which a sketch's quantile surely lies: more than twice its error.
MARGIN = 4


def daily(samples: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """keys, day, sketch, total, n. samples: keys, ts, value; null values are left out."""
    rows = samples.filter(F.col("value").isNotNull()).withColumn("day", F.to_date("ts"))
    return rows.groupBy(*keys, "day").agg(F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(size)).alias("sketch"), F.sum("value").alias("total"), F.count("value").alias("n"))


def over_days(sketches: DataFrame, keys: list[str], share: float = 0.95, days: int = 7) -> DataFrame:
    """keys, day, quantile, average of the samples of each day and the days before it. sketches: as ``daily`` gives them, one or more for a day.

    Each sketch goes to the days that it counts for; only days with samples have a row.
    """
    return _merged(sketches, keys, days).select(*keys, "day", F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("quantile"), "average")


def _reach(days: int):
    """The days that a day counts for."""
    return F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))).alias("day")


def _merged(sketches: DataFrame, keys: list[str], days: int) -> DataFrame:
    """keys, day, sketch, n, average of each day with the days before it."""
    reach = sketches.select(*keys, _reach(days), "sketch", "total", "n")
    merged = reach.groupBy(*keys, "day").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("average"))
    return merged.join(sketches.select(*keys, "day").distinct(), [*keys, "day"], "left_semi")


def exact_over_days(samples: DataFrame, keys: list[str], share: float = 0.95, days: int = 7, size: int = SIZE) -> DataFrame:
    """keys, day, quantile, average as ``over_days`` gives them, but the quantile is exact: of the n values the one at rank ceil(share * n).

    Sketches tell between which values that rank lies; what is below them is counted, and only what
    is between is ranked. Days whose rank doesn't lie there after all are ranked whole. samples: keys, ts, value.
    """
    # a sketch of nothing but NaN is empty, and has no quantiles
    quantile = lambda at: F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(at, 0.0), 1.0))))
    at = F.greatest(F.ceil(F.col("n").cast("decimal(20,0)") * F.lit(Decimal(str(share)))).cast("long"), F.lit(1)).alias("at")
    merged = _merged(daily(samples, keys, size), keys, days)
    bounds = settled(merged.select(*keys, "day", "average", at, quantile(share - MARGIN / size).alias("low"), quantile(share + MARGIN / size).alias("high")))
    found = settled(_ranked(samples, bounds, keys, days))
    missed = bounds.join(found, [*keys, "day"], "left_anti")
    if not missed.isEmpty():
        whole = missed.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("nan"))})
        found = found.unionByName(_ranked(samples, whole, keys, days))
    return bounds.select(*keys, "day", "average").join(found, [*keys, "day"]).select(*keys, "day", "quantile", "average")


def _ranked(samples: DataFrame, bounds: DataFrame, keys: list[str], days: int) -> DataFrame:
    """keys, day, quantile: the value at rank ``at``, if it is one from low to high. NaN is the highest value."""
    rows = samples.filter(F.col("value").isNotNull()).select(*keys, F.to_date("ts").alias("day"), F.col("value").cast("double").alias("value")).select(*keys, _reach(days), "value")
    near = rows.join(bounds.select(*keys, "day", "at", "low", "high"), [*keys, "day"]).filter("value <= high")
    counts = near.groupBy(*keys, "day", "at", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("quantile")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "day").orderBy(F.col("quantile").asc_nulls_first())))
    return upto.filter("quantile IS NOT NULL AND upto >= at AND upto - n < at").select(*keys, "day", "quantile")


def against(samples: DataFrame, baselines: DataFrame, keys: list[str], slow: float = 2.0, drop: float = 0.5) -> DataFrame:
    """samples with quantile, average, slow (value above slow times the quantile) and dropped (below drop times the average) of their day."""
    base = baselines.select(*keys, "day", "quantile", "average")
    rows = samples.withColumn("day", F.to_date("ts")).join(base, [*keys, "day"], "left")
    return rows.withColumns({"slow": F.col("value") > slow * F.col("quantile"), "dropped": F.col("value") < drop * F.col("average")})


def rates(samples: DataFrame, keys: list[str], seconds: int = 900) -> DataFrame:
    """keys, start, increase, rate of counters by windows. samples: keys, ts, value.

    A counter that falls was set back to zero, so what it shows then was added since.
    The step from a window's last sample to the next window's first counts for the later
    one. Each window is worked out apart from the others; only its first and last values meet its neighbours'.
    Of samples of one key and time the greatest counts.
    """
    rows = samples.filter(F.col("value").isNotNull()).groupBy(*keys, "ts").agg(F.max("value").alias("value"))
    rows = rows.withColumn("start", F.window("ts", f"{seconds} seconds")["start"])
    grown = lambda now, before: F.when(now >= before, now - before).otherwise(now)
    inside = F.lag("value").over(Window.partitionBy(*keys, "start").orderBy("ts"))
    steps = rows.withColumn("step", F.when(inside.isNotNull(), grown(F.col("value"), inside)))
    parts = steps.groupBy(*keys, "start").agg(F.sum("step").alias("own"), F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"))
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("start"))
    edge = F.when(before.isNotNull(), grown(F.col("first"), before))
    return parts.select(*keys, "start", (F.coalesce("own", F.lit(0.0)) + F.coalesce(edge, F.lit(0.0))).alias("increase")).withColumn("rate", F.col("increase") / seconds)


def ratio_above(errors: DataFrame, handled: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """keys, start, ratio of two rates where it is above the share; no handled rows: no ratio."""
    both = errors.select(*keys, "start", F.col("rate").alias("e")).join(handled.select(*keys, "start", F.col("rate").alias("h")), [*keys, "start"])
    return both.select(*keys, "start", F.try_divide("e", "h").alias("ratio")).filter(F.col("ratio") > share)


