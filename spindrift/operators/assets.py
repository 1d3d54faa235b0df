"""The corpus's own analytics: variance, pricing, elasticity, gaps, schema checks, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def variance(budget: DataFrame, actual: DataFrame, threshold: float = 10.0) -> DataFrame:
    """metric, budget, actual, abs_var, pct_var, favorable, flagged; metrics missing on a side and zero budgets are left out. Both: metric, value."""
    j = budget.select("metric", F.col("value").alias("budget")).join(actual.select("metric", F.col("value").alias("actual")), "metric").filter("budget <> 0")
    diff, inverse = F.col("actual") - F.col("budget"), F.col("metric").isin(V.INVERSE_METRICS)
    pct = diff / F.abs("budget") * 100
    return j.select("*", diff.alias("abs_var"), pct.alias("pct_var"), F.when(inverse, diff < 0).otherwise(diff > 0).alias("favorable"), (F.abs(pct) >= threshold).alias("flagged"))


def price_points(points: DataFrame) -> DataFrame:
    """points (price, units, unit_cost, fixed_costs) with revenue, costs, profits and margins."""
    revenue, variable = F.col("price") * F.col("units"), F.col("unit_cost") * F.col("units")
    out = points.withColumns({"revenue": F.round(revenue, 2), "total_cost": F.round(variable + F.col("fixed_costs"), 2), "gross_profit": F.round(revenue - variable, 2), "net_profit": F.round(revenue - variable - F.col("fixed_costs"), 2)})
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100, F.col("revenue")), F.lit(0.0)), 1)
    return out.withColumns({"gross_margin": share("gross_profit"), "net_margin": share("net_profit")})


def recommend_price(analysed: DataFrame, least: float = 20.0, group: list[str] | None = None) -> DataFrame:
    """group, price, net_profit, low, high: the most net profit among points of that margin, or among all if none has it; the profitable range if two or more."""
    group = group or []
    rows = analysed.groupBy(*group).agg(
        F.max_by(F.struct("price", "net_profit"), F.when(F.col("net_margin") >= least, F.struct("net_profit", (-F.col("price")).alias("p")))).alias("good"),
        F.max_by(F.struct("price", "net_profit"), F.struct("net_profit", (-F.col("price")).alias("p"))).alias("any"),
        F.count_if(F.col("net_profit") > 0).alias("n"),
        F.min(F.when(F.col("net_profit") > 0, F.col("price"))).alias("low"),
        F.max(F.when(F.col("net_profit") > 0, F.col("price"))).alias("high"),
    )
    best = F.coalesce("good", "any")
    return rows.select(*group, best["price"].alias("price"), best["net_profit"].alias("net_profit"), F.when(F.col("n") >= 2, F.col("low")).alias("low"), F.when(F.col("n") >= 2, F.col("high")).alias("high"))


def elasticity(points: DataFrame, group: list[str]) -> DataFrame:
    """points (price, units) with the elasticity from the next lower price: 0 where it can't be divided, 3 digits; the first has none."""
    w = Window.partitionBy(*group).orderBy("price")
    p0, u0 = F.lag("price").over(w), F.lag("units").over(w)
    dp, du = F.try_divide(F.col("price") - p0, p0), F.try_divide(F.col("units") - u0, u0)
    return points.withColumn("elasticity", F.when(p0.isNotNull(), F.round(F.coalesce(F.try_divide(du, dp), F.lit(0.0)), 3)))


def gaps(events: DataFrame, group: list[str], seconds: int = 60, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """events with the seconds since the one before in their group, where over the limit."""
    before = F.lag("ts").over(Window.partitionBy(*group).orderBy(*order))
    delta = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return events.withColumn("gap_seconds", delta / 1e6).filter(F.col("gap_seconds") > seconds)


def validate_schema(columns: DataFrame, keys: DataFrame, types: list[str]) -> DataFrame:
    """table, column, issue. columns: table, column, type, nullable; keys: table, column, ref_table, ref_column."""
    named = columns.filter(~F.col("column").rlike("^[a-z][a-z0-9_]*$")).select("table", "column", F.lit("naming").alias("issue"))
    twice = columns.groupBy("table", "column").count().filter("count > 1").select("table", "column", F.lit("duplicate").alias("issue"))
    unknown = columns.filter(~F.lower("type").isin(types)).select("table", "column", F.lit("unknown type").alias("issue"))
    no_id = columns.groupBy("table").agg(F.count_if(F.col("column") == "id").alias("n")).filter("n = 0").select("table", F.lit("id").alias("column"), F.lit("missing id").alias("issue"))
    target = columns.select(F.col("table").alias("ref_table"), F.col("column").alias("ref_column"), F.col("type").alias("ref_type"))
    # Types are few: each once for a column, or a repeated column meets a repeated one in all pairs.
    checked = keys.join(columns.select("table", "column", "type").distinct(), ["table", "column"], "left").join(target.distinct(), ["ref_table", "ref_column"], "left")
    bad = checked.filter(F.col("ref_type").isNull() | (F.col("type") != F.col("ref_type"))).select("table", "column", F.when(F.col("ref_type").isNull(), "orphan reference").otherwise("reference type").alias("issue")).distinct()
    return named.unionByName(twice).unionByName(unknown).unionByName(no_id).unionByName(bad)


def nullable_share(columns: DataFrame) -> DataFrame:
    return columns.groupBy("table").agg(F.round(F.avg(F.col("nullable").cast("double")) * 100, 1).alias("nullable_pct"))


def persistent_alerts(samples: DataFrame, threshold: float, window: str = "5 minutes") -> DataFrame:
    """start, low: windows in which every sample (ts, value) is above the threshold."""
    own = samples.groupBy(F.window("ts", window).alias("w")).agg(F.min("value").alias("low"))
    return own.filter(F.col("low") > threshold).select(F.col("w.start").alias("start"), "low")


def baseline(samples: DataFrame, days: int = 7) -> DataFrame:
    """samples (day, value) with the average and the 95th percentile over the days before and itself; days without a sample count as days, not as samples.

    Each sample is handed to the days that it counts for, so days are worked out apart from each other.
    """
    reach = samples.select("day", "value", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("k")).select(F.date_add("day", F.col("k")).alias("day"), F.col("value").alias("other"))
    over = reach.groupBy("day").agg(F.avg("other").alias("avg_over"), F.percentile("other", F.lit(0.95)).alias("p95_over"))
    return samples.join(over, "day")


def top_slow(rows: DataFrame, total: Column, calls: Column, k: int = 10) -> DataFrame:
    """rows with total, calls and mean, the k greatest totals."""
    return rows.withColumns({"total": total, "calls": calls, "mean": F.try_divide(total, calls)}).orderBy(F.desc("total"), *rows.columns).limit(k)


def parse_log(lines: DataFrame) -> DataFrame:
    """lines with ts, source and message in place of raw; without a time the line is kept with a null one."""
    raw = F.col("raw")
    tag = F.nullif(F.regexp_extract(F.regexp_replace(raw, r"^\[?\d[^\]\s]*(?: \d{2}:\d{2}:\d{2})?\]?\s*", ""), r"\[([^\]]+)\]", 1), F.lit(""))
    message = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\[?\d[^\]\s]*(?: \d{2}:\d{2}:\d{2})?\]?\s*", ""), r"\[[^\]]+\]\s*", ""))
    return lines.select(*[c for c in lines.columns if c != "raw"], X.parse_timestamp(raw).alias("ts"), F.coalesce(tag, F.lit("unknown")).alias("source"), message.alias("message"))


def _first(rows: DataFrame, k: int | None, order: Column, key: str) -> DataFrame:
    out = rows.orderBy(order, key)
    return out if k is None else out.limit(k)


def _hit_share(hits: str = "hits", reads: str = "reads") -> Column:
    return F.try_divide(F.col(hits).cast("double"), F.col(hits) + F.col(reads))


def low_cache(statements: DataFrame, k: int = 20, least_reads: int = 100, share: float = 0.90) -> DataFrame:
    """Statements (query, calls, total, hits, reads) that read much past the cache, most reads first."""
    rows = statements.withColumns({"cache_hit_pct": F.round(_hit_share() * 100, 1), "mean": F.round(F.try_divide("total", "calls"), 2)})
    return _first(rows.filter((F.col("reads") > least_reads) & (_hit_share() < share)).select("query", "calls", "reads", "hits", "cache_hit_pct", "mean"), k, F.desc("reads"), "query")


def full_scans(tables: DataFrame, k: int = 20, least_scans: int = 50, least_rows: int = 10_000) -> DataFrame:
    """Large tables (table, seq_scan, seq_read, idx_scan, live) that are often read whole, most rows read first."""
    pct = F.when(F.col("idx_scan") > 0, F.round(F.col("seq_scan") * 100 / (F.col("seq_scan") + F.col("idx_scan")), 1)).otherwise(100.0)
    rows = tables.filter((F.col("seq_scan") > least_scans) & (F.col("live") > least_rows)).withColumn("seq_scan_pct", pct)
    return _first(rows.select("table", "seq_scan", "seq_read", "idx_scan", "live", "seq_scan_pct"), k, F.desc("seq_read"), "table")


def missing_indexes(tables: DataFrame, k: int = 15, least_scans: int = 100, least_read: int = 100_000) -> DataFrame:
    """Tables read whole again and again while an index is used for less than a tenth of that."""
    rare = F.col("idx_scan").isNull() | (F.col("idx_scan") < F.col("seq_scan") * 0.1)
    rows = tables.filter((F.col("seq_scan") > least_scans) & (F.col("seq_read") > least_read) & rare)
    return _first(rows.select("table", "seq_scan", "seq_read", "idx_scan", "live", F.round(F.try_divide(F.col("seq_read").cast("double"), "seq_scan"), 0).alias("rows_per_scan")), k, F.desc("seq_read"), "table")


def unused_indexes(indexes: DataFrame, k: int = 20, most_scans: int = 10) -> DataFrame:
    """Indexes (index, table, idx_scan, size) hardly used, the largest first; those of primary and unique keys stay."""
    rows = indexes.filter((F.col("idx_scan") < most_scans) & ~F.col("index").endswith("_pkey") & ~F.col("index").endswith("_unique"))
    return _first(rows.select("index", "table", "idx_scan", "size"), k, F.desc("size"), "index")


def bloat(tables: DataFrame, k: int = 20, least_dead: int = 1000) -> DataFrame:
    """Tables (table, live, dead) with many dead rows."""
    pct = F.when(F.col("live") > 0, F.round(F.col("dead") * 100 / F.col("live"), 1)).otherwise(0.0)
    return _first(tables.filter(F.col("dead") > least_dead).select("table", "live", "dead", pct.alias("dead_pct")), k, F.desc("dead"), "table")


def long_running(sessions: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Sessions (pid, state, query, started) that aren't idle and run for longer, the longest first, with their seconds."""
    seconds = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    rows = sessions.withColumn("seconds", seconds).filter((F.col("seconds") > minutes * 60) & (F.col("state") != "idle"))
    return _first(rows.select("pid", "state", "query", "seconds"), None, F.desc("seconds"), "pid")
