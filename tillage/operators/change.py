"""How a series has changed: against the point before, a trailing mean, its first point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.numeric import known, percent_change, round_half_up
from tillage.operators.latest import last_n


def _exact(value: str) -> Column:
    return F.col(value).cast("decimal(20,4)")


def last_change(points: DataFrame, keys: list[str], order: str, value: str, places: int = 2, above: float | None = 0.0) -> DataFrame:
    """keys, at (the last point's order), latest, previous, change_pct: against the point before, known ones only.

    change_pct is null with a single point or where the previous value isn't above the floor (None: where it is 0).
    """
    kept = last_n(points.where(F.col(value).isNotNull()), keys, [F.col(order)], 2)
    out = kept.groupBy(*keys).agg(F.max(order).alias("at"), F.max(F.when(F.col("rn") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("rn") == 2, F.col(value))).alias("previous"))
    return out.withColumn("change_pct", round_half_up(percent_change("latest", "previous", above), places))


def every_change(points: DataFrame, keys: list[str], order: str, value: str, places: int = 2) -> DataFrame:
    """points with previous and change_pct at each of them."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return points.withColumn("previous", before).withColumn("change_pct", round_half_up(percent_change(value, "previous"), places))


def trailing(points: DataFrame, keys: list[str], order: str, value: str, short: int = 7, long: int = 30) -> DataFrame:
    """keys, n (points of the long stretch there are), short_sum, long_sum, short_mean, long_mean over each key's last points.

    Values are added exactly, at four decimals.
    """
    kept = last_n(points.where(F.col(value).isNotNull()), keys, [F.col(order)], long)
    near = F.when(F.col("rn") <= short, _exact(value))
    out = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(near).cast("double").alias("short_sum"), F.sum(_exact(value)).cast("double").alias("long_sum"))
    return out.withColumn("short_mean", F.col("short_sum") / F.least(F.col("n"), F.lit(short))).withColumn("long_mean", F.col("long_sum") / F.col("n"))


def trailing_in(values: str, short: int = 7, long: int = 30) -> dict[str, Column]:
    """What trailing() gives, of a column that holds each key's known values as an array, newest first."""
    exact = F.transform(F.col(values), lambda x: x.cast("decimal(20,4)"))
    total = lambda k: F.aggregate(F.slice(exact, 1, k), F.lit(0).cast("decimal(30,4)"), lambda a, x: (a + x).cast("decimal(30,4)")).cast("double")
    n = F.least(F.size(values), F.lit(long))
    out = {"n": n, "short_sum": F.when(n > 0, total(short)), "long_sum": F.when(n > 0, total(long))}
    return out | {"short_mean": out["short_sum"] / F.least(n, F.lit(short)), "long_mean": out["long_sum"] / n}


def rain_change(t: dict[str, Column], short: int = 7, long: int = 30) -> Column:
    """The short sum of trailing values against its share of the long one; null with fewer than `long` points or a baseline of at most 1."""
    return round_half_up(percent_change(t["short_sum"], F.when(t["n"] >= long, t["long_sum"] * F.lit(short / long)), above=1.0), 1)


def river_change(t: dict[str, Column]) -> Column:
    """The short mean of trailing values against the long one."""
    return round_half_up(percent_change(t["short_mean"], t["long_mean"]), 1)


def _named(t: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in ("n", "short_sum", "long_sum", "short_mean", "long_mean")}


def rain_anomaly(points: DataFrame, keys: list[str], order: str, value: str, short: int = 7, long: int = 30) -> DataFrame:
    """trailing() with anomaly_pct: see rain_change()."""
    t = trailing(points, keys, order, value, short, long)
    return t.withColumn("anomaly_pct", rain_change(_named(t), short, long))


def river_anomaly(points: DataFrame, keys: list[str], order: str, value: str, least: int = 14, flood_above: float = 75.0) -> DataFrame:
    """keys, short_mean, anomaly_pct and flood_flag of keys with enough points: 7-point mean against the mean of up to 30."""
    t = trailing(points, keys, order, value).where(F.col("n") >= least)
    t = t.withColumn("anomaly_pct", river_change(_named(t)))
    return t.withColumn("flood_flag", known(F.col("anomaly_pct") > flood_above))


def flow_change(first: Column, last: Column, last_places: int = 0) -> Column:
    """Change from the first to the last value, which is rounded before; null if an end is missing or 0."""
    last = round_half_up(last, last_places)
    return F.when((first != 0) & (last != 0), round_half_up((last - first) / first * 100.0, 1))


def flow_label(change: Column, low: float = -25.0, high: float = 50.0) -> Column:
    return F.when(change < low, "low").when(change > high, "high").otherwise("normal")


def first_to_last(rows: DataFrame, keys: list[str], order: list[str], value: str, low: float = -25.0, high: float = 50.0, last_places: int = 0) -> DataFrame:
    """keys, first, last, change_pct and anomaly: low, normal or high.

    The last value is rounded before the change is taken; a missing or zero end gives no change and normal.
    """
    at, kept = F.struct(*order), rows.where(F.col(value).isNotNull())
    out = kept.groupBy(*keys).agg(F.min_by(value, at).alias("first"), round_half_up(F.max_by(value, at), last_places).alias("last"))
    out = out.withColumn("change_pct", flow_change(F.col("first"), F.col("last"), last_places))
    return out.withColumn("anomaly", flow_label(F.col("change_pct"), low, high))


def indexed(points: DataFrame, keys: list[str], order: str, value: str, out: str = "index") -> DataFrame:
    """points with the value as percent of the key's first one, to the whole; null if that is 0 or null."""
    first = F.first_value(value).over(Window.partitionBy(*keys).orderBy(order))
    return points.withColumn(out, round_half_up(F.when(first != 0, F.col(value) / first * 100.0)))


def growth_rate(points: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """keys, first_year, last_year, growth_pct: yearly growth from the first to the last known point; null for one year or a first value not above 0."""
    kept = points.where(F.col(value).isNotNull())
    out = kept.groupBy(*keys).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.min_by(value, year).alias("first"), F.max_by(value, year).alias("last"))
    span = F.col("last_year") - F.col("first_year")
    rate = F.when((span > 0) & (F.col("first") > 0) & (F.col("last") >= 0), (F.pow(F.col("last") / F.col("first"), F.lit(1.0) / span) - 1) * 100.0)
    return out.withColumn("growth_pct", round_half_up(rate, 2)).drop("first", "last")
