"""The newest of each key's rows, and points counted back from it.

Windows here keep rows, not calendar days: nulls go first, then the n-th newest row counts. Picking one row is an aggregate
(partial sums before the shuffle, so a hot key costs no more than others); keeping n rows is row_number() <= n, of which
Spark keeps n a key and task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def latest(rows: DataFrame, keys: Names, order: list[Column], take: Names) -> DataFrame:
    """keys and take of each key's row that is greatest by order; a smaller-wins tie-break is given negated. Null orders lose."""
    best = F.max_by(F.struct(*take), F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order))))
    return rows.groupBy(*keys).agg(best.alias("best__")).select(*keys, "best__.*")


def latest_nonnull(rows: DataFrame, keys: Names, order: list[Column], value: str, take: Names) -> DataFrame:
    """latest() over the rows whose value is known, so the newest unknown ones are passed over."""
    return latest(rows.where(F.col(value).isNotNull()), keys, order, take)


def newest_of_wide(columns: dict[int, Column], year: str = "year", value: str = "value") -> list[Column]:
    """year and value of the newest known of a row's year columns, without turning the row into many."""
    newest = sorted(columns, reverse=True)
    return [F.coalesce(*(F.when(columns[y].isNotNull(), F.lit(y)) for y in newest)).alias(year), F.coalesce(*(columns[y] for y in newest)).alias(value)]


def last_n(rows: DataFrame, keys: Names, order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The n last rows of each key by ascending order, numbered back from the last (1)."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*(o.desc() for o in order)))).where(F.col(rank) <= n)


def nth_back(rows: DataFrame, keys: Names, order: list[Column], value: str, n: int) -> DataFrame:
    """keys, latest, back (the n-th value from the last, or the oldest if there are fewer), points (how many of n there are)."""
    kept = last_n(rows.where(F.col(value).isNotNull()), keys, order, n)
    return kept.groupBy(*keys).agg(F.max(F.when(F.col("rn") == 1, F.col(value))).alias("latest"), F.max_by(value, "rn").alias("back"), F.count("*").alias("points"))


def latest_with_both(rows: DataFrame, keys: Names, preference: str, year: str, a: str, b: str) -> DataFrame:
    """keys, preference, year, a, b where both a and b are known: the smallest preference that has such a year, and its newest one.

    rows: one row for each of keys, preference, year.
    """
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return latest(both, keys, [-F.col(preference), F.col(year)], [preference, year, a, b])
