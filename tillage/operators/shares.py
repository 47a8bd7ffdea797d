"""Parts of a whole: shares, top partners, concentration, the most frequent value, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.bands import concentration_tier
from tillage.functions.numeric import money, percent_of, round_half_up


def partner_shares(rows: DataFrame, parent: list[str], child: str, value: str, top: int = 5, places: int = 1) -> DataFrame:
    """parent, child, rank, value, total, share_pct: each parent's `top` children by summed value, ties by child, of the parent's positive values.

    Values are summed by parent and child before anything is ranked, so hot parents are small by then.
    """
    summed = rows.where(F.col(value) > 0).groupBy(*parent, child).agg(money(value).alias("value"))
    whole = F.sum(F.col("value").cast("decimal(28,2)")).over(Window.partitionBy(*parent)).cast("double")
    rank = F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc("value"), child)).cast("long")
    ranked = summed.withColumn("total", whole).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.withColumn("share_pct", round_half_up(percent_of("value", "total"), places))


def concentration(shares: DataFrame, parent: list[str], top: int = 5) -> DataFrame:
    """parent, hhi and tier: the sum of squared shares of the top partners, in percent of a single partner's."""
    squares = F.sum((F.col("share_pct") * F.col("share_pct") / 100.0).cast("decimal(12,4)")).cast("double")
    out = shares.where(F.col("rank") <= top).groupBy(*parent).agg(round_half_up(squares, 1).alias("hhi"))
    return out.withColumn("tier", concentration_tier("hhi"))


def most_frequent(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """keys, value, n: each key's most frequent known value; of equal ones the first seen by order."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("seen__"))
    best = F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "seen__")).alias("best__")
    return (counted.groupBy(*keys) if keys else counted).agg(best).select(*keys, "best__.*")


def histogram(rows: DataFrame, label: Column, labels: list[str]) -> DataFrame:
    """ord, label, n for every label in the order given, those without rows too."""
    counted = rows.groupBy(label.alias("label")).count()
    every = F.explode(F.arrays_zip(F.array(*(F.lit(k) for k in range(len(labels)))).alias("ord"), F.array(*map(F.lit, labels)).alias("label"))).alias("e")
    one = rows.sparkSession.range(1).select(every).select("e.ord", "e.label")
    return one.join(counted, "label", "left").select("ord", "label", F.coalesce("count", F.lit(0)).alias("n"))


def parts_of_total(rows: DataFrame, keys: list[str], item: str, value: str, items: dict[str, str], places: int = 2) -> DataFrame:
    """keys, total and a <name>_pct for each listed item: its value as percent of all; keys whose total isn't positive go."""
    sums = [money(F.when(F.col(item) == k, F.col(value))).alias(f"{name}__") for k, name in items.items()]
    grouped = rows.groupBy(*keys).agg(money(value).alias("total"), *sums).where(F.col("total") > 0)
    return grouped.select(*keys, "total", *(round_half_up(F.coalesce(f"{name}__", F.lit(0.0)) / F.col("total") * 100.0, places).alias(f"{name}_pct") for name in items.values()))
