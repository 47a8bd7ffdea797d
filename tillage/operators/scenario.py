"""Scenario stress tests: what price, weather and trade shocks add to each country's score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.bands import five_bands, risk_label
from tillage.functions.numeric import or_zero, round_half_up

#: Fixed values: (id, label, input, base, factors): the impact is the rounded base + input * factors, multiplied in that order.
#: An input c0 to c5 is a component, 100-c2 what component 2 lacks to 100.
SCENARIOS = (
    ("wheat20", "Wheat prices +20%", "w", 0.0, (0.30, 0.20)),
    ("rice20", "Rice prices +20%", "r", 0.0, (0.25, 0.20)),
    ("maize20", "Maize prices +20%", "m", 0.0, (0.20, 0.20)),
    ("fert30", "Fertilizer prices +30%", "100-c2", 4.0, (0.04,)),
    ("drought", "Domestic drought -15%", "100-c2", 0.0, (0.12,)),
    ("oil25", "Oil/fuel prices +25%", "c5", 2.0, (0.08,)),
    ("ban", "Major supplier export ban", "c1", 0.0, (0.18,)),
    ("fx", "Currency depreciation -30%", "c3", 0.0, (0.12,)),
    ("ship", "Shipping costs +50%", "c5", 1.0, (0.06,)),
    ("conflict", "Conflict disrupts trade routes", "c5", 0.0, (0.15,)),
)


def _input(name: str) -> Column:
    if name.startswith("100-"):
        return F.lit(100.0) - _input(name[4:])
    return or_zero(F.get("c", F.lit(int(name[1:]))) if name[0] == "c" else F.col(name))


def impact(scenario: tuple) -> Column:
    _, _, name, base, factors = scenario
    moved = _input(name)
    for f in factors:
        moved = moved * F.lit(f)
    return round_half_up(F.lit(base) + moved)


def impacts(profiles: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """A row for each country and scenario: iso, scenario, impact. The scenarios are a list in each row, not a join."""
    listed = F.array(*(F.struct(F.lit(s[0]).alias("scenario"), impact(s).alias("impact")) for s in scenarios))
    return profiles.select("iso", F.explode(listed).alias("s")).select("iso", "s.scenario", "s.impact")


def stressed(profiles: DataFrame, chosen: list[str] | None = None, scenarios=SCENARIOS) -> DataFrame:
    """iso, name, fdrs, delta, new_score (at most 100), crosses (whether the risk label changes) under the chosen scenarios (all by default).

    Impacts are rounded one by one, then added.
    """
    delta = F.lit(0.0)
    for s in scenarios:
        if chosen is None or s[0] in chosen:
            delta = delta + impact(s)
    out = profiles.select("iso", "name", "fdrs", delta.alias("delta")).withColumn("new_score", F.least(F.lit(100.0), F.col("fdrs") + F.col("delta")))
    return out.withColumn("crosses", risk_label("fdrs") != risk_label("new_score"))


def band_moves(stress: DataFrame) -> DataFrame:
    """before, after, countries, mean_delta (one decimal): how many countries a stress takes from each of the five bands to each."""
    moves = stress.groupBy(five_bands("fdrs").alias("before"), five_bands("new_score").alias("after"))
    return moves.agg(F.count("*").alias("countries"), round_half_up(F.sum(F.col("delta").cast("decimal(12,2)")).cast("double") / F.count("*"), 1).alias("mean_delta"))


def most_affected(stress: DataFrame, n: int = 40) -> DataFrame:
    """The n countries of the largest delta, ties by name."""
    return stress.orderBy(F.desc("delta"), "name").limit(n)


def summary(stress: DataFrame) -> DataFrame:
    """One row: crossings, mean_delta (one decimal), highest, most_exposed (three names, joined)."""
    # the three best of each task meet in one; a top-k of names, not a collected list of all
    top = stress.orderBy(F.desc("delta"), "name").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("delta")).alias("d"), "name"))), lambda e: e["name"]), ", ").alias("most_exposed"))
    whole = stress.agg(F.count_if("crosses").alias("crossings"), round_half_up(F.sum(F.col("delta").cast("decimal(12,2)")).cast("double") / F.count("*"), 1).alias("mean_delta"), F.max("delta").alias("highest"))
    return whole.crossJoin(top)  # one row each


def damped(kicks: DataFrame, sourced: float = 1.0, legacy: float = 0.6) -> DataFrame:
    """key, channel, kick of kicks(key, channel, kick, is_sourced): where shocks overlap on a channel, the root of the sum of their squares.

    A kick that rests on unsourced values counts by the legacy factor.
    """
    weighed = kicks.withColumn("k", F.col("kick") * F.when(F.col("is_sourced"), F.lit(sourced)).otherwise(F.lit(legacy)))
    square, plain = F.sum((F.col("k") * F.col("k")).cast("decimal(20,6)")).cast("double"), F.sum(F.col("k").cast("decimal(20,6)")).cast("double")
    return weighed.where(F.col("kick") != 0).groupBy("key", "channel").agg(round_half_up(F.when(F.count("*") >= 2, F.sqrt(square)).otherwise(plain), 2).alias("kick"), F.count("*").alias("shocks"))
