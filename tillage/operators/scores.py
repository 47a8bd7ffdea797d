"""Scores of country profiles: iso, name, region, fdrs, c (six components), f2030, w, r, m, net, fi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.bands import risk_colour, risk_label
from tillage.functions.numeric import clamp, or_zero, round_half_up
from tillage.functions.text import in_language
from tillage.operators.reshape import weighted

#: Weights of the six stored components, and of the seven of the later score.
SIX = (0.30, 0.20, 0.15, 0.15, 0.10, 0.10)
SEVEN = (0.28, 0.18, 0.14, 0.14, 0.09, 0.09, 0.08)


def structural(profiles: DataFrame, weights: tuple[float, ...] = SIX) -> DataFrame:
    """iso, score (one decimal), label: the weighted sum of the components."""
    return profiles.select("iso", round_half_up(weighted(F.col("c"), list(weights)), 1).alias("score")).withColumn("label", risk_label("score"))


def seven_components(profiles: DataFrame, rescale: float = 0.92) -> DataFrame:
    """iso, score, label by the seven weights: the six components and the wheat share as caloric dependency, rescaled and held at 100.

    The source of this score is known from its description only; which value the seventh weight takes is our reading.
    """
    seventh = F.least(F.lit(100.0), or_zero("w") / rescale)
    return structural(profiles.withColumn("c", F.concat("c", F.array(seventh))), SEVEN)


def blended(sourced: Column, heritage: Column, share: float = 0.6) -> Column:
    """A component of which part is sourced: so much of the sourced value, the rest of the older one; the older one alone where nothing is sourced."""
    return F.when(sourced.isNull(), heritage).otherwise(sourced * share + or_zero(heritage) * (1 - share))


def headline(structure: DataFrame, adjustments: DataFrame) -> DataFrame:
    """iso, score, adjustment, headline: structural score and adjustment (0 where there is none) added, held between 0 and 100."""
    out = structure.join(adjustments.select(F.col("key").alias("iso"), "adjustment"), "iso", "left").withColumn("adjustment", or_zero("adjustment"))
    return out.select("iso", "score", "adjustment", clamp(round_half_up(F.col("score") + F.col("adjustment"), 1), 0.0, 100.0).alias("headline"))


def forecast(profiles: DataFrame) -> DataFrame:
    """iso, gap (consumption less production at the last but one point), delta to 2030, projected_dependency, direction.

    profiles also have arrays production and consumption; with fewer than two points the gap is null.
    """
    delta = F.col("f2030") - F.col("fdrs")
    gap = F.try_element_at("consumption", F.lit(-2)) - F.try_element_at("production", F.lit(-2))
    projected = F.least(F.lit(100.0), F.get("c", F.lit(0)) + round_half_up(delta * 0.4))
    return profiles.select("iso", gap.alias("gap"), delta.alias("delta"), projected.alias("projected_dependency"), F.when(delta > 0, "worsening").otherwise("improving").alias("direction"))


def matrix(profiles: DataFrame) -> DataFrame:
    """iso, x (resilience: 100 less the rounded mean of two components), y (import dependency)."""
    c = lambda k: F.get("c", F.lit(k))
    return profiles.select("iso", (F.lit(100.0) - round_half_up((c(2) + c(5)) / 2)).alias("x"), c(0).alias("y"))


def stats(profiles: DataFrame) -> DataFrame:
    """One row: n, vulnerable, mean_score, mean_wheat, high_inflation, rising. Means take US states in, counts leave them out."""
    country = ~F.col("iso").startswith("US-")
    mean = lambda c: round_half_up(F.sum(F.col(c).cast("decimal(12,2)")).cast("double") / F.count("*"))
    count = lambda cond: F.count_if(country & cond)
    return profiles.agg(
        F.count("*").alias("n"), count(F.col("fdrs") > 75).alias("vulnerable"), mean("fdrs").alias("mean_score"), mean("w").alias("mean_wheat"),
        count(F.col("fi") > 30).alias("high_inflation"), count(F.col("f2030") > F.col("fdrs") + 5).alias("rising"),
    )


def ranking(profiles: DataFrame) -> DataFrame:
    """rank, iso, name, fdrs, label, colour by score downward, then name as people sort it. The window is over one row a country."""
    rank = F.row_number().over(Window.orderBy(F.desc("fdrs"), in_language("name"), "name")).cast("long")
    return profiles.select(rank.alias("rank"), "iso", "name", "fdrs", risk_label("fdrs").alias("label"), risk_colour("fdrs").alias("colour"))


def compared(profiles: DataFrame, one: str, other: str) -> DataFrame:
    """component (from 0), a, b, delta of two countries' components."""
    side = lambda iso, c: profiles.where(F.col("iso") == iso).select(F.posexplode("c").alias("component", c))
    return side(one, "a").join(side(other, "b"), "component").select(F.col("component").cast("long").alias("component"), "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def percentiles(profiles: DataFrame, peers: int = 3) -> DataFrame:
    """iso, fdrs, higher_than_pct and the peers nearest in score, ties by iso, as peer_rank, peer, distance.

    Scores are grouped first; each score's peers stand in its own group and in the `peers` groups before and after, of which
    the first few isos are enough. No pairs of countries are made, and the windows are over one row a score.
    """
    place = F.row_number().over(Window.partitionBy("fdrs").orderBy("iso"))
    few = profiles.where("iso is not null").select("fdrs", "iso", place.alias("place")).where(F.col("place") <= peers + 1)
    firsts = few.groupBy(F.col("fdrs").alias("at")).agg(F.sort_array(F.collect_list(F.struct(F.col("fdrs").alias("at"), F.col("iso").alias("peer")))).alias("firsts"))
    groups = profiles.groupBy("fdrs").agg(F.count("*").alias("m")).join(firsts, F.col("fdrs").eqNullSafe(F.col("at")), "left").drop("at")
    steps, every = Window.orderBy("fdrs"), Window.partitionBy()
    below = F.coalesce(F.sum("m").over(steps.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    around = [f("firsts", k).over(steps) for f in (F.lag, F.lead) for k in range(1, peers + 1)]
    near = F.flatten(F.filter(F.array(F.col("firsts"), *around), lambda a: a.isNotNull()))
    placed = groups.select("fdrs", below.alias("below"), F.sum("m").over(every).alias("n"), near.alias("near"))
    share = F.when(F.col("n") > 1, round_half_up(F.col("below") / (F.col("n") - 1) * 100.0)).otherwise(0.0)
    own = profiles.select("iso", "fdrs").join(placed.withColumn("higher_than_pct", share), "fdrs")
    others = F.transform(F.filter("near", lambda e: e["peer"] != F.col("iso")), lambda e: F.struct(F.abs(e["at"] - F.col("fdrs")).alias("distance"), e["peer"].alias("peer")))
    out = own.select("iso", "fdrs", "higher_than_pct", F.posexplode(F.slice(F.array_sort(others), 1, peers)).alias("k", "p"))
    return out.select("iso", "fdrs", "higher_than_pct", (F.col("k") + 1).cast("long").alias("peer_rank"), "p.peer", "p.distance")
