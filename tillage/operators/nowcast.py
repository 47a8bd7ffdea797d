"""The nowcast: a capped adjustment of each country's score from many feeds' signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.numeric import clamp, known, or_zero, round_half_up

#: What each feed gives, by column; feeds of SPINE bring keys in, the others only add to keys that are there.
FEEDS = {
    "hungermap": {"fcs_pct": "double"},
    "hungermap_country": {"fx_90d_change_pct": "double", "food_inflation_pct": "double"},
    "ipc": {"phase3plus_pct": "double"},
    "conflict": {"intensity_score": "double"},
    "reports": {"active_reports": "bigint"},
    "weather": {"precip_anomaly_pct": "double", "temp_anomaly_c": "double", "drought_flag": "boolean", "heat_flag": "boolean", "wet_flag": "boolean"},
    "rivers": {"flood_flag": "boolean"},
    "fires": {"fire_flag": "boolean"},
    "air": {"pm25_latest": "double", "pm25_flag": "boolean"},
    "us_water": {"flow_anomaly": "string"},
    "eurostat": {"food_hicp_yoy_pct": "double"},
    "faostat": {"food_cpi_yoy_pct": "double"},
    "inform": {"inform_risk": "double"},
    "governance": {"rule_of_law": "double"},
    "staples": {f"{s}_{m}": "double" for s in ("wheat", "rice", "corn") for m in ("production_kt", "consumption_kt")},
}
SPINE = ("hungermap", "ipc", "conflict", "weather", "hungermap_country", "eurostat", "faostat", "inform", "governance", "staples")
#: Components in the order in which they are added.
COMPONENTS = (
    "ipc_pressure", "wfp_pressure", "conflict_kick", "global_food_kick", "fx_shock", "inflation_shock", "weather_kick", "flood_kick",
    "fire_kick", "aq_kick", "us_water_kick", "inform_amp", "governance_drag", "psd_shortfall", "relief_damp",
)


def signals(feeds: dict[str | tuple[str, ...], DataFrame]) -> DataFrame:
    """One row for each key of the spine feeds, with the columns of all feeds; null where a feed lacks the key.

    Each feed has a row per key. Their rows are stacked and grouped once by key, which costs one shuffle however many feeds
    there are, where a chain of joins would cost one each. A tuple of names stands for a table that holds columns of several
    feeds; a column `spine` says which of its rows bring keys in, else all do if one of the feeds does.
    """
    stacked = []
    for name, table in feeds.items():
        names = (name,) if isinstance(name, str) else name
        if any(n not in FEEDS for n in names):
            continue
        own = [F.col(c).cast(kind).alias(c) for n in names for c, kind in FEEDS[n].items() if c in table.columns]
        spine = F.col("spine") if "spine" in table.columns else F.lit(any(n in SPINE for n in names))
        stacked.append(table.select("key", spine.alias("spine__"), *own))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    for columns in FEEDS.values():
        rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in rows.columns})
    merged = rows.groupBy("key").agg(F.max("spine__").alias("spine__"), *(F.max(c).alias(c) for columns in FEEDS.values() for c in columns))
    return merged.where("spine__ and key is not null").drop("spine__")


def _above(x: Column, threshold: float | Column, rate: float, cap: float) -> Column:
    return F.when(x > threshold, F.least(F.lit(cap), (x - threshold) * rate)).otherwise(0.0)


def _flag(x: Column | str, points: float) -> Column:
    return F.when(known(F.col(x) if isinstance(x, str) else x), F.lit(points)).otherwise(0.0)


def _shortfall(staple: str) -> Column:
    made, used = F.col(f"{staple}_production_kt"), F.col(f"{staple}_consumption_kt")
    gap = F.when(used > 0, (used - made) / used * 100.0)
    return F.when(gap > 95, 3.0).when(gap > 80, 2.0).when((gap > 60) & (made < 200), 1.0).otherwise(0.0)


def nowcast(feeds: dict[str | tuple[str, ...], DataFrame], month_change: DataFrame | None = None) -> DataFrame:
    """key, adjustment, the components (one decimal) and the signals behind them.

    feeds: by the names in FEEDS, those that there are (see signals); a missing feed counts as an empty one. month_change: one row with
    change_mom_pct of the world food price index; none or null: no kick. Each component has its own cap; their sum, unrounded,
    is rounded to one decimal and held between -10 and 35.
    """
    s = signals(feeds)
    if month_change is None:
        s = s.withColumn("change_mom_pct", F.lit(None).cast("double"))
    else:
        s = s.crossJoin(F.broadcast(month_change.agg(F.max("change_mom_pct").alias("change_mom_pct"))))  # one row
    inflation = F.coalesce("food_inflation_pct", "food_hicp_yoy_pct", "food_cpi_yoy_pct")
    source = F.when(F.col("food_inflation_pct").isNotNull(), "hungermap").when(F.col("food_hicp_yoy_pct").isNotNull(), "eurostat").when(F.col("food_cpi_yoy_pct").isNotNull(), "faostat")
    s = s.withColumn("inflation__", inflation).withColumn("food_inflation_source", source)
    s = s.withColumns({c: or_zero(c) for c in ("phase3plus_pct", "fcs_pct", "intensity_score")}).withColumn("active_reports", F.coalesce("active_reports", F.lit(0)))
    fx, rule, mom = F.col("fx_90d_change_pct"), F.col("rule_of_law"), or_zero("change_mom_pct")
    terms = {
        "ipc_pressure": F.least(F.lit(12.0), F.col("phase3plus_pct") * 0.12),
        "wfp_pressure": F.least(F.lit(6.0), F.greatest(F.lit(0.0), (F.col("fcs_pct") - 30) * 0.15)),
        "conflict_kick": F.least(F.lit(5.0), F.col("intensity_score") * 0.05),
        "global_food_kick": F.when(mom > 3, 2.0).when(mom > 1, 1.0).otherwise(0.0),
        "fx_shock": F.when(fx < -10, F.least(F.lit(3.0), F.abs(fx + 10) * 0.1)).otherwise(0.0),
        "inflation_shock": _above(F.col("inflation__"), F.when(F.col("food_inflation_source") == "eurostat", 8.0).otherwise(15.0), 0.1, 3.0),
        "weather_kick": F.least(F.lit(4.0), _flag("drought_flag", 3.0) + _flag("heat_flag", 1.5)),
        "flood_kick": _flag("flood_flag", 3.0),
        "fire_kick": _flag("fire_flag", 2.0),
        "aq_kick": _flag("pm25_flag", 1.0),
        "us_water_kick": _flag(F.col("key").startswith("US-") & F.col("flow_anomaly").isin("low", "high"), 2.0),
        "inform_amp": _above(F.col("inform_risk"), 7.0, 1.5, 3.0),
        "governance_drag": F.when(rule < -1, F.least(F.lit(2.0), (F.abs(rule) - 1) * 1.5)).otherwise(0.0),
        "psd_shortfall": F.greatest(*map(_shortfall, ("wheat", "rice", "corn"))),
        "relief_damp": F.when(F.col("active_reports") >= 3, -2.0).when(F.col("active_reports") >= 1, -1.0).otherwise(0.0),
    }
    s = s.withColumns({f"raw_{k}": terms[k] for k in COMPONENTS})
    total = reduce(lambda a, b: a + b, (F.col(f"raw_{k}") for k in COMPONENTS))
    shown = [round_half_up(f"raw_{k}", 1).alias(k) for k in COMPONENTS]
    seen = [c for columns in FEEDS.values() for c in columns if not c.startswith(("wheat_", "rice_", "corn_")) and c not in ("food_inflation_pct", "food_hicp_yoy_pct", "food_cpi_yoy_pct")]
    return s.select("key", clamp(round_half_up(total, 1), -10.0, 35.0).alias("adjustment"), *shown, *seen, F.col("inflation__").alias("food_inflation_pct"), "food_inflation_source", "change_mom_pct")


def top_channels(scores: DataFrame, n: int = 3) -> DataFrame:
    """key, rank, channel, points: each key's n largest positive components, ties by name. Rows stay in one piece: no shuffle."""
    pairs = F.array(*(F.struct(F.col(c).alias("points"), F.lit(c).alias("channel")) for c in COMPONENTS))
    order = F.array_sort(F.filter(pairs, lambda p: p["points"] > 0), lambda a, b: F.when(a["points"] > b["points"], -1).when(a["points"] < b["points"], 1).when(a["channel"] < b["channel"], -1).otherwise(1))
    return scores.select("key", F.posexplode(F.slice(order, 1, n)).alias("k", "p")).select("key", (F.col("k") + 1).cast("long").alias("rank"), "p.channel", "p.points")


def movers(scores: DataFrame, least: float = 8.0, n: int = 3) -> DataFrame:
    """key, adjustment of the n largest adjustments of at least so much, US states left out, ties by key."""
    return scores.where((F.col("adjustment") >= least) & ~F.col("key").startswith("US-")).select("key", "adjustment").orderBy(F.desc("adjustment"), "key").limit(n)
