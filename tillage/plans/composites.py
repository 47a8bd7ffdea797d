"""The queries that an analyst asks: nowcast, scenarios, forecasts, trade, manifest, summary, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.numeric import clamp, known, money, percent_change, round_half_up
from tillage.operators import change, health, latest, nowcast, scenario, scores, trade
from tillage.operators.reshape import in_order
from tillage.operators.shares import partner_shares
from tillage.plans.registry import Tables, query, rounded, summed
from tillage.plans.rollups import LABEL_SQL
from tillage.plans.views import MONTHLY, PROFILES, PURCHASES, monthly, profiles, purchases

# --- nowcast ----------------------------------------------------------------------------------------------------------


def _key(column: str):
    """Every 25th key is a US state."""
    return F.concat(F.when(F.col(column) % 25 == 0, "US-").otherwise("K-"), F.col(column).cast("string")).alias("key")


STAPLES = ("wheat", "rice", "corn")


def order_feeds(t: Tables) -> DataFrame:
    """The feeds that are made up of customers' orders, a row per key: one pass, added up by status and year first."""
    price, tier = F.col("o_totalprice").cast("decimal(12,2)"), F.substring("o_orderpriority", 1, 1)
    cells = t.orders.groupBy("o_custkey", F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n"), F.count_if(tier.isin("1", "2")).alias("hi"), F.count_if(F.col("o_totalprice") > 200000).alias("big"), F.sum(price).alias("total"),
        *(F.sum(F.when(tier == str(k), price)).alias(s) for k, s in enumerate(STAPLES, 1)),
    )
    of = lambda s: F.col("status") == s
    year = F.struct("year", F.col("total").cast("double").alias("total"))
    some = F.col("total").isNotNull()
    o = cells.groupBy("o_custkey").agg(
        F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("big").alias("big"), *(F.coalesce(F.sum(F.when(of(s), F.col("n"))), F.lit(0)).alias(f"n{s}") for s in "OP"),
        *(e for s in STAPLES for e in ((F.sum(F.when(of("F"), F.col(s))).cast("double") / 1000).alias(f"{s}_production_kt"), (F.sum(s).cast("double") / 1000).alias(f"{s}_consumption_kt"))),
        *(F.sort_array(F.collect_list(F.when(of(s) & some, year)), asc=False).alias(f"years{s}") for s in "FOP"),  # a year each
    )
    part = lambda c, scale, places: round_half_up(F.col(c) * scale / F.col("n"), places)
    change_of = lambda s: round_half_up(percent_change(F.get(f"years{s}", F.lit(0))["total"], F.get(f"years{s}", F.lit(1))["total"]), 2)
    third = F.col("o_custkey") % 3
    return o.select(
        _key("o_custkey"), part("nO", 100, 1).alias("fcs_pct"), part("hi", 100, 1).alias("phase3plus_pct"), part("big", 10, 1).alias("inform_risk"), round_half_up(F.col("nP") * 5 / F.col("n") - 2.5, 2).alias("rule_of_law"),
        *(f"{s}_{m}" for s in STAPLES for m in ("production_kt", "consumption_kt")),
        F.when(third == 0, change_of("F")).alias("food_inflation_pct"), F.when(third == 1, change_of("O")).alias("food_hicp_yoy_pct"), change_of("P").alias("food_cpi_yoy_pct"),
    )


def event_feeds(t: Tables) -> DataFrame:
    """The feeds that are made up of users' events, a row per key: one pass, added up by day first."""
    anchor = t.events.agg(F.max("ts").alias("top"))
    kind = lambda k: F.col("event_type") == k
    since = lambda d: F.expr(f"ts >= top - interval {d} days")
    cents, at = F.col("value").cast("decimal(12,2)"), F.when(F.col("value").isNotNull(), F.struct("ts", "event_id", "value"))
    day = t.events.crossJoin(F.broadcast(anchor)).groupBy("user_id", F.to_date("ts").alias("day")).agg(  # one row
        F.sum(cents).cast("double").alias("total"), F.sum(F.when(kind("purchase"), cents)).cast("double").alias("bought"), F.sum(F.when(kind("view"), cents)).alias("viewed"),
        F.count_if(kind("view")).alias("views"), F.count_if(kind("click")).alias("clicks"), F.count_if(kind("error") & since(10)).alias("near"), F.count_if(kind("error") & since(25)).alias("errors"),
        F.count_if(kind("signup") & since(10)).alias("signups"), F.min(at).alias("first"), F.max(at).alias("last"),
    )
    newest = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("day", c))), asc=False), lambda x: x[c])
    u = day.groupBy("user_id").agg(*(F.sum(c).alias(c) for c in ("viewed", "views", "clicks", "near", "errors", "signups")), F.min("first").alias("first"), F.max("last").alias("last"), newest("total").alias("totals"), newest("bought").alias("purchases"))  # a day each
    rain, river = change.trailing_in("totals", 3, 10), change.trailing_in("purchases")
    u = u.withColumns({"precip_anomaly_pct": change.rain_change(rain, 3, 10), "temp_anomaly_c": round_half_up(rain["short_mean"] - rain["long_mean"], 2), "rainy": rain["n"] > 0, "flow": change.flow_change(F.col("first.value"), F.col("last.value"))})
    when = lambda condition, x: F.when(condition, x)
    mean = F.col("viewed").cast("double") / F.col("views")
    return u.select(
        _key("user_id"), (F.col("rainy") | (F.col("errors") > 0)).alias("spine"),
        when(F.col("errors") > 0, clamp(round_half_up(F.col("near") / 20.0 * 100.0, 1), high=100.0)).alias("intensity_score"), F.nullif("signups", F.lit(0)).alias("active_reports"),
        "precip_anomaly_pct", "temp_anomaly_c",
        when(F.col("rainy"), known(F.col("precip_anomaly_pct") < -50)).alias("drought_flag"), when(F.col("rainy"), known(F.col("temp_anomaly_c") > 3)).alias("heat_flag"), when(F.col("rainy"), known(F.col("precip_anomaly_pct") > 100)).alias("wet_flag"),
        when(river["n"] >= 5, known(change.river_change(river) > 75.0)).alias("flood_flag"), when(F.col("clicks") > 0, F.col("clicks") > 2 * 8).alias("fire_flag"),
        round_half_up(mean, 1).alias("pm25_latest"), (mean > 35).alias("pm25_flag"), when(F.col("first").isNotNull(), change.flow_label(F.col("flow"))).alias("flow_anomaly"),
    )


def feeds(t: Tables) -> dict[str | tuple[str, ...], DataFrame]:
    """Feeds made up of customers' orders and users' events: two tables that hold several each, and the price of the newest orders."""
    fx = latest.nth_back(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice", 3)
    return {
        ("hungermap", "ipc", "inform", "governance", "staples", "hungermap_country", "eurostat", "faostat"): order_feeds(t),
        "hungermap_country": fx.select(_key("o_custkey"), round_half_up(percent_change("latest", "back", above=None), 1).alias("fx_90d_change_pct")),
        ("conflict", "reports", "weather", "rivers", "fires", "air", "us_water"): event_feeds(t),
    }


def adjustments(t: Tables) -> DataFrame:
    month = change.last_change(monthly(t).withColumn("all", F.lit(1)), ["all"], "month", "total").select(F.col("change_pct").alias("change_mom_pct"))
    return nowcast.nowcast(feeds(t), month)


_KEY = "CASE WHEN {0} % 25 = 0 THEN 'US-' ELSE 'K-' END || {0}"
_STAPLES = ", ".join(f"{summed(f'CASE WHEN tier = {k} AND o_orderstatus = {chr(39)}F{chr(39)} THEN o_totalprice END')} / 1000 AS {s}_made, {summed(f'CASE WHEN tier = {k} THEN o_totalprice END')} / 1000 AS {s}_used" for k, s in enumerate(("wheat", "rice", "corn"), 1))
_GAPS = ", ".join(f"CASE WHEN {s}_used > 0 THEN CASE WHEN ({s}_used - {s}_made) / {s}_used * 100.0::DOUBLE > 95 THEN 3 WHEN ({s}_used - {s}_made) / {s}_used * 100.0::DOUBLE > 80 THEN 2 WHEN ({s}_used - {s}_made) / {s}_used * 100.0::DOUBLE > 60 AND {s}_made < 200 THEN 1 ELSE 0 END ELSE 0 END" for s in ("wheat", "rice", "corn"))
_SUM = " + ".join(f"raw_{c}" for c in nowcast.COMPONENTS)
_SHOWN = ", ".join(f"{rounded(f'raw_{c}', 1)} AS {c}" for c in nowcast.COMPONENTS)
NOWCAST = f"""{MONTHLY}, mom AS (SELECT {rounded('(total - lag(total) OVER (ORDER BY month)) / lag(total) OVER (ORDER BY month) * 100.0::DOUBLE', 2)} AS change_mom_pct FROM monthly ORDER BY month DESC LIMIT 1),
ot AS (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INT) AS tier FROM orders),
o AS (SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (tier <= 2) AS hi, count(*) FILTER (o_orderstatus = 'O') AS no_, count(*) FILTER (o_orderstatus = 'P') AS np, count(*) FILTER (o_totalprice > 200000) AS big, {_STAPLES} FROM ot GROUP BY o_custkey),
fr AS (SELECT o_custkey AS id, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
fx AS (SELECT id, max(CASE WHEN rn = 1 THEN v END) AS a, arg_max(v, rn) AS b FROM fr WHERE rn <= 3 GROUP BY id),
yt AS (SELECT o_custkey AS id, o_orderstatus AS s, year(o_orderdate) AS y, {summed('o_totalprice')} AS v FROM orders GROUP BY ALL),
yr AS (SELECT *, row_number() OVER (PARTITION BY id, s ORDER BY y DESC) AS rn, lead(v) OVER (PARTITION BY id, s ORDER BY y DESC) AS w FROM yt),
yoy AS (SELECT id, s, CASE WHEN w > 0 THEN {rounded('(v - w) / w * 100.0::DOUBLE', 2)} END AS c FROM yr WHERE rn = 1),
top AS (SELECT max(ts) AS top FROM events),
cf AS (SELECT user_id AS id, least(100.0::DOUBLE, {rounded('count(*) FILTER (ts >= top - INTERVAL 10 DAY) / 20.0::DOUBLE * 100.0::DOUBLE', 1)}) AS intensity_score FROM events, top WHERE event_type = 'error' AND ts >= top - INTERVAL 25 DAY GROUP BY user_id),
rp AS (SELECT user_id AS id, count(*) AS active_reports FROM events, top WHERE event_type = 'signup' AND ts >= top - INTERVAL 10 DAY GROUP BY user_id),
dd AS (SELECT user_id AS id, CAST(ts AS DATE) AS day, {summed('value')} AS total, {summed("CASE WHEN event_type = 'purchase' THEN value END")} AS bought FROM events GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC) AS rn FROM dd),
wk AS (SELECT id, count(*) AS n, {summed('CASE WHEN rn <= 3 THEN total END')} AS s, {summed('total')} AS l FROM dr WHERE rn <= 10 GROUP BY id),
wa AS (SELECT id, CASE WHEN n >= 10 AND l * (3::DOUBLE / 10) > 1 THEN {rounded('(s - l * (3::DOUBLE / 10)) / (l * (3::DOUBLE / 10)) * 100.0::DOUBLE', 1)} END AS precip_anomaly_pct, {rounded('s / least(n, 3) - l / n', 2)} AS temp_anomaly_c FROM wk),
br AS (SELECT id, bought, row_number() OVER (PARTITION BY id ORDER BY day DESC) AS rn FROM dd WHERE bought IS NOT NULL),
bk AS (SELECT id, count(*) AS n, {summed('CASE WHEN rn <= 7 THEN bought END')} AS s, {summed('bought')} AS l FROM br WHERE rn <= 30 GROUP BY id),
fl AS (SELECT id, coalesce(CASE WHEN l / n > 0 THEN {rounded('(s / least(n, 7) - l / n) / (l / n) * 100.0::DOUBLE', 1)} END > 75, false) AS flood_flag FROM bk WHERE n >= 5),
fi AS (SELECT user_id AS id, count(*) > 16 AS fire_flag FROM events WHERE event_type = 'click' GROUP BY user_id),
vw AS (SELECT user_id AS id, {summed('value')} / count(*) AS mean FROM events WHERE event_type = 'view' GROUP BY user_id),
fe AS (SELECT user_id AS id, arg_min(value, (ts, event_id)) AS a, {rounded('arg_max(value, (ts, event_id))')} AS b FROM events GROUP BY user_id),
fc AS (SELECT id, CASE WHEN a <> 0 AND b <> 0 THEN {rounded('(b - a) / a * 100.0::DOUBLE', 1)} END AS c FROM fe),
uw AS (SELECT id, CASE WHEN c < -25 THEN 'low' WHEN c > 50 THEN 'high' ELSE 'normal' END AS flow_anomaly FROM fc),
spine AS (SELECT id FROM o UNION SELECT id FROM cf UNION SELECT id FROM wa),
s AS (SELECT {_KEY.format('spine.id')} AS key, coalesce({rounded('no_ * 100 / n', 1)}, 0) AS fcs_pct, coalesce({rounded('hi * 100 / n', 1)}, 0) AS phase3plus_pct, {rounded('big * 10 / n', 1)} AS inform_risk,
  {rounded('np * 5 / n - 2.5::DOUBLE', 2)} AS rule_of_law, o.* EXCLUDE (id), CASE WHEN b <> 0 THEN {rounded('(a - b) / b * 100.0::DOUBLE', 1)} END AS fx_90d_change_pct, yf.c AS i1, yo.c AS i2, yp.c AS i3,
  coalesce(intensity_score, 0) AS intensity_score, coalesce(active_reports, 0) AS active_reports, precip_anomaly_pct, temp_anomaly_c,
  CASE WHEN wa.id IS NOT NULL THEN coalesce(precip_anomaly_pct < -50, false) END AS drought_flag, CASE WHEN wa.id IS NOT NULL THEN coalesce(temp_anomaly_c > 3, false) END AS heat_flag, CASE WHEN wa.id IS NOT NULL THEN coalesce(precip_anomaly_pct > 100, false) END AS wet_flag,
  flood_flag, fire_flag, {rounded('mean', 1)} AS pm25_latest, mean > 35 AS pm25_flag, flow_anomaly, change_mom_pct
  FROM spine LEFT JOIN o USING (id) LEFT JOIN fx USING (id) LEFT JOIN yoy yf ON yf.id = spine.id AND yf.s = 'F' AND spine.id % 3 = 0 LEFT JOIN yoy yo ON yo.id = spine.id AND yo.s = 'O' AND spine.id % 3 = 1 LEFT JOIN yoy yp ON yp.id = spine.id AND yp.s = 'P'
  LEFT JOIN cf ON cf.id = spine.id LEFT JOIN rp ON rp.id = spine.id LEFT JOIN wa ON wa.id = spine.id LEFT JOIN fl ON fl.id = spine.id LEFT JOIN fi ON fi.id = spine.id LEFT JOIN vw ON vw.id = spine.id LEFT JOIN uw ON uw.id = spine.id, mom),
i AS (SELECT *, coalesce(i1, i2, i3) AS food_inflation_pct, CASE WHEN i1 IS NOT NULL THEN 'hungermap' WHEN i2 IS NOT NULL THEN 'eurostat' WHEN i3 IS NOT NULL THEN 'faostat' END AS food_inflation_source FROM s),
r AS (SELECT *, least(12.0::DOUBLE, phase3plus_pct * 0.12::DOUBLE) AS raw_ipc_pressure, least(6.0::DOUBLE, greatest(0.0::DOUBLE, (fcs_pct - 30) * 0.15::DOUBLE)) AS raw_wfp_pressure, least(5.0::DOUBLE, intensity_score * 0.05::DOUBLE) AS raw_conflict_kick,
  CASE WHEN change_mom_pct > 3 THEN 2.0::DOUBLE WHEN change_mom_pct > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS raw_global_food_kick,
  CASE WHEN fx_90d_change_pct < -10 THEN least(3.0::DOUBLE, abs(fx_90d_change_pct + 10) * 0.1::DOUBLE) ELSE 0.0::DOUBLE END AS raw_fx_shock,
  CASE WHEN food_inflation_pct > CASE WHEN food_inflation_source = 'eurostat' THEN 8 ELSE 15 END THEN least(3.0::DOUBLE, (food_inflation_pct - CASE WHEN food_inflation_source = 'eurostat' THEN 8 ELSE 15 END) * 0.1::DOUBLE) ELSE 0.0::DOUBLE END AS raw_inflation_shock,
  least(4.0::DOUBLE, CASE WHEN drought_flag THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN heat_flag THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END) AS raw_weather_kick, CASE WHEN flood_flag THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS raw_flood_kick,
  CASE WHEN fire_flag THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS raw_fire_kick, CASE WHEN pm25_flag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS raw_aq_kick,
  CASE WHEN key LIKE 'US-%' AND flow_anomaly IN ('low', 'high') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS raw_us_water_kick, CASE WHEN inform_risk > 7 THEN least(3.0::DOUBLE, (inform_risk - 7) * 1.5::DOUBLE) ELSE 0.0::DOUBLE END AS raw_inform_amp,
  CASE WHEN rule_of_law < -1 THEN least(2.0::DOUBLE, (abs(rule_of_law) - 1) * 1.5::DOUBLE) ELSE 0.0::DOUBLE END AS raw_governance_drag, CAST(greatest({_GAPS}) AS DOUBLE) AS raw_psd_shortfall,
  CASE WHEN active_reports >= 3 THEN -2.0::DOUBLE WHEN active_reports >= 1 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS raw_relief_damp FROM i),
nowcast AS (SELECT key, greatest(-10.0::DOUBLE, least(35.0::DOUBLE, {rounded(_SUM, 1)})) AS adjustment, {_SHOWN}, fcs_pct, fx_90d_change_pct, phase3plus_pct, intensity_score, active_reports, precip_anomaly_pct, temp_anomaly_c, drought_flag, heat_flag, wet_flag,
  flood_flag, fire_flag, pm25_latest, pm25_flag, flow_anomaly, inform_risk, rule_of_law, food_inflation_pct, food_inflation_source, change_mom_pct FROM r)"""


@query(f"WITH {NOWCAST} SELECT * FROM nowcast")
def q_nowcast(t: Tables) -> DataFrame:
    """The adjustment of every key, its components and signals, from fifteen feeds and one scalar."""
    return adjustments(t)


@query(f"WITH {NOWCAST} SELECT key, adjustment FROM nowcast WHERE adjustment >= 8 AND key NOT LIKE 'US-%' ORDER BY adjustment DESC, key LIMIT 3")
def q_movers(t: Tables) -> DataFrame:
    """The three largest adjustments of at least 8, states left out."""
    return nowcast.movers(adjustments(t))


_CHANNELS = " UNION ALL ".join(f"SELECT key, '{c}' AS channel, {c} AS points FROM nowcast" for c in nowcast.COMPONENTS)


@query(f"WITH {NOWCAST}, c AS ({_CHANNELS}) SELECT key, row_number() OVER (PARTITION BY key ORDER BY points DESC, channel) AS rank, channel, points FROM c WHERE points > 0 QUALIFY rank <= 3")
def q_top_channels(t: Tables) -> DataFrame:
    """Three largest components of each key."""
    return nowcast.top_channels(adjustments(t))


# --- scores -----------------------------------------------------------------------------------------------------------

_STRUCTURAL = rounded("0.0::DOUBLE + c[1] * 0.30::DOUBLE + c[2] * 0.20::DOUBLE + c[3] * 0.15::DOUBLE + c[4] * 0.15::DOUBLE + c[5] * 0.10::DOUBLE + c[6] * 0.10::DOUBLE", 1)


@query(f"WITH {PROFILES}, s AS (SELECT iso, {_STRUCTURAL} AS score FROM profiles) SELECT iso, score, {LABEL_SQL.format('score')} AS label FROM s")
def q_structural_score(t: Tables) -> DataFrame:
    """The weighted sum of each profile's components."""
    return scores.structural(profiles(t))


_SEVEN = rounded("0.0::DOUBLE + c[1] * 0.28::DOUBLE + c[2] * 0.18::DOUBLE + c[3] * 0.14::DOUBLE + c[4] * 0.14::DOUBLE + c[5] * 0.09::DOUBLE + c[6] * 0.09::DOUBLE + least(100.0::DOUBLE, w / 0.92::DOUBLE) * 0.08::DOUBLE", 1)


@query(f"WITH {PROFILES}, s AS (SELECT iso, {_SEVEN} AS score FROM profiles) SELECT iso, score, {LABEL_SQL.format('score')} AS label FROM s")
def q_seven_components(t: Tables) -> DataFrame:
    """The later score of seven components."""
    return scores.seven_components(profiles(t))


@query(f"""WITH {PROFILES}, {NOWCAST}, st AS (SELECT iso, {_STRUCTURAL} AS score FROM profiles), adj AS (SELECT replace(key, 'K-', 'N') AS iso, adjustment FROM nowcast),
h AS (SELECT iso, score, coalesce(adjustment, 0.0::DOUBLE) AS adjustment FROM st LEFT JOIN adj USING (iso)) SELECT *, least(100.0::DOUBLE, greatest(0.0::DOUBLE, {rounded('score + adjustment', 1)})) AS headline FROM h""")
def q_headline_score(t: Tables) -> DataFrame:
    """Structural score and adjustment added."""
    a = adjustments(t).withColumn("key", F.replace("key", F.lit("K-"), F.lit("N")))
    return scores.headline(scores.structural(profiles(t)), a)


_IMPACTS = {s[0]: rounded(f"{s[3]}::DOUBLE + " + " * ".join([f"(100.0::DOUBLE - c[{int(s[2][5]) + 1}])" if s[2].startswith("100") else f"c[{int(s[2][1]) + 1}]" if s[2][0] == "c" else s[2], *(f"{f}::DOUBLE" for f in s[4])])) for s in scenario.SCENARIOS}
_STRESS = f"""stress AS (SELECT iso, name, fdrs, 0.0::DOUBLE + {' + '.join(_IMPACTS.values())} AS delta FROM profiles),
stressed AS (SELECT *, least(100.0::DOUBLE, fdrs + delta) AS new_score, {LABEL_SQL.format('fdrs')} <> {LABEL_SQL.format('least(100.0::DOUBLE, fdrs + delta)')} AS crosses FROM stress)"""


@query(f"WITH {PROFILES}, {_STRESS} SELECT * FROM stressed ORDER BY delta DESC, name LIMIT 40")
def q_scenario(t: Tables) -> DataFrame:
    """All ten scenarios at once: the forty countries most affected."""
    return scenario.most_affected(scenario.stressed(profiles(t)))


_FIVE = "CASE WHEN {0} <= 25 THEN 'Resilient' WHEN {0} <= 50 THEN 'Exposed' WHEN {0} <= 75 THEN 'Dependent' WHEN {0} <= 88 THEN 'Structurally Vulnerable' ELSE 'Critical' END"


@query(f"WITH {PROFILES}, {_STRESS} SELECT {_FIVE.format('fdrs')} AS before, {_FIVE.format('new_score')} AS after, count(*) AS countries, {rounded(summed('delta') + ' / count(*)', 1)} AS mean_delta FROM stressed GROUP BY ALL")
def q_scenario_bands(t: Tables) -> DataFrame:
    """From which of five bands to which the scenarios together take countries."""
    return scenario.band_moves(scenario.stressed(profiles(t)))


@query(f"WITH {PROFILES} SELECT iso, {rounded('CASE WHEN customers % 3 = 0 THEN c[4] ELSE (customers % 90) * 0.6::DOUBLE + c[4] * (1 - 0.6::DOUBLE) END', 2)} AS climate, {rounded('CASE WHEN nf % 2 = 0 THEN c[5] ELSE (nf % 100) * 0.6::DOUBLE + c[5] * (1 - 0.6::DOUBLE) END', 2)} AS conflict FROM profiles JOIN (SELECT iso AS i, c[2] AS b, c[3] AS a FROM profiles) ON i = iso, LATERAL (SELECT CAST(b AS BIGINT) AS customers, CAST(a AS BIGINT) AS nf)")
def q_blended(t: Tables) -> DataFrame:
    """Two components of which three fifths are sourced where a source has them: sourced values are made of two others, every third and second unknown."""
    c = lambda k: F.get("c", F.lit(k))
    sourced = lambda k, by, of: F.when(c(k).cast("long") % by != 0, (c(k).cast("long") % of).cast("double"))
    return profiles(t).select("iso", round_half_up(scores.blended(sourced(1, 3, 90), c(3)), 2).alias("climate"), round_half_up(scores.blended(sourced(2, 2, 100), c(4)), 2).alias("conflict"))


@query(f"WITH {PROFILES} SELECT iso, s.scenario, s.impact FROM (SELECT iso, unnest([{', '.join(f'{{scenario: {chr(39)}{k}{chr(39)}, impact: {v}}}' for k, v in _IMPACTS.items())}]) AS s FROM profiles)")
def q_scenario_impacts(t: Tables) -> DataFrame:
    """Every scenario's impact on every country."""
    return scenario.impacts(profiles(t))


@query(f"""WITH {PROFILES}, {_STRESS} SELECT count(*) FILTER (crosses) AS crossings, {rounded(summed('delta') + ' / count(*)', 1)} AS mean_delta, max(delta) AS highest,
  (SELECT string_agg(name, ', ' ORDER BY delta DESC, name) FROM (SELECT * FROM stressed ORDER BY delta DESC, name LIMIT 3)) AS most_exposed FROM stressed""")
def q_scenario_summary(t: Tables) -> DataFrame:
    """How many labels change, the mean and highest delta, the three most exposed."""
    return scenario.summary(scenario.stressed(profiles(t)))


_CHANNEL_OF = {"wheat20": "price", "rice20": "price", "maize20": "price", "fert30": "input", "oil25": "input", "drought": "weather", "ban": "trade", "ship": "trade", "conflict": "trade", "fx": "money"}
_KICKS = " UNION ALL ".join(f"SELECT iso AS key, '{_CHANNEL_OF[k]}' AS channel, {v} AS kick, iso NOT LIKE 'US-%' AS is_sourced FROM profiles" for k, v in _IMPACTS.items())


@query(f"""WITH {PROFILES}, k AS ({_KICKS}), w AS (SELECT *, kick * CASE WHEN is_sourced THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS k FROM k WHERE kick <> 0)
SELECT key, channel, {rounded("CASE WHEN count(*) >= 2 THEN sqrt(CAST(sum(CAST(k * k AS DECIMAL(20,6))) AS DOUBLE)) ELSE CAST(sum(CAST(k AS DECIMAL(20,6))) AS DOUBLE) END", 2)} AS kick, count(*) AS shocks FROM w GROUP BY key, channel""")
def q_scenario_damped(t: Tables) -> DataFrame:
    """Shocks of one channel damped where they overlap, and where they rest on old values (here: states)."""
    channel = F.create_map(*(F.lit(x) for kv in _CHANNEL_OF.items() for x in kv))
    kicks = scenario.impacts(profiles(t)).select(F.col("iso").alias("key"), channel[F.col("scenario")].alias("channel"), F.col("impact").alias("kick"), (~F.col("iso").startswith("US-")).alias("is_sourced"))
    return scenario.damped(kicks)


@query(f"""WITH {PROFILES}, d AS (SELECT *, [w * 2, r * 2, m * 2] AS production, [r * 3, w * 3, m * 3] AS consumption FROM profiles)
SELECT iso, consumption[2] - production[2] AS gap, f2030 - fdrs AS delta, least(100.0::DOUBLE, c[1] + {rounded('(f2030 - fdrs) * 0.4::DOUBLE')}) AS projected_dependency, CASE WHEN f2030 - fdrs > 0 THEN 'worsening' ELSE 'improving' END AS direction FROM d""")
def q_forecast(t: Tables) -> DataFrame:
    """Supply gap, change to 2030 and projected dependency."""
    w, r, m = F.col("w"), F.col("r"), F.col("m")
    return scores.forecast(profiles(t).withColumn("production", F.array(w * 2, r * 2, m * 2)).withColumn("consumption", F.array(r * 3, w * 3, m * 3)))


@query(f"WITH {PROFILES} SELECT iso, 100.0::DOUBLE - {rounded('(c[3] + c[6]) / 2')} AS x, c[1] AS y FROM profiles")
def q_matrix(t: Tables) -> DataFrame:
    """Resilience against dependency."""
    return scores.matrix(profiles(t))


@query(f"""WITH {PROFILES}, p AS (SELECT iso, fdrs, {rounded('percent_rank() OVER (ORDER BY fdrs) * 100.0::DOUBLE')} AS higher_than_pct FROM profiles),
d AS (SELECT p.*, q.iso AS peer, abs(q.fdrs - p.fdrs) AS distance FROM p JOIN profiles q ON q.iso <> p.iso)
SELECT iso, fdrs, higher_than_pct, row_number() OVER (PARTITION BY iso ORDER BY distance, peer) AS peer_rank, peer, distance FROM d QUALIFY peer_rank <= 3""")
def q_percentile_peers(t: Tables) -> DataFrame:
    """How many countries score lower, and the three of nearest score."""
    return scores.percentiles(profiles(t))


# --- trade ------------------------------------------------------------------------------------------------------------


@query(f"""WITH b AS (SELECT c_custkey AS key, {rounded('c_acctbal * 100 - 400000')} AS net FROM customer)
SELECT key, net, net >= 0 AS is_exporter, {rounded('abs(least(net, 0.0::DOUBLE)) / 1000', 1)} AS imports_bn, {rounded('greatest(net, 0.0::DOUBLE) / 1000', 1)} AS exports_bn, least(abs(net) / 2000, 45.0::DOUBLE) AS bar_width FROM b""")
def q_trade_panel(t: Tables) -> DataFrame:
    """Balances split by sign, with the width of their bar."""
    return trade.panel(t.customer.select(F.col("c_custkey").alias("key"), round_half_up(F.col("c_acctbal") * 100 - 400000).alias("net")))


@query(f"""WITH {PROFILES}, b AS (SELECT iso AS key, CASE WHEN net < 0 THEN abs(net) * 0.8::DOUBLE ELSE 500.0::DOUBLE END AS base FROM profiles), w(rank, w) AS (VALUES (1, 35), (2, 25), (3, 18), (4, 12), (5, 10))
SELECT key, CAST(rank AS BIGINT) AS rank, greatest({rounded('base * (w / 100.0::DOUBLE) / 100.0::DOUBLE')}, 10.0::DOUBLE) AS value FROM b, w""")
def q_import_bars(t: Tables) -> DataFrame:
    """Five guessed import values of each country."""
    return trade.import_bars(profiles(t).select(F.col("iso").alias("key"), "net"))


def _places(t: Tables) -> DataFrame:
    """A made-up place for each nation but every seventh."""
    n = F.col("n_nationkey")
    return t.nation.where("n_nationkey % 7 <> 6").select(F.col("n_name").alias("name"), (n * 3 - 36).cast("double").alias("lat"), (n * 7 - 80).cast("double").alias("lon"))


@query(f"""WITH {PURCHASES}, i AS (SELECT importer, supplier, {summed('value')} AS v FROM purchases WHERE value > 0 GROUP BY ALL),
im AS (SELECT importer, supplier, {rounded('v / CAST(sum(CAST(v AS DECIMAL(28,2))) OVER (PARTITION BY importer) AS DOUBLE) * 100.0::DOUBLE', 1)} AS share, row_number() OVER (PARTITION BY importer ORDER BY v DESC, supplier) AS rank FROM i),
ex AS (SELECT supplier AS exporter, importer, row_number() OVER (PARTITION BY supplier ORDER BY v DESC, importer) AS rank FROM i),
e AS (SELECT importer AS k, 'import' AS type, rank, supplier AS p, share AS weight FROM im WHERE rank <= 5 UNION ALL SELECT exporter, 'export', rank, importer, CASE rank WHEN 1 THEN 35 WHEN 2 THEN 25 WHEN 3 THEN 18 ELSE 12 END FROM ex WHERE rank <= 4)
SELECT a.n_name AS key, type, rank, b.n_name AS partner, CAST(weight AS DOUBLE) AS weight, CAST(a.n_nationkey * 3 - 36 AS DOUBLE) AS lat, CAST(a.n_nationkey * 7 - 80 AS DOUBLE) AS lon, CAST(b.n_nationkey * 3 - 36 AS DOUBLE) AS partner_lat, CAST(b.n_nationkey * 7 - 80 AS DOUBLE) AS partner_lon
FROM e JOIN nation a ON a.n_nationkey = k JOIN nation b ON b.n_nationkey = p WHERE a.n_nationkey % 7 <> 6 AND b.n_nationkey % 7 <> 6""")
def q_trade_flows(t: Tables) -> DataFrame:
    """Edges from suppliers and to destinations, between places that are known."""
    p = purchases(t)
    name = t.nation.select("n_nationkey", "n_name")
    named = lambda df, k, out: df.join(name.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(out)), k)
    im = named(named(partner_shares(p, ["importer"], "supplier", "value"), "importer", "key"), "supplier", "partner")
    ex = named(named(partner_shares(p, ["supplier"], "importer", "value", 4), "supplier", "key"), "importer", "partner")
    lists = im.groupBy("key").agg(in_order(F.col("rank"), "partner", "share_pct").alias("s")).select("key", F.col("s.partner").alias("suppliers"), F.col("s.share_pct").alias("shares"))
    to = ex.groupBy("key").agg(in_order(F.col("rank"), "partner").alias("d")).select("key", F.col("d.partner").alias("destinations"))
    return trade.flows(lists.join(to, "key", "left"), _places(t))


# --- health -----------------------------------------------------------------------------------------------------------

#: name, mode, present, source, notes, monthly, snapshot and the age in months of the period, for the manifest of the test tables.
_FEEDS = (
    ("orders", "auto", True, "Orders", "", True, False, 0), ("lineitem", "auto", True, "Lines", "API_KEY not configured", False, False, 0), ("customer", "auto", True, "Customers", "HTTP 403 returned", False, False, 0),
    ("supplier", "manual", True, "Suppliers", "", False, True, 0), ("part", "static_helper", False, "", "", False, False, 0), ("nation", "auto", False, "", "", False, False, 0), ("events", "auto", True, "Events", "fine", True, False, 5), ("empty", "manual", True, "Nothing", "", False, False, 0),
)


def manifest_feeds(t: Tables) -> DataFrame:
    rows = [(*f[:5], *f[5:]) for f in _FEEDS]
    spec = t.literal(rows, "feed string, mode string, present boolean, source string, notes string, monthly boolean, snapshot boolean, age int")
    counts = reduce(lambda a, b: a.union(b), (getattr(t, f[0]).agg(F.lit(f[0]).alias("feed"), F.count("*").alias("n_rows")) for f in _FEEDS if f[0] != "empty"))
    out = spec.join(counts, "feed", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return out.withColumn("period", F.when(F.col("monthly"), F.expr("add_months(date'2026-04-01', -age)"))).withColumn("generated_at", F.when(F.col("present"), F.lit("2026-05-20 12:00:00").cast("timestamp"))).drop("age")


_MANIFEST = f"""spec(feed, mode, present, source, notes, monthly, snapshot, age) AS (VALUES {', '.join('(' + ', '.join(repr(x) for x in f) + ')' for f in _FEEDS)}),
counts AS ({' UNION ALL '.join(f"SELECT '{f[0]}' AS feed, count(*) AS n_rows FROM {f[0]}" for f in _FEEDS if f[0] != 'empty')}),
m AS (SELECT spec.* EXCLUDE (age), coalesce(n_rows, 0) AS n_rows, CASE WHEN monthly THEN CAST(DATE '2026-04-01' - to_months(age) AS DATE) END AS period, CASE WHEN present THEN TIMESTAMP '2026-05-20 12:00:00' END AS generated_at, lower(source || ' ' || notes) AS said FROM spec LEFT JOIN counts USING (feed)),
manifest AS (SELECT * EXCLUDE (said), CASE WHEN mode = 'static_helper' THEN 'manual' WHEN NOT present THEN 'failed' WHEN contains(said, 'not configured') THEN 'setup_required' WHEN contains(said, '403') THEN 'degraded' WHEN n_rows = 0 THEN 'degraded'
  WHEN monthly AND (2026 - year(period)) * 12 + 5 - month(period) > 2 THEN 'degraded' WHEN snapshot THEN 'manual' ELSE 'ok' END AS status,
  CASE WHEN mode = 'static_helper' THEN 'static deep-link helper (curated lookup)' WHEN NOT present THEN 'missing file' WHEN contains(said, 'not configured') THEN 'setup or approval required' WHEN contains(said, '403') THEN 'upstream auth or access failure'
  WHEN n_rows = 0 THEN CASE WHEN mode = 'manual' THEN 'manual source has no rows' ELSE 'empty payload' END WHEN monthly AND (2026 - year(period)) * 12 + 5 - month(period) > 2 THEN 'stale release (' || strftime(period, '%Y-%m') || ')' WHEN snapshot THEN 'manual annual snapshot' ELSE 'healthy' END AS reason,
  date_diff('day', CAST(generated_at AS DATE), DATE '2026-05-30') AS age_days FROM m)"""


@query(f"WITH {_MANIFEST} SELECT * FROM manifest")
def q_manifest(t: Tables) -> DataFrame:
    """State of each feed by ordered rules."""
    return health.manifest(manifest_feeds(t), F.lit("2026-05-30").cast("date"))


@query(f"""WITH {_MANIFEST}, s AS (SELECT count(*) AS total_sources, {', '.join(f"count(*) FILTER (status = '{k}') AS {k}_sources" for k in ('ok', 'manual', 'degraded', 'setup_required', 'failed'))}, max(generated_at) AS loaded_at FROM manifest)
SELECT *, ok_sources + manual_sources AS healthy_sources, CASE WHEN degraded_sources + setup_required_sources + failed_sources = 0 THEN 'healthy' ELSE 'attention' END AS headline_status FROM s""")
def q_manifest_summary(t: Tables) -> DataFrame:
    """Counts by state."""
    return health.manifest_summary(health.manifest(manifest_feeds(t), F.lit("2026-05-30").cast("date")))


_COUNTS = f"""{NOWCAST}, best AS (SELECT key, adjustment FROM nowcast WHERE key NOT LIKE 'US-%' ORDER BY adjustment DESC, key LIMIT 1), ipc AS (SELECT key, phase3plus_pct FROM nowcast ORDER BY phase3plus_pct DESC, key LIMIT 1), inf AS (SELECT key, inform_risk FROM nowcast WHERE inform_risk IS NOT NULL ORDER BY inform_risk DESC, key LIMIT 1),
counts AS (SELECT count(*) FILTER (key NOT LIKE 'US-%' AND adjustment >= 8) AS movers, (SELECT key FROM best) AS top_name, (SELECT adjustment FROM best) AS top_adjustment, count(*) FILTER (phase3plus_pct >= 25) AS high_ipc,
  (SELECT key FROM ipc) AS worst_ipc_name, count(*) FILTER (drought_flag) AS drought, count(*) FILTER (flood_flag) AS flood, count(*) FILTER (fire_flag) AS fire, count(*) FILTER (fx_90d_change_pct < -10) AS fx, max(change_mom_pct) AS ffpi_mom_pct,
  count(*) FILTER (inform_risk >= 7.5) AS high_inform, (SELECT key FROM inf) AS top_inform_name FROM nowcast)"""


def summary_counts(t: Tables) -> DataFrame:
    n = adjustments(t)
    best = lambda v, *cond: F.min_by("key", F.struct((-F.col(v)).alias("v"), "key")) if not cond else F.min_by(F.when(cond[0], F.col("key")), F.when(cond[0], F.struct((-F.col(v)).alias("v"), "key")))
    country = ~F.col("key").startswith("US-")
    return n.agg(
        F.count_if(country & (F.col("adjustment") >= 8)).alias("movers"), best("adjustment", country).alias("top_name"), F.max(F.when(country, F.col("adjustment"))).alias("top_adjustment"),
        F.count_if(F.col("phase3plus_pct") >= 25).alias("high_ipc"), best("phase3plus_pct").alias("worst_ipc_name"), F.max("phase3plus_pct").alias("worst_ipc_pct"), F.count_if("drought_flag").alias("drought"), F.count_if("flood_flag").alias("flood"),
        F.count_if("fire_flag").alias("fire"), F.count_if(F.col("fx_90d_change_pct") < -10).alias("fx"), F.max("change_mom_pct").alias("ffpi_mom_pct"), F.count_if(F.col("inform_risk") >= 7.5).alias("high_inform"),
        best("inform_risk", F.col("inform_risk").isNotNull()).alias("top_inform_name"), F.max("inform_risk").alias("top_inform"),
    )


@query(f"""WITH {_COUNTS} SELECT *, CASE WHEN movers > 0 THEN movers || ' countries with active nowcast pressure; ' || top_name || ' leads.' WHEN high_ipc > 0 THEN high_ipc || ' countries in active IPC Phase 3+ crisis; quiet day on the nowcast layer.'
  WHEN drought + flood + fire > 0 THEN 'Quiet on FDRS movements; environmental signals firing across multiple regions.' ELSE 'No major shocks today; structural FDRS unchanged at most countries.' END AS headline,
  'Today: ' || concat_ws(' · ', CASE WHEN movers > 0 THEN movers || ' country nowcast moves' END, CASE WHEN high_ipc > 0 THEN high_ipc || ' IPC Phase 3+ crises' END, CASE WHEN drought + flood + fire > 0 THEN (drought + flood + fire) || ' environmental flags' END, CASE WHEN fx > 0 THEN fx || ' currency shocks' END) || '.' AS subhead FROM counts""")
def q_daily_summary(t: Tables) -> DataFrame:
    """The day's headline from counts of what the nowcast shows."""
    return health.daily_summary(summary_counts(t)).drop("bullets", "worst_ipc_pct", "top_inform")


@query("""SELECT 'orders: at least 150 rows' AS "check", count(*) AS found, count(*) >= 150 AS passed FROM orders
UNION ALL SELECT 'customers: every customer has orders', count(*), count(*) = 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'nations: no empty name', count(*) FILTER (trim(coalesce(n_name, '')) = ''), count(*) FILTER (trim(coalesce(n_name, '')) = '') = 0 FROM nation
UNION ALL SELECT 'nations: no known swap', count(*), count(*) = 0 FROM nation WHERE (n_nationkey, n_name) IN ((1, 'NATION_2'), (3, 'NATION_3'))
UNION ALL SELECT 'nations: names agree', count(*), count(*) = 0 FROM nation WHERE n_name = 'NATION_4' AND n_nationkey <> 4
UNION ALL SELECT 'labels: quality known', count(quality), count(quality) >= 50 FROM labels
UNION ALL SELECT 'lineitem: key is unique', count(*) - count(DISTINCT (l_orderkey, l_linenumber)), count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def q_quality_checks(t: Tables) -> DataFrame:
    """A quality report, a row per check."""
    swaps = t.literal([(1, "NATION_2"), (3, "NATION_3")], "n_nationkey int, n_name string")
    canon = t.literal([("NATION_4", 4)], "n_name string, expected int")
    repeated = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg((F.count("*") - 1).alias("extra"))
    checks = [
        health.at_least("orders: at least 150 rows", t.orders, 150),
        health.none_missing("customers: every customer has orders", t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k"),
        health.none_bad("nations: no empty name", t.nation, F.trim(F.coalesce("n_name", F.lit(""))) == ""),
        health.no_swaps("nations: no known swap", t.nation, swaps, ["n_nationkey", "n_name"]),
        health.names_agree("nations: names agree", t.nation, canon, "n_nationkey", "n_name"),
        health.known_in("labels: quality known", t.labels, "quality", 50),
        health.checked("lineitem: key is unique", repeated, F.coalesce(F.sum("extra"), F.lit(0)), F.col("found") == 0),
    ]
    return reduce(lambda a, b: a.union(b), checks)
