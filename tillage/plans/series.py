"""Latest values, changes and trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.numeric import clamp, known, money, percent_change, round_half_up
from tillage.operators import change, latest
from tillage.operators.reshape import in_order
from tillage.plans.registry import Tables, query, rounded, summed
from tillage.plans.views import DAILY, MONTHLY, NATION_YEARS, YEARLY, daily, monthly, nation_years, yearly


@query("""SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def q_latest_per_key(t: Tables) -> DataFrame:
    """Each customer's latest order; of equal dates the first key."""
    rows = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderdate", "o_totalprice")
    return latest.latest(rows, ["o_custkey"], [F.col("o_orderdate"), -F.col("o_orderkey")], ["o_orderkey", "day", "o_totalprice"])


@query(f"""WITH {YEARLY} SELECT o_custkey, o_orderstatus, year, total AS value FROM yearly WHERE (year + o_custkey) % 3 <> 0
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY year DESC) = 1""")
def q_latest_nonnull(t: Tables) -> DataFrame:
    """Newest known yearly total by customer and status; every third is made unknown."""
    rows = yearly(t).withColumn("value", F.when((F.col("year") + F.col("o_custkey")) % 3 != 0, F.col("total")))
    return latest.latest_nonnull(rows, ["o_custkey", "o_orderstatus"], [F.col("year")], "value", ["year", "value"])


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P')
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1),
p AS (SELECT o_custkey, count(*) AS projections FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT a.*, coalesce(projections, 0) AS projections FROM a LEFT JOIN p USING (o_custkey)""")
def q_latest_actual(t: Tables) -> DataFrame:
    """Latest actual row (F or P) of each customer, with how many projections (O) it has; one grouping gives both."""
    actual = F.col("o_orderstatus").isin("F", "P")
    best = F.max_by(F.when(actual, F.struct("o_orderkey", "o_orderstatus", "o_totalprice")), F.when(actual, F.struct("o_orderdate", -F.col("o_orderkey"))))
    rows = t.orders.groupBy("o_custkey").agg(best.alias("b"), F.count_if(F.col("o_orderstatus") == "O").alias("projections"))
    return rows.where("b is not null").select("o_custkey", "b.*", "projections")


@query(f"""WITH y AS (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS tier, CAST(year(o_orderdate) AS INT) AS year,
  {summed("CASE WHEN o_orderstatus = 'F' THEN o_totalprice END")} AS exports, {summed("CASE WHEN o_orderstatus = 'O' THEN o_totalprice END")} AS imports FROM orders GROUP BY ALL)
SELECT o_custkey, tier, year, exports, imports, {rounded('(exports - imports) / 1000.0::DOUBLE', 1)} AS net FROM y WHERE exports IS NOT NULL AND imports IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY tier, year DESC) = 1""")
def q_net_trade(t: Tables) -> DataFrame:
    """Exports (F) less imports (O) of the latest year that has both, in the first priority tier that has such a year."""
    tier = F.substring("o_orderpriority", 1, 1).cast("int")
    side = lambda s: money(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    rows = t.orders.groupBy("o_custkey", tier.alias("tier"), F.year("o_orderdate").alias("year")).agg(side("F").alias("exports"), side("O").alias("imports"))
    out = latest.latest_with_both(rows, ["o_custkey"], "tier", "year", "exports", "imports")
    return out.withColumn("net", round_half_up((F.col("exports") - F.col("imports")) / 1000.0, 1))


@query(f"""WITH {MONTHLY}, l AS (SELECT month, total AS latest, lag(total) OVER (ORDER BY month) AS previous FROM monthly)
SELECT month AS "at", latest, previous, CASE WHEN previous > 0 THEN {rounded('(latest - previous) / previous * 100.0::DOUBLE', 2)} END AS change_pct FROM l ORDER BY month DESC LIMIT 1""")
def q_mom_change(t: Tables) -> DataFrame:
    """The last month's total against the month before."""
    return change.last_change(monthly(t).withColumn("all", F.lit(1)), ["all"], "month", "total").drop("all")


@query(f"""WITH {NATION_YEARS}, l AS (SELECT nation, year, total AS latest, lag(total) OVER (PARTITION BY nation ORDER BY year) AS previous FROM nation_years),
c AS (SELECT nation, year AS "at", latest, previous, CASE WHEN previous > 0 THEN {rounded('(latest - previous) / previous * 100.0::DOUBLE', 2)} END AS change_pct FROM l
  QUALIFY row_number() OVER (PARTITION BY nation ORDER BY year DESC) = 1)
SELECT *, coalesce(change_pct > 15, false) AS shock FROM c""")
def q_yoy_change(t: Tables) -> DataFrame:
    """Each nation's last year against the year before that it has, and whether that is a shock."""
    return change.last_change(nation_years(t), ["nation"], "year", "total").withColumn("shock", known(F.col("change_pct") > 15))


@query(f"WITH {MONTHLY} SELECT month, total FROM monthly ORDER BY month DESC LIMIT 24")
def q_trailing_n(t: Tables) -> DataFrame:
    """The last 24 months."""
    return monthly(t).orderBy(F.desc("month")).limit(24)


_TRAIL = f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn FROM daily),
k AS (SELECT event_type, count(*) AS n, {summed('CASE WHEN rn <= 7 THEN total END')} AS short_sum, {summed('total')} AS long_sum FROM r WHERE rn <= 30 GROUP BY event_type)"""


@query(f"""{_TRAIL}, b AS (SELECT *, CASE WHEN n >= 30 THEN long_sum * (7::DOUBLE / 30) END AS baseline FROM k),
a AS (SELECT *, CASE WHEN baseline > 1 THEN {rounded('(short_sum - baseline) / baseline * 100.0::DOUBLE', 1)} END AS anomaly_pct FROM b)
SELECT event_type, {rounded('short_sum', 1)} AS short_sum, anomaly_pct, {rounded('short_sum / 7', 2)} AS short_mean, {rounded('short_sum / least(n, 7) - long_sum / n', 2)} AS mean_delta,
  coalesce(anomaly_pct < -5, false) AS drought_flag, coalesce(anomaly_pct > 5, false) AS wet_flag, coalesce({rounded('short_sum / least(n, 7) - long_sum / n', 2)} > 3, false) AS heat_flag FROM a""")
def q_precip_anomaly(t: Tables) -> DataFrame:
    """Sum of the last 7 daily totals against the last 30, and the means' difference, with flags (thresholds suited to these tables)."""
    a = change.rain_anomaly(daily(t), ["event_type"], "day", "total")
    delta = round_half_up(F.col("short_mean") - F.col("long_mean"), 2)
    return a.select(
        "event_type", round_half_up("short_sum", 1).alias("short_sum"), "anomaly_pct", round_half_up("short_mean", 2).alias("short_mean"), delta.alias("mean_delta"),
        known(F.col("anomaly_pct") < -5).alias("drought_flag"), known(F.col("anomaly_pct") > 5).alias("wet_flag"), known(delta > 3).alias("heat_flag"),
    )


@query(f"""{_TRAIL}, a AS (SELECT event_type, short_sum / least(n, 7) AS s, long_sum / n AS l FROM k WHERE n >= 14),
p AS (SELECT event_type, s, CASE WHEN l > 0 THEN {rounded('(s - l) / l * 100.0::DOUBLE', 1)} END AS anomaly_pct FROM a)
SELECT event_type, {rounded('s', 1)} AS short_mean, anomaly_pct, coalesce(anomaly_pct > 2, false) AS flood_flag FROM p""")
def q_flood_anomaly(t: Tables) -> DataFrame:
    """Mean of the last 7 daily totals against the mean of up to 30, with at least 14."""
    a = change.river_anomaly(daily(t), ["event_type"], "day", "total", flood_above=2.0)
    return a.select("event_type", round_half_up("short_mean", 1).alias("short_mean"), "anomaly_pct", "flood_flag")


@query(f"""WITH e AS (SELECT user_id, arg_min(value, (ts, event_id)) AS first, {rounded('arg_max(value, (ts, event_id))', 0)} AS last FROM events GROUP BY user_id),
c AS (SELECT *, CASE WHEN first <> 0 AND last <> 0 THEN {rounded('(last - first) / first * 100.0::DOUBLE', 1)} END AS change_pct FROM e)
SELECT *, CASE WHEN change_pct < -25 THEN 'low' WHEN change_pct > 50 THEN 'high' ELSE 'normal' END AS anomaly FROM c""")
def q_flow_change(t: Tables) -> DataFrame:
    """Each user's last value against the first, as low, normal or high."""
    return change.first_to_last(t.events, ["user_id"], ["ts", "event_id"], "value")


@query(f"""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
k AS (SELECT user_id, max(CASE WHEN rn = 1 THEN value END) AS latest, arg_max(value, rn) AS back, count(*) AS points FROM r WHERE rn <= 90 GROUP BY user_id)
SELECT *, CASE WHEN back <> 0 THEN {rounded('(latest - back) / back * 100.0::DOUBLE', 1)} END AS change_pct FROM k""")
def q_nth_back(t: Tables) -> DataFrame:
    """Each user's last value against the 90th from the last, or the oldest."""
    out = latest.nth_back(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "value", 90)
    return out.withColumn("change_pct", round_half_up(percent_change("latest", "back", above=None), 1))


@query(f"""WITH {NATION_YEARS} SELECT nation, year, total, {rounded('total / first_value(total) OVER (PARTITION BY nation ORDER BY year) * 100.0::DOUBLE')} AS index FROM nation_years""")
def q_index_base(t: Tables) -> DataFrame:
    """Each nation's yearly totals with the first year as 100."""
    return change.indexed(nation_years(t), ["nation"], "year", "total")


@query(f"WITH {NATION_YEARS} SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY year) - 1 AS pos, year, total FROM nation_years")
def q_series_collect(t: Tables) -> DataFrame:
    """Each nation's series as one ordered array, written as rows with their place."""
    one = nation_years(t).groupBy("nation").agg(in_order(F.col("year"), "year", "total").alias("series"))
    return one.select("nation", F.posexplode("series").alias("pos", "p")).select("nation", F.col("pos").cast("long").alias("pos"), "p.year", "p.total")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def q_recent_events(t: Tables) -> DataFrame:
    """Events of the ten days before the last one; the anchor is a value of the data, taken by one aggregate."""
    anchor = t.events.agg((F.max("ts") - F.expr("interval 10 days")).alias("since"))
    return t.events.crossJoin(F.broadcast(anchor)).where("ts >= since").select("event_id", "user_id", "event_type")  # one row


@query("""WITH w AS (SELECT o_custkey, o_orderstatus, CAST(min(CAST(substr(o_orderpriority, 1, 1) AS INT)) AS INT) AS phase FROM orders GROUP BY ALL),
p AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 6 - phase END) AS current_phase, max(CASE WHEN o_orderstatus = 'O' THEN 6 - phase END) AS projected_phase,
  max(CASE WHEN o_orderstatus = 'P' THEN 6 - phase END) AS projected2_phase FROM w GROUP BY o_custkey)
SELECT *, projected_phase - current_phase AS delta FROM p WHERE current_phase IS NOT NULL OR projected_phase IS NOT NULL""")
def q_worst_phase(t: Tables) -> DataFrame:
    """Each customer's worst phase (urgent is 5) now (F) and as projected (O, P), and the change; rows with only the far projection go."""
    phase = F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")
    worst = lambda s: F.max(F.when(F.col("o_orderstatus") == s, phase))
    out = t.orders.groupBy("o_custkey").agg(worst("F").alias("current_phase"), worst("O").alias("projected_phase"), worst("P").alias("projected2_phase"))
    return out.where("current_phase is not null or projected_phase is not null").withColumn("delta", F.col("projected_phase") - F.col("current_phase"))


@query(f"""WITH m AS (SELECT max(ts) AS top FROM events), e AS (SELECT user_id, count(*) FILTER (ts >= top - INTERVAL 10 DAY) AS events_short, count(*) AS events_long,
  coalesce({summed('CASE WHEN ts >= top - INTERVAL 10 DAY THEN value END')}, 0) AS value_short FROM events, m WHERE event_type = 'error' AND ts >= top - INTERVAL 25 DAY GROUP BY user_id)
SELECT *, least(100.0::DOUBLE, {rounded('events_short / 20.0::DOUBLE * 100.0::DOUBLE', 1)}) AS intensity_score FROM e""")
def q_conflict_intensity(t: Tables) -> DataFrame:
    """Errors by user over a short and a long stretch before the last event, and a score of the short count that is capped at 100."""
    return conflict(t)


def conflict(t: Tables, kind: str = "error", baseline: float = 20.0) -> DataFrame:
    anchor = t.events.agg(F.max("ts").alias("top"))
    rows = t.events.where(F.col("event_type") == kind).crossJoin(F.broadcast(anchor)).where("ts >= top - interval 25 days")  # one row
    near = F.expr("ts >= top - interval 10 days")
    out = rows.groupBy("user_id").agg(F.count_if(near).alias("events_short"), F.count("*").alias("events_long"), F.coalesce(money(F.when(near, F.col("value"))), F.lit(0.0)).alias("value_short"))
    return out.withColumn("intensity_score", clamp(round_half_up(F.col("events_short") / baseline * 100.0, 1), high=100.0))


@query(f"""WITH {NATION_YEARS}, f AS (SELECT nation, CAST(min(year) AS INT) AS first_year, CAST(max(year) AS INT) AS last_year, arg_min(total, year) AS a, arg_max(total, year) AS b FROM nation_years GROUP BY nation)
SELECT nation, first_year, last_year, {rounded('(pow(b / a, 1.0::DOUBLE / (last_year - first_year)) - 1) * 100.0::DOUBLE', 2)} AS growth_pct FROM f WHERE last_year > first_year""")
def q_cagr(t: Tables) -> DataFrame:
    """Yearly growth of each nation's total from its first to its last year."""
    return change.growth_rate(nation_years(t), ["nation"], "year", "total")


@query("""SELECT o_custkey, CASE WHEN year(min(o_orderdate)) = year(max(o_orderdate)) THEN strftime(min(o_orderdate), '%b') || '–' || strftime(max(o_orderdate), '%b %Y')
  ELSE strftime(min(o_orderdate), '%b %Y') || ' – ' || strftime(max(o_orderdate), '%b %Y') END AS period FROM orders GROUP BY o_custkey""")
def q_period_label(t: Tables) -> DataFrame:
    """From when to when each customer has ordered, as a label."""
    from tillage.functions.dates import period_label

    ends = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return ends.select("o_custkey", period_label(F.col("a"), F.col("b")).alias("period"))
