"""Streams over the tables: windows that slide, and a keyed table that takes batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.plans.registry import Tables, query, rounded
from tillage.session import work_folder
from tillage.streaming import events
from tillage.streaming.keyed import KeyedTable


def _events(t: Tables) -> DataFrame:
    rows = events.table_stream(t.spark, t.folder, "events", t.events.schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # of a time without zone: in the session's


@query("""WITH e AS (SELECT DISTINCT ON (event_id) * FROM events), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS done FROM events)
SELECT CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM e, w
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= done GROUP BY ALL""")
def q_stream_daily(t: Tables) -> DataFrame:
    """Counts and totals by day, user and type from the events as a stream, for the days that the watermark has passed."""
    return events.finished(events.daily_counts(_events(t)), work_folder(t.spark, "stream-daily"))


@query(f"""WITH e AS (SELECT DISTINCT ON (event_id) * FROM events WHERE event_type = 'error'), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS done FROM e),
d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(value AS DECIMAL(12,2))) AS v FROM e GROUP BY ALL),
p AS (SELECT *, k, CAST(day + k * INTERVAL 1 DAY AS DATE) AS as_of FROM d, range(1, 26) r(k)),
s AS (SELECT as_of, user_id, CAST(sum(CASE WHEN k <= 10 THEN n ELSE 0 END) AS BIGINT) AS events_short, CAST(sum(n) AS BIGINT) AS events_long, coalesce(CAST(sum(v) FILTER (k <= 10) AS DOUBLE), 0) AS value_short
  FROM p, w WHERE as_of <= done GROUP BY ALL)
SELECT *, least(100.0::DOUBLE, {rounded('events_short / 20.0::DOUBLE * 100.0::DOUBLE', 1)}) AS intensity_score FROM s""")
def q_stream_intensity(t: Tables) -> DataFrame:
    """Each user's errors in the 10 and 25 days before every midnight that the watermark has passed, from state that slides."""
    return events.finished(events.sliding_intensity(_events(t)), work_folder(t.spark, "stream-intensity"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_totalprice DESC) = 1""")
def q_upserts(t: Tables) -> DataFrame:
    """Each customer's newest order in a keyed table that the orders were merged into, year by year."""
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice").where("o_custkey is not null")
    kept = KeyedTable(t.spark, work_folder(t.spark, "upserts"), ["o_custkey"], ["o_orderdate", "o_orderkey", "o_totalprice"], ", ".join(f"{c} {k}" for c, k in orders.dtypes), buckets=16)
    year = F.coalesce(F.year("o_orderdate"), F.lit(0))
    for number, r in enumerate(orders.select(year.alias("year")).distinct().sort("year").collect()):  # a row a year
        kept.merge(orders.where(year == r["year"]), number)
    return kept.current()
