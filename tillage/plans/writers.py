"""Tables that are written and read again: rules told by the write, and a document that its own reader takes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.numeric import money
from tillage.operators import health
from tillage.plans.registry import Tables, query, summed
from tillage.plans.views import NATION_YEARS, nation_years
from tillage.session import work_folder
from tillage.sources import landing, sinks


@query(f"""WITH c AS (SELECT o_custkey, count(*) AS n, {summed('o_totalprice')} AS total, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey)
SELECT 'at least 100 rows' AS "check", count(*) AS found, count(*) >= 100 AS passed FROM c
UNION ALL SELECT 'newest known in at least 50 rows', count(newest), count(newest) >= 50 FROM c
UNION ALL SELECT 'total within 0 and 1000000000', count(*) FILTER (total < 0 OR total > 1000000000), count(*) FILTER (total < 0 OR total > 1000000000) = 0 FROM c
UNION ALL SELECT 'no customer without orders', count(*) FILTER (n = 0), count(*) FILTER (n = 0) = 0 FROM c""")
def q_watched_write(t: Tables) -> DataFrame:
    """The report on each customer's totals that the one pass which wrote them gave."""
    rows = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), money("o_totalprice").alias("total"), F.max("o_orderdate").alias("newest"))
    rules = [health.rows_at_least(100), health.known_at_least("newest", 50), health.within("total", 0, 1_000_000_000), health.no_rows("no customer without orders", F.col("n") == 0)]
    return sinks.write_watched(rows, rules, f"{work_folder(t.spark, 'watched')}/totals")


@query(f"WITH {NATION_YEARS} SELECT nation || '-' || year AS key, nation, total FROM nation_years")
def q_envelope(t: Tables) -> DataFrame:
    """Yearly totals of nations out of one JSON document that holds them all."""
    rows = nation_years(t).select(F.concat_ws("-", "nation", F.col("year").cast("string")).alias("key"), "nation", "total")
    path = f"{work_folder(t.spark, 'envelope')}/totals.json"
    sinks.write_envelope(rows, path, "key", "orders", "totals by nation and year", datetime(2026, 5, 30))
    return landing.keyed_rows(landing.envelope(t.spark, path, "map<string, struct<nation:int, total:double>>"), "key")
