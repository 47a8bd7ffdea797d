"""Views of the tables that several queries start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.numeric import money, round_half_up
from tillage.plans.registry import Tables, rounded, summed


def yearly(t: Tables) -> DataFrame:
    """o_custkey, o_orderstatus, year, total: a customer's orders by status and year."""
    return t.orders.groupBy("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("year")).agg(money("o_totalprice").alias("total"))


YEARLY = f"yearly AS (SELECT o_custkey, o_orderstatus, CAST(year(o_orderdate) AS INT) AS year, {summed('o_totalprice')} AS total FROM orders GROUP BY ALL)"


def monthly(t: Tables) -> DataFrame:
    """month, total of all orders."""
    return t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(money("o_totalprice").alias("total"))


MONTHLY = f"monthly AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {summed('o_totalprice')} AS total FROM orders GROUP BY ALL)"


def nation_years(t: Tables) -> DataFrame:
    """nation, year, total: orders summed by customer first, so that the join with customers is small."""
    per = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("part"))
    joined = per.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    return joined.groupBy("nation", "year").agg(F.sum("part").cast("double").alias("total"))


NATION_YEARS = f"nation_years AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INT) AS year, {summed('o_totalprice')} AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


def daily(t: Tables) -> DataFrame:
    """event_type, day, total."""
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(money("value").alias("total"))


DAILY = f"daily AS (SELECT event_type, CAST(ts AS DATE) AS day, {summed('value')} AS total FROM events GROUP BY ALL)"


def profiles(t: Tables) -> DataFrame:
    """A country profile for each nation, made up of its customers' and orders' counts.

    iso (every fifth a US state), name, region, c (six components from 0 to 100), fdrs, f2030, w, r, m, fi, net (millions).
    """
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    own = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice").cast("decimal(12,2)")))
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), status("F").alias("nf"), status("O").alias("no"), status("P").alias("np"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("nu"), own("F").alias("vf"), own("O").alias("vo"))
    each = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(per, "o_custkey", "left")
    counted = each.groupBy("c_nationkey").agg(F.count("*").alias("customers"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "nf", "no", "np", "nu")), *(F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in ("vf", "vo")))
    named = counted.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    part = lambda x, k: (x * k % 101).cast("double")
    c = [part(F.col(x), k) for x, k in (("n", 1), ("customers", 13), ("nf", 7), ("no", 11), ("np", 17), ("nu", 19))]
    out = named.withColumn("c", F.array(*c))
    weights = (0.30, 0.20, 0.15, 0.15, 0.10, 0.10)
    score = F.lit(0.0)
    for k, w in enumerate(weights):
        score = score + F.col("c")[k] * F.lit(w)
    out = out.withColumn("fdrs", round_half_up(score))
    key = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    iso = F.when(F.col("n_nationkey") % 5 == 4, F.concat(F.lit("US-"), key)).otherwise(F.concat(F.lit("N"), key))
    f2030 = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("fdrs") + F.col("customers") % 21 - 10))
    return out.select(
        iso.alias("iso"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), "c", "fdrs", f2030.alias("f2030"), part(F.col("nf"), 1).alias("w"), part(F.col("no"), 1).alias("r"),
        part(F.col("np"), 1).alias("m"), (F.col("nu") % 60).cast("double").alias("fi"), round_half_up((F.col("vf") - F.col("vo")) / 1000, 1).alias("net"),
    )


PROFILES = f"""counted AS (
  SELECT c_nationkey, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS nf, count(*) FILTER (o_orderstatus = 'O') AS no_,
    count(*) FILTER (o_orderstatus = 'P') AS np, count(*) FILTER (o_orderpriority = '1-URGENT') AS nu,
    coalesce({summed("CASE WHEN o_orderstatus = 'F' THEN o_totalprice END")}, 0) AS vf, coalesce({summed("CASE WHEN o_orderstatus = 'O' THEN o_totalprice END")}, 0) AS vo
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey),
parts AS (SELECT *, [CAST(n % 101 AS DOUBLE), CAST(customers * 13 % 101 AS DOUBLE), CAST(nf * 7 % 101 AS DOUBLE), CAST(no_ * 11 % 101 AS DOUBLE), CAST(np * 17 % 101 AS DOUBLE), CAST(nu * 19 % 101 AS DOUBLE)] AS c
  FROM counted JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
scored AS (SELECT *, {rounded("0.0::DOUBLE + c[1] * 0.30::DOUBLE + c[2] * 0.20::DOUBLE + c[3] * 0.15::DOUBLE + c[4] * 0.15::DOUBLE + c[5] * 0.10::DOUBLE + c[6] * 0.10::DOUBLE")} AS fdrs FROM parts),
profiles AS (SELECT CASE WHEN n_nationkey % 5 = 4 THEN 'US-' ELSE 'N' END || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso, n_name AS name, r_name AS region, c, fdrs,
  least(100.0::DOUBLE, greatest(0.0::DOUBLE, fdrs + customers % 21 - 10)) AS f2030, CAST(nf % 101 AS DOUBLE) AS w, CAST(no_ % 101 AS DOUBLE) AS r, CAST(np % 101 AS DOUBLE) AS m,
  CAST(nu % 60 AS DOUBLE) AS fi, {rounded("(vf - vo) / 1000", 1)} AS net FROM scored)"""


def purchases(t: Tables) -> DataFrame:
    """importer (nation of the customer), supplier (nation of the supplier), commodity (type of the part), value.

    Lines are joined to their orders once; suppliers, parts and customers are dimensions, which Spark broadcasts while they are small.
    """
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    importer = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("importer")), "o_custkey")
    joined = lines.join(importer, "l_orderkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("supplier")), "l_suppkey")
    return joined.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("commodity")), "l_partkey").select("importer", "supplier", "commodity", F.col("l_extendedprice").alias("value"))


PURCHASES = """purchases AS (SELECT c_nationkey AS importer, s_nationkey AS supplier, p_type AS commodity, l_extendedprice AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"""
