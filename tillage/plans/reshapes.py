"""Between wide, long and nested forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.numeric import money
from tillage.functions.text import trimmed_parts
from tillage.operators.latest import newest_of_wide
from tillage.operators.reshape import in_order, keyed, to_long, to_wide, year_columns
from tillage.plans.registry import Tables, query, summed
from tillage.plans.views import YEARLY, yearly

YEARS = range(1995, 2002)
_WIDE = ", ".join(f"{summed(f'CASE WHEN year(l_shipdate) = {y} THEN l_extendedprice END')} AS Y{y}" for y in YEARS)


def wide(t: Tables) -> DataFrame:
    """l_returnflag and a column for each year, Y1995 and so on."""
    rows = t.lineitem.select("l_returnflag", F.concat(F.lit("Y"), F.year("l_shipdate").cast("string")).alias("y"), "l_extendedprice")
    return to_wide(rows, ["l_returnflag"], "y", [f"Y{y}" for y in YEARS], money("l_extendedprice"))


@query(f"SELECT l_returnflag, {_WIDE} FROM lineitem GROUP BY l_returnflag")
def q_pivot(t: Tables) -> DataFrame:
    """Return flags by years."""
    return wide(t)


@query(f"WITH w AS (SELECT l_returnflag, {_WIDE} FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, CAST(substr(y, 2) AS INT) AS year, value FROM w UNPIVOT INCLUDE NULLS (value FOR y IN (COLUMNS(* EXCLUDE l_returnflag)))")
def q_unpivot(t: Tables) -> DataFrame:
    """Year columns, found by their heading, as rows; unknown years are kept."""
    df = wide(t)
    columns = year_columns(df, r"Y(\d{4})")
    return to_long(df, ["l_returnflag"], list(columns.values()), "y").select("l_returnflag", F.substring("y", 2, 4).cast("int").alias("year"), "value")


@query(f"""WITH {YEARLY}, g AS (SELECT o_custkey, year, total FROM yearly WHERE o_orderstatus = 'F') SELECT o_custkey, year, total AS value FROM g QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY year DESC) = 1""")
def q_newest_column(t: Tables) -> DataFrame:
    """The newest known of year columns, row by row."""
    df = to_wide(yearly(t).where("o_orderstatus = 'F'").withColumn("y", F.concat(F.lit("Y"), F.col("year").cast("string"))), ["o_custkey"], "y", [f"Y{y}" for y in YEARS], F.max("total"))
    columns = {y: F.col(c) for y, c in year_columns(df, r"Y(\d{4})").items()}
    return df.select("o_custkey", *newest_of_wide(columns))


@query("""SELECT p_brand, p_type, l_suppkey, count(*) AS claims FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount >= 0.1 GROUP BY ALL""")
def q_flatten(t: Tables) -> DataFrame:
    """Brands with an array of types, each with an array of suppliers, flattened twice."""
    pairs = t.lineitem.where("l_discount >= 0.1").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey").groupBy("p_brand", "p_type", "l_suppkey").agg(F.count("*").alias("claims"))
    types = pairs.groupBy("p_brand", "p_type").agg(in_order(F.col("l_suppkey"), "l_suppkey", "claims").alias("suppliers"))
    nested = types.groupBy("p_brand").agg(in_order(F.col("p_type"), "p_type", "suppliers").alias("types"))
    once = nested.select("p_brand", F.explode_outer("types").alias("t")).select("p_brand", "t.p_type", F.explode_outer("t.suppliers").alias("s"))
    return once.select("p_brand", "p_type", "s.l_suppkey", "s.claims")


@query(f"""WITH {YEARLY} SELECT o_custkey, 'year_' || year || '_' || lower(o_orderstatus) AS k, total AS v FROM yearly WHERE o_orderstatus <> 'F'""")
def q_dynamic_map(t: Tables) -> DataFrame:
    """Projections under keys that the data make, as a map and as its rows."""
    rows = yearly(t).where("o_orderstatus <> 'F'")
    key = F.concat(F.lit("year_"), F.col("year").cast("string"), F.lit("_"), F.lower("o_orderstatus"))
    maps = rows.groupBy("o_custkey").agg(keyed(key, F.col("total")).alias("projection"))
    return maps.select("o_custkey", F.explode("projection").alias("k", "v"))


@query("SELECT user_id, event_type AS k, count(*) AS v FROM events GROUP BY ALL")
def q_map_explode(t: Tables) -> DataFrame:
    """A map of counts by type, exploded."""
    counts = t.events.groupBy("user_id", "event_type").count()
    return counts.groupBy("user_id").agg(keyed(F.col("event_type"), F.col("count")).alias("m")).select("user_id", F.explode("m").alias("k", "v"))


@query("""SELECT p_partkey, unnest(string_split(p_name, ' ')) AS part, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part""")
def q_split_explode(t: Tables) -> DataFrame:
    """Names split at blanks, with each part's place."""
    return t.part.select("p_partkey", F.posexplode(trimmed_parts("p_name", " ")).alias("pos", "part")).select("p_partkey", "part", F.col("pos").cast("long").alias("pos"))
