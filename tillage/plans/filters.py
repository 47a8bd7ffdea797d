"""Filters and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.bands import risk_label
from tillage.functions.parse import number
from tillage.functions.text import matches
from tillage.plans.registry import Tables, query
from tillage.plans.rollups import LABEL_SQL, SCORED, scored
from tillage.plans.views import PROFILES, profiles

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINES = ", ".join(_LINE)


@query(f"SELECT {_LINES} FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O'")
def q_filter_eq(t: Tables) -> DataFrame:
    """Two attributes equal to given values."""
    return t.lineitem.where("l_returnflag = 'A' and l_linestatus = 'O'").select(_LINE)


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_filter_in(t: Tables) -> DataFrame:
    """One of a set of values."""
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query(f"WITH f AS (SELECT {_LINES}, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END AS flag FROM lineitem) SELECT * FROM f WHERE coalesce(flag, '') NOT IN ('R', 'N')")
def q_filter_not_in(t: Tables) -> DataFrame:
    """None of a set of flags; rows without a flag are kept."""
    rows = t.lineitem.select(*_LINE, F.when(F.col("l_linenumber") != 1, F.col("l_returnflag")).alias("flag"))
    return rows.where(~F.coalesce("flag", F.lit("")).isin("R", "N"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 2) OR lower(trim(p_name)) IN ('red widget', 'small ring')")
def q_filter_or(t: Tables) -> DataFrame:
    """A code or a name of interest."""
    return t.part.where(F.col("p_size").isin(1, 2) | F.lower(F.trim("p_name")).isin("red widget", "small ring")).select("p_partkey", "p_name")


@query("WITH k AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'N' || chr(CAST(65 + n_nationkey AS INT)) || 'X' WHEN 1 THEN 'us' || n_nationkey WHEN 2 THEN 'U1A' ELSE '' END AS key FROM nation) SELECT * FROM k WHERE regexp_full_match(key, '[A-Z]{3}')")
def q_filter_regex(t: Tables) -> DataFrame:
    """Keys of three capital letters."""
    n = F.col("n_nationkey")
    key = F.when(n % 4 == 0, F.concat(F.lit("N"), F.char(65 + n), F.lit("X"))).when(n % 4 == 1, F.concat(F.lit("us"), n.cast("string"))).when(n % 4 == 2, "U1A").otherwise("")
    return t.nation.select("n_nationkey", key.alias("key")).where(F.col("key").rlike("^[A-Z]{3}$"))


@query(f"SELECT {_LINES} FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount > 0.05")
def q_filter_range(t: Tables) -> DataFrame:
    """Values within bounds; both reach the scan."""
    return t.lineitem.where(F.col("l_quantity").between(10, 12) & (F.col("l_discount") > 0.05)).select(_LINE)


@query(f"WITH {PROFILES} SELECT iso, name FROM profiles WHERE iso NOT LIKE 'US-%'")
def q_filter_prefix(t: Tables) -> DataFrame:
    """Keys without a prefix."""
    return profiles(t).where(~F.col("iso").startswith("US-")).select("iso", "name")


@query("""WITH x AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '..' WHEN 1 THEN 'NA' WHEN 2 THEN '' WHEN 3 THEN 'n/k' ELSE json_extract_string(props, '$.k') END AS x FROM events),
y AS (SELECT event_id, TRY_CAST(x AS DOUBLE) AS value FROM x WHERE x NOT IN ('', '..', 'NA')) SELECT event_id, value, CAST(trunc(value) AS BIGINT) AS whole FROM y WHERE value IS NOT NULL""")
def q_try_cast(t: Tables) -> DataFrame:
    """Numbers read from text; marks for missing ones and what is no number go."""
    k = F.col("event_id") % 7
    text = F.when(k == 0, "..").when(k == 1, "NA").when(k == 2, "").when(k == 3, "n/k").otherwise(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", number(text).alias("value")).where("value is not null").withColumn("whole", F.col("value").cast("bigint"))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a, event_id % 5 = 0 AS flag, CASE WHEN event_id % 4 = 0 THEN value END AS b FROM events)
SELECT * FROM x WHERE coalesce(a <> 0, false) OR flag OR coalesce(b <> 0, false)""")
def q_drop_empty(t: Tables) -> DataFrame:
    """Rows of which something is known; 0 and false say nothing."""
    k = F.col("event_id")
    x = t.events.select("event_id", F.when(k % 3 != 0, F.col("value")).alias("a"), (k % 5 == 0).alias("flag"), F.when(k % 4 == 0, F.col("value")).alias("b"))
    said = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    return x.where(said("a") | F.col("flag") | said("b"))


def dashboard(rows: DataFrame, region: str | None = None, label: str | None = None, commodity: str | None = None) -> DataFrame:
    """Profiles that pass the filters set: region, risk label, and at least 30 of wheat, rice or maize, or 40 of the fertiliser component."""
    least = {"wheat": F.col("w") >= 30, "rice": F.col("r") >= 30, "maize": F.col("m") >= 30, "fertilizer": F.col("c")[2] >= 40}
    for wanted, cond in ((region, F.col("region") == region), (label, risk_label("fdrs") == label), (commodity, least.get(commodity or ""))):
        rows = rows.where(cond) if wanted else rows
    return rows


@query(f"WITH {PROFILES} SELECT iso, name, fdrs FROM profiles WHERE region = 'ASIA' AND w >= 30")
def q_dashboard_filter(t: Tables) -> DataFrame:
    """Profiles of a region and commodity."""
    return dashboard(profiles(t), region="ASIA", commodity="wheat").select("iso", "name", "fdrs")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ed') ORDER BY p_partkey LIMIT 7")
def q_search_top7(t: Tables) -> DataFrame:
    """The first seven names that hold a text, in either case."""
    return t.part.where(matches("ED", "p_name")).select("p_partkey", "p_name").orderBy("p_partkey").limit(7)


@query(f"WITH {PROFILES} SELECT iso, name, region, fdrs, {LABEL_SQL.format('fdrs')} AS label FROM profiles WHERE contains(lower(concat_ws(' ', iso, name, region, CAST(CAST(fdrs AS INT) AS VARCHAR), {LABEL_SQL.format('fdrs')})), 'as')")
def q_table_search(t: Tables) -> DataFrame:
    """Rows that hold a text anywhere."""
    rows = profiles(t).select("iso", "name", "region", "fdrs", risk_label("fdrs").alias("label"))
    return rows.where(matches("as", "iso", "name", "region", F.col("fdrs").cast("int"), "label"))


@query(f"WITH {SCORED} SELECT c_custkey, score FROM scored WHERE score >= 25 ORDER BY score DESC, c_custkey LIMIT 40")
def q_threshold_top(t: Tables) -> DataFrame:
    """The forty largest scores of at least 25."""
    return scored(t).where("score >= 25").select("c_custkey", "score").orderBy(F.desc("score"), "c_custkey").limit(40)


