"""Joins, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.numeric import money, round_half_up
from tillage.operators import resolve, scores, trade
from tillage.operators.grams import names_inside
from tillage.operators.reshape import in_order, zipped
from tillage.plans.registry import Tables, query, rounded, summed
from tillage.plans.views import NATION_YEARS, PROFILES, PURCHASES, nation_years, profiles, purchases


@query("SELECT DISTINCT key FROM (SELECT o_custkey AS key FROM orders UNION SELECT user_id FROM events UNION SELECT s_suppkey FROM supplier)")
def q_key_universe(t: Tables) -> DataFrame:
    """All keys that any of three tables has."""
    parts = [t.orders.select(F.col("o_custkey").alias("key")), t.events.select(F.col("user_id").alias("key")), t.supplier.select(F.col("s_suppkey").alias("key"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("SELECT 'customer' AS origin, c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def q_union_all(t: Tables) -> DataFrame:
    """Two tables stacked, with where a row is from."""
    a = t.customer.select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey % 2 = 0")
def q_join_inner_dim(t: Tables) -> DataFrame:
    """Suppliers of the nations that a code table knows."""
    codes = t.nation.where("n_nationkey % 2 = 0")
    return t.supplier.join(codes, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("""WITH code AS (SELECT n_nationkey AS k, 'C' || n_nationkey AS iso3 FROM nation WHERE n_nationkey < 10), name AS (SELECT n_name AS n, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'N' || n_nationkey END AS iso3 FROM nation WHERE n_nationkey < 20)
SELECT n_nationkey, coalesce(code.iso3, name.iso3) AS iso3 FROM nation LEFT JOIN code ON k = n_nationkey LEFT JOIN name ON n = n_name WHERE coalesce(code.iso3, name.iso3) IS NOT NULL""")
def q_join_fallback(t: Tables) -> DataFrame:
    """A key by code, else by name; names with a null key are skipped."""
    code = t.nation.where("n_nationkey < 10").select("n_nationkey", F.concat(F.lit("C"), F.col("n_nationkey").cast("string")))
    name = t.nation.where("n_nationkey < 20").select(F.col("n_name").alias("lookup"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))))
    return resolve.two_step(t.nation, code, name, F.col("n_nationkey"), F.col("n_name")).select("n_nationkey", "iso3")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '2001-01-01')")
def q_join_semi(t: Tables) -> DataFrame:
    """Customers with a late urgent order."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT' and o_orderdate >= date'2001-01-01'")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '2001-01-01')")
def q_join_anti(t: Tables) -> DataFrame:
    """Customers without one."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT' and o_orderdate >= date'2001-01-01'")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def q_intersect(t: Tables) -> DataFrame:
    """Customers with both kinds of order."""
    of = lambda s: t.orders.where(F.col("o_orderstatus") == s).select("o_custkey")
    return of("F").intersect(of("P"))


_LAYERS = """layers AS (
  SELECT n_nationkey AS iso, f AS field, CAST(n_nationkey * 10 AS DOUBLE) AS value, 'legacy' AS layer, 0 AS rank FROM nation, (VALUES ('w'), ('r'), ('m'), ('net')) AS v(f) WHERE n_nationkey < 20
  UNION ALL SELECT n_nationkey, f, CAST(n_nationkey * 10 + 1 AS DOUBLE), 'override', CASE WHEN f = 'net' THEN CASE WHEN n_nationkey % 3 = 0 THEN -1 ELSE 1 END WHEN n_nationkey % 2 = 0 THEN -1 ELSE 1 END FROM nation, (VALUES ('w'), ('net')) AS v(f)
  UNION ALL SELECT n_nationkey, f, CAST(n_nationkey * 10 + 2 AS DOUBLE), 'shares', 2 FROM nation, (VALUES ('w'), ('r'), ('m')) AS v(f) WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 'net', CAST(n_nationkey * 10 + 3 AS DOUBLE), 'trade', 3 FROM nation WHERE n_nationkey % 3 = 0)"""


@query(f"""WITH {_LAYERS} SELECT iso, field, value, layer FROM layers WHERE iso < 20 QUALIFY row_number() OVER (PARTITION BY iso, field ORDER BY rank DESC) = 1""")
def q_overlay_merge(t: Tables) -> DataFrame:
    """Fields of four layers merged: old values, overrides, sourced shares, sourced trade; overrides don't hide what is sourced."""
    def layer(plus: int, names: str, where: str = "true") -> DataFrame:
        fields = F.explode(F.split(F.lit(names), ",")).alias("field")
        return t.nation.where(where).select(F.col("n_nationkey").alias("iso"), fields, (F.col("n_nationkey") * 10 + plus).cast("double").alias("value"))

    layers = [("legacy", layer(0, "w,r,m,net", "n_nationkey < 20")), ("override", layer(1, "w,net")), ("shares", layer(2, "w,r,m", "n_nationkey % 2 = 0")), ("trade", layer(3, "net", "n_nationkey % 3 = 0"))]
    return resolve.overlay(layers, ["iso", "field"], "value")


@query(f"""WITH {PROFILES}, a AS (SELECT unnest(c) AS a, generate_subscripts(c, 1) - 1 AS component FROM profiles WHERE iso = 'N01'), b AS (SELECT unnest(c) AS b, generate_subscripts(c, 1) - 1 AS component FROM profiles WHERE iso = 'N02')
SELECT component, a, b, b - a AS delta FROM a JOIN b USING (component)""")
def q_compare(t: Tables) -> DataFrame:
    """Two nations' components side by side."""
    return scores.compared(profiles(t), "N01", "N02")


@query("""WITH names AS (SELECT lower(n_name) AS n, n_nationkey AS key, n_nationkey AS ord FROM nation), needles AS (SELECT DISTINCT needle, lower(trim(needle)) AS s FROM (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'NATION_' || (s_nationkey % 25)
    WHEN s_suppkey % 4 = 1 THEN 'Alias ' || (s_nationkey % 5) WHEN s_suppkey % 4 = 2 THEN 'Republic of Nation_' || (s_nationkey % 10) ELSE 'zz' || s_suppkey END AS needle FROM supplier) WHERE s <> ''),
aliases AS (SELECT 'alias ' || k AS a, 'nation_' || (k + 20) AS n FROM range(0, 4) AS r(k)),
m AS (SELECT needle, 1 AS class, ord, n, key FROM needles JOIN names ON s = n UNION ALL SELECT needle, 2, ord, names.n, key FROM needles JOIN aliases ON s = a JOIN names ON names.n = aliases.n
  UNION ALL SELECT needle, 3, ord, n, key FROM needles JOIN names ON contains(s, n) OR contains(n, s))
SELECT needle, CASE class WHEN 1 THEN 'exact' WHEN 2 THEN 'alias' ELSE 'partial' END AS how, n AS name, key FROM m QUALIFY row_number() OVER (PARTITION BY needle ORDER BY class, ord) = 1""")
def q_fuzzy_match(t: Tables) -> DataFrame:
    """Supplier labels matched to nations: the same name, an alias, or one that holds the other."""
    nation = lambda by: (F.col("s_nationkey") % by).cast("string")
    kind = F.col("s_suppkey") % 4
    needle = F.when(kind == 0, F.concat(F.lit("NATION_"), nation(25))).when(kind == 1, F.concat(F.lit("Alias "), nation(5))).when(kind == 2, F.concat(F.lit("Republic of Nation_"), nation(10))).otherwise(F.concat(F.lit("zz"), F.col("s_suppkey").cast("string")))
    names = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.col("n_nationkey").alias("ord"))
    aliases = t.literal([(f"Alias {k}", f"NATION_{k + 20}") for k in range(4)], "alias string, name string")
    return resolve.closest_name(t.supplier.select(needle.alias("needle")), names, aliases)


@query("""WITH n AS (SELECT DISTINCT lower(w) AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region) WHERE w <> '')
SELECT DISTINCT doc_id, name FROM documents JOIN n ON contains(lower(text), name)""")
def q_names_in_texts(t: Tables) -> DataFrame:
    """Which names of parts, nations and regions, and words of part names, stand in each document, found by their rarest grams."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("name"))
    names = words.union(t.part.select("p_name")).union(t.nation.select("n_name")).union(t.region.select("r_name"))
    texts = t.documents.select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return names_inside(texts, names.select(F.lower("name").alias("name"))).withColumnRenamed("id", "doc_id")


@query("""WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS names, list(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END ORDER BY o_orderkey) AS w FROM orders GROUP BY o_custkey),
z AS (SELECT o_custkey, unnest(range(1, len(names) + 1)) AS pos, names, w[1:3] AS w FROM a)
SELECT o_custkey, pos, names[pos] AS name, coalesce(nullif(w[pos], 0), 20.0::DOUBLE) AS weight FROM z""")
def q_zip_arrays(t: Tables) -> DataFrame:
    """Two parallel arrays, the second shorter and with zeros, as one; what is missing weighs 20."""
    per = t.orders.groupBy("o_custkey").agg(in_order(F.col("o_orderkey"), "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("w")).alias("s"))
    arrays = per.select("o_custkey", F.col("s.o_orderkey").alias("names"), F.slice(F.col("s.w"), 1, 3).alias("w"))
    return arrays.select("o_custkey", F.explode(zipped(F.col("names"), F.col("w"), 20.0)).alias("z")).select("o_custkey", F.col("z.pos").cast("long").alias("pos"), "z.name", "z.weight")


@query("""WITH c AS (SELECT o_custkey, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS priority, o_orderkey, o_totalprice FROM orders)
SELECT o_custkey, priority, o_totalprice, o_orderkey FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY priority, o_totalprice DESC, o_orderkey DESC) = 1""")
def q_source_priority(t: Tables) -> DataFrame:
    """Observed before modelled before old: the best source of each customer."""
    status = F.col("o_orderstatus")
    rows = t.orders.withColumn("priority", F.when(status == "P", 1).when(status == "O", 2).otherwise(3))
    rows = rows.withColumn("p", F.col("priority"))
    return resolve.by_priority(rows, ["o_custkey"], "p", ["o_totalprice", "o_orderkey", "priority"]).select("o_custkey", "priority", "o_totalprice", "o_orderkey")


@query(f"""WITH {PURCHASES}, i AS (SELECT importer, supplier, {summed('value')} AS value FROM purchases GROUP BY ALL)
SELECT a.supplier AS exporter, a.importer AS partner, a.value AS mirror_value, b.value AS own_value, CASE WHEN b.value > 0 THEN {rounded('(a.value - b.value) / b.value * 100.0::DOUBLE', 1)} END AS gap_pct
FROM i a LEFT JOIN i b ON b.importer = a.supplier AND b.supplier = a.importer""")
def q_mirror_flow(t: Tables) -> DataFrame:
    """What partners import from each nation, beside what it imports from them."""
    return trade.mirrored(purchases(t).groupBy("importer", "supplier").agg(money("value").alias("value")))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS key FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')""")
def q_code_map(t: Tables) -> DataFrame:
    """Codes replaced by keys; rows of unknown codes go."""
    codes = t.literal([("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("5-LOW", "low")], "o_orderpriority string, key string")
    return t.orders.join(F.broadcast(codes), "o_orderpriority").select("o_orderkey", "key")  # four rows


@query("SELECT n_nationkey AS iso, n_name AS value, 'Test tables' AS source, 'copied' AS method, 'sourced' AS quality_flag FROM nation")
def q_provenance(t: Tables) -> DataFrame:
    """Values with where they are from."""
    return t.nation.select(F.col("n_nationkey").alias("iso"), F.col("n_name").alias("value"), F.lit("Test tables").alias("source"), F.lit("copied").alias("method"), F.lit("sourced").alias("quality_flag"))


@query(f"WITH {NATION_YEARS} SELECT n_name AS row, year AS col, total AS value FROM nation_years JOIN nation ON n_nationkey = nation")
def q_cube_decode(t: Tables) -> DataFrame:
    """A cube of nations and years, flattened to places and read back by them."""
    cells = nation_years(t)
    years = t.literal([(y, y - 1995) for y in range(1995, 2002)], "col int, col_pos int")
    flat = cells.select((F.col("nation") * 7 + F.col("year") - 1995).alias("pos"), F.col("total").alias("value"))
    rows = t.nation.select(F.col("n_name").alias("row"), F.col("n_nationkey").alias("row_pos"))
    return resolve.cube_cells(flat, rows, years).select("row", "col", "value")


@query(f"""WITH {NATION_YEARS}, l AS (SELECT nation, year, total, lag(total) OVER (PARTITION BY nation ORDER BY year) AS previous FROM nation_years)
SELECT *, CASE WHEN previous > 0 THEN {rounded('(total - previous) / previous * 100.0::DOUBLE', 2)} END AS change_pct FROM l""")
def q_every_change(t: Tables) -> DataFrame:
    """Each nation's year against the one before it."""
    from tillage.operators.change import every_change

    return every_change(nation_years(t), ["nation"], "year", "total")


@query(f"""WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders)
SELECT o_orderkey, {rounded('o_totalprice / top * 100.0::DOUBLE', 1)} AS of_top_pct FROM a""")
def q_share_of_max(t: Tables) -> DataFrame:
    """Each order as percent of its customer's largest; the maximum is grouped and joined, so a hot customer isn't one task's window."""
    top = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return t.orders.join(top, "o_custkey").select("o_orderkey", round_half_up(F.col("o_totalprice") / F.col("top") * 100.0, 1).alias("of_top_pct"))
