"""Counts, shares, histograms, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.bands import RISK, risk_colour, risk_label
from tillage.functions.numeric import known, money, percent_of, round_half_up
from tillage.functions.text import in_language, url_host
from tillage.operators import scores, shares
from tillage.operators.ordering import numbered
from tillage.plans.registry import Tables, query, rounded, summed
from tillage.plans.views import PROFILES, PURCHASES, profiles, purchases

LABELS = [name for _, name in RISK]
#: SQL of functions.bands.risk_label.
LABEL_SQL = "CASE WHEN {0} <= 25 THEN 'Resilient' WHEN {0} <= 50 THEN 'Exposed' WHEN {0} <= 75 THEN 'Dependent' ELSE 'Structurally Vulnerable' END"
COLOUR_SQL = "CASE WHEN {0} <= 25 THEN '#6ba36b' WHEN {0} <= 50 THEN '#c9a957' WHEN {0} <= 75 THEN '#d27a3e' WHEN {0} <= 88 THEN '#c44b3c' ELSE '#7a2922' END"


def scored(t: Tables) -> DataFrame:
    """Customers with a score from 0 to 100 made of their balance."""
    return t.customer.withColumn("score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), round_half_up(F.col("c_acctbal") / 100.0))))


SCORED = f"scored AS (SELECT *, least(100.0::DOUBLE, greatest(0.0::DOUBLE, {rounded('c_acctbal / 100.0::DOUBLE')})) AS score FROM customer)"


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY user_id)
SELECT count(*) AS users, count(*) FILTER (e > 10) AS errors_flagged, count(*) FILTER (p > 10) AS purchases_flagged, count(*) FILTER (c > 10) AS clicks_flagged FROM u""")
def q_flag_counts(t: Tables) -> DataFrame:
    """How many users carry each flag."""
    of = lambda k: F.count_if(F.col("event_type") == k)
    per = t.events.groupBy("user_id").agg(of("error").alias("e"), of("purchase").alias("p"), of("click").alias("c"))
    return per.agg(F.count("*").alias("users"), F.count_if(F.col("e") > 10).alias("errors_flagged"), F.count_if(F.col("p") > 10).alias("purchases_flagged"), F.count_if(F.col("c") > 10).alias("clicks_flagged"))


@query("""SELECT event_type, count(*) AS fires, count(*) FILTER (value > 100) AS strong, count(*) > 2 * CASE event_type WHEN 'error' THEN 100 WHEN 'click' THEN 5000 ELSE 500 END AS fire_flag FROM events GROUP BY event_type""")
def q_fire_flag(t: Tables) -> DataFrame:
    """Counts by type against twice a baseline, which a table gives for some types and a default for the others."""
    base = t.literal([("error", 100), ("click", 5000)], "event_type string, baseline int")
    out = t.events.groupBy("event_type").agg(F.count("*").alias("fires"), F.count_if(F.col("value") > 100).alias("strong")).join(base, "event_type", "left")
    return out.select("event_type", "fires", "strong", (F.col("fires") > 2 * F.coalesce("baseline", F.lit(500))).alias("fire_flag"))


@query(f"""WITH m AS (SELECT user_id, {summed('value')} / count(*) AS mean, count(*) AS stations FROM events WHERE value >= 0 GROUP BY user_id)
SELECT user_id, {rounded('mean', 1)} AS latest, stations, mean > 35 AS flag FROM m""")
def q_station_mean(t: Tables) -> DataFrame:
    """Mean value by user, with how many there are and whether it is above 35."""
    out = t.events.where("value >= 0").groupBy("user_id").agg((money("value") / F.count("*")).alias("mean"), F.count("*").alias("stations"))
    return out.select("user_id", round_half_up("mean", 1).alias("latest"), "stations", (F.col("mean") > 35).alias("flag"))


_SHARES = f"""WITH {PURCHASES}, s AS (SELECT importer, commodity, supplier, {summed('value')} AS value FROM purchases WHERE value > 0 GROUP BY ALL),
r AS (SELECT *, {summed('value')} OVER (PARTITION BY importer, commodity) AS total, row_number() OVER (PARTITION BY importer, commodity ORDER BY value DESC, supplier) AS rank FROM s),
shares AS (SELECT importer, commodity, supplier, value, total, rank, {rounded('value / total * 100.0::DOUBLE', 1)} AS share_pct FROM r WHERE rank <= 5)"""
_SHARES = _SHARES.replace("CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) OVER (PARTITION BY importer, commodity)", "CAST(sum(CAST(value AS DECIMAL(28,2))) OVER (PARTITION BY importer, commodity) AS DOUBLE)")


@query(f"{_SHARES} SELECT * FROM shares")
def q_supplier_shares(t: Tables) -> DataFrame:
    """Five largest supplier nations of each nation and commodity, with their share."""
    return shares.partner_shares(purchases(t), ["importer", "commodity"], "supplier", "value")


@query(f"""{_SHARES}, h AS (SELECT importer, commodity, {rounded('CAST(sum(CAST(share_pct * share_pct / 100.0::DOUBLE AS DECIMAL(12,4))) AS DOUBLE)', 1)} AS hhi FROM shares GROUP BY ALL)
SELECT *, CASE WHEN hhi > 60 THEN 'High concentration risk' WHEN hhi > 30 THEN 'Moderate concentration' ELSE 'Well diversified' END AS tier FROM h""")
def q_hhi(t: Tables) -> DataFrame:
    """How concentrated each nation's suppliers of a commodity are."""
    return shares.concentration(shares.partner_shares(purchases(t), ["importer", "commodity"], "supplier", "value"), ["importer", "commodity"])


@query("""SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages WHERE url LIKE '%://%' GROUP BY host ORDER BY n DESC, min(page_id) LIMIT 1""")
def q_top_domain(t: Tables) -> DataFrame:
    """The host of most pages, of equal ones the first seen."""
    return shares.most_frequent(t.pages.withColumn("host", url_host("url")), [], "host", F.col("page_id"))


@query("""WITH c AS (SELECT p_brand, p_type, s_nationkey, l_discount FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT p_brand, count(DISTINCT s_nationkey) AS n_countries, count(DISTINCT p_type) AS n_commodities, count(*) AS n_claims, bool_or(l_discount >= 0.1) AS has_strong,
  CASE WHEN bool_or(l_discount >= 0.1) AND count(*) >= 5 THEN 'sourced' ELSE 'partial' END AS data_quality FROM c GROUP BY p_brand""")
def q_company_rollup(t: Tables) -> DataFrame:
    """Brands as companies: supplier nations, types, claims, and whether any claim is strong. Lines are counted by part and supplier before the joins."""
    lines = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.max("l_discount").alias("top"))
    joined = lines.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    out = joined.groupBy("p_brand").agg(F.count_distinct("s_nationkey").alias("n_countries"), F.count_distinct("p_type").alias("n_commodities"), F.sum("n").alias("n_claims"), (F.max("top") >= 0.1).alias("has_strong"))
    return out.withColumn("data_quality", F.when(F.col("has_strong") & (F.col("n_claims") >= 5), "sourced").otherwise("partial"))


@query(f"""WITH {SCORED}, b(ord, label) AS (VALUES (0, 'Resilient'), (1, 'Exposed'), (2, 'Dependent'), (3, 'Structurally Vulnerable')),
c AS (SELECT {LABEL_SQL.format('score')} AS label, count(*) AS n FROM scored WHERE score <= 75 GROUP BY ALL)
SELECT ord, label, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (label)""")
def q_band_hist(t: Tables) -> DataFrame:
    """Customers by risk band, the empty band too."""
    return shares.histogram(scored(t).where("score <= 75"), risk_label("score"), LABELS)


@query(f"""WITH {SCORED}, b(lo, hi, band) AS (VALUES (-1, 25, 'a'), (25, 50, 'b'), (50, 75, 'c'), (75, 100, 'd')) SELECT c_custkey, score, band FROM scored JOIN b ON score > lo AND score <= hi""")
def q_range_join(t: Tables) -> DataFrame:
    """Scores joined to a table of ranges, by the steps of 25 that the ranges span."""
    bands = t.literal([(-1, 25, "a"), (25, 50, "b"), (50, 75, "c"), (75, 100, "d")], "lo int, hi int, band string")
    steps = bands.withColumn("step", F.explode(F.expr("sequence(cast(ceil(lo / 25) as int), cast(ceil(hi / 25) as int))")))
    return scored(t).withColumn("step", F.expr("cast(ceil(score / 25) as int)")).join(F.broadcast(steps), "step").where("score > lo and score <= hi").select("c_custkey", "score", "band")  # a few rows


@query(f"""WITH {PROFILES} SELECT count(*) AS n, count(*) FILTER (iso NOT LIKE 'US-%' AND fdrs > 75) AS vulnerable, {rounded(summed('fdrs') + ' / count(*)')} AS mean_score, {rounded(summed('w') + ' / count(*)')} AS mean_wheat,
  count(*) FILTER (iso NOT LIKE 'US-%' AND fi > 30) AS high_inflation, count(*) FILTER (iso NOT LIKE 'US-%' AND f2030 > fdrs + 5) AS rising FROM profiles""")
def q_overlay_stats(t: Tables) -> DataFrame:
    """Counts and rounded means over all profiles."""
    return scores.stats(profiles(t))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
def q_top7(t: Tables) -> DataFrame:
    """The seven largest balances."""
    return t.customer.select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(7)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7")
def q_bottom7(t: Tables) -> DataFrame:
    """The seven smallest balances."""
    return t.customer.select("c_custkey", "c_name", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(7)


@query(f"WITH {PROFILES} SELECT row_number() OVER (ORDER BY fdrs DESC, name) AS rank, iso, name, fdrs, {LABEL_SQL.format('fdrs')} AS label, {COLOUR_SQL.format('fdrs')} AS colour FROM profiles")
def q_ranking(t: Tables) -> DataFrame:
    """Profiles ranked by score."""
    return scores.ranking(profiles(t))


@query(f"""WITH u AS (SELECT user_id, {summed('value')} AS total FROM events GROUP BY user_id) SELECT user_id, total, row_number() OVER (ORDER BY total DESC, user_id) AS rank FROM u WHERE total >= 3000 ORDER BY rank LIMIT 20""")
def q_threshold_rank(t: Tables) -> DataFrame:
    """Users over a threshold, the twenty largest ranked; only those twenty are numbered."""
    from pyspark.sql import Window

    top = t.events.groupBy("user_id").agg(money("value").alias("total")).where("total >= 3000").orderBy(F.desc("total"), "user_id").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "user_id")).cast("long"))


@query("""SELECT n_name, r_name, n_nationkey % 5 = 4 AS is_state, row_number() OVER (ORDER BY n_nationkey % 5 = 4, n_name COLLATE en, n_name) AS ord FROM nation JOIN region ON r_regionkey = n_regionkey""")
def q_name_sort(t: Tables) -> DataFrame:
    """Countries before states, each by name as people sort it; numbered over one row a nation."""
    from pyspark.sql import Window

    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", (F.col("n_nationkey") % 5 == 4).alias("is_state"))
    return rows.withColumn("ord", F.row_number().over(Window.orderBy("is_state", in_language("n_name"), "n_name")).cast("long"))


@query("""WITH w AS (SELECT coalesce(lang, '') AS lang, unnest(regexp_extract_all(coalesce(text, ''), '\\p{L}+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY word COLLATE en, word) AS ord FROM c""")
def q_word_sort(t: Tables) -> DataFrame:
    """The words of each language's documents in the order of a dictionary: accents and capitals tell only words apart that are spelled alike."""
    word = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    words = t.documents.select(F.coalesce("lang", F.lit("")).alias("lang"), word).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return numbered(words, [F.col("lang"), in_language("word"), F.col("word")], within=["lang"])


@query(f"""WITH g AS (SELECT l_suppkey, {summed('l_extendedprice')} AS total, {summed("CASE WHEN p_type = 'ECONOMY' THEN l_extendedprice END")} AS e, {summed("CASE WHEN p_type = 'PROMO' THEN l_extendedprice END")} AS p,
  {summed("CASE WHEN p_type = 'SMALL' THEN l_extendedprice END")} AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey)
SELECT l_suppkey, total, {rounded('coalesce(e, 0) / total * 100.0::DOUBLE', 2)} AS wheat_pct, {rounded('coalesce(p, 0) / total * 100.0::DOUBLE', 2)} AS rice_pct, {rounded('coalesce(s, 0) / total * 100.0::DOUBLE', 2)} AS maize_pct FROM g WHERE total > 0""")
def q_share_of_total(t: Tables) -> DataFrame:
    """Three types' part of each supplier's total."""
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_extendedprice").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return shares.parts_of_total(rows, ["l_suppkey"], "p_type", "l_extendedprice", {"ECONOMY": "wheat", "PROMO": "rice", "SMALL": "maize"})


@query(f"""WITH g AS (SELECT o_custkey, {summed("CASE WHEN o_orderstatus = 'F' THEN o_totalprice END")} AS f, {summed("CASE WHEN o_orderstatus = 'O' THEN o_totalprice END")} AS o FROM orders GROUP BY o_custkey),
x AS (SELECT o_custkey, CASE WHEN f > 0 THEN {rounded('(o - f) / f * 100.0::DOUBLE', 1)} END AS fx_change_pct, CASE WHEN o > 0 THEN {rounded('f / o * 100.0::DOUBLE', 1)} END AS inflation_pct FROM g)
SELECT *, coalesce(fx_change_pct < -10, false) AS fx_shock, coalesce(inflation_pct > 15, false) AS inflation_shock FROM x""")
def q_shock_flags(t: Tables) -> DataFrame:
    """Flags of a fall over 10 % and a share over 15 %; false where the input is missing."""
    side = lambda s: money(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    g = t.orders.groupBy("o_custkey").agg(side("F").alias("f"), side("O").alias("o"))
    fx = F.when(F.col("f") > 0, round_half_up((F.col("o") - F.col("f")) / F.col("f") * 100.0, 1))
    x = g.select("o_custkey", fx.alias("fx_change_pct"), round_half_up(percent_of("f", "o"), 1).alias("inflation_pct"))
    return x.withColumn("fx_shock", known(F.col("fx_change_pct") < -10)).withColumn("inflation_shock", known(F.col("inflation_pct") > 15))


@query(f"""WITH g AS (SELECT o_custkey, {summed('CASE WHEN year(o_orderdate) = 1995 THEN o_totalprice END')} AS hist, {summed('CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice END')} AS proj FROM orders GROUP BY o_custkey),
x AS (SELECT o_custkey, {rounded('hist / 1000.0::DOUBLE', 2)} AS hist, CASE WHEN hist <> 0 THEN {rounded('(proj - hist) / hist * 100.0::DOUBLE', 1)} END AS change_pct, {rounded('(proj - hist) / 1000.0::DOUBLE', 2)} AS change_abs FROM g)
SELECT * FROM x WHERE hist IS NOT NULL OR change_pct IS NOT NULL OR change_abs IS NOT NULL""")
def q_climate_delta(t: Tables) -> DataFrame:
    """A projected year against a historic one, in percent and absolute; customers with neither go."""
    of = lambda y: money(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    g = t.orders.groupBy("o_custkey").agg(of(1995).alias("h"), of(2000).alias("p"))
    change = F.when(F.col("h") != 0, round_half_up((F.col("p") - F.col("h")) / F.col("h") * 100.0, 1))
    out = g.select("o_custkey", round_half_up(F.col("h") / 1000.0, 2).alias("hist"), change.alias("change_pct"), round_half_up((F.col("p") - F.col("h")) / 1000.0, 2).alias("change_abs"))
    return out.na.drop(how="all", subset=["hist", "change_pct", "change_abs"])


@query(f"WITH {SCORED} SELECT c_custkey, score, {LABEL_SQL.format('score')} AS label, {COLOUR_SQL.format('score')} AS colour FROM scored")
def q_risk_band(t: Tables) -> DataFrame:
    """Customers' risk label and colour."""
    return scored(t).select("c_custkey", "score", risk_label("score").alias("label"), risk_colour("score").alias("colour"))
