"""Text, JSON, array, date and geometry expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.bands import PHASES, phase_label
from tillage.functions.geo import great_circle, opacity, polygon_centroid
from tillage.functions.numeric import by_unit, first_truthy, round_half_up
from tillage.functions.text import first_link, severity, url_host
from tillage.operators.reshape import mean_of
from tillage.plans.registry import Tables, query, rounded
from tillage.plans.rollups import SCORED, scored
from tillage.sources import landing


@query("SELECT n_nationkey, 'US-' || substr(n_name, 8) AS key FROM nation")
def q_concat_key(t: Tables) -> DataFrame:
    """A prefix and part of a name as a key."""
    return t.nation.select("n_nationkey", F.concat(F.lit("US-"), F.expr("substring(n_name, 8)")).alias("key"))


@query("""SELECT o_orderkey, coalesce(nullif(o_orderkey % 3, 0), nullif(o_custkey % 2, 0), o_orderkey) AS value FROM orders""")
def q_coalesce(t: Tables) -> DataFrame:
    """The first of several fields that is neither null nor 0."""
    return t.orders.select("o_orderkey", first_truthy(F.col("o_orderkey") % 3, F.col("o_custkey") % 2, F.col("o_orderkey")).alias("value"))


@query("""SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding) - 1] AS DOUBLE) AS last_but_one, len(embedding[1:5]) AS five FROM embeddings""")
def q_array_pick(t: Tables) -> DataFrame:
    """The first and the last but one element, and a slice."""
    pick = lambda k: F.try_element_at("embedding", F.lit(k)).cast("double")
    return t.embeddings.select("vec_id", pick(1).alias("first"), pick(-2).alias("last_but_one"), F.size(F.slice("embedding", 1, 5)).cast("long").alias("five"))


@query(f"""SELECT vec_id, {rounded('list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: CAST(x AS DOUBLE))), lambda a, x: a + x) / len(embedding)', 6)} AS mean FROM embeddings""")
def q_array_mean(t: Tables) -> DataFrame:
    """The mean of each vector's elements."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", round_half_up(mean_of(doubles), 6).alias("mean"))


_WORDS = "CASE WHEN contains(lower(text), 'secret') OR contains(lower(text), 'password') THEN 'high' WHEN contains(lower(text), 'copyright') OR contains(lower(text), 'licens') THEN 'med' ELSE 'low' END"


@query(f"SELECT doc_id AS id, {_WORDS} AS grade FROM documents")
def q_severity(t: Tables) -> DataFrame:
    """Texts graded by the first list of words of which one occurs (words of these tables)."""
    grades = (("high", ("secret", "password")), ("med", ("copyright", "licens")))
    return t.documents.select(F.col("doc_id").alias("id"), severity("text", grades).alias("grade"))


@query("""SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(url, '/', 3) END AS host, replace(nullif(regexp_extract(html, '<a href="[^"]*"', 0), ''), '&amp;', '&') AS link FROM pages""")
def q_url_extract(t: Tables) -> DataFrame:
    """A url's host, and the first link of its page."""
    return t.pages.select("page_id", url_host("url").alias("host"), first_link("html", '<a href="[^"]*"').alias("link"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(t: Tables) -> DataFrame:
    """A field of a JSON text."""
    return t.events.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("""SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS field FROM events WHERE json_type(props) = 'OBJECT'""")
def q_json_fields(t: Tables) -> DataFrame:
    """Every field of a JSON text, parsed once into a variant."""
    return landing.fields(t.events.select("event_id", "props"), "props").select("event_id", "key", F.try_variant_get("field", "$", "string").alias("field"))


@query(f"""WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, round(o_totalprice / 100) AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year ORDER BY o_orderkey) = 1),
m AS (SELECT o_custkey, CASE WHEN o_custkey % 5 = 4 THEN arg_max(v, year) ELSE CAST(sum(CAST(v AS DECIMAL(20,0))) AS DOUBLE) / count(*) END AS mean FROM y GROUP BY o_custkey)
SELECT o_custkey, {rounded('mean', 3)} AS mean FROM m""")
def q_json_shapes(t: Tables) -> DataFrame:
    """Means over years of documents in five shapes, made of each customer's first order of every year: by year, by key and year, wrapped, records, and one value (the last)."""
    first = F.min_by(F.floor(F.col("o_totalprice") / 100 + 0.5).cast("double"), "o_orderkey").alias("v")
    years = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(first)
    listed = F.sort_array(F.collect_list(F.struct(F.col("year").cast("string").alias("k"), "v")))
    docs = years.groupBy("o_custkey").agg(F.map_from_entries(listed).alias("m"), F.transform(listed, lambda e: F.struct(e["k"].alias("year"), e["v"].alias("value"))).alias("r"), F.max_by("v", "year").alias("v"))
    shapes = [F.to_json("m"), F.to_json(F.create_map(F.lit("ABC"), F.col("m"))), F.to_json(F.struct(F.create_map(F.lit("ABC"), F.col("m")).alias("data"))), F.to_json(F.struct(F.col("r").alias("data"))), F.to_json(F.struct(F.col("v").alias("value")))]
    value = F.element_at(F.array(*shapes), F.pmod("o_custkey", F.lit(5)).cast("int") + 1)
    return landing.year_mean(docs.select("o_custkey", value.alias("value"))).select("o_custkey", round_half_up("mean", 3).alias("mean"))


@query("SELECT o_orderkey, " + "CASE " + " ".join(f"WHEN substr(o_orderpriority, 1, 1) = '{6 - k}' THEN '{v}'" for k, v in PHASES.items()) + " END AS phase FROM orders")
def q_phase_label(t: Tables) -> DataFrame:
    """Priorities as phases, the most urgent the highest, by name."""
    return t.orders.select("o_orderkey", phase_label(F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("phase"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN {rounded('l_extendedprice / 7', 0)} WHEN 'N' THEN {rounded('l_extendedprice / 7', 1)} ELSE {rounded('l_extendedprice / 7', 2)} END AS value FROM lineitem""")
def q_unit_round(t: Tables) -> DataFrame:
    """Rounded as a code's unit asks."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", by_unit(F.col("l_extendedprice") / 7, "l_returnflag", {"A": 0, "N": 1}).alias("value"))


@query(f"WITH {SCORED} SELECT c_custkey, {rounded('0.18::DOUBLE + pow(score / 100.0::DOUBLE, 0.85::DOUBLE) * 0.78::DOUBLE', 4)} AS opacity FROM scored")
def q_opacity(t: Tables) -> DataFrame:
    """How solid a score is drawn."""
    return scored(t).select("c_custkey", round_half_up(opacity("score"), 4).alias("opacity"))


_ENDS = "SELECT n_nationkey, radians(CAST(n_nationkey * 3 - 36 AS DOUBLE)) AS p1, radians(CAST(n_nationkey * 7 - 80 AS DOUBLE)) AS l1, radians(CAST(51 AS DOUBLE)) AS p2, radians(CAST(5 AS DOUBLE)) AS l2 FROM nation"


@query(f"""WITH e AS ({_ENDS}), a AS (SELECT *, 2.0::DOUBLE * asin(sqrt(least(sin((p2 - p1) / 2) * sin((p2 - p1) / 2) + cos(p1) * cos(p2) * sin((l2 - l1) / 2) * sin((l2 - l1) / 2), 1.0::DOUBLE))) AS arc FROM e),
s AS (SELECT *, CAST(k AS INT) AS step, sin((1 - k / 8.0::DOUBLE) * arc) / sin(arc) AS u, sin(k / 8.0::DOUBLE * arc) / sin(arc) AS v FROM a, range(0, 9) AS r(k)),
x AS (SELECT n_nationkey, step, u * cos(p1) * cos(l1) + v * cos(p2) * cos(l2) AS x, u * cos(p1) * sin(l1) + v * cos(p2) * sin(l2) AS y, u * sin(p1) + v * sin(p2) AS z FROM s)
SELECT n_nationkey, step, {rounded('degrees(atan2(z, sqrt(x * x + y * y)))', 3)} AS lat, {rounded('degrees(atan2(y, x))', 3)} AS lon FROM x""")
def q_great_circle(t: Tables) -> DataFrame:
    """Nine points on the great circle from each nation's place to one city."""
    n = F.col("n_nationkey").cast("double")
    path = great_circle(n * 3 - 36, n * 7 - 80, F.lit(51.0), F.lit(5.0), 8)
    return t.nation.select("n_nationkey", F.explode(path).alias("p")).select("n_nationkey", "p.step", round_half_up("p.lat", 3).alias("lat"), round_half_up("p.lon", 3).alias("lon"))


#: Each nation's rings: a four-cornered one that may cross the date line, and a hole in it, as (ring, point, lon, lat).
_RINGS = """r AS (SELECT n_nationkey, CAST(n_nationkey * 15 - 175 AS DOUBLE) AS lon, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS lat, CAST(8 + n_nationkey % 5 AS DOUBLE) AS w, CAST(4 + n_nationkey % 3 AS DOUBLE) AS h FROM nation),
p AS (SELECT n_nationkey, ring, k, radians(lon + (CASE WHEN k IN (1, 2) THEN w ELSE -w END) * s + (1 - s)) AS l, radians(lat + (CASE WHEN k >= 2 THEN h ELSE -h END) * s) AS b FROM r, (VALUES (0, 1.0::DOUBLE), (1, 0.25::DOUBLE)) q(ring, s), range(0, 4) t(k))"""


@query(f"""WITH {_RINGS}, u AS (SELECT *, cos(b) * cos(l) AS x, cos(b) * sin(l) AS y, sin(b) AS z FROM p),
e AS (SELECT a.n_nationkey, a.ring, a.k, a.y * o.z - a.z * o.y AS x, a.z * o.x - a.x * o.z AS y, a.x * o.y - a.y * o.x AS z, a.x * o.x + a.y * o.y + a.z * o.z AS d FROM u a JOIN u o ON o.n_nationkey = a.n_nationkey AND o.ring = a.ring AND o.k = (a.k + 1) % 4),
v AS (SELECT *, sqrt(x * x + y * y + z * z) AS m FROM e),
s AS (SELECT n_nationkey, sum((CASE WHEN ring = 0 THEN 1 ELSE -1 END) * x * atan2(m, d) / m) AS x, sum((CASE WHEN ring = 0 THEN 1 ELSE -1 END) * y * atan2(m, d) / m) AS y, sum((CASE WHEN ring = 0 THEN 1 ELSE -1 END) * z * atan2(m, d) / m) AS z FROM v GROUP BY n_nationkey)
SELECT n_nationkey, {rounded('degrees(atan2(z, sqrt(x * x + y * y)))', 3)} AS lat, {rounded('degrees(atan2(y, x))', 3)} AS lon FROM s""")
def q_centroid(t: Tables) -> DataFrame:
    """The middle of area of a polygon with a hole for each nation."""
    lon, lat = (F.col("n_nationkey") * 15 - 175).cast("double"), (F.col("n_nationkey") * 5 - 60).cast("double")
    w, h = (F.col("n_nationkey") % 5 + 8).cast("double"), (F.col("n_nationkey") % 3 + 4).cast("double")
    ring = lambda s: F.array(*(F.array(lon + w * (a * s) + (1 - s), lat + h * (b * s)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    at = polygon_centroid(F.array(F.array(ring(1.0), ring(0.25))))
    return t.nation.select("n_nationkey", at.alias("at")).select("n_nationkey", round_half_up("at.lat", 3).alias("lat"), round_half_up("at.lon", 3).alias("lon"))
