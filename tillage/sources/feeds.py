"""The feeds: raw rows in, one typed table each out.

Each function takes landed rows (see landing.py) and, where keys need translating, a code table (code, iso3); code tables are
data of their own and belong to one source each, as the same code means other countries elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.bands import phase_label
from tillage.functions.geo import polygon_centroid
from tillage.functions.dates import period_label
from tillage.functions.numeric import by_unit, clamp, first_truthy, known, percent_change, round_half_up
from tillage.functions.parse import country_key, integer, iso_date, month_start, month_token, number
from tillage.functions.text import severity
from tillage.operators import change, latest, resolve
from tillage.operators.reshape import in_order, keyed, year_columns
from tillage.operators.shares import partner_shares
from tillage.sources.landing import feature_properties, find_column, json_stat_cells, polygons, table_below, world_bank_rows, year_mean

# --- fixed values -----------------------------------------------------------------------------------------------------

#: Two-letter codes of the European statistics and their keys.
EUROPE = {
    "AT": "AUT", "BE": "BEL", "BG": "BGR", "CY": "CYP", "CZ": "CZE", "DE": "DEU", "DK": "DNK", "EE": "EST",
    "EL": "GRC", "ES": "ESP", "FI": "FIN", "FR": "FRA", "HR": "HRV", "HU": "HUN", "IE": "IRL", "IT": "ITA",
    "LT": "LTU", "LU": "LUX", "LV": "LVA", "MT": "MLT", "NL": "NLD", "PL": "POL", "PT": "PRT", "RO": "ROU",
    "SE": "SWE", "SI": "SVN", "SK": "SVK", "UK": "GBR", "NO": "NOR", "CH": "CHE", "IS": "ISL",
}
#: Items of the balance sheets, the element for calories, items and elements of the trade table, flags of missing values.
CALORIE_ITEMS, CALORIES = {2901: "total", 2511: "wheat", 2807: "rice", 2514: "maize"}, 664
TRADE_ITEMS, TRADE_NAMES = (1842, 1841), ("food, total", "agricultural products, total", "food", "agricultural products")
IMPORT_VALUE, EXPORT_VALUE, NO_VALUE = 5622, 5922, ("M", "-")
#: Commodity codes and attribute labels of the supply and distribution tables.
STAPLES = {"0410000": "wheat", "0422110": "rice", "0440000": "corn", "2222000": "soybeans", "410000": "wheat", "422110": "rice", "440000": "corn"}
ATTRIBUTES = {
    "production_kt": ("Production",),
    "imports_kt": ("MY Imports", "Imports", "Total Imports", "Imports for Domestic Consumption", "Imports - Calendar Year", "TY Imports"),
    "exports_kt": ("MY Exports", "Exports", "Total Exports", "Exports - Calendar Year", "TY Exports"),
    "consumption_kt": ("Domestic Consumption", "Total Consumption", "Domestic Use"),
    "stocks_kt": ("Ending Stocks",),
}
#: Commodity headings of the trade statistics.
HEADINGS = {"1001": "wheat", "1005": "corn", "1006": "rice", "1201": "soybeans", "1511": "palm_oil", "1701": "sugar", "0901": "coffee", "1801": "cocoa", "3102": "fertilizer", "0201": "beef"}
#: Fires a week that are usual where no baseline is known; particles above which air is flagged.
USUAL_FIRES, PARTICLES = 500, 35.0
#: Indicators of the outlook, of logistics and of governance, and prefixes of human development columns.
OUTLOOK = {
    "Crisis Affected Population (Number)": "crisis_pop", "Emergency Affected Population (Number)": "emergency_pop", "Prevalence of Food Crises (Rate)": "crisis_pct", "Prevalence of Food Emergencies (Rate)": "emergency_pct",
    "Prevalence of Severe Food Insecurity (%)": "severe_fi_pct", "Severely Food Insecure Population (Number)": "severe_fi_pop", "Short-Term Caloric Needs Financing (Thousands)": "financing_need_usd_k", "Short-Term Caloric Needs Financing Burden (Rate)": "financing_burden_pct",
}
LOGISTICS = {"LP.LPI.OVRL.XQ": "overall", "LP.LPI.CUST.XQ": "customs", "LP.LPI.INFR.XQ": "infrastructure", "LP.LPI.ITRN.XQ": "international_shipments", "LP.LPI.LOGS.XQ": "logistics_quality", "LP.LPI.TRAC.XQ": "tracking_tracing", "LP.LPI.TIME.XQ": "timeliness"}
GOVERNANCE = {"CC.EST": "control_corruption", "GE.EST": "gov_effectiveness", "PV.EST": "political_stability", "RQ.EST": "regulatory_quality", "RL.EST": "rule_of_law", "VA.EST": "voice_accountability"}
DEVELOPMENT = ("hdi", "le", "eys", "mys", "gnipc", "gii", "ihdi", "coi", "phdi")
#: Places of indicators that aren't rounded to two decimals.
PLACES = {"SP.POP.TOTL": 0, "NY.GDP.PCAP.CD": 1, "AG.CON.FERT.ZS": 1, "AG.YLD.CREL.KG": 1}
#: Headings of the humanitarian risk sheet.
RISK_SHEET = {
    "iso3": "^ISO3$", "inform_risk": "^INFORMRISK$", "country": "^COUNTRY$", "hazard_exposure": "^HAZARDANDEXPOSURE$", "vulnerability": "^VULNERABILITY$", "lack_coping_capacity": "^LACKOFCOPINGCAPACITY$", "rank": "^RANK$", "trend": "^(TREND$|INFORMTREND)",
}


def _mapped(column: Column, pairs: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def codes(spark, pairs: dict) -> DataFrame:
    """A code table of constants."""
    return spark.createDataFrame([(str(k), v) for k, v in pairs.items()], "code string, iso3 string")


# --- humanitarian -----------------------------------------------------------------------------------------------------


def hungermap(texts: DataFrame) -> DataFrame:
    """iso3, fcs_pct, fcs_people_total, ipc_phase3plus_pct, undernourishment_pct, alerts, country of a map document of any known shape."""
    get = lambda p, kind="string": F.try_variant_get("props", f"$.{p}", kind)
    rows = feature_properties(texts).select(country_key(F.coalesce("key", F.nullif(get("iso3"), F.lit("")), get("adm0_code"))).alias("iso3"), "props").where("iso3 is not null")
    return rows.select(
        "iso3", round_half_up(get("fcs").try_cast("double") * 100, 2).alias("fcs_pct"), integer(get("fcs_people_total")).alias("fcs_people_total"),
        round_half_up(first_truthy(number(get("ipcPopulation")), number(get("ipc_phase3plus"))), 2).alias("ipc_phase3plus_pct"), round_half_up(number(get("undernourishment")), 2).alias("undernourishment_pct"),
        F.coalesce(get("alerts", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("alerts"), F.coalesce(get("adm0_name"), get("name")).alias("country"),
    )


def places(texts: DataFrame) -> DataFrame:
    """name, lat, lon: the middle of area of each feature of a map document, to four decimals; features without a name or area's place go."""
    name = F.coalesce(*(F.try_variant_get("props", f"$.{k}", "string") for k in ("name", "NAME", "ADMIN", "admin")))
    found = feature_properties(texts).select(name.alias("name"), polygon_centroid(polygons("geometry")).alias("at")).where("name is not null and at is not null")
    return found.select("name", round_half_up("at.lat", 4).alias("lat"), round_half_up("at.lon", 4).alias("lon"))


def hungermap_country(texts: DataFrame) -> DataFrame:
    """iso3, fx and inflation figures with their shock flags, wasting and stunting, of one document a country (iso3, value); rows that say nothing go."""
    doc = texts.select("iso3", F.coalesce(F.get_json_object("value", "$.body"), F.col("value")).alias("d"))
    points = lambda p: F.filter(F.from_json(F.get_json_object("d", p), "array<struct<x:string, y:double>>"), lambda e: e["y"].isNotNull())
    fx = F.array_sort(points("$.currencyExchangeGraph.data"))
    last = lambda p: round_half_up(F.try_element_at(F.transform(points(p), lambda e: e["y"]), F.lit(-1)), 2)
    rows = doc.select(
        "iso3", F.get_json_object("d", "$.currencyExchangeGraph.name").alias("fx_currency"), F.transform(fx, lambda e: e["y"]).alias("fx"),
        last("$.inflationGraphs.food.data").alias("food_inflation_pct"), last("$.inflationGraphs.headline.data").alias("headline_inflation_pct"),
        round_half_up(number(F.get_json_object("d", "$.nutrition.wasting")), 2).alias("wasting_pct"), round_half_up(number(F.get_json_object("d", "$.nutrition.stunting")), 2).alias("stunting_pct"),
    )
    end, back = F.try_element_at("fx", F.lit(-1)), F.try_element_at("fx", -F.least(F.size("fx"), F.lit(90)))
    enough = F.size("fx") > 0
    change_pct = F.when(enough, round_half_up(percent_change(end, back, above=None), 1))
    out = rows.select(
        "iso3", "fx_currency", F.when(enough, round_half_up(end, 4)).alias("fx_latest"), change_pct.alias("fx_90d_change_pct"), known(change_pct < -10).alias("fx_currency_shock"), "food_inflation_pct", "headline_inflation_pct",
        known(F.col("food_inflation_pct") > 15).alias("inflation_shock"), "wasting_pct", "stunting_pct",
    )
    said = F.col("fx_currency").isNotNull() | F.col("fx_currency_shock") | F.col("inflation_shock")
    for c in ("fx_latest", "fx_90d_change_pct", "food_inflation_pct", "headline_inflation_pct", "wasting_pct", "stunting_pct"):
        said = said | F.coalesce(F.col(c) != 0, F.lit(False))
    return out.where(said)


def ipc(mirror: DataFrame, official: DataFrame) -> DataFrame:
    """iso3, phase figures, period, analysis_date, analysis_year, country, source_via: the mirror's rows where it has any, else the official ones, the newest year first.

    mirror and official: rows of text columns as delivered; official has year_asked.
    """
    first = lambda df, *names: F.coalesce(*(F.nullif(F.nullif(F.col(n), F.lit("")), F.lit("0")) for n in names if n in df.columns), F.lit(None).cast("string"))

    def rows(df: DataFrame, via: str, key: tuple, pct: tuple, count: tuple, four: tuple, five: tuple, period: tuple, year: Column) -> DataFrame:
        return df.select(
            country_key(first(df, *key)).alias("iso3"), round_half_up(number(first(df, *pct)), 2).alias("phase3plus_pct"), integer(first(df, *count)).alias("phase3plus_count"), integer(first(df, *four)).alias("phase4_count"),
            integer(first(df, *five)).alias("phase5_count"), first(df, *period).alias("period"), first(df, "date_of_analysis").alias("analysis_date"), year.cast("int").alias("analysis_year"),
            first(df, "adm0_name", "country_name").alias("country"), F.lit(via).alias("source_via"),
        ).where("iso3 is not null")

    a = rows(mirror, "hungermap", ("iso3", "adm0_code"), ("ipc_percent", "phase3plus_percentage"), ("ipc_population_affected", "phase3plus_population"), ("phase_4_plus_population",), ("phase_5_population",), ("analysis_period", "period"), F.lit(None))
    b = rows(official, "ipcinfo", ("country", "iso3"), ("phase3plus_percentage", "p3_plus_pct"), ("phase3plus_population",), ("phase4_population",), ("phase5_population", "famine_population"), ("period_dates", "period"), F.col("year_asked"))
    take = [c for c in a.columns if c != "iso3"]
    newest = latest.latest(b, ["iso3"], [F.col("analysis_year")], take)
    any_mirror = a.agg((F.count("*") > 0).alias("has__"))
    return a.unionByName(newest.crossJoin(F.broadcast(any_mirror)).where("not has__").drop("has__"))  # one row


def conflict(events: DataFrame, today: Column, baseline: float = 500.0) -> DataFrame:
    """iso3, events_last_30d, events_last_90d, fatalities_last_30d, intensity_score of events(iso3, event_date, fatalities) of the last 90 days."""
    day = iso_date("event_date")
    rows = events.select(F.upper("iso3").alias("iso3"), day.alias("day"), integer("fatalities").alias("f")).where("iso3 <> ''").where(F.col("day") >= F.date_sub(today, 90))
    near = F.col("day") >= F.date_sub(today, 30)
    out = rows.groupBy("iso3").agg(F.count_if(near).alias("events_last_30d"), F.count("*").alias("events_last_90d"), F.coalesce(F.sum(F.when(near, F.col("f"))), F.lit(0)).alias("fatalities_last_30d"))
    return out.withColumn("intensity_score", clamp(round_half_up(F.col("events_last_30d") / baseline * 100.0, 1), high=100.0))


def reports(items: DataFrame) -> DataFrame:
    """title, iso3, country, date, url, severity of items(fields struct): the primary country, else the first listed."""
    f = F.col("fields")
    iso = F.coalesce(F.when(f["primary_country"].isNotNull(), f["primary_country"]["iso3"]), F.get(f["country"], F.lit(0))["iso3"])
    title = F.coalesce(f["title"], F.lit(""))
    return items.select(title.alias("title"), F.nullif(F.upper(iso), F.lit("")).alias("iso3"), f["primary_country"]["name"].alias("country"), f["date"]["original"].alias("date"), f["url_alias"].alias("url"), severity(title).alias("severity"))


def outlook_phases(rows: DataFrame, today: Column) -> DataFrame:
    """iso3 with the worst phase now and as projected, labels, periods, delta, report_url, as_of, of rows(iso3, slug, scenario, ipc_phase, value, start_date, end_date, period_date, ord).

    Of equal phases the first counts. Countries with neither a current nor a near projected phase go.
    """
    phase = F.coalesce(integer(F.nullif(F.col("ipc_phase"), F.lit("0"))), integer("value")).cast("int")
    kept = rows.withColumn("phase", phase).where(F.col("phase").between(1, 5))
    start, end = (F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in (a, "period_date"))) for a in ("start_date", "end_date"))
    kept = kept.withColumn("label", period_label(iso_date(start), iso_date(end)))
    names = {"CS": "current", "ML1": "projected", "ML2": "projected2"}
    worst = [F.max_by(F.when(F.col("scenario") == s, F.struct("phase", "label")), F.when(F.col("scenario") == s, F.struct("phase", -F.col("ord")))).alias(n) for s, n in names.items()]
    out = kept.groupBy("iso3").agg(F.first("slug", True).alias("slug"), *worst).where("current is not null or projected is not null")
    columns = [c for n in names.values() for c in (F.col(f"{n}.phase").alias(f"{n}_phase"), phase_label(f"{n}.phase").alias(f"{n}_phase_label"), F.col(f"{n}.label").alias(f"{n}_period"))]
    return out.select("iso3", *columns, (F.col("projected.phase") - F.col("current.phase")).alias("delta"), F.concat(F.lit("https://fews.net/"), F.coalesce("slug", F.lit(""))).alias("report_url"), today.alias("as_of"))


def outlook_series(rows: DataFrame) -> DataFrame:
    """iso3, indicator, label, unit, series (by year, baseline projections first), latest actual year, value, flag and type, of text rows(iso3c, country, indicator_short, unit, year, value, flag, type)."""
    r = rows.select(country_key("iso3c").alias("iso3"), "country", _mapped(F.col("indicator_short"), OUTLOOK).alias("indicator"), F.col("indicator_short").alias("label"), "unit", integer("year").cast("int").alias("year"), number("value").alias("value"), "flag", "type")
    r = r.where("iso3 is not null and indicator is not null and year is not null and value is not null")
    actual = F.col("type").isin("Actual", "Preliminary model estimate")
    order = F.struct("year", F.when(F.col("type") == "Baseline projection", 0).otherwise(1).alias("k"), "type", "value")
    newest = F.max_by(F.when(actual, F.struct("year", "value", "flag", "type")), F.when(actual, F.struct("year", F.col("value")))).alias("last")
    out = r.groupBy("iso3", "indicator").agg(F.first("country", True).alias("country"), F.first("label", True).alias("label"), F.first("unit", True).alias("unit"), in_order(order, "year", "value", "flag", "type").alias("series"), newest)
    return out.select("iso3", "indicator", "country", "label", "unit", "series", F.col("last.year").alias("latest_year"), F.col("last.value").alias("latest_value"), F.col("last.flag").alias("latest_flag"), F.col("last.type").alias("latest_type"))


def outlook_projections(series: DataFrame) -> DataFrame:
    """iso3, projection: a map with a key for each projected year of the crisis population."""
    points = series.where("indicator = 'crisis_pop'").select("iso3", F.explode("series").alias("p")).where("p.type in ('Baseline projection', 'Downside projection')")
    key = F.concat(F.lit("year_"), F.col("p.year").cast("string"), F.lit("_"), F.lower(F.split_part("p.type", F.lit(" "), F.lit(1))), F.lit("_crisis_pop"))
    one = points.select("iso3", key.alias("k"), "p.value").groupBy("iso3", "k").agg(F.max("value").alias("v"))
    return one.groupBy("iso3").agg(keyed(F.col("k"), F.col("v")).alias("projection"))


# --- prices -----------------------------------------------------------------------------------------------------------


def food_price_index(cells: DataFrame) -> DataFrame:
    """month, at, fpi, meat, dairy, cereals, oils, sugar of positional cells; rows without a month or a number go. The last 24 months stay."""
    names = ("fpi", "meat", "dairy", "cereals", "oils", "sugar")
    rows = cells.select(F.trim("_c0").alias("month"), month_start("_c0").alias("at"), *(round_half_up(number(f"_c{k}"), 2).alias(n) for k, n in enumerate(names, 1))).where("fpi is not null and at is not null")
    return rows.orderBy(F.desc("at")).limit(24)


def freshest(candidates: DataFrame) -> DataFrame:
    """Rows of the candidate (source, priority, at, ...) whose last point is newest; of equal ones the one of smallest priority."""
    best = candidates.groupBy("source", "priority").agg(F.max("at").alias("last")).agg(F.max_by("source", F.struct("last", -F.col("priority"))).alias("best__"))
    return candidates.crossJoin(F.broadcast(best)).where("source = best__").drop("best__")  # one row


def month_change(series: DataFrame, value: str = "fpi") -> DataFrame:
    """One row: at, latest, previous, change_mom_pct of a monthly series."""
    one = change.last_change(series.withColumn("all__", F.lit(1)), ["all__"], "at", value, above=None)
    return one.drop("all__").withColumnRenamed("change_pct", "change_mom_pct")


def commodity_prices(cells: DataFrame, series: dict[str, str]) -> DataFrame:
    """key, label, unit, source_code, latest_month, latest_value, previous_value, change_mom_pct, history (60 points) of a price sheet's cells(row, col, value).

    Row 5 has the labels, row 6 the units, row 7 the codes; data follow with the month in the first column. series: our key -> code.
    """
    of = lambda n, name: cells.where(F.col("row") == n).select("col", F.trim("value").alias(name))
    heads = of(7, "source_code").join(of(5, "label"), "col", "left").join(of(6, "unit"), "col", "left").withColumn("key", _mapped(F.col("source_code"), {v: k for k, v in series.items()})).where("key is not null")
    months = cells.where("row > 7 and col = 0").select("row", month_token("value").alias("month")).where("month is not null")
    points = cells.where("row > 7").select("row", "col", number("value").alias("v")).where("v is not null").join(months, "row").join(F.broadcast(heads), "col")  # a column a series
    kept = latest.last_n(points, ["key"], [F.col("month")], 60)
    rank = lambda k, c: F.max(F.when(F.col("rn") == k, F.col(c)))
    out = kept.groupBy("key", "label", "unit", "source_code").agg(rank(1, "month").alias("latest_month"), rank(1, "v").alias("a"), rank(2, "v").alias("b"), in_order(F.col("month"), "month", round_half_up("v", 3).alias("value")).alias("history"))
    return out.select("key", "label", "unit", "source_code", "latest_month", round_half_up("a", 3).alias("latest_value"), round_half_up("b", 3).alias("previous_value"), round_half_up(percent_change("a", "b", above=None), 2).alias("change_mom_pct"), "history")


def european_inflation(texts: DataFrame, threshold: float = 8.0) -> DataFrame:
    """iso3, food_hicp_yoy_pct, month, country, inflation_shock: the newest known cell of each country of a cube."""
    cells, geo, time = json_stat_cells(texts)
    table = resolve.cube_cells(cells, geo.select("row", "row_pos"), time).where("value is not null").join(time, "col")
    newest = latest.latest(table, ["row"], [F.col("col_pos")], ["col", "value"])
    out = newest.join(codes(texts.sparkSession, EUROPE), F.col("row") == F.col("code")).join(geo.select(F.col("row").alias("code"), "label"), "code")
    return out.select("iso3", round_half_up("value", 2).alias("food_hicp_yoy_pct"), F.col("col").alias("month"), F.coalesce("label", "iso3").alias("country"), (F.col("value") > threshold).alias("inflation_shock"))


def world_inflation(rows: DataFrame, areas: DataFrame, threshold: float = 15.0) -> DataFrame:
    """iso3, food_cpi_index_latest, food_cpi_yoy_pct, year_latest, country, inflation_shock of text rows(Area Code, Area, Year, Value, ord)."""
    r = rows.select(integer("Area Code").cast("string").alias("code"), F.col("Area").alias("country"), integer("Year").alias("year"), number("Value").alias("v"), "ord").where("year is not null and v is not null").join(areas, "code")
    per = latest.latest(r, ["iso3", "year"], [F.col("ord")], ["v", "country"])
    last = change.last_change(per, ["iso3"], "year", "v")
    names = latest.latest(r, ["iso3"], [F.col("ord")], ["country"])
    return last.join(names, "iso3").select("iso3", round_half_up("latest", 1).alias("food_cpi_index_latest"), F.col("change_pct").alias("food_cpi_yoy_pct"), F.col("at").cast("int").alias("year_latest"), "country", known(F.col("change_pct") > threshold).alias("inflation_shock"))


# --- supply and trade -------------------------------------------------------------------------------------------------


def _resolved(rows: DataFrame, first: DataFrame, second: DataFrame, a: Column, b: Column) -> DataFrame:
    return resolve.two_step(rows, first.select("code", "iso3"), second.select("code", "iso3"), a, b)


def caloric_shares(rows: DataFrame, areas: DataFrame, names: DataFrame) -> DataFrame:
    """iso3, wheat_pct, rice_pct, maize_pct, kcal columns, year, country, of wide rows (Area Code, Area, Item Code, Element Code, Y2010, ...).

    Each item keeps its own newest year that is above 0; the year shown is the total's. Countries by name, else by area code.
    """
    years = {y: F.when(number(c) > 0, number(c)) for y, c in year_columns(rows, r"Y(\d{4})").items()}
    item = _mapped(integer("Item Code").cast("string"), {str(k): v for k, v in CALORIE_ITEMS.items()})
    kept = rows.where(integer("Element Code") == CALORIES).withColumn("item", item).where("item is not null")
    kept = _resolved(kept, names, areas, F.trim("Area"), integer("Area Code").cast("string"))
    flat = kept.select("iso3", "item", F.trim("Area").alias("country"), *latest.newest_of_wide(years)).where("value is not null")
    pick = lambda i, c: F.max_by(F.when(F.col("item") == i, F.col(c)), F.when(F.col("item") == i, F.col("year")))
    out = flat.groupBy("iso3").agg(F.min("country").alias("country"), pick("total", "value").alias("total"), pick("total", "year").alias("year"), *(F.coalesce(pick(i, "value"), F.lit(0.0)).alias(i) for i in ("wheat", "rice", "maize")))
    out = out.where("total > 0")
    share = [round_half_up(F.col(i) / F.col("total") * 100.0, 2).alias(f"{i}_pct") for i in ("wheat", "rice", "maize")]
    return out.select("iso3", *share, round_half_up("total", 1).alias("total_kcal_per_day"), *(round_half_up(i, 1).alias(f"{i}_kcal") for i in ("wheat", "rice", "maize")), "year", "country", F.lit("sourced").alias("quality_flag"))


def net_food_trade(rows: DataFrame, areas: DataFrame, names: DataFrame) -> DataFrame:
    """iso3, value, exports_musd, imports_musd, year, item_used, country of long rows: export less import value, food before all farm goods, of the newest year that has both.

    Headings differ between releases and are looked up; a missing one that is needed gives no rows.
    """
    col = {k: find_column(rows, *n) for k, n in {"item": ("Item Code",), "element": ("Element Code",), "year": ("Year",), "value": ("Value",), "area": ("Area", "Country"), "code": ("Area Code",), "flag": ("Flag",), "name": ("Item", "Commodity")}.items()}
    out = "iso3 string, value double, exports_musd double, imports_musd double, year int, item_used int, country string"
    if not all(col[k] for k in ("item", "element", "year", "value", "area")):
        return rows.sparkSession.createDataFrame([], out)
    text = lambda k: F.trim(F.col(f"`{col[k]}`")) if col[k] else F.lit(None).cast("string")
    r = rows.select(integer(text("item")).alias("item"), F.lower(text("name")).alias("name"), integer(text("element")).alias("element"), F.coalesce(text("flag"), F.lit("")).alias("flag"), integer(text("year")).cast("int").alias("year"), number(text("value")).alias("v"), text("area").alias("country"), integer(text("code")).cast("string").alias("acode"))
    r = r.where(F.col("item").isin(*TRADE_ITEMS) | F.col("name").isin(*TRADE_NAMES)).where(F.col("element").isin(IMPORT_VALUE, EXPORT_VALUE) & ~F.col("flag").isin(*NO_VALUE) & F.col("year").isNotNull() & F.col("v").isNotNull())
    r = _resolved(r, names, areas, F.col("country"), F.col("acode"))
    preference = F.when(F.col("item") == TRADE_ITEMS[0], 0).when(F.col("item") == TRADE_ITEMS[1], 1)
    sides = r.withColumn("preference", preference).where("preference is not null").groupBy("iso3", "preference", "year").agg(F.max(F.when(F.col("element") == EXPORT_VALUE, F.col("v"))).alias("e"), F.max(F.when(F.col("element") == IMPORT_VALUE, F.col("v"))).alias("i"))
    best = latest.latest_with_both(sides, ["iso3"], "preference", "year", "e", "i").join(r.groupBy("iso3").agg(F.min("country").alias("country")), "iso3")
    musd = lambda x: round_half_up(x / 1000.0, 1)
    return best.select("iso3", musd(F.col("e") - F.col("i")).alias("value"), musd(F.col("e")).alias("exports_musd"), musd(F.col("i")).alias("imports_musd"), "year", F.when(F.col("preference") == 0, TRADE_ITEMS[0]).otherwise(TRADE_ITEMS[1]).alias("item_used"), "country")


def staple_supply(rows: DataFrame, fas: DataFrame, names: DataFrame) -> DataFrame:
    """iso3, staple, production_kt, imports_kt, exports_kt, consumption_kt, stocks_kt, a year for each, year, country, of text rows(Commodity_Code, Country_Code, Country_Name, Market_Year, Attribute_Description, Value, ord).

    Each attribute keeps its newest year, of equal ones the first row. Countries by code, else by name.
    """
    label = {x: k for k, xs in ATTRIBUTES.items() for x in xs}
    r = rows.select(_mapped(F.trim("Commodity_Code"), STAPLES).alias("staple"), _mapped(F.trim("Attribute_Description"), label).alias("attribute"), F.trim("Country_Code").alias("fas"), F.trim("Country_Name").alias("country"), integer("Market_Year").cast("int").alias("year"), number("Value").alias("v"), "ord")
    r = _resolved(r.where("staple is not null and attribute is not null and year is not null and v is not null"), fas, names, F.col("fas"), F.col("country"))
    mine = lambda a: F.col("attribute") == a
    picks = [F.max_by(F.when(mine(a), F.struct("v", "year")), F.when(mine(a), F.struct("year", -F.col("ord")))).alias(a) for a in ATTRIBUTES]
    out = r.groupBy("iso3", "staple").agg(F.min_by("country", "ord").alias("country"), F.max("year").alias("year"), *picks)
    return out.select("iso3", "staple", *(round_half_up(f"{a}.v", 1).alias(a) for a in ATTRIBUTES), *(F.col(f"{a}.year").alias(f"year_{a}") for a in ATTRIBUTES), "year", "country", F.lit("1000 MT").alias("unit"))


def staples_wide(supply: DataFrame) -> DataFrame:
    """key and <staple>_production_kt, <staple>_consumption_kt: the shape that the nowcast reads."""
    one = [F.max(F.when(F.col("staple") == s, F.col(m))).alias(f"{s}_{m}") for s in ("wheat", "rice", "corn") for m in ("production_kt", "consumption_kt")]
    return supply.groupBy(F.col("iso3").alias("key")).agg(*one)


def import_partners(rows: DataFrame, m49: DataFrame) -> DataFrame:
    """importer, commodity, supplier, rank, usd_m, total_usd_m, share_pct: five largest suppliers of rows(importer, cmdCode, partnerCode, primaryValue)."""
    r = rows.select("importer", _mapped(F.col("cmdCode"), HEADINGS).alias("commodity"), F.col("partnerCode").cast("string").alias("code"), F.col("primaryValue").cast("double").alias("usd")).where("commodity is not null and code <> '0' and usd > 0").join(m49, "code")
    top = partner_shares(r.withColumnRenamed("iso3", "supplier"), ["importer", "commodity"], "supplier", "usd")
    return top.select("importer", "commodity", "supplier", "rank", round_half_up("value", 2).alias("usd_m"), round_half_up("total", 2).alias("total_usd_m"), "share_pct")


# --- environment ------------------------------------------------------------------------------------------------------


def weather(days: DataFrame) -> DataFrame:
    """iso3, sums, anomalies and flags of days(iso3, day, rain, temperature, soil): the last 7 known points against the last 30. Countries without rain or temperature go."""
    rain, warm, soil = (change.trailing(days, ["iso3"], "day", c) for c in ("rain", "temperature", "soil"))
    base = F.when(F.col("n") >= 30, F.col("long_sum") * (7 / 30))
    r = rain.select("iso3", round_half_up("short_sum", 1).alias("precip_7d_mm"), round_half_up(percent_change("short_sum", base, above=1.0), 1).alias("precip_anomaly_pct"))
    t = warm.select("iso3", round_half_up("short_mean", 2).alias("temp_7d_c"), F.when(F.col("n") >= 30, round_half_up(F.col("short_mean") - F.col("long_mean"), 2)).alias("temp_anomaly_c"))
    s = soil.select("iso3", round_half_up("short_mean", 3).alias("soil_moisture_7d"))
    out, a = r.join(t, "iso3").join(s, "iso3", "left"), F.col("precip_anomaly_pct")
    dry = F.coalesce(F.col("soil_moisture_7d") < 0.15, F.lit(True))
    return out.withColumn("drought_flag", known((a < -50) & dry)).withColumn("wet_flag", known(a > 100)).withColumn("heat_flag", known(F.col("temp_anomaly_c") > 3))


def rivers(days: DataFrame, gauges: DataFrame) -> DataFrame:
    """iso3, river, discharge_7d_m3s, discharge_anomaly_pct, flood_flag of days(iso3, day, discharge) and gauges(iso3, river)."""
    out = change.river_anomaly(days, ["iso3"], "day", "discharge").join(gauges, "iso3")
    return out.select("iso3", "river", round_half_up("short_mean", 1).alias("discharge_7d_m3s"), F.col("anomaly_pct").alias("discharge_anomaly_pct"), "flood_flag")


def us_rivers(readings: DataFrame) -> DataFrame:
    """state, river, site, gage_ft_latest, discharge_cfs_latest, discharge_7d_change_pct, flow_anomaly of readings(state, river, site, code, ts, value); of several sites of a state the last counts.

    00065 is height, 00060 discharge; values come as text with marks for missing ones.
    """
    r = readings.select("state", "river", "site", "code", "ts", number("value").alias("v")).where("v is not null")
    height, flow = F.col("code") == "00065", F.col("code") == "00060"
    per = r.groupBy("state", "river", "site").agg(
        round_half_up(F.max_by(F.when(height, F.col("v")), F.when(height, F.col("ts"))), 2).alias("gage_ft_latest"), round_half_up(F.max_by(F.when(flow, F.col("v")), F.when(flow, F.col("ts")))).alias("discharge_cfs_latest"),
        F.min_by(F.when(flow, F.col("v")), F.when(flow, F.col("ts"))).alias("first"),
    )
    pct = F.when((F.col("discharge_cfs_latest") != 0) & (F.col("first") != 0), round_half_up((F.col("discharge_cfs_latest") - F.col("first")) / F.col("first") * 100.0, 1))
    per = per.withColumn("discharge_7d_change_pct", pct).withColumn("flow_anomaly", F.when(pct < -25, "low").when(pct > 50, "high").otherwise("normal"))
    return latest.latest(per, ["state"], [F.col("site")], ["river", "site", "gage_ft_latest", "discharge_cfs_latest", "discharge_7d_change_pct", "flow_anomaly"])


def air(stations: DataFrame, alpha2: DataFrame) -> DataFrame:
    """iso3, pm25_latest, stations_reporting, pm25_flag: the mean of stations(country, parameter_id, value) that measure particles (2)."""
    r = stations.where((F.col("parameter_id") == 2) & (F.col("value") >= 0)).select(F.upper("country").alias("code"), F.col("value").cast("decimal(20,4)").alias("v")).join(alpha2, "code")
    mean = F.sum("v").cast("double") / F.count("*")
    return r.groupBy("iso3").agg(mean.alias("m"), F.count("*").alias("stations_reporting")).select("iso3", round_half_up("m", 1).alias("pm25_latest"), "stations_reporting", (F.col("m") > PARTICLES).alias("pm25_flag"))


def fires(detections: DataFrame, baselines: DataFrame) -> DataFrame:
    """iso3, fires_7d, fires_high_confidence, fire_flag (over twice the baseline) of detections(iso3, confidence) and baselines(iso3, baseline)."""
    r = detections.groupBy("iso3").agg(F.count("*").alias("fires_7d"), F.count_if(F.lower("confidence").isin("h", "high")).alias("fires_high_confidence"))
    out = r.join(baselines, "iso3", "left")
    return out.select("iso3", "fires_7d", "fires_high_confidence", (F.col("fires_7d") > 2 * F.coalesce("baseline", F.lit(USUAL_FIRES))).alias("fire_flag"))


def climate(responses: DataFrame) -> DataFrame:
    """iso3, hist_temp_c, proj_temp_change_c, proj_precip_change_pct of responses(iso3, measure, value): hist_temp, proj_temp, hist_rain, proj_rain."""
    means = year_mean(responses)
    of = lambda m: F.max(F.when(F.col("measure") == m, F.col("mean")))
    w = means.groupBy("iso3").agg(*(of(m).alias(m) for m in ("hist_temp", "proj_temp", "hist_rain", "proj_rain")))
    out = w.select("iso3", round_half_up("hist_temp", 2).alias("hist_temp_c"), round_half_up(F.col("proj_temp") - F.col("hist_temp"), 2).alias("proj_temp_change_c"), round_half_up(percent_change("proj_rain", "hist_rain"), 1).alias("proj_precip_change_pct"))
    return out.na.drop(how="all", subset=["hist_temp_c", "proj_temp_change_c", "proj_precip_change_pct"])


def water_risk(rows: DataFrame, indicators: dict[str, str]) -> DataFrame:
    """iso3, country and a struct (score, cat, label) for each indicator, of long rows(gid_0, name_0, weight, indicator_name, year, score, label, cat), baseline only."""
    r = rows.where((F.trim("weight") == "Def") & F.coalesce(F.lower(F.trim("year")), F.lit("")).isin("", "baseline"))
    r = r.select(country_key("gid_0").alias("iso3"), F.trim("name_0").alias("country"), _mapped(F.lower(F.trim("indicator_name")), indicators).alias("k"), F.struct(round_half_up(number("score"), 2).alias("score"), integer("cat").alias("cat"), F.trim("label").alias("label")).alias("v"))
    r = r.where("iso3 is not null and k is not null and (v.score is not null or v.cat is not null)")
    one = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in indicators.values()]
    return r.groupBy("iso3").agg(F.min("country").alias("country"), *one, F.lit("baseline").alias("year"))


# --- indices ----------------------------------------------------------------------------------------------------------


def development_bank(texts: DataFrame) -> DataFrame:
    """iso3, indicator, value, year of [page, rows] documents: the last known row of each counts."""
    rows = world_bank_rows(texts).where("value is not null")
    out = latest.latest(rows, ["iso3", "indicator"], [F.col("ord")], ["value", "year"])
    return out.withColumn("value", round_half_up("value", 3))


def development_bulk(rows: DataFrame, known_keys: DataFrame, indicators: list[str]) -> DataFrame:
    """iso3, indicator, value (rounded as its unit asks), year, name of wide rows (Country Code, Indicator Code, Indicator Name, 1960, ...): the newest known year. Keys that aren't countries go."""
    years = {y: number(f"`{c}`") for y, c in year_columns(rows).items()}
    r = rows.select(F.upper(F.trim("Country Code")).alias("iso3"), F.trim("Indicator Code").alias("indicator"), F.trim("Indicator Name").alias("name"), *latest.newest_of_wide(years))
    r = r.where(F.col("indicator").isin(*indicators) & F.col("value").isNotNull()).join(known_keys.select("iso3").distinct(), "iso3", "left_semi")
    return r.select("iso3", "indicator", by_unit("value", "indicator", PLACES).alias("value"), "year", "name")


def coverage(cells: DataFrame) -> DataFrame:
    """bucket, n: countries by how many indicators they have."""
    n = F.col("n")
    bucket = F.when(n > 15, ">15").when(n >= 10, "10-15").when(n >= 5, "5-9").otherwise("1-4")
    return cells.groupBy("iso3").agg(F.count("*").alias("n")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def bank_index(texts: DataFrame, indicators: dict[str, str], points: int = 15) -> DataFrame:
    """iso3, country, year and for each indicator a struct (value, year, series of the last points), of [page, rows] documents."""
    rows = world_bank_rows(texts).where("value is not null and year is not null and length(iso3) = 3").withColumn("k", _mapped(F.col("indicator"), indicators)).where("k is not null").withColumn("v", round_half_up("value", 2))
    kept = latest.last_n(rows, ["iso3", "k"], [F.col("year"), F.col("ord")], points)
    per = kept.groupBy("iso3", "k").agg(F.first("country", True).alias("country"), F.max(F.when(F.col("rn") == 1, F.struct(F.col("v").alias("value"), "year"))).alias("last"), in_order(F.struct("year", "ord"), "year", F.col("v").alias("value")).alias("series"))
    cell = F.struct(F.col("last.value").alias("value"), F.col("last.year").alias("year"), "series")
    return per.groupBy("iso3").agg(F.first("country", True).alias("country"), F.max("last.year").alias("year"), *(F.max_by(F.when(F.col("k") == k, cell), F.when(F.col("k") == k, F.col("last.year"))).alias(k) for k in indicators.values()))


def logistics(texts: DataFrame) -> DataFrame:
    return bank_index(texts, LOGISTICS, 1)


def governance(texts: DataFrame) -> DataFrame:
    return bank_index(texts, GOVERNANCE, 15)


def human_development(rows: DataFrame) -> DataFrame:
    """iso3, country, a struct (value, year) for each series, year, hdi_rank, hdi_group of wide rows (iso3, country, hdi_1990, ...)."""
    iso = find_column(rows, "iso3", "country code", "code") or rows.columns[0]
    name, rank, group = find_column(rows, "country", "name"), find_column(rows, "hdi_rank", "rank"), find_column(rows, "hdicode", "hdi_group", "group")
    found = {p: {y: number(c) for y, c in year_columns(rows, rf"(?i){p}_(\d{{4}})").items()} for p in DEVELOPMENT}
    found = {p: ys for p, ys in found.items() if ys}
    places = lambda p: 1 if p == "gnipc" else 3
    cells = [F.when(F.coalesce(*(ys[y] for y in sorted(ys, reverse=True))).isNotNull(), F.struct(round_half_up(v, places(p)).alias("value"), y.alias("year"))).alias(p) for p, ys in found.items() for y, v in [latest.newest_of_wide(ys)]]
    text = lambda c: F.nullif(F.trim(c), F.lit("")) if c else F.lit(None).cast("string")
    out = rows.select(country_key(iso).alias("iso3"), text(name).alias("country"), *cells, F.when(integer(rank) > 0, integer(rank)).alias("hdi_rank") if rank else F.lit(None).cast("bigint").alias("hdi_rank"), text(group).alias("hdi_group"))
    return out.where("iso3 is not null").na.drop(how="all", subset=list(found)).withColumn("year", F.array_max(F.array(*(F.col(f"{p}.year") for p in found))))


def adaptation_index(tables: dict[str, DataFrame]) -> DataFrame:
    """iso3, a column for each metric's newest known value, year: wide tables (ISO3, Name, 1995, ...) by metric."""
    stacked = None
    for metric, df in tables.items():
        years = {y: number(f"`{c}`") for y, c in year_columns(df).items()}
        iso = find_column(df, "iso3", "code", "iso", "iso_code") or df.columns[0]
        part = df.select(country_key(iso).alias("iso3"), F.lit(metric).alias("metric"), *latest.newest_of_wide(years)).where("iso3 is not null and value is not null")
        stacked = part if stacked is None else stacked.union(part)
    of = [F.max(F.when(F.col("metric") == m, round_half_up("value", 3))).alias(m) for m in tables]
    return stacked.groupBy("iso3").agg(*of, F.max("year").alias("year"))


def humanitarian_risk(cells: DataFrame, year: int | None = None) -> DataFrame:
    """iso3, country, inform_risk and its parts, rank, trend, year of a sheet's cells; rows without the composite go."""
    t = table_below(cells, RISK_SHEET)
    numbers = ("inform_risk", "hazard_exposure", "vulnerability", "lack_coping_capacity")
    out = t.select(country_key("iso3").alias("iso3"), F.trim("country").alias("country"), *(round_half_up(number(c), 2).alias(c) for c in numbers), integer("rank").alias("rank"), F.trim("trend").alias("trend"), F.lit(year).cast("int").alias("year"))
    return out.where("iso3 is not null and inform_risk is not null")


def state_insecurity(rows: DataFrame) -> DataFrame:
    """iso3 (US- and the state), food_insecurity_pct, child_food_insecurity_pct, year of rows(state, overall, child, year)."""
    return rows.select(F.concat(F.lit("US-"), "state").alias("iso3"), F.col("overall").alias("food_insecurity_pct"), F.col("child").alias("child_food_insecurity_pct"), "year")


# --- countries --------------------------------------------------------------------------------------------------------


def country_fields(profiles: DataFrame, overrides: DataFrame, shares: DataFrame, trade: DataFrame) -> DataFrame:
    """iso3, field, value, layer, as_of, quality_flag: structural fields with where they are from.

    profiles: old records, which say what countries there are; overrides(iso3, field, value); shares as caloric_shares gives them
    (w, r, m to one decimal); trade as net_food_trade does (net, whole millions). An override stands unless its field is sourced.
    """
    fields = [c for c in ("fdrs", "f2030", "w", "r", "m", "fi", "net") if c in profiles.columns]
    old = profiles.select(F.col("iso").alias("iso3"), *fields).unpivot(["iso3"], fields, "field", "value").where("value is not null")
    calories = shares.select("iso3", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), round_half_up(c, 1).alias("value")) for f, c in (("w", "wheat_pct"), ("r", "rice_pct"), ("m", "maize_pct"))))).alias("s")).select("iso3", "s.*")
    net = trade.select("iso3", F.lit("net").alias("field"), round_half_up("value").alias("value"))
    out = resolve.overlay([("legacy", old), ("override", overrides), ("shares", calories), ("trade", net)], ["iso3", "field"], "value")
    flag = F.when(F.col("layer") != "legacy", F.when(F.col("layer") == "override", "override").otherwise("sourced")).when(F.col("field").isin("w", "r", "m"), "legacy_import_dependency").otherwise("legacy_curated")
    return out.withColumn("quality_flag", flag)
