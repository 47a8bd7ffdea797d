from __future__ import annotations

import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tillage.operators import health
from tillage.sources import feeds, landing, sinks

def today():
    return F.lit("2026-05-30").cast("date")


def texts(spark, *documents, **columns):
    rows = [(json.dumps(d) if not isinstance(d, str) else d,) for d in documents]
    return spark.createDataFrame(rows, "value string")


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict(recursive=True)


def by(df, key="iso3"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


def test_map_documents_of_every_shape(spark):
    row = {"iso3": "afg", "fcs": 0.4567, "fcs_people_total": "12.9", "ipcPopulation": 0, "ipc_phase3plus": "33.333", "undernourishment": "", "alerts": {"a": 1}, "adm0_name": "Afghanistan"}
    shapes = [
        {"body": {"features": [{"properties": row}]}}, {"features": [{"properties": json.dumps(row)}]}, [row], [{"properties": row}], {"AFG": {k: v for k, v in row.items() if k != "iso3"}},
    ]
    for s in shapes:
        out = one(feeds.hungermap(texts(spark, s)))
        assert out == {"iso3": "AFG", "fcs_pct": 45.67, "fcs_people_total": 12, "ipc_phase3plus_pct": 33.33, "undernourishment_pct": None, "alerts": {"a": "1"}, "country": "Afghanistan"}
    assert feeds.hungermap(texts(spark, [{"iso3": "U1A"}, {"iso3": ""}, {"x": 1}], "not json", {"features": []})).collect() == []


def test_country_document(spark):
    points = [{"x": f"2026-{1 + k // 28:02d}-{1 + k % 28:02d}", "y": 100 - k * 0.2} for k in range(100)]
    doc = {"body": {"currencyExchangeGraph": {"name": "AFN", "data": points[::-1] + [{"x": "2026-09-01", "y": None}]}, "inflationGraphs": {"food": {"data": [{"x": "a", "y": 3}, {"x": "b", "y": 15.004}]}}, "nutrition": {"wasting": "3.456", "stunting": ""}}}
    df = table(spark, "iso3 string, value string", ("AFG", json.dumps(doc)), ("XXX", json.dumps({})), ("YYY", "broken"), ("ZZZ", json.dumps({"inflationGraphs": {"food": {"data": [{"y": 0}]}}})))
    out = by(feeds.hungermap_country(df))
    assert set(out) == {"AFG"}
    a = out["AFG"]
    assert a["fx_latest"] == 80.2 and a["fx_90d_change_pct"] == pytest.approx(round((80.2 - 98.0) / 98.0 * 100, 1)) and a["fx_currency_shock"] is True
    assert a["food_inflation_pct"] == 15.0 and a["inflation_shock"] is False and a["wasting_pct"] == 3.46 and a["stunting_pct"] is None


def test_ipc_prefers_the_mirror_and_then_the_newest_year(spark):
    mirror = table(spark, "iso3 string, ipc_percent string, phase3plus_percentage string, ipc_population_affected string, period string, adm0_name string", ("SOM", "0", "41.239", "12.7", "now", "Somalia"), ("bad", "1", None, None, None, None), ("S0M", "1", None, None, None, None))
    official = table(spark, "country string, phase3plus_percentage string, year_asked int", ("YEM", "50", 2025), ("YEM", "60", 2026), ("", "1", 2026))
    out = by(feeds.ipc(mirror, official))
    assert set(out) == {"SOM", "BAD"} and out["SOM"]["phase3plus_pct"] == 41.24 and out["SOM"]["phase3plus_count"] == 12
    out = by(feeds.ipc(mirror.where("false"), official))
    assert set(out) == {"YEM"} and (out["YEM"]["phase3plus_pct"], out["YEM"]["analysis_year"], out["YEM"]["source_via"]) == (60.0, 2026, "ipcinfo")


def test_conflict_counts_and_cap(spark):
    rows = [("afg", "2026-05-29", "3")] * 400 + [("AFG", "2026-04-30", "2")] * 201 + [("AFG", "2026-04-29", "9"), ("AFG", "2026-02-27", "1"), ("", "2026-05-29", "1"), ("SYR", "2026-03-10", "x"), ("SYR", "2026-05-20", None)]
    out = by(feeds.conflict(table(spark, "iso3 string, event_date string, fatalities string", *rows), today()))
    assert out["AFG"] == {"iso3": "AFG", "events_last_30d": 601, "events_last_90d": 602, "fatalities_last_30d": 1602, "intensity_score": 100.0}
    assert out["SYR"] == {"iso3": "SYR", "events_last_30d": 1, "events_last_90d": 2, "fatalities_last_30d": 0, "intensity_score": 0.2}


def test_reports(spark):
    schema = "fields struct<title:string, date:struct<original:string>, country:array<struct<iso3:string, name:string>>, url_alias:string, primary_country:struct<iso3:string, name:string>>"
    rows = [(("Famine looms", ("2026-05-01",), [("yem", "Yemen")], "u", ("som", "Somalia")),), ((None, None, [("yem", "Yemen")], None, None),), (("Acute need", None, None, None, None),)]
    out = feeds.reports(table(spark, schema, *rows)).collect()
    assert [(r.title, r.iso3, r.country, r.severity) for r in out] == [("Famine looms", "SOM", "Somalia", "high"), ("", "YEM", None, "low"), ("Acute need", None, None, "med")]


def test_outlook_phases(spark):
    schema = "iso3 string, slug string, scenario string, ipc_phase string, value string, start_date string, end_date string, period_date string, ord int"
    rows = [
        ("SOM", "somalia", "CS", "3", None, "2026-02-01", "2026-05-31", None, 1), ("SOM", "somalia", "CS", "3", None, "2025-11-01", "2026-01-31", None, 2), ("SOM", "somalia", "CS", "9", None, None, None, None, 3), ("SOM", "somalia", "ML1", None, "4", None, None, "2026-06-15T00", 4),
        ("YEM", None, "ML2", "2", None, None, None, None, 5), ("HTI", "haiti", "ML1", "2", None, "2025-11-01", "2026-01-31", None, 6), ("HTI", "haiti", "XX", "5", None, None, None, None, 7),
    ]
    out = by(feeds.outlook_phases(table(spark, schema, *rows), today()))
    assert set(out) == {"SOM", "HTI"}
    s = out["SOM"]
    assert (s["current_phase"], s["current_period"], s["projected_phase"], s["projected_period"], s["delta"]) == (3, "Feb–May 2026", 4, "Jun–Jun 2026", 1)
    assert s["current_phase_label"] == "Crisis (3)" and s["report_url"] == "https://fews.net/somalia" and s["as_of"] == date(2026, 5, 30)
    assert out["HTI"]["projected_period"] == "Nov 2025 – Jan 2026" and out["HTI"]["delta"] is None


def test_outlook_series_and_projections(spark):
    n = "Crisis Affected Population (Number)"
    schema = "iso3c string, country string, indicator_short string, unit string, year string, value string, flag string, type string"
    rows = [("AFG", "Afghanistan", n, "n", "2025", "10", "f", "Actual"), ("AFG", "Afghanistan", n, "n", "2026", "11", "g", "Preliminary model estimate"), ("AFG", "Afghanistan", n, "n", "2027", "13", None, "Downside projection"), ("AFG", "Afghanistan", n, "n", "2027", "12", None, "Baseline projection"), ("AFG", "A", "other", "n", "2025", "1", None, "Actual"), ("AFG", "A", n, "n", "x", "1", None, "Actual")]
    s = feeds.outlook_series(table(spark, schema, *rows))
    r = one(s)
    assert (r["indicator"], r["latest_year"], r["latest_value"], r["latest_flag"]) == ("crisis_pop", 2026, 11.0, "g")
    assert [(p["year"], p["type"]) for p in r["series"]][2:] == [(2027, "Baseline projection"), (2027, "Downside projection")]
    assert one(feeds.outlook_projections(s))["projection"] == {"year_2027_baseline_crisis_pop": 12.0, "year_2027_downside_crisis_pop": 13.0}


def test_food_price_index_reproduces_the_published_change(spark, tmp_path):
    (tmp_path / "f.csv").write_text("FAO Food Price Index,,\nDate,Food,Meat\n2026-03,128.6,1,2,3,4,5\n2026-04,130.7,129.4,119.6,111.3,193.9,88.5\nFeb-26,x\n,,\n")
    s = feeds.food_price_index(landing.csv_cells(spark, str(tmp_path / "f.csv"), 7))
    assert s.count() == 2
    r = one(feeds.month_change(s))
    assert r["change_mom_pct"] == 1.63 and r["latest"] == 130.7 and r["at"] == date(2026, 4, 1)


def test_freshest_candidate(spark):
    rows = [("new", 1, date(2026, 3, 1), 1.0), ("new", 1, date(2026, 4, 1), 2.0), ("old", 2, date(2026, 4, 1), 3.0), ("older", 3, date(2025, 4, 1), 3.0)]
    assert {r.source for r in feeds.freshest(table(spark, "source string, priority int, at date, fpi double", *rows)).collect()} == {"new"}


def test_commodity_sheet(spark):
    grid = {4: ["Updated on May 02, 2026"], 5: [None, "Wheat", "Rice"], 6: [None, "$/mt", "$/mt"], 7: [None, "WHEAT_US_HRW", " RICE_05 "], 8: ["2026M01", "231.1", "…"], 9: ["2026M02", "236.4", "0"], 10: ["note", "9", "9"], 11: ["2026M03", "", "5"]}
    cells = table(spark, "row int, col int, value string", *((r, c, v) for r, vs in grid.items() for c, v in enumerate(vs)))
    out = by(feeds.commodity_prices(cells, {"wheat": "WHEAT_US_HRW", "rice": "RICE_05", "none": "NOPE"}), "key")
    assert out["wheat"]["change_mom_pct"] == 2.29 and out["wheat"]["latest_month"] == "2026-02" and [p["value"] for p in out["wheat"]["history"]] == [231.1, 236.4]
    assert out["rice"]["change_mom_pct"] is None and out["rice"]["previous_value"] == 0.0 and set(out) == {"wheat", "rice"}


def test_european_cube(spark):
    doc = {"dimension": {"geo": {"category": {"index": {"DE": 0, "EL": 1, "EA": 2}, "label": {"DE": "Germany"}}}, "time": {"category": {"index": {"2026-03": 0, "2026-04": 1}}}}, "value": {"0": 2.0, "1": 2.345, "2": 9.1, "4": 5, "5": 6}}
    out = by(feeds.european_inflation(texts(spark, doc)))
    assert out == {"DEU": {"iso3": "DEU", "food_hicp_yoy_pct": 2.35, "month": "2026-04", "country": "Germany", "inflation_shock": False}, "GRC": {"iso3": "GRC", "food_hicp_yoy_pct": 9.1, "month": "2026-03", "country": "GRC", "inflation_shock": True}}


def test_world_inflation(spark):
    areas = feeds.codes(spark, {4: "ALB"})
    rows = [("4", "Albania", "2023", "100", 1), ("4", "Albania", "2025", "120.04", 2), ("4", "Albania", "2024", "..", 3), ("4", "Albania", "2025", "116", 4), ("999", "x", "2024", "1", 5)]
    out = one(feeds.world_inflation(table(spark, "`Area Code` string, Area string, Year string, Value string, ord int", *rows), areas))
    assert out == {"iso3": "ALB", "food_cpi_index_latest": 116.0, "food_cpi_yoy_pct": 16.0, "year_latest": 2025, "country": "Albania", "inflation_shock": True}


def test_caloric_shares_keep_each_items_own_year(spark):
    areas, names = feeds.codes(spark, {100: "IND", 5: "XXX"}), feeds.codes(spark, {"India": "IND"})
    schema = "`Area Code` string, Area string, `Item Code` string, `Element Code` string, Y2020 string, Y2021 string, Y2022 string"
    rows = [("5", "India", "2901", "664", "2400", "2500", ""), ("100", "x", "2511", "664", "500", "0", "0"), ("100", "x", "2807", "664", "1", "700", "710"), ("100", "x", "2901", "645", "9", "9", "9"), ("7", "?", "2901", "664", "1", "1", "1")]
    r = one(feeds.caloric_shares(table(spark, schema, *rows), areas, names))
    assert (r["wheat_pct"], r["rice_pct"], r["maize_pct"], r["total_kcal_per_day"], r["year"]) == (20.0, 28.4, 0.0, 2500.0, 2021)


def test_net_food_trade(spark):
    areas, names = feeds.codes(spark, {1: "AAA", 2: "BBB"}), feeds.codes(spark, {"Ceeland": "CCC"})
    schema = "`Area Code` string, Area string, `Item Code` string, `Item Code (CPC)` string, Item string, `Element Code` string, Year string, Value string, Flag string"
    rows = [
        ("1", "A", "1842", "F", "Food", "5922", "2022", "5000", "A"), ("1", "A", "1842", "F", "Food", "5622", "2022", "3000", ""), ("1", "A", "1842", "F", "Food", "5922", "2023", "9", "A"), ("1", "A", "1842", "F", "Food", "5622", "2023", "9", "M"), ("1", "A", "1841", "F", "Agri", "5922", "2023", "1", "A"), ("1", "A", "1841", "F", "Agri", "5622", "2023", "1", "A"),
        ("2", "B", "1841", "F", "Agri", "5922", "2021", "100", None), ("2", "B", "1841", "F", "Agri", "5622", "2021", "1100", "E"), ("9", "Ceeland", "1842", "F", "Food", "5922", "2021", "1", "A"), ("8", "?", "1842", "F", "Food", "5922", "2021", "1", "A"),
    ]
    out = by(feeds.net_food_trade(table(spark, schema, *rows), areas, names))
    assert {k: (v["value"], v["year"], v["item_used"]) for k, v in out.items()} == {"AAA": (2.0, 2022, 1842), "BBB": (-1.0, 2021, 1841)}
    assert feeds.net_food_trade(table(spark, "a string", ("1",)), areas, names).count() == 0


def test_staple_supply_takes_newest_and_first(spark):
    fas, names = feeds.codes(spark, {"GM": "DEU"}), feeds.codes(spark, {"Burma": "MMR"})
    schema = "Commodity_Code string, Country_Code string, Country_Name string, Market_Year string, Attribute_Description string, Value string, ord int"
    rows = [("0410000", "GM", "Germany", "2024", "Production", "10", 1), ("410000", "GM", "Germany", "2025", "Production", "12.34", 2), ("410000", "GM", "Germany", "2025", "Production", "99", 3), ("410000", "GM", "Germany", "2023", "TY Imports", "5", 4), ("0422110", "??", "Burma", "2025", "Domestic Use", "7", 5), ("0410000", "E4", "European Union", "2025", "Production", "1", 6), ("0410000", "GM", "Germany", "2025", "Feed Dom. Consumption", "1", 7)]
    out = feeds.staple_supply(table(spark, schema, *rows), fas, names)
    r = {(x.iso3, x.staple): x for x in out.collect()}
    assert set(r) == {("DEU", "wheat"), ("MMR", "rice")}
    w = r["DEU", "wheat"]
    assert (w.production_kt, w.year_production_kt, w.imports_kt, w.year, w.exports_kt) == (12.3, 2025, 5.0, 2025, None)
    assert by(feeds.staples_wide(out), "key")["MMR"]["rice_consumption_kt"] == 7.0


def test_import_partners(spark):
    m49 = feeds.codes(spark, {k: f"C{k:02d}" for k in range(1, 9)})
    rows = [("EGY", "1001", k, float(k)) for k in range(1, 9)] + [("EGY", "1001", 0, 99.0), ("EGY", "1001", 77, 9.0), ("EGY", "1001", 3, -5.0), ("EGY", "9999", 3, 5.0), ("EGY", "1001", 8, 2.0)]
    out = feeds.import_partners(table(spark, "importer string, cmdCode string, partnerCode int, primaryValue double", *rows), m49).orderBy("rank").collect()
    assert [(r.supplier, r.usd_m) for r in out] == [("C08", 10.0), ("C07", 7.0), ("C06", 6.0), ("C05", 5.0), ("C04", 4.0)] and out[0].total_usd_m == 38.0 and out[0].share_pct == 26.3


def days(spark, name, values, iso="KEN"):
    return [(iso, date(2026, 4, 1 + k) if k < 30 else date(2026, 5, k - 29), v) for k, v in enumerate(values)]


def test_weather_flags(spark):
    rows = [("KEN", d, r, 20.0 if k < 23 else 28.0, 0.1) for k, (_, d, r) in enumerate(days(spark, "r", [10.0] * 23 + [1.0] * 7))]
    rows += [("UGA", d, 1.0, 20.0, None) for _, d, _ in days(spark, "r", [1.0] * 20)] + [("TZA", date(2026, 4, 1), None, 20.0, None)]
    out = by(feeds.weather(table(spark, "iso3 string, day date, rain double, temperature double, soil double", *rows)))
    k = out["KEN"]
    assert k["precip_7d_mm"] == 7.0 and k["precip_anomaly_pct"] == pytest.approx(round((7 - 237 * 7 / 30) / (237 * 7 / 30) * 100, 1)) and k["drought_flag"] and k["heat_flag"] and not k["wet_flag"]
    assert out["UGA"]["precip_anomaly_pct"] is None and out["UGA"]["temp_anomaly_c"] is None and out["UGA"]["drought_flag"] is False and "TZA" not in out


def test_rivers(spark):
    rows = days(spark, "d", [10.0] * 13 + [40.0] * 7) + days(spark, "d", [1.0] * 13, "UGA")
    gauges = table(spark, "iso3 string, river string", ("KEN", "Tana"), ("UGA", "Nile"))
    r = one(feeds.rivers(table(spark, "iso3 string, day date, discharge double", *rows), gauges))
    assert r == {"iso3": "KEN", "river": "Tana", "discharge_7d_m3s": 40.0, "discharge_anomaly_pct": pytest.approx(95.1), "flood_flag": True}


def test_us_rivers(spark):
    t = lambda h: datetime(2026, 5, 1, h)
    rows = [("US-MO", "Missouri", "1", "00060", t(1), "100"), ("US-MO", "Missouri", "1", "00060", t(2), "-999999"), ("US-MO", "Missouri", "1", "00060", t(3), "160.4"), ("US-MO", "Missouri", "1", "00065", t(3), "3.456"), ("US-LA", "Mississippi", "2", "00060", t(1), "0"), ("US-LA", "Mississippi", "2", "00060", t(2), "5")]
    out = by(feeds.us_rivers(table(spark, "state string, river string, site string, code string, ts timestamp, value string", *rows)), "state")
    assert (out["US-MO"]["discharge_7d_change_pct"], out["US-MO"]["flow_anomaly"], out["US-MO"]["gage_ft_latest"], out["US-MO"]["discharge_cfs_latest"]) == (60.0, "high", 3.46, 160.0)
    assert out["US-LA"]["discharge_7d_change_pct"] is None and out["US-LA"]["flow_anomaly"] == "normal"


def test_air_and_fires(spark):
    alpha = feeds.codes(spark, {"IN": "IND"})
    stations = table(spark, "country string, parameter_id int, value double", ("in", 2, 30.0), ("IN", 2, 41.0), ("IN", 2, -1.0), ("IN", 1, 500.0), ("XX", 2, 1.0), ("IN", 2, None))
    assert one(feeds.air(stations, alpha)) == {"iso3": "IND", "pm25_latest": 35.5, "stations_reporting": 2, "pm25_flag": True}
    found = table(spark, "iso3 string, confidence string", *[("PHL", "H")] * 3, *[("PHL", "low")] * 2, *[("XXX", None)] * 3)
    out = by(feeds.fires(found, table(spark, "iso3 string, baseline int", ("PHL", 2))))
    assert out["PHL"] == {"iso3": "PHL", "fires_7d": 5, "fires_high_confidence": 3, "fire_flag": True} and out["XXX"]["fire_flag"] is False


def test_climate_means_of_every_shape(spark):
    shapes = [{"BGD": {"1991": 25.0, "1992": 27.0}}, {"1991": 25.0, "1992-01": "27", "x": 9}, {"data": {"BGD": {"1991": 25.0, "1992": 27.0}}}, {"data": [{"year": 1, "value": 25.0}, {"val": 27.0}, {"x": 1}]}, {"value": 26.0}, {"BGD": 26.0}]
    assert [r.mean for r in landing.year_mean(texts(spark, *shapes)).collect()] == [26.0] * 6
    assert [r.mean for r in landing.year_mean(texts(spark, {}, [], "broken", {"a": {"b": 1}})).collect()] == [None] * 4
    rows = [("BGD", "hist_temp", '{"value": 25}'), ("BGD", "proj_temp", '{"value": 26.504}'), ("BGD", "hist_rain", '{"value": 0}'), ("BGD", "proj_rain", '{"value": 5}'), ("XXX", "hist_rain", '{"value": 1}')]
    assert one(feeds.climate(table(spark, "iso3 string, measure string, value string", *rows))) == {"iso3": "BGD", "hist_temp_c": 25.0, "proj_temp_change_c": 1.5, "proj_precip_change_pct": None}


def test_water_risk(spark):
    schema = "gid_0 string, name_0 string, weight string, indicator_name string, year string, score string, label string, cat string"
    rows = [("ind", "India", "Def", "BWS", "baseline", "4.123", "High", "4"), ("IND", "India", "Def", "bws", "2030", "1", "Low", "1"), ("IND", "India", "Agr", "bws", "", "1", "Low", "1"), ("IND", "India", "Def", "drr", "", "NA", "x", "2"), ("X1", "x", "Def", "bws", "", "1", "", "")]
    r = one(feeds.water_risk(table(spark, schema, *rows), {"bws": "water_stress", "drr": "drought_risk"}))
    assert r["water_stress"] == {"score": 4.12, "cat": 4, "label": "High"} and r["drought_risk"] == {"score": None, "cat": 2, "label": "x"}


def bank(indicator, *rows):
    return [{"page": 1}, [{"indicator": {"id": indicator}, "country": {"value": c}, "countryiso3code": i, "date": y, "value": v} for i, c, y, v in rows]]


def test_bank_documents(spark):
    df = texts(spark, bank("NY.X", ("USA", "US", "2024", 1.23456), ("USA", "US", "2023", 2.0), ("", "World", "2024", 1), ("BRA", "Brazil", "2024", None)), bank("RL.EST", ("USA", "US", "2022", -1.115), ("USA", "US", "2020", 0.5), ("USA", "US", "2023", None)), "oops", [{"message": 1}])
    assert {(r.iso3, r.indicator, r.value, r.year) for r in feeds.development_bank(df).collect()} == {("USA", "NY.X", 2.0, 2023), ("USA", "RL.EST", 0.5, 2020)}
    g = one(feeds.governance(df))
    assert g["rule_of_law"]["year"] == 2022 and [p["year"] for p in g["rule_of_law"]["series"]] == [2020, 2022] and g["year"] == 2022 and g["control_corruption"] is None
    assert feeds.logistics(df).count() == 0


def test_development_bulk_and_coverage(spark, tmp_path):
    (tmp_path / "w.csv").write_text("﻿Country Name,Country Code,Indicator Name,Indicator Code,2022,2023,2024\nUS,USA,Population,SP.POP.TOTL,1.4,2.6,\nUS,USA,Rural,SP.RUR.TOTL.ZS,1.234,..,x\nWorld,WLD,Population,SP.POP.TOTL,1,2,3\nUS,USA,Other,NOPE,1,2,3\n", encoding="utf-8")
    rows = landing.csv_rows(spark, str(tmp_path / "w.csv"))
    out = feeds.development_bulk(rows, table(spark, "iso3 string", ("USA",)), ["SP.POP.TOTL", "SP.RUR.TOTL.ZS"])
    assert {(r.iso3, r.indicator, r.value, r.year, r.name) for r in out.collect()} == {("USA", "SP.POP.TOTL", 3.0, 2023, "Population"), ("USA", "SP.RUR.TOTL.ZS", 1.23, 2022, "Rural")}
    assert [(r.bucket, r.n) for r in feeds.coverage(out).collect()] == [("1-4", 1)]


def test_wide_indices(spark):
    hdi = table(spark, "iso3 string, country string, hdicode string, hdi_rank string, hdi_2021 string, hdi_2022 string, le_2021 string, gnipc_2022 string", ("nor", "Norway", "Very High", "2.0", "0.9612", "..", "83", "1.26"), ("ZZK.WORLD", "World", "", "", "1", "1", "1", "1"), ("XXX", "x", "", "0", "", "", "", ""))
    r = one(feeds.human_development(hdi))
    assert r["hdi"] == {"value": 0.961, "year": 2021} and r["gnipc"] == {"value": 1.3, "year": 2022} and (r["year"], r["hdi_rank"], r["hdi_group"]) == (2022, 2, "Very High")
    gain = table(spark, "ISO3 string, Name string, `2022` string, `2023` string", ("AFG", "a", "33.1234", "NA"), ("af1", "b", "1", "1"))
    vulnerable = table(spark, "Code string, `2023` string", ("AFG", "0.5"))
    assert one(feeds.adaptation_index({"gain": gain, "vulnerability": vulnerable})) == {"iso3": "AFG", "gain": 33.123, "vulnerability": 0.5, "year": 2023}


def test_risk_sheet_with_its_heading_found_by_content(spark):
    grid = [["INFORM Risk 2026"], [None], ["COUNTRY", "ISO3", "HAZARD & EXPOSURE", "VULNERABILITY", "LACK OF COPING CAPACITY", "INFORM RISK", "RANK"], ["Afghanistan", "afg", "8.9", "7.1", "7.2", "8.123", "3"], ["Average", "x", "1", "1", "1", "1", "1"], ["Niger", "NER", "5", "5", "5", "N.D.", "9"]]
    cells = table(spark, "row int, col int, value string", *((r, c, v) for r, vs in enumerate(grid, 1) for c, v in enumerate(vs)))
    r = one(feeds.humanitarian_risk(cells, 2026))
    assert (r["iso3"], r["inform_risk"], r["hazard_exposure"], r["rank"], r["trend"], r["year"]) == ("AFG", 8.12, 8.9, 3, None, 2026)


def test_states_and_country_fields(spark):
    assert one(feeds.state_insecurity(table(spark, "state string, overall double, child double, year int", ("AL", 16.1, 22.0, 2023))))["iso3"] == "US-AL"
    profiles = table(spark, "iso string, fdrs double, w double, net double", ("NLD", 30.0, 80.0, 100.0), ("BGD", 60.0, 20.0, -50.0))
    overrides = table(spark, "iso3 string, field string, value double", ("NLD", "w", 1.0), ("BGD", "w", 2.0), ("BGD", "fdrs", 61.0), ("ZZZ", "w", 1.0), ("NLD", "net", 7.0))
    shares = table(spark, "iso3 string, wheat_pct double, rice_pct double, maize_pct double", ("NLD", 20.04, 1.0, 2.0), ("QQQ", 1.0, 1.0, 1.0))
    trade = table(spark, "iso3 string, value double", ("BGD", -7000.5))
    out = {(r.iso3, r.field): (r.value, r.layer, r.quality_flag) for r in feeds.country_fields(profiles, overrides, shares, trade).collect()}
    assert out["NLD", "w"] == (20.0, "shares", "sourced") and out["BGD", "w"] == (2.0, "override", "override") and out["BGD", "net"] == (-7000.0, "trade", "sourced") and out["NLD", "net"] == (7.0, "override", "override")
    assert out["NLD", "fdrs"] == (30.0, "legacy", "legacy_curated") and out["BGD", "fdrs"][0] == 61.0 and not any(k[0] in ("ZZZ", "QQQ") for k in out)


# --- landing and sinks ------------------------------------------------------------------------------------------------


def test_envelopes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_meta": {"generated_at": "2026-05-30T19:39:08+00:00", "source": "S", "notes": "n", "version": "1"}, "data": {"AFG": {"x": 1.5}, "SOM": {"x": None}}}))
    (tmp_path / "b.json").write_text('{"_meta": {"source": "T", "notes": "not configured"}, "data": {}}')
    a = landing.envelope(spark, str(tmp_path / "a.json"), "map<string,struct<x:double>>")
    assert {(r.iso3, r.x) for r in landing.keyed_rows(a).collect()} == {("AFG", 1.5), ("SOM", None)}
    assert landing.envelope(spark, str(tmp_path / "none.json"), "map<string,struct<x:double>>").count() == 0
    meta = by(landing.feed_meta(spark, {k: str(tmp_path / f"{k}.json") for k in ("a", "b", "c")}), "feed")
    assert {k: (v["present"], v["n_rows"], v["source"]) for k, v in meta.items()} == {"a": (True, 2, "S"), "b": (True, 0, "T"), "c": (False, 0, None)}


def test_zip_and_worksheet(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("All_Data.csv", "a,b\n1,é\n".encode("latin-1"))
        z.writestr("Flags.csv", "no\n")
    landing.land_zip(spark, str(tmp_path / "z.zip"), str(tmp_path / "out"), "All_Data", "latin-1")
    assert [r.asDict() for r in landing.csv_rows(spark, str(tmp_path / "out")).collect()] == [{"a": "1", "b": "é"}]
    (tmp_path / "sheet.xml").write_text('<worksheet><sheetData><row r="4"><c r="A4" t="s"><v>1</v></c><c r="AB4"><v>2.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "strings.xml").write_text("<sst><si><t>zero</t></si><si><t>one</t></si></sst>")
    cells = landing.sheet_cells(spark, str(tmp_path / "sheet.xml"), str(tmp_path / "strings.xml"))
    assert {(r.row, r.col, r.value) for r in cells.collect()} == {(4, 0, "one"), (4, 27, "2.5")}


def test_each_zip_of_a_folder_is_a_task_of_its_own(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        with zipfile.ZipFile(tmp_path / "in" / f"{k}.zip", "w") as z:
            z.writestr("x.csv", f"a,b\n{k},y\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    landing.land_zip(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) == 3 and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert sorted(r.a for r in landing.csv_rows(spark, str(tmp_path / "out")).collect()) == ["0", "1", "2"]


def test_dashboard_records(spark):
    js = """const X = [\n// don't trip on this\n{iso:"NLD", name:"Netherlands", region:'Europe', fdrs:30, c:[10,20,30,40,50,60], f2030:35, w:80.5, net:-12, imports:['Soy','Maize'], suppliers:["Brazil"], supPct:[40]},\n{iso:'US-AL', name:'Alabama', region:'US', fdrs:41, c:[1,2,3,4,5,6], imports:[], suppliers:[], supPct:[]}\n];"""
    out = by(landing.js_records(texts(spark, js)), "iso")
    n = out["NLD"]
    assert (n["name"], n["fdrs"], n["c"], n["w"], n["net"], n["imports"], n["suppliers"], n["supPct"]) == ("Netherlands", 30.0, [10.0, 20.0, 30.0, 40.0, 50.0, 60.0], 80.5, -12.0, ["Soy", "Maize"], ["Brazil"], [40.0])
    assert out["US-AL"]["w"] is None and out["US-AL"]["imports"] == []


def test_landing_helpers():
    tried, slept = [], []

    def get():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("no")
        return "body"

    assert landing.attempts(get, 3, 2.0, sleep=slept.append) == "body" and slept == [1.0, 2.0]
    with pytest.raises(OSError):
        landing.attempts(lambda: (_ for _ in ()).throw(OSError("x")), 2, patient=True, sleep=slept.append)
    assert slept[2:] == [15, 30, 60, 120]
    assert list(landing.pages(lambda k: [k] * (2 if k < 3 else 1), 2, 50)) == [[1, 1], [2, 2], [3]]
    assert list(landing.pages(lambda k: [k] * 2, 2, 3)) == [[1, 1], [2, 2], [3, 3]]
    assert landing.first_large([("a", ""), ("b", "xx"), ("c", "xxxxxx")], 5) == ("c", "xxxxxx")


def test_sinks(spark, tmp_path):
    empty = table(spark, "iso3 string, x double")
    rows = table(spark, "iso3 string, x double", ("B", 1.0), ("A", None))
    at = datetime(2026, 5, 30)
    report = sinks.run_steps(spark, [("good", lambda s: rows, empty), ("bad", lambda s: s.read.parquet("/nowhere"), empty)], str(tmp_path / "r"), at)
    assert {(r.feed, r.ok) for r in report.collect()} == {("good", True), ("bad", False)}
    assert spark.read.parquet(str(tmp_path / "r/good")).count() == 2 and spark.read.parquet(str(tmp_path / "r/bad")).columns == ["iso3", "x"]
    with pytest.raises(RuntimeError):
        sinks.run_steps(spark, [("bad", lambda s: s.read.parquet("/nowhere"), empty)], str(tmp_path / "r2"), at, allowed=0)
    sinks.write_json(rows, str(tmp_path / "j"), "iso3")
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"iso3":"A"}', '{"iso3":"B","x":1.0}']
    many = spark.range(9)
    assert sinks.keep_better(many, str(tmp_path / "k")) and not sinks.keep_better(spark.range(2), str(tmp_path / "k")) and sinks.keep_better(spark.range(6), str(tmp_path / "k"))
    good, bad = (table(spark, "check string, passed boolean", ("c", p)) for p in (True, False))
    sinks.write_checked(many, good, str(tmp_path / "w"))
    with pytest.raises(ValueError, match="c"):
        sinks.write_checked(many, bad, str(tmp_path / "w"))


def test_a_feed_that_fails_in_its_last_partition_stops_no_other(spark, tmp_path):
    empty, at = table(spark, "id long"), datetime(2026, 5, 30)
    late = lambda s: s.range(0, 1000, 1, 8).select(F.when(F.col("id") == 999, F.raise_error("late")).otherwise(F.col("id")).cast("long").alias("id"))
    spark.range(3).write.parquet(str(tmp_path / "a"))
    report = sinks.run_steps(spark, [("a", late, empty), ("b", lambda s: s.range(4), empty)], str(tmp_path), at)
    assert [(r.feed, r.ok) for r in report.collect()] == [("a", False), ("b", True)]
    assert spark.read.parquet(str(tmp_path / "a")).count() == 0 and spark.read.parquet(str(tmp_path / "b")).count() == 4
    notes = {r.feed: r.notes for r in spark.read.parquet(str(tmp_path / "_meta")).collect()}
    assert "late" in notes["a"] or "failed" in notes["a"]
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith(("_new-", "_old-"))]
    # a guarded writer leaves what was there
    with pytest.raises(Exception, match="late"):
        sinks.keep_better(late(spark), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 4
    seen = []
    sinks.write_checked(spark.range(7), lambda written: seen.append(written.count()) or table(spark, "check string, passed boolean", ("c", True)), str(tmp_path / "b"))
    assert seen == [7] and spark.read.parquet(str(tmp_path / "b")).count() == 7


def test_feeds_that_are_not_configured(spark):
    empty = table(spark, "id long")
    rows, note = sinks.gated("acled", {"KEY": " ", "EMAIL": "x"}, ["KEY", "EMAIL", "OTHER"], lambda: spark.range(2), empty)
    assert rows.count() == 0 and note == "acled not configured: set KEY, OTHER"
    rows, note = sinks.gated("acled", {"KEY": "k"}, ["KEY"], lambda: spark.range(2), empty)
    assert rows.count() == 2 and note == ""


def test_pages_by_offset():
    def get(offset, size):
        if offset == 2:
            raise OSError("no")
        return list(range(offset, min(offset + size, 7)))

    assert list(landing.offset_pages(get, lambda: 7, 2)) == [[0, 1], [4, 5], [6]]
    assert list(landing.offset_pages(get, lambda: 0, 2)) == []


def test_workbooks_by_sheet_name_with_rich_text(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Notes" sheetId="1" r:id="rId1"/><sheet name="Monthly Prices" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>plain</t></si><si><r><rPr/><t xml:space="preserve">rich </t></r><r><t>text</t></r><rPh><t>hint</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"/><c r="AB4"><v>2.5</v></c></row><row r="5"><c r="C5" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    cells = lambda *a: {(r.row, r.col, r.value) for r in landing.workbook_cells(spark, str(tmp_path / "b.xlsx"), *a).collect()}
    assert cells("Monthly Prices") == {(4, 0, "rich text"), (4, 27, "2.5"), (5, 2, "in")} and cells() == {(1, 0, "plain")} and cells("none") == set()
    assert landing.workbook_cells(spark, str(tmp_path / "none.xlsx")).count() == 0


def test_records_with_braces_in_strings_comments_and_nesting(spark):
    js = """const X = [{iso:'AAA', name:"a } {iso:'no'} \\"q\\"", /* {iso:'ZZZ', */ fdrs:1.5, // {iso:'YYY'}
      trend:{years:[1,2], note:'x{'}, c:[1,-2,.5,], imports:['O\\'Neil','b',], region:`R`, }, {other:1, name:'skip'}, {"iso":"BBB", name:undefined, w:-3e1}];"""
    out = by(landing.js_records(texts(spark, js)), "iso")
    assert set(out) == {"AAA", "BBB"}
    assert (out["AAA"]["name"], out["AAA"]["fdrs"], out["AAA"]["c"], out["AAA"]["imports"], out["AAA"]["region"]) == ("a } {iso:'no'} \"q\"", 1.5, [1.0, -2.0, 0.5], ["O'Neil", "b"], "R")
    assert out["BBB"]["name"] is None and out["BBB"]["w"] == -30.0 and out["BBB"]["imports"] == []


def test_company_files_are_told_apart_by_name(spark, tmp_path):
    claim = lambda host: {"iso3": "BRA", "citation_url": f"https://{host}/x"}
    for name, host in (("b", "second.org"), ("a", "first.org"), ("_x", "hidden.org")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"_meta": {"company": "C"}, "commodities": [{"name": "soy", "sourcing_countries": [claim(host)]}]}))
    from tillage.operators import companies

    assert {r.primary_citation for r in companies.rollup(landing.company_documents(spark, str(tmp_path))).collect()} == {"first.org"}


def test_whole_texts_are_one_row_a_file(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text('[1,\n{"a":\n2}]\n')
    assert [r.value for r in landing.whole_text(spark, str(tmp_path)).collect()] == ['[1,\n{"a":\n2}]\n'] * 2
    assert landing.whole_text(spark, str(tmp_path / "none")).count() == 0


def test_an_envelope_is_read_as_it_was_written(spark, tmp_path):
    at = datetime(2026, 5, 30, 1, 2, 3)
    rows = spark.createDataFrame([(f"K{k:04d}" if k else 'q"\\é\n', k, None if k % 3 else float(k)) for k in range(500)], "iso3 string, n long, x double").repartition(9)
    path = str(tmp_path / "sub" / "e.json")
    for _ in range(2):  # the second takes the first one's place
        sinks.write_envelope(rows, path, "iso3", "S", 'a "note"', at, "v2")
    text = json.loads((tmp_path / "sub" / "e.json").read_text())
    assert list(text) == ["_meta", "data"] and list(text["data"]) == sorted(text["data"], key=str.encode) and text["data"]["K0004"] == {"n": 4, "x": None} and len(text["data"]) == 500
    doc = landing.envelope(spark, path, "map<string,struct<n:bigint,x:double>>")
    assert sorted(map(str, landing.keyed_rows(doc).collect())) == sorted(map(str, rows.collect()))
    assert doc.select("_meta.*").first() == (at, "S", 'a "note"', "v2")
    sinks.write_envelope(rows.limit(0), str(tmp_path / "none.json"), "iso3", "S", "", at)
    assert json.loads((tmp_path / "none.json").read_text())["data"] == {}
    for odd in (rows.union(rows.limit(1)), rows.withColumn("iso3", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="iso3"):
            sinks.write_envelope(odd, path, "iso3", "S", "", at)
    assert len(json.loads((tmp_path / "sub" / "e.json").read_text())["data"]) == 500
    assert [p.name for p in (tmp_path / "sub").iterdir() if not p.name.startswith(".")] == ["e.json"]


def test_rules_are_told_by_the_one_pass_that_writes(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(0, 1000, 1, 5).mapInArrow(count, "id long").withColumn("x", F.when(F.col("id") % 10 != 0, F.col("id").cast("double")))
    rules = [health.rows_at_least(1000), health.known_at_least("x", 900), health.within("x", 0, 999), health.keys_present("id", [0, 5, 999]), health.no_rows("no id 7000", F.col("id") == 7000)]
    report = sinks.write_watched(rows, rules, str(tmp_path / "t"))
    assert [(r.found, r.passed) for r in report.collect()] == [(1000, True), (900, True), (0, True), (0, True), (0, True)] and read.value == 1000
    bad = [health.rows_at_least(1001), health.keys_present("id", [5, 1000, 1001]), health.known_at_least("x", 1)]
    with pytest.raises(ValueError, match="at least 1001 rows, 3 keys of id present$"):
        sinks.write_watched(rows, bad, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000 and [p.name for p in tmp_path.iterdir()] == ["t"]
    read.value = 0
    assert sinks.keep_better(rows, str(tmp_path / "t")) and read.value == 1000


def test_a_writer_that_died_while_publishing_loses_nothing(spark, tmp_path):
    path = tmp_path / "feed"
    spark.range(7).write.parquet(str(path))
    path.rename(tmp_path / "_old-feed-abc")  # between its two renames
    (tmp_path / "_new-feed-abc").mkdir()
    assert sinks.published(spark, str(path), "id long").count() == 7
    path.rename(tmp_path / "_old-feed-abd")
    assert not sinks.keep_better(spark.range(2), str(path)) and spark.read.parquet(str(path)).count() == 7
    assert sinks.published(spark, str(tmp_path / "never"), "id long").count() == 0 and not sinks.recover(spark, str(path))


def test_a_run_gates_guards_and_reports(spark, tmp_path):
    empty, at, root = table(spark, "id long"), datetime(2026, 5, 30), str(tmp_path)
    good = lambda n: lambda s: s.range(n)
    fails = lambda s: s.read.parquet("/nowhere")
    steps = lambda a, b, c: [sinks.Step("keyed", good(3), empty, needs=("KEY",)), sinks.Step("trade", a, empty, least=5), sinks.Step("food", b, empty, rules=(health.rows_at_least(150),)), ("plain", c, empty)]
    run = lambda *s, **more: {r.feed: (r.notes, r.ok) for r in sinks.run_steps(spark, steps(*s), root, at, **more).collect()}
    rows = lambda feed: spark.read.parquet(f"{root}/{feed}").count()
    assert run(good(9), good(200), good(1)) == {"keyed": ("keyed not configured: set KEY", True), "trade": ("", True), "food": ("", True), "plain": ("", True)}
    assert [rows(f) for f in ("keyed", "trade", "food", "plain")] == [0, 9, 200, 1]
    again = run(good(2), good(10), fails, settings={"KEY": "k"})
    assert again["keyed"] == ("", True) and "kept" in again["trade"][0] and again["trade"][1] and "at least 150 rows" in again["food"][0] and not again["food"][1] and not again["plain"][1]
    assert [rows(f) for f in ("keyed", "trade", "food", "plain")] == [3, 9, 200, 0]
    assert "kept" not in str(run(fails, fails, good(4))) and [rows(f) for f in ("trade", "food", "plain")] == [9, 200, 4]
    notes = {r.feed: r.notes for r in spark.read.parquet(f"{root}/_meta").collect()}
    assert "failed" in notes["food"] and notes["plain"] == ""


def test_features_as_variants_are_parsed_once(spark):
    square = [[[170, -10], [-170, -10], [-170, 10], [170, 10], [170, -10]]]
    docs = [
        {"features": [{"properties": {"name": "Line", "iso3": "FJI"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": '{"iso3": "KEN", "fcs": 0.5}'}, {"iso3": "UGA"}, None, 3]},
        {"body": {"features": [{"properties": None, "iso3": "TZA"}]}}, [{"properties": {"adm0_code": "tza"}}], {"ETH": {"fcs": 1}, "NOTE": {}, "SOM": "x"}, "broken", None,
    ]
    found = landing.feature_properties(texts(spark, *docs))
    get = lambda p: F.try_variant_get("props", f"$.{p}", "string")
    assert sorted(map(str, (tuple(r) for r in found.select("key", F.coalesce(get("iso3"), get("adm0_code"))).collect()))) == sorted(map(str, [(None, "FJI"), (None, "KEN"), (None, "UGA"), (None, "TZA"), (None, "tza"), ("ETH", None)]))
    assert [tuple(r) for r in feeds.places(texts(spark, *docs)).collect()] == [("Line", 0.0, 180.0)]
    given = texts(spark, *docs)
    for df, n in ((feeds.hungermap(given), 2), (feeds.places(given), 2), (landing.year_mean(given), 1), (landing.fields(given), 1)):  # a text that stands for properties is a text of its own
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == n


def test_pages_are_tasks(spark, tmp_path):
    from tillage.sources import paged

    log = str(tmp_path / "tries")

    def get(offset, size):
        with open(log, "a") as f:
            f.write(f"{offset}\n")
        if offset == 20 or (offset == 10 and open(log).read().split().count("10") < 2):
            raise OSError("no")
        return [(k, f"r{k}") for k in range(offset, min(offset + size, 47))]

    rows = lambda **more: paged.offset_rows(spark, get, lambda: 47, "id long, name string", 10, tries=2, backoff=0.01, **more)
    df = rows()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(r.id for r in df.collect()) == [k for k in range(47) if not 20 <= k < 30]
    assert open(log).read().split().count("20") == 2 and open(log).read().split().count("10") == 2
    with pytest.raises(Exception, match="no"):
        rows(strict=True).collect()
    assert paged.offset_rows(spark, get, lambda: 0, "id long, name string").collect() == []
    numbered = paged.numbered_rows(spark, lambda k: [(k,)] * (3 if k < 3 else 1 if k == 3 else 0), "page long", 5)
    assert sorted(r.page for r in numbered.collect()) == [1, 1, 1, 2, 2, 2, 3]


def test_members_of_archives_are_tasks(spark, tmp_path):
    from tillage.sources import paged

    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for m in ("a.csv", "b.csv", "notes.txt"):
                z.writestr(m, "".join(f"{k},{m},é{n}\r\n" for n in range(3)).encode("latin-1"))
    df = paged.member_lines(spark, str(tmp_path), encoding="latin-1")
    assert df.rdd.getNumPartitions() == 4
    assert sorted((r.archive[-5:], r.member, r.line, r.value) for r in df.collect()) == sorted((f"{k}.zip", m, n, f"{k},{m},é{n}") for k in range(2) for m in ("a.csv", "b.csv") for n in range(3))
    assert paged.member_lines(spark, str(tmp_path / "0.zip"), "notes").count() == 3 and paged.member_lines(spark, str(tmp_path / "none.zip")).count() == 0
