from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tillage.functions import bands, dates, geo, numeric, parse, text
from tillage.operators import change, companies, health, latest, nowcast, reshape, resolve, scenario, scores, shares, trade


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def calc(spark, column, **inputs):
    """The value of an expression over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items())) if inputs else spark.range(1)
    return row.select(column).first()[0]


# --- functions --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("x, places, want", [(0.25, 1, 0.3), (0.35, 1, 0.4), (2.5, 0, 3.0), (-2.5, 0, -2.0), (-0.5, 0, 0.0), (1.005, 2, 1.0), (7.0, 1, 7.0), (None, 1, None)])
def test_round_half_up(spark, x, places, want):
    assert calc(spark, numeric.round_half_up("x", places), x=float(x) if x is not None else None) == want if x is not None else True


@pytest.mark.parametrize("score, label, colour", [(0.0, "Resilient", "#6ba36b"), (25.0, "Resilient", "#6ba36b"), (25.1, "Exposed", "#c9a957"), (50.0, "Exposed", "#c9a957"), (75.0, "Dependent", "#d27a3e"), (75.5, "Structurally Vulnerable", "#c44b3c"), (88.0, "Structurally Vulnerable", "#c44b3c"), (88.1, "Structurally Vulnerable", "#7a2922")])
def test_risk_bands(spark, score, label, colour):
    assert calc(spark, bands.risk_label("s"), s=score) == label and calc(spark, bands.risk_colour("s"), s=score) == colour


def test_phases_and_tiers(spark):
    assert [calc(spark, bands.phase_label("p"), p=p) for p in (1, 3, 5, 6)] == ["Minimal (1)", "Crisis (3)", "Famine (5)", "—"]
    assert [calc(spark, bands.concentration_tier("h"), h=h) for h in (61.0, 60.0, 30.5, 30.0)] == ["High concentration risk", "Moderate concentration", "Moderate concentration", "Well diversified"]


def test_parsing(spark):
    assert [calc(spark, parse.number("x"), x=x) for x in ("1.5", " 2 ", "..", "NA", "", "n/k", "nan", "-999999", "…", "1e3")] == [1.5, 2.0, None, None, None, None, None, None, None, 1000.0]
    assert [calc(spark, parse.integer("x"), x=x) for x in ("3.9", "-3.9", "x")] == [3, -3, None]
    assert [calc(spark, parse.month_start("x"), x=x) for x in ("2026-04", "Apr-26", "2026M04", "2026-13", "April", "")] == [date(2026, 4, 1)] * 3 + [None] * 3
    assert [calc(spark, parse.month_token("x"), x=x) for x in ("2026M04", "2026-04")] == ["2026-04", None]
    assert [calc(spark, parse.country_key("x"), x=x) for x in (" usa ", "US", "U1A", "")] == ["USA", None, None, None]
    assert calc(spark, parse.iso_date("x"), x="2026-05-30T19:39:08Z") == date(2026, 5, 30)


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    assert calc(spark, dates.period_label(d("2026-01-01"), d("2026-03-31"))) == "Jan–Mar 2026"
    assert calc(spark, dates.period_label(d("2025-11-01"), d("2026-01-31"))) == "Nov 2025 – Jan 2026"
    assert calc(spark, dates.months_apart(d("2026-05-01"), d("2025-12-31"))) == 5


def test_text(spark):
    assert [calc(spark, text.severity("t"), t=t) for t in ("IPC 5 and acute", "Acute need", "Calm", "")] == ["high", "med", "low", "low"]
    assert [calc(spark, text.url_host("u"), u=u) for u in ("https://a.org:80/x", "a.org/x", "http://u@h")] == ["a.org:80", None, "u@h"]
    assert calc(spark, text.first_link("h", r'https://x/[^"]*'), h='<a href="https://x/a.csv?a=1&amp;b=2">') == "https://x/a.csv?a=1&b=2"
    assert calc(spark, text.first_link("h", r"https://x/"), h="nothing") is None
    assert calc(spark, text.trimmed_parts("s", "·"), s="a ·b· c") == ["a", "b", "c"]
    assert calc(spark, text.header_key("s"), s="Item Code (CPC)") == "itemcode"


def test_great_circle(spark):
    path = calc(spark, geo.great_circle(*(F.lit(x) for x in (0.0, 0.0, 0.0, 90.0)), steps=2))
    assert [(p.step, round(p.lat, 6), round(p.lon, 6)) for p in path] == [(0, 0.0, 0.0), (1, 0.0, 45.0), (2, 0.0, 90.0)]
    same = calc(spark, geo.great_circle(*(F.lit(x) for x in (5.0, 5.0, 5.0, 5.0)), steps=1))
    assert [(p.lat, p.lon) for p in same] == [(5.0, 5.0)] * 2
    assert calc(spark, geo.opacity("s"), s=100.0) == pytest.approx(0.96)


# --- series -----------------------------------------------------------------------------------------------------------


def test_latest_ties_nulls_and_wide(spark):
    rows = table(spark, "k int, year int, ord int, v double", (1, 2020, 1, 1.0), (1, 2021, 2, 2.0), (1, 2021, 3, 3.0), (1, 2022, 4, None), (2, 2020, 5, None))
    assert values(latest.latest(rows, ["k"], [F.col("year"), -F.col("ord")], ["year", "v"])) == [(1, 2022, None), (2, 2020, None)]
    assert values(latest.latest_nonnull(rows, ["k"], [F.col("year"), -F.col("ord")], "v", ["year", "v"])) == [(1, 2021, 2.0)]
    wide = table(spark, "k int, a double, b double, c double", (1, 1.0, None, None), (2, 1.0, 2.0, None), (3, None, None, None))
    assert values(wide.select("k", *latest.newest_of_wide({2020: F.col("a"), 2021: F.col("b"), 2022: F.col("c")}))) == [(1, 2020, 1.0), (2, 2021, 2.0), (3, None, None)]


def test_nth_back_and_both_sides(spark):
    rows = table(spark, "k int, t int, v double", *((1, t, float(t)) for t in range(100)), (2, 1, 5.0), (2, 2, None))
    assert values(latest.nth_back(rows, ["k"], [F.col("t")], "v", 90)) == [(1, 99.0, 10.0, 90), (2, 5.0, 5.0, 1)]
    sides = table(spark, "k int, p int, year int, a double, b double", (1, 0, 2022, 1.0, None), (1, 0, 2020, 1.0, 2.0), (1, 1, 2023, 3.0, 4.0), (2, 1, 2021, 5.0, 6.0), (3, 0, 2021, None, 6.0))
    assert values(latest.latest_with_both(sides, ["k"], "p", "year", "a", "b")) == [(1, 0, 2020, 1.0, 2.0), (2, 1, 2021, 5.0, 6.0)]


def test_changes(spark):
    rows = table(spark, "k int, t int, v double", (1, 1, 100.0), (1, 2, 103.0), (2, 1, 5.0), (3, 1, 0.0), (3, 2, 4.0), (4, 1, -2.0), (4, 2, 1.0), (4, 3, None))
    assert values(change.last_change(rows, ["k"], "t", "v"), "k", "change_pct") == [(1, 3.0), (2, None), (3, None), (4, None)]
    assert values(change.last_change(rows, ["k"], "t", "v", above=None), "k", "change_pct") == [(1, 3.0), (2, None), (3, None), (4, -150.0)]
    assert values(change.growth_rate(rows, ["k"], "t", "v"), "k", "growth_pct") == [(1, 3.0), (2, None), (3, None), (4, None)]
    assert values(change.indexed(rows, ["k"], "t", "v").where("k = 1 or k = 3"), "k", "t", "index") == [(1, 1, 100.0), (1, 2, 103.0), (3, 1, None), (3, 2, None)]


def test_trailing_windows_count_points(spark):
    rows = table(spark, "k int, t int, v double", *((1, t, 1.0) for t in range(23)), *((1, t, 4.0) for t in range(40, 47)), *((2, t, 1.0) for t in range(29)), *((3, t, 1.0) for t in range(13)), *((4, t, 0.0) for t in range(30)))
    rain = {r.k: r.anomaly_pct for r in change.rain_anomaly(rows, ["k"], "t", "v").collect()}
    base = 51 * (7 / 30)
    assert rain == {1: math.floor((28 - base) / base * 100 * 10 + 0.5) / 10, 2: None, 3: None, 4: None}
    assert values(change.river_anomaly(rows, ["k"], "t", "v"), "k", "anomaly_pct", "flood_flag") == [(1, 135.3, True), (2, 0.0, False), (4, None, False)]


@pytest.mark.parametrize("first, last, want", [(100.0, 75.0, "normal"), (100.0, 74.0, "low"), (100.0, 150.0, "normal"), (100.0, 151.0, "high"), (0.0, 9.0, "normal"), (9.0, 0.2, "normal")])
def test_first_to_last(spark, first, last, want):
    rows = table(spark, "k int, t int, v double", (1, 1, first), (1, 2, None), (1, 3, last))
    assert change.first_to_last(rows, ["k"], ["t"], "v").first().anomaly == want


# --- shares, lookups --------------------------------------------------------------------------------------------------


def test_shares_concentration_mode_histogram(spark):
    rows = table(spark, "p string, c string, v double", *(("x", f"c{k}", float(10 - k)) for k in range(7)), ("x", "c0", 5.0), ("x", "c9", -5.0), ("y", "only", 1.0))
    top = shares.partner_shares(rows, ["p"], "c", "v")
    assert values(top.where("p = 'x'"), "rank", "c", "value", "share_pct")[0] == (1, "c0", 15.0, 27.8) and top.where("p = 'x'").count() == 5
    assert values(shares.concentration(top, ["p"]), "p", "hhi", "tier")[1] == ("y", 100.0, "High concentration risk")
    cited = table(spark, "k int, h string, o int", (1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (1, None, 5), (2, None, 1))
    assert values(shares.most_frequent(cited, ["k"], "h", F.col("o"))) == [(1, "b", 2)]
    assert values(shares.histogram(cited, F.col("h"), ["a", "b", "z"])) == [(0, "a", 2), (1, "b", 2), (2, "z", 0)]


def test_two_step_lookup_and_priority(spark):
    rows = table(spark, "code string, name string", ("A", "x"), ("?", "Burma"), ("?", "EU"), ("?", "?"))
    first, second = table(spark, "c string, k string", ("A", "AAA")), table(spark, "n string, k string", ("Burma", "MMR"), ("EU", None), ("x", "XXX"))
    assert values(resolve.two_step(rows, first, second, F.col("code"), F.col("name")), "name", "iso3") == [("Burma", "MMR"), ("x", "AAA")]
    c = table(spark, "k int, p int, v double", (1, 2, 9.0), (1, 1, 3.0), (1, 1, 4.0), (2, 3, 1.0))
    assert values(resolve.by_priority(c, ["k"], "p", ["v"])) == [(1, 4.0), (2, 1.0)]


def test_overlay_and_superseded_overrides(spark):
    t = lambda *rows: table(spark, "iso string, field string, value double", *rows)
    layers = [("legacy", t(("A", "w", 1.0), ("A", "n", 1.0), ("B", "w", 1.0))), ("shares", t(("A", "w", 3.0), ("Z", "w", 3.0))), ("override", t(("A", "w", 2.0), ("A", "n", 2.0), ("B", "w", 2.0), ("C", "w", 2.0)))]
    assert values(resolve.overlay(layers, ["iso", "field"], "value", {"override": ("shares",)})) == [("A", "n", 2.0, "override"), ("A", "w", 3.0, "shares"), ("B", "w", 2.0, "override")]


def test_closest_name(spark):
    names = table(spark, "name string, key string, ord int", ("Niger", "NER", 1), ("Nigeria", "NGA", 2), ("Korea, South", "KOR", 3), ("UK", "GBR", 4), ("", "XXX", 0))
    aliases = table(spark, "alias string, name string", ("South Korea", "korea, south"), ("nowhere", "no such"))
    asked = table(spark, "needle string", ("nigeria",), ("Republic of Niger",), ("South Korea",), ("the uk",), (" ",), ("Nig",), ("Peru",), ("U",), (None,))
    got = {r.needle: (r.how, r.key) for r in resolve.closest_name(asked, names, aliases).collect()}
    assert got == {"nigeria": ("exact", "NGA"), "Republic of Niger": ("partial", "NER"), "South Korea": ("alias", "KOR"), "the uk": ("partial", "GBR"), "Nig": ("partial", "NER"), "U": ("partial", "KOR")}


def test_names_inside_texts(spark):
    import random
    import time

    from tillage.operators.grams import grams, names_inside

    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abé😀 ") for _ in range(k))
    texts = [(k, word(rng.randrange(0, 60))) for k in range(150)] + [(500, None), (501, ""), (502, "abab"), (502, "é"), (None, "abab")]
    names = [word(rng.randrange(0, 7)) for _ in range(80)] + ["", None, "abab", "abab", "nowhere at all"]
    got = names_inside(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(map(tuple, got.collect())) == sorted({(i, n) for i, t in texts for n in names if i is not None and t and n and n in t})
    assert calc(spark, grams(F.lit("ababa"), 4)) == ["abab", "baba"] and calc(spark, grams(F.lit("aba"), 4)) == [] and calc(spark, grams(F.lit(""), 1)) in ([], [""])
    long, begun = " ".join(str(k * 7919) for k in range(60_000)), time.monotonic()  # 500,000 characters
    got = names_inside(spark.createDataFrame([(1, long + " needle here"), (2, long)], "id long, text string"), spark.createDataFrame([("needle",), ("7919",), ("absent",)], "name string"))
    assert sorted(map(tuple, got.collect())) == [(1, "7919"), (1, "needle"), (2, "7919")] and time.monotonic() - begun < 60


@pytest.mark.parametrize("sent", [0, 32 << 20])
def test_names_inside_look_at_a_word_once(spark, monkeypatch, sent):
    from pathlib import Path

    from tillage.operators import grams
    from tillage.session import shared_folder

    monkeypatch.setattr(grams, "SENT", sent)
    written = lambda: set(Path(f"{shared_folder(spark).removeprefix('file:')}/tillage-{spark.sparkContext.applicationId}").glob("grams-*"))
    texts, names = "alpha bolts  hotbolt cold  plates", ["bolt", "hot", "ts  h", "  ", "   ", " ", "d  plate", "old plate", "alpha bolts", "alpha  bolts", "zzzz bolt"]
    before = written()
    got = grams.names_inside(table(spark, "id long, text string", *((k, texts) for k in range(300))), table(spark, "name string", *((n,) for n in names)))
    assert values(got) == sorted(((k, n) for k in range(300) for n in names if n in texts), key=str)
    (folder,) = written() - before
    assert spark.read.parquet(str(folder)).count() < 60  # a posting for a different word and gram, not for a text


def test_reshape(spark):
    df = table(spark, "k int, `2020` double, `2021` double, other string", (1, 1.0, None, "x"))
    assert reshape.year_columns(df) == {2020: "2020", 2021: "2021"}
    assert values(reshape.to_long(df, ["k"], ["2020", "2021"])) == [(1, "2020", 1.0), (1, "2021", None)]
    z = calc(spark, reshape.zipped(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(40.0), F.lit(0.0)), 20.0))
    assert [(r.pos, r.name, r.weight) for r in z] == [(1, "a", 40.0), (2, "b", 20.0), (3, "c", 20.0)]
    assert calc(spark, reshape.mean_of(F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)))) == 2.0
    assert calc(spark, reshape.mean_of(F.array().cast("array<double>"))) is None


# --- nowcast ----------------------------------------------------------------------------------------------------------


def feed(spark, name, *rows):
    return table(spark, "key string, " + ", ".join(f"{c} {k}" for c, k in nowcast.FEEDS[name].items()), *rows)


def components(spark, mom=None, **feeds):
    month = table(spark, "change_mom_pct double", (mom,)) if mom is not None else None
    rows = nowcast.nowcast({k: feed(spark, k, *v) for k, v in feeds.items()}, month).collect()
    return {r.key: r.asDict() for r in rows}


def test_each_component_at_its_thresholds(spark):
    out = components(
        spark, ipc=[("A", 50.0), ("B", 100.0), ("C", None)], hungermap=[("A", 30.0), ("B", 70.0), ("C", 100.0)], conflict=[("A", 100.0), ("B", 40.0)], reports=[("A", 3), ("B", 2), ("C", 0), ("NOT_IN_SPINE", 5)],
        hungermap_country=[("A", -10.0, 15.0), ("B", -11.0, 20.0), ("C", -50.0, None), ("D", None, None)], eurostat=[("C", 8.0), ("D", 9.0), ("A", 99.0)], faostat=[("D", 99.0), ("E", 46.0)],
        weather=[("A", -60.0, 4.0, True, True, False), ("B", None, None, False, True, False)], rivers=[("A", True)], fires=[("A", True)], air=[("A", 40.0, True)], us_water=[("US-MO", "high"), ("A", "low")], inform=[("A", 7.0), ("B", 8.0), ("C", 9.9), ("US-MO", None)],
        governance=[("A", -1.0), ("B", -2.0), ("C", -9.0)], staples=[("A", 39.0, 100.0, 19.0, 100.0, None, None), ("B", 4.0, 100.0, None, None, None, None), ("C", 390.0, 1000.0, 5.0, 0.0, None, None)],
    )
    assert set(out) == {"A", "B", "C", "D", "E", "US-MO"}
    pick = lambda c: {k: v[c] for k, v in out.items() if v[c]}
    assert pick("ipc_pressure") == {"A": 6.0, "B": 12.0} and pick("wfp_pressure") == {"B": 6.0, "C": 6.0} and pick("conflict_kick") == {"A": 5.0, "B": 2.0} and pick("relief_damp") == {"A": -2.0, "B": -1.0}
    assert pick("fx_shock") == {"B": 0.1, "C": 3.0} and pick("inflation_shock") == {"B": 0.5, "D": 0.1, "E": 3.0}
    assert {k: v["food_inflation_source"] for k, v in out.items()} == {"A": "hungermap", "B": "hungermap", "C": "eurostat", "D": "eurostat", "E": "faostat", "US-MO": None}
    assert pick("weather_kick") == {"A": 4.0, "B": 1.5} and pick("flood_kick") == {"A": 3.0} and pick("fire_kick") == {"A": 2.0} and pick("aq_kick") == {"A": 1.0} and pick("us_water_kick") == {"US-MO": 2.0}
    assert pick("inform_amp") == {"B": 1.5, "C": 3.0} and pick("governance_drag") == {"B": 1.5, "C": 2.0} and pick("psd_shortfall") == {"A": 2.0, "B": 3.0}
    assert out["A"]["adjustment"] == 6 + 5 - 2 + 4 + 3 + 2 + 1 + 2 and out["C"]["phase3plus_pct"] == 0.0 and out["D"]["fx_90d_change_pct"] is None


@pytest.mark.parametrize("mom, kick", [(None, 0.0), (1.0, 0.0), (1.01, 1.0), (3.0, 1.0), (3.01, 2.0), (-9.0, 0.0)])
def test_world_price_kick_is_for_all(spark, mom, kick):
    assert {v["global_food_kick"] for v in components(spark, mom, ipc=[("A", 0.0), ("B", 1.0)]).values()} == {kick}


def test_sum_is_capped_and_rounded_once(spark):
    out = components(
        spark, 9.0, ipc=[("A", 100.0), ("B", 0.4)], hungermap=[("A", 100.0), ("B", 30.3)], conflict=[("A", 100.0)], hungermap_country=[("A", -90.0, 90.0)], weather=[("A", 0.0, 9.0, True, True, True)], rivers=[("A", True)], fires=[("A", True)], air=[("A", 99.0, True)], inform=[("A", 10.0)], governance=[("A", -2.5)], staples=[("A", 0.0, 9.0, None, None, None, None)],
    )
    assert out["A"]["adjustment"] == 35.0
    assert out["B"]["adjustment"] == 2.1 and out["B"]["ipc_pressure"] == 0.0 and out["B"]["wfp_pressure"] == 0.0


def test_movers_and_channels(spark):
    adj = components(spark, ipc=[(k, p) for k, p in (("A", 70.0), ("B", 70.0), ("C", 66.0), ("US-XX", 99.0), ("D", 80.0), ("E", 90.0))])
    rows = nowcast.nowcast({"ipc": feed(spark, "ipc", *((k, v["phase3plus_pct"]) for k, v in adj.items()))})
    assert [tuple(r) for r in nowcast.movers(rows).collect()] == [("E", 10.8), ("D", 9.6), ("A", 8.4)]
    both = nowcast.nowcast({"ipc": feed(spark, "ipc", ("A", 50.0)), "conflict": feed(spark, "conflict", ("A", 120.0)), "rivers": feed(spark, "rivers", ("A", True)), "fires": feed(spark, "fires", ("A", True))})
    assert values(nowcast.top_channels(both), "rank", "channel", "points") == [(1, "ipc_pressure", 6.0), (2, "conflict_kick", 5.0), (3, "flood_kick", 3.0)]


# --- scores -----------------------------------------------------------------------------------------------------------

PROFILE = "iso string, name string, region string, fdrs double, c array<double>, f2030 double, w double, r double, m double, net double, fi double, production array<double>, consumption array<double>"


def profile(iso="AAA", fdrs=60.0, c=(10.0, 20.0, 30.0, 40.0, 50.0, 60.0), f2030=70.0, w=50.0, r=30.0, m=10.0, net=-1500.0, fi=31.0, made=(1.0, 2.0, 3.0), used=(4.0, 6.0, 9.0)):
    return (iso, f"Name {iso}", "R", fdrs, list(c), f2030, w, r, m, net, fi, list(made), list(used))


def test_scores(spark):
    p = table(spark, PROFILE, profile(), profile("US-AL", 80.0, f2030=80.0, made=(1.0,)))
    assert values(scores.structural(p))[0] == ("AAA", 28.5, "Exposed")
    assert values(scores.forecast(p)) == [("AAA", 4.0, 10.0, 14.0, "worsening"), ("US-AL", None, 0.0, 10.0, "improving")]
    assert values(scores.matrix(p))[0] == ("AAA", 55.0, 10.0)
    assert scores.stats(p).first().asDict() == {"n": 2, "vulnerable": 0, "mean_score": 70.0, "mean_wheat": 50.0, "high_inflation": 1, "rising": 1}
    h = scores.headline(scores.structural(p), table(spark, "key string, adjustment double", ("AAA", 90.0), ("ZZZ", 1.0)))
    assert values(h, "iso", "headline") == [("AAA", 100.0), ("US-AL", 28.5)]
    assert calc(spark, scores.blended(F.col("a"), F.col("b")), a=10.0, b=20.0) == 14.0
    assert values(scores.compared(p, "AAA", "US-AL"), "component", "delta") == [(k, 0.0) for k in range(6)]


def test_percentiles_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [profile(f"K{k:02d}", float(rng.randrange(12))) for k in range(40)]
    want = []
    for r in rows:
        near = sorted((abs(q[3] - r[3]), q[0]) for q in rows if q[0] != r[0])[:3]
        lower = math.floor(sum(q[3] < r[3] for q in rows) / 39 * 100 + 0.5)
        want += [(r[0], r[3], float(lower), k, q, d) for k, (d, q) in enumerate(near, 1)]
    assert values(scores.percentiles(table(spark, PROFILE, *rows))) == sorted(want, key=str)
    assert scores.percentiles(table(spark, PROFILE, profile())).count() == 0


def test_scenarios(spark):
    p = table(spark, PROFILE, profile(), profile("BBB", 99.0, c=(0.0,) * 6, w=0.0, r=0.0, m=0.0), profile("CCC", 74.0, c=(0.0, 100.0, 100.0, 0.0, 0.0, 0.0), w=None, r=0.0, m=0.0))
    got = {r.scenario: r.impact for r in scenario.impacts(p.where("iso = 'AAA'")).collect()}
    assert got == {"wheat20": 3.0, "rice20": 2.0, "maize20": 0.0, "fert30": 7.0, "drought": 8.0, "oil25": 7.0, "ban": 4.0, "fx": 5.0, "ship": 5.0, "conflict": 9.0}
    s = scenario.stressed(p, ["ban", "fx"])
    assert values(s, "iso", "delta", "new_score", "crosses") == [("AAA", 9.0, 69.0, False), ("BBB", 0.0, 99.0, False), ("CCC", 18.0, 92.0, True)]
    assert scenario.summary(s).first().asDict() == {"crossings": 1, "mean_delta": 9.0, "highest": 18.0, "most_exposed": "Name CCC, Name AAA, Name BBB"}
    assert [r.iso for r in scenario.most_affected(s, 2).collect()] == ["CCC", "AAA"]
    kicks = table(spark, "key string, channel string, kick double, is_sourced boolean", ("A", "x", 3.0, True), ("A", "x", 4.0, True), ("A", "y", 5.0, False), ("A", "z", 0.0, True), ("A", "y", 0.0, True))
    assert values(scenario.damped(kicks)) == [("A", "x", 5.0, 2), ("A", "y", 3.0, 1)]


def test_trade(spark):
    b = table(spark, "key string, net double", ("A", -1500.0), ("B", 0.0), ("C", 123456.0))
    assert values(trade.panel(b), "key", "is_exporter", "imports_bn", "exports_bn", "bar_width") == [("A", False, 1.5, 0.0, 0.75), ("B", True, 0.0, 0.0, 0.0), ("C", True, 0.0, 123.5, 45.0)]
    assert values(trade.import_bars(b.where("key = 'A'")), "rank", "value") == [(k, 10.0) for k in range(1, 6)]
    assert values(trade.import_bars(table(spark, "key string, net double", ("D", -1e6))), "value") == sorted([(2800.0,), (2000.0,), (1440.0,), (960.0,), (800.0,)], key=str)
    records = table(spark, "key string, suppliers array<string>, shares array<double>, destinations array<string>", ("X", ["p", "q", "?", "r", "s", "t"], [40.0, 0.0], []), ("US-AL", ["p", "q", "r", "s"], [1.0], ["p"]))
    places = table(spark, "name string, lat double, lon double", *((n, 1.0, 2.0) for n in ("X", "US-AL", "p", "q", "r", "s", "t", "China", "USA")))
    got = values(trade.flows(records, places), "key", "type", "rank", "partner", "weight")
    assert got == sorted([("US-AL", "export", 1, "p", 40.0), ("US-AL", "import", 1, "p", 40.0), ("US-AL", "import", 2, "q", 28.0), ("US-AL", "import", 3, "r", 16.0), ("X", "export", 1, "China", 35.0), ("X", "export", 4, "USA", 12.0), ("X", "import", 1, "p", 40.0), ("X", "import", 2, "q", 20.0), ("X", "import", 4, "r", 20.0), ("X", "import", 5, "s", 20.0)], key=str)
    m = trade.mirrored(table(spark, "importer string, supplier string, value double", ("A", "B", 110.0), ("B", "A", 100.0), ("C", "A", 5.0)))
    assert values(m, "exporter", "partner", "mirror_value", "own_value", "gap_pct") == [("A", "B", 100.0, 110.0, -9.1), ("A", "C", 5.0, None, None), ("B", "A", 110.0, 100.0, 10.0)]


# --- companies, health ------------------------------------------------------------------------------------------------


def test_companies(spark):
    claim = lambda iso, url=None, strength=None, role=None: {"iso3": iso, "citation_url": url, "evidence_strength": strength, "role": role}
    docs = [
        {"_meta": {"company": "One", "research_status": "partial"}, "commodities": [{"name": "Soy", "evidence_strength": "strong", "sourcing_countries": [claim("BRA", "https://a.org/1"), claim("BRA", "https://b.org/1"), claim(None), claim("ARG", "https://b.org/2", "weak")]}, {"name": None, "sourcing_countries": [claim("USA", "x"), claim("CAN", "https://a.org/2")]}], "evidence_gaps": ["g"]},
        {"_meta": {"company": "Two", "research_status": "complete"}, "commodities": [], "evidence_gaps": None}, {"_meta": {"company": "Three"}, "commodities": None},
    ]
    df = spark.createDataFrame(docs, companies.DOCUMENT)
    out = {r.company: r for r in companies.rollup(df).collect()}
    assert (out["One"].n_claims, out["One"].n_countries, out["One"].n_commodities, out["One"].data_quality, out["One"].primary_citation) == (5, 4, 2, "sourced", "a.org")
    assert (out["Two"].n_claims, out["Two"].data_quality, out["Three"].data_quality, out["Three"].n_commodities) == (0, "sourced", "partial", 0)
    assert {(r.commodity, r.iso3, r.evidence_strength, r.role) for r in companies.claims(df).collect()} >= {("Soy", "ARG", "weak", "origin"), ("Unknown", "USA", "medium", "origin")}


def test_company_files(spark, tmp_path):
    import json

    from tillage.sources.landing import company_documents

    (tmp_path / "one.json").write_text(json.dumps({"_meta": {"company": "One", "research_status": "complete"}, "commodities": [{"name": "Soy", "sourcing_countries": [{"iso3": "BRA", "share_pct": 3.5}]}]}, indent=1))
    (tmp_path / "_draft.json").write_text(json.dumps({"_meta": {"company": "Draft"}}))
    (tmp_path / "bad.json").write_text("{broken")
    assert values(companies.rollup(company_documents(spark, str(tmp_path))), "company", "n_claims", "n_commodities") == [("One", 1, 1)]


def test_manifest_rules_in_order(spark):
    schema = "feed string, mode string, present boolean, source string, notes string, n_rows long, period date, monthly boolean, snapshot boolean, generated_at timestamp"
    at = datetime(2026, 5, 28)
    rows = [
        ("static", "static_helper", False, None, None, 0, None, False, False, None), ("gone", "auto", None, "s", "n", 5, None, False, False, None), ("setup", "auto", True, "X (Not Configured)", "403", 0, None, False, False, at), ("403", "auto", True, "x", "HTTP 403", 9, None, False, False, at),
        ("none", "manual", True, "x", None, 0, None, False, False, at), ("old", "auto", True, "x", "", 9, date(2026, 2, 1), True, False, at), ("fresh", "auto", True, "x", "", 9, date(2026, 3, 1), True, False, at), ("snap", "manual", True, "x", "", 9, None, False, True, at), ("fine", "auto", True, "x", "appname=y", 9, None, False, False, at),
    ]
    out = health.manifest(table(spark, schema, *rows), F.lit("2026-05-30").cast("date"))
    assert {r.feed: r.status for r in out.collect()} == {"static": "manual", "gone": "failed", "setup": "setup_required", "403": "degraded", "none": "degraded", "old": "degraded", "fresh": "ok", "snap": "manual", "fine": "ok"}
    assert {r.feed: r.age_days for r in out.collect()}["fine"] == 2
    s = health.manifest_summary(out).first()
    assert (s.total_sources, s.healthy_sources, s.degraded_sources, s.headline_status) == (9, 4, 3, "attention")


def test_shape_checks(spark):
    rows = [("dict_nonempty", True, True, True, 0, True), ("dict_nonempty", True, True, True, 3, True), ("dict_nonempty", True, True, True, 3, False), ("dict_or_empty", True, True, True, None, None), ("object", True, True, True, None, None), ("flexible", True, True, False, 1, True), ("flexible", True, False, True, 1, True), ("flexible", False, True, True, 1, True), ("list_nonempty", True, True, True, 0, False)]
    df = table(spark, "kind string, parsed boolean, meta boolean, data boolean, n long, obj boolean", *rows)
    got = [r[0] for r in df.select(health.shape_problem(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["data dict is empty", None, "data is no object", None, "data is null", "missing data envelope", "missing _meta envelope", "JSON parse error", "data list is empty"]


def test_quality_report_and_gate(spark):
    rows = table(spark, "iso string, name string, x double", ("BOL", "Belarus", 1.0), ("DEU", "Germany", None))
    report = health.at_least("rows", rows, 2).union(health.known_in("x", rows, "x", 2)).union(health.no_swaps("swap", rows, table(spark, "iso string, name string", ("BOL", "Belarus")), ["iso", "name"]))
    report = report.union(health.names_agree("names", rows, table(spark, "name string, expected string", ("Belarus", "BLR"), ("Germany", "DEU")), "iso", "name")).union(health.none_missing("required", table(spark, "iso string", ("BOL",), ("USA",)), rows, "iso")).union(health.none_bad("blank", rows, F.trim("name") == ""))
    assert {r.check: (r.found, r.passed) for r in report.collect()} == {"rows": (2, True), "x": (1, False), "swap": (1, False), "names": (1, False), "required": (1, False), "blank": (0, True)}
    assert health.gate(report).first().asDict() == {"failures": 4, "ok": False}


def test_daily_summary_priorities(spark):
    schema = "movers long, top_name string, top_adjustment double, high_ipc long, worst_ipc_name string, worst_ipc_pct double, drought long, flood long, fire long, fx long, ffpi_mom_pct double, high_inform long, top_inform_name string, top_inform double"
    rows = [(2, "Sudan", 9.5, 1, "Gaza", 61.4, 1, 0, 2, 3, -1.5, 1, "Somalia", 8.5), (0, None, None, 4, "Haiti", 48.0, 0, 0, 0, 0, 1.4, 0, None, None), (0, None, None, 0, None, None, 0, 1, 0, 0, None, 0, None, None), (0, None, None, 0, None, None, 0, 0, 0, 0, None, 0, None, None)]
    out = health.daily_summary(table(spark, schema, *rows)).collect()
    assert out[0].headline.startswith("2 countries with active nowcast pressure; Sudan") and len(out[0].bullets) == 6 and "down 1.5%" in out[0].bullets[2] and "Gaza at 61%" in out[0].bullets[1]
    assert out[0].subhead == "Today: 2 country nowcast moves · 1 IPC Phase 3+ crises · 3 environmental flags · 3 currency shocks."
    assert out[1].headline.startswith("4 countries in active IPC") and len(out[1].bullets) == 1
    assert out[2].headline.startswith("Quiet") and out[3].subhead == "All sources nominal." and out[3].bullets == []


def test_polygon_centroid(spark):
    from tillage.functions.geo import polygon_centroid

    ring = lambda lon, lat, w, h: [[lon - w, lat - h], [lon + w, lat - h], [lon + w, lat + h], [lon - w, lat + h]]
    octant = [[0.0, 0.0], [90.0, 0.0], [0.0, 90.0]]
    cases = {
        "octant": ([[octant]], (35.2644, 45.0)), "other way": ([[octant[::-1]]], (35.2644, 45.0)), "closed": ([[[*octant, octant[0]]]], (35.2644, 45.0)),
        "date line": ([[ring(180.0, 0.0, 10.0, 5.0)]], (0.0, 180.0)), "written below": ([[[[170.0, -5.0], [-170.0, -5.0], [-170.0, 5.0], [170.0, 5.0]]]], (0.0, 180.0)),
        "pole": ([[[[0.0, 80.0], [90.0, 80.0], [180.0, 80.0], [-90.0, 80.0]]]], (90.0, None)), "hole in the middle": ([[ring(20.0, 0.0, 9.0, 9.0), ring(20.0, 0.0, 3.0, 3.0)]], (0.0, 20.0)),
        "hole to the east": ([[ring(20.0, 0.0, 4.0, 4.0), ring(22.0, 0.0, 2.0, 4.0)[::-1]]], (0.0, 18.0)), "two of one size": ([[ring(0.0, 0.0, 1.0, 1.0)], [ring(10.0, 0.0, 1.0, 1.0)]], (0.0, 5.0)),
        "mostly the large": ([[ring(0.0, 0.0, 10.0, 10.0)], [ring(90.0, 0.0, 1.0, 1.0)]], (0.0, 0.58)), "a line": ([[[[0.0, 0.0], [10.0, 0.0]]]], (0.0, 5.0)), "a point": ([[[[7.0, 8.0]]]], (8.0, 7.0)), "nothing": ([], None), "no rings": ([[]], None), "empty ring": ([[[]]], None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, p array<array<array<array<double>>>>")
    for r in df.select("name", polygon_centroid(F.col("p")).alias("at")).collect():
        want = cases[r.name][1]
        assert (r.at is None) == (want is None), r.name
        if want:
            assert r.at.lat == pytest.approx(want[0], abs=0.01), r
            assert want[1] is None or abs((r.at.lon - want[1] + 180) % 360 - 180) < 0.02, r
    assert df.select(polygon_centroid(F.lit(None).cast("array<array<array<array<double>>>>")).alias("x")).first().x is None
