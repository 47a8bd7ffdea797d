from __future__ import annotations

import functools
import math
import random
import re
import time

import pytest

from tillage.llm import urlfilter as u
from tillage.llm.common import Scratch

CASES = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"), ("https://Example.NET/en/page?q=1#f", "example.net", "/en/page", "example.net/en/", "allow"), ("http://www.example.net/en/", "www.example.net", "/en/", "example.net/en/", "allow"),
    ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"), ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"), ("http://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
    ("http://myexample.com/de/1", "myexample.com", "/de/1", None, None), ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"), ("http://b.org/fr", "b.org", "/fr", None, None), ("http://net", "net", "", None, None), ("http://net/", "net", "/", "net/", "block"),
    ("http://a.net", "a.net", "", None, None), ("http://a.net?x=/", "a.net", "", None, None), ("no scheme/x", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"), ("x://h#f/p", "h", "", None, None),
    ("http://ÄB.net/é?z", "Äb.net", "/é", "net/", "block"), ("http://a.b://c.net/d", "a.b:", "//c.net/d", None, None),
]


def pages(spark, urls):
    rows = [(i, url, "<html>", "clash", "clash") for i, url in urls]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")


def test_rules_and_parts(spark):
    out = {r.page_id: r for r in u.judge(pages(spark, [(k, c[0]) for k, c in enumerate(CASES)])).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (out[k].host, out[k].path, out[k].rule) == (host, path, rule), CASES[k]
        assert out[k].verdict == verdict if verdict else out[k].verdict in ("allow", "block")


def test_learns_unwanted_hosts_and_their_company(spark):
    urls = [f"http://best{w}site{k}.info/win/big{k}" for w in ("casino", "poker", "slots") for k in range(20)] + [f"http://green{w}farm{k}.info/field/{k}" for w in ("river", "park", "book") for k in range(20)]
    asked = [(1000, "http://megacasinonight.info/x"), (1001, "http://quietgarden.info/win/big7"), (1002, "http://greenbookshop.info/field/9")]
    out = {r.page_id: r.verdict for r in u.judge(pages(spark, [*enumerate(urls), *asked])).collect()}
    assert out[1000] == "block" and out[1002] == "allow" and out[1001] == "block"
    assert sum(out[k] == ("block" if k < 60 else "allow") for k in range(120)) > 110


def test_verdict_is_bayes_over_the_tokens(spark):
    urls = [(k, f"http://{'casino' if k % 3 == 0 else 'garden'}{k % 7}.info/p{k % 5}/x") for k in range(60)]
    by_url = {url: u.features(*re.match("http://([^/]*)(/.*)", url).groups()) for _, url in urls}
    tokens = [by_url[url] for _, url in urls]
    y = [u.weak_label(t) for t in by_url.values()]  # what is learned from is distinct urls
    counts = [{}, {}]
    for t, c in zip(by_url.values(), y):
        for w in t:
            counts[c][u.bucket(w)] = counts[c].get(u.bucket(w), 0) + 1
    seen = set(counts[0]) | set(counts[1])
    total = [sum(c.values()) + u.SMOOTH * len(seen) for c in counts]
    prior = math.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    for r in u.judge(pages(spark, urls)).collect():
        want = prior + sum(math.log((counts[1].get(b, 0) + u.SMOOTH) / total[1]) - math.log((counts[0].get(b, 0) + u.SMOOTH) / total[0]) for b in map(u.bucket, tokens[r.page_id]))
        assert r.log_odds == pytest.approx(want, abs=1e-9) and r.verdict == ("block" if want > 0 else "allow")


def test_segmentation_is_the_cheapest_split():
    def cost(word, name):
        short = max(0, u.SHORT - len(word))
        unknown = u.UNKNOWN + u.LETTER * len(word) - u.SPLIT if word == name else u.UNKNOWN + u.LETTER * (len(word) + short) - short / 2
        return min(u.COSTS.get(word, math.inf), unknown)

    @functools.cache
    def cheapest(s, name):
        return min((cost(s[:k], name) + cheapest(s[k:], name) for k in range(1, len(s) + 1)), default=0.0)

    rng = random.Random(3)
    names = ["onlinecasino", "bestblog", "xqzt", "newsforum", "gamesx", "a", "ab", "xxadsx"] + ["".join(rng.choice([*u.UNWANTED, *u.COMMON, "q", "xz", "vbnm"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    for name in names:
        words = u.segmented(name)
        assert "".join(words) == name and sum(cost(w, name) for w in words) == pytest.approx(cheapest(name, name)), name
    assert u.segmented("onlinecasino") == ("online", "casino")


def test_known_splits_and_long_names():
    for name, want in {"bestcasinosite0": "best casino site 0", "24casino7": "24 casino 7", "freewin2020slots": "free win 2020 slots", "bücher": "bücher", "": ""}.items():
        assert u.segmented(name) == tuple(want.split()), name
    assert u.host_words("m.casino-win.example.com") == ["m", "casino", "win", "example", "com"]
    name, begun = "bestcasino" * 20_000, time.monotonic()  # far over any label's length: one pass, no cut
    assert u.segmented(name) == ("best", "casino") * 20_000 and time.monotonic() - begun < 60
    assert u.segmented("q" * 63 + "casino") == ("q" * 63, "casino")


def test_learns_from_what_pages_say_not_only_from_names(spark):
    """Labels come from the texts of two thirds of the hosts; urls of the others, without text, are told by the company of their words and paths."""
    rng, rows = random.Random(11), []
    bad, good = ["zorbex", "quanti", "velmor"], ["tundral", "pimsey", "ockham"]
    for k in range(180):
        y, held = k % 2, k % 3 == 1
        text = rng.choice(["poker and slots, bets at the casino, jackpot", "viagra pills, cheap pharma, pills"]) if y else "apples in the garden and a river, the town sells one of its slots"
        host = f"{rng.choice(bad if y else good)}{k}.info"
        rows.append((k, f"http://{host}/{rng.choice(['spin', 'order'] if y else ['recipe', 'walks'])}/{k}", "" if held else f"<p>{text}</p>"))
    df = spark.createDataFrame([r for r in rows if r[0] % 3 != 1] + [(r[0], r[1], None) for r in rows if r[0] % 3 == 1], "page_id long, url string, html string")
    out = {r.page_id: r.verdict for r in u.judge(df).collect()}
    learned = [out[k] == ("block" if k % 2 else "allow") for k in out if k % 3 != 1]
    held = [out[k] == ("block" if k % 2 else "allow") for k in out if k % 3 == 1]
    assert len(held) == 60 and sum(learned) / len(learned) > 0.95 and sum(held) / len(held) > 0.9  # either class alone: 0.5


def test_listed_words_are_split_off_inside_unknown_text():
    for name, words in {"luckypoker": "lucky poker", "megaporn": "mega porn", "superslots": "super slots", "royalcasinoclub": "royal casino club", "megacasinonight": "mega casino night", "essex": "essex", "roads": "roads", "downloads": "downloads"}.items():
        assert u.segmented(name) == tuple(words.split())
    for words in (u.LISTED, u.Words({"other": 5})):
        for w in u.UNWANTED:
            if len(w) > 3:
                assert u.segmented(f"zqvkj{w}", words) == ("zqvkj", w) and u.segmented(f"zqvkj{w}yhwub", words) == ("zqvkj", w, "yhwub")


def test_words_are_learned_from_all_pages(spark):
    text = "<html><style>p{unseen:0}</style><p>Hot chat in Essex: roads &amp; downloads, <b>lucky</b> threads für payday loans fast</html>"
    rows = [(k, f"http://site{k}.info/royal/", text) for k in range(3)] + [(10, "http://mega-club.info/", "<p>Mega-club luckypoker"), (11, "http://luckypoker.info/", "luckypoker")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    counts = u.vocabulary(u.said(df), Scratch(spark, "test"))
    assert counts["roads"] == counts["royal"] == 3 and counts["mega"] == counts["club"] == counts["luckypoker"] == 1 and not {"unseen", "html", "style", "amp", "für", "in"} & set(counts)
    words = u.Words({w: n for w, n in counts.items() if w != "luckypoker"})
    for name, want in {"hotsexchat": "hot sex chat", "luckypoker": "lucky poker", "luckyads": "lucky ads", "paydayloansfast": "payday loans fast", "essex": "essex", "essexroads": "essex roads", "downloads": "downloads", "threads": "threads"}.items():
        assert u.segmented(name, words) == tuple(want.split()), name


def test_long_pages_take_linear_time(spark):
    openers = ["<!--", "<", "<script>", "<style ", "<a ", "</script", "<!", "&", "&a", "<p", "-->", "<script></style>", "<!-- -->", "a<b "]
    rows = [(k, f"http://long{k}.info/", "before " + o * (1_000_000 // len(o)) + " after") for k, o in enumerate(openers)]
    begun = time.monotonic()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert len(u.judge(df).collect()) == len(rows) and time.monotonic() - begun < 60
    text = lambda html: spark.createDataFrame([(html,)], "html string").select(u.page_text(spark.createDataFrame([(html,)], "html string"))).first()[0].split()
    cases = {"<p>One<br>two</p>": "one two", "a<!-- x > y -->b": "a b", "a<!-- never closed <p>": "a", "1 < 2 and more": "1 < 2 and more", "<script>var t='</p>';</script>x": "x", "<STYLE>p{}</style >y": "y", "<script>no end": "", "x &amp; y&#39;z": "x y z", "a <b": "a"}
    assert {h: text(h) for h in cases} == {h: w.split() for h, w in cases.items()}


def test_the_bound_of_the_vocabulary_keeps_the_most_widespread(spark, monkeypatch):
    monkeypatch.setattr(u, "VOCABULARY", 2)
    df = spark.createDataFrame([(k, f"http://s{k}.info/", "alpha beta" + " gamma delta" * (k == 0)) for k in range(2)], "page_id long, url string, html string")
    assert u.vocabulary(u.said(df), Scratch(spark, "test")) == {"alpha": 2, "beta": 2}


def test_planted_hosts_are_blocked_and_clean_ones_are_not(spark):
    planted, clean = ["luckypoker", "royalcasinoclub", "megacasinonight", "megaporn", "superslots", "hotsexchat"], ["essex", "roads", "downloads", "middlesexcounty"]
    text = "<p>hot chat roads essex downloads middlesex county</p>"
    rows = [(k, f"http://{h}.info/p", text) for k, h in enumerate(planted + clean)] + [(100 + k, f"http://plain{k}garden.info/p", text) for k in range(20)]
    out = {r.page_id: r.verdict for r in u.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[k] for k in range(len(planted))] == ["block"] * len(planted)
    assert all(out[k] == "allow" for k in out if k >= len(planted))


def test_defined_cases(spark):
    urls = [(None, "http://a.info/"), (1, "http://" + "casino" * 3000 + "/" + "x/" * 20_000), (2, "http://a.info/"), (2, "http://a.info/"), (3, None)]
    assert len(u.judge(pages(spark, urls)).collect()) == 5
    assert u.judge(pages(spark, [])).collect() == []
    assert [r.verdict for r in u.judge(pages(spark, [(1, None), (2, "nothing")])).collect()] == ["allow", "allow"]
