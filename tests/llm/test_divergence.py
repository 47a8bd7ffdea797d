from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=3, top=200):
    """All terms of all pairs of groups, with Python's whole numbers."""
    langs, counts, docs = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        counts[lang, source].update(terms_of(text))
        docs[lang].update(set(terms_of(text)))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        def share(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", own)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture
def table(spark):
    def make(rows):
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
        for c in ("term", "count", "group", "number", "block", "kind", "part", "item", "value", "rank", "v", "n", "total"):
            df = df.withColumn(c, F.lit("clash"))
        return df

    return make


def some_rows(rng, n=300, sources=9):
    words = [f"{a}{b}" for a in ("alpha", "Beta", "gämma", "δέλτα", "字", "é") for b in ("", "x", "xx", "Y", "😀")]
    rows = []
    for _ in range(n):
        s = rng.randrange(sources)
        some = rng.sample(words, 1 + s)
        glue = rng.choice([" ", "\n", "1", "_", " - ", "\x00", "@"])
        rows.append((glue.join(rng.choice(some) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None]), f"s{s}"))
    rows += [(None, "en", "silent"), ("", "en", None), ("123", "en", "silent"), ("rare", "en", "s1"), ("rare rare rare", "en", "s2"), ("lonely", "xx", "a"), (None, "xx", "b"), (None, None, None)]
    rng.shuffle(rows)
    return rows


def test_matches_all_pairs(spark, table, rng):
    rows = some_rows(rng)
    assert got(divergence.audit(table(rows).repartition(5))) == brute(rows)
    assert got(divergence.audit(table(rows), least_docs=1, top=3)) == brute(rows, 1, 3)


def test_small_blocks_and_meetings_give_the_same(spark, table, rng, monkeypatch):
    for name, value in (("BLOCK", 200), ("OPEN", 600), ("COMMON", 5), ("SOURCES", 4), ("POSTINGS", 10)):
        monkeypatch.setattr(divergence, name, value)
    rows = some_rows(rng, 200, 15) + [(" ".join(["alpha", "BETA", "same"] * 400), "en", "s3"), ("same " * 300, "en", "s4"), ("Same", "en", "s5")]
    assert got(divergence.audit(table(rows).repartition(3))) == brute(rows)


@pytest.mark.parametrize("common", [0, 3, 10])
def test_terms_of_most_blocks_are_common_ones(spark, table, monkeypatch, common):
    for name, value in (("BLOCK", 64), ("COMMON", common), ("GATHERED", 20), ("TERMS", 4)):
        monkeypatch.setattr(divergence, name, value)
    rows = [(f"the word w{k % 7} the rest{'x' * k}", "en", f"s{k % 3}") for k in range(400)]
    assert got(divergence.audit(table(rows))) == brute(rows)


def test_automaton_counts_neighbours():
    found = divergence.automaton(["the", "he", "thé"])
    assert divergence.occurrences(found, " the the he thé  the then ") == {0: 3, 1: 1, 2: 1}


def test_shares_are_exact(rng):
    for _ in range(500):
        total = rng.randrange(1, 10 ** rng.randrange(1, 16))
        count = rng.randrange(total)
        assert divergence.shares(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total


def test_empty_table(spark, table):
    df = divergence.audit(table([]))
    assert df.collect() == [] and dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_a_block_has_each_term_once(spark, table):
    import zstandard

    df = table([(f"same words {k % 5} again and again", "en", f"s{k % 2}") for k in range(200)]).coalesce(1)
    rows = [r for r in divergence._first_pass(df).collect() if r.kind != divergence.TERM]
    unpack = lambda data: zstandard.ZstdDecompressor().decompress(bytes(data))
    assert sorted(w for r in rows if r.kind == divergence.TEXT for w in unpack(r.text).split()) == [b"again", b"and", b"same", b"words"]
    times = {r.source: np.frombuffer(unpack(r.times), np.int64).tolist() for r in rows if r.times is not None}
    assert times == {"s0": [100, 100, 200, 100], "s1": [100, 100, 200, 100]}


def test_shares_as_columns_are_exact(spark):
    counts = [0, 1, 10**9, 8 * 10**9 - 1, 8 * 10**9, 8 * 10**9 + 1, 10**12, 10**15]
    rows = spark.createDataFrame([(c, 3 * c + 7) for c in counts], "count long, total long")
    got = rows.select(divergence._exact_share("count", "total").cast("long")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 1) // (3 * c + 7) for c in counts]
