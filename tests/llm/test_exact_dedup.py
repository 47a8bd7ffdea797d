from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from plain import prose
from pyspark.sql import functions as F

from tillage.llm import exact_dedup


def brute(rows, keep=max, change=lambda t: t):
    groups = defaultdict(list)
    for d, t in rows:
        groups[change(t or "")].append(d)
    out = []
    for t, ids in groups.items():
        named = [d for d in ids if d is not None]
        stays, left = keep(named) if named else None, True
        for d in ids:
            out.append((d, stays, len(ids), left and d == stays, hashlib.sha256(t.encode()).hexdigest()))
            left = left and d != stays
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def some_rows(rng, n=400):
    base = [" ".join(prose(rng, rng.randrange(0, 60))) for _ in range(60)]
    rows = [(d, rng.choice(base) + rng.choice(["", "", " tail", "\n", "é", "😀"])) for d in range(n)]
    rows += [(9000, None), (9001, ""), (9002, None), (None, base[0]), (None, base[1]), (None, "only without id"), (None, "only without id")]
    rows += [(9003, "a"), (9003, "a"), (9003, "b"), ((1 << 62) + 1, "b"), ((1 << 62) + 3, "b"), (9004, "a" * 200_000), (9005, "a" * 199_999), (9006, "a" * 200_000)]
    rows += [(9100 + k, "a" * k) for k in range(40)]  # each the start of the next
    rng.shuffle(rows)
    return rows


def test_matches_groups(spark, documents, rng):
    rows = some_rows(rng)
    df = documents(rows).repartition(7)
    assert got(exact_dedup.owners(df, "largest")) == brute(rows)
    assert got(exact_dedup.owners(df)) == brute(rows, min)
    lower = lambda t: t.lower().strip()
    rows = [(1, "A b "), (2, "a B"), (3, "a c")]
    assert got(exact_dedup.owners(documents(rows), normalise=lambda c: F.trim(F.lower(c)))) == brute(rows, min, lower)


def test_tries_that_spill_give_the_same(spark, documents, rng):
    rows = some_rows(rng, 1500)
    df = documents(rows).repartition(3)
    for budget in (12_000, 60_000):
        assert got(exact_dedup.owners(df, "largest", budget=budget, each=1 << 30)) == brute(rows)


def test_one_group_of_a_third(spark, documents, rng, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMBERS", 3)
    monkeypatch.setattr(exact_dedup, "hot_limit", lambda rows: 4)
    rows = [(d, "the same" if d % 3 == 0 else f"text {d // 2}") for d in range(900)]
    assert got(exact_dedup.owners(documents(rows).repartition(5), "largest")) == brute(rows)


def test_trie_against_a_set(rng):
    trie, want = exact_dedup.Trie(), {}
    for k in range(3000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))
        node = trie.place(text)
        if node.end is None:
            node.end = [k]
            trie.ends += 1
        want.setdefault(text, k)
    assert dict((t, e[0]) for t, e in trie) == want and trie.ends == len(want)
    nodes = sum(1 for _ in trie._weights())
    assert nodes <= 2 * len(want)  # compressed: no node without a terminal has one branch only
    gone = {t: e[0] for t, e in trie.spill(trie.held // 2, mark=True)}
    left = {t: e[0] for t, e in trie}
    assert gone and left and gone | left == want and not set(gone) & set(left)
    assert all(trie.place(t) is None for t in gone) and all(trie.place(t).end == [k] for t, k in left.items())


def test_a_text_longer_than_the_budget(spark, documents):
    rows = [(1, "x" * 50_000), (2, "y" * 50_000), (3, "x" * 50_000), (4, "x" * 49_999)]
    assert got(exact_dedup.owners(documents(rows).coalesce(1), "largest", budget=1000)) == brute(rows)


def test_deduplicate_returns_whole_rows(spark, documents):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (5, "c"), (None, "a"), (None, "d")]
    df = documents(rows)
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in out.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == [("1", "a"), ("3", ""), ("5", "b"), ("5", "c"), ("None", "d")]


def test_empty_table(spark, documents):
    df = exact_dedup.owners(documents([]))
    assert df.collect() == [] and dict(df.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
