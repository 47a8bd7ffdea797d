from __future__ import annotations

import random

import pytest
from plain import words_of

from tillage.llm import mixing


def fill(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by repeated resharing, as the contract tells it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, target = set(), {s: 0.0 for s in order}
    total = share * sum(sizes.values())
    while True:
        rest, open_w = total - sum(cap * sizes[s] for s in full), sum(w[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * w[s] / open_w for s in order}
        over = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def rows_of(rng, sources, n, longest=60):
    return [(i, " ".join("w" for _ in range(rng.randrange(longest))), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_sums(documents, seed):
    rng = random.Random(seed)
    rows = rows_of(rng, ["a", "b", None, "é", "Z", "c", "c", "c", "c"], 400) + [(900, None, "a"), (901, "", None), (902, " ".join("w" * 5000), "b")]
    out = mixing.mixed(documents(rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    want = fill(sizes)
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r.size == len(words_of(dict((i, t) for i, t, _ in rows)[r.doc_id])) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert want[s] - 1 - 1e-6 <= t <= want[s] + 1e-6


def test_reruns_agree_and_order_does_not_matter(documents):
    rows = rows_of(random.Random(5), ["x", "y"], 150)
    one = {r.doc_id: r.taken for r in mixing.mixed(documents(rows)).collect()}
    assert one == {r.doc_id: r.taken for r in mixing.mixed(documents(rows[::-1]).repartition(7)).collect()}


def test_repeated_rows_null_ids_and_no_words(documents):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b", "s"), (None, "a b", None), (3, None, "t")]
    out = mixing.mixed(documents(rows)).collect()
    assert len(out) == 5 and all(r.taken <= 2 * r.size for r in out)
    assert {(r.taken, r.target) for r in mixing.mixed(documents([(1, None, "s"), (2, " ", None)])).collect()} == {(0, 0.0)}
    assert mixing.mixed(documents([])).collect() == []


def test_one_source_holds_nearly_all(documents):
    rows = rows_of(random.Random(6), ["big"], 500) + [(1000 + k, "w w w", f"s{k}") for k in range(5)]
    out = mixing.mixed(documents(rows)).collect()
    big = sum(r.taken for r in out if r.source == "big")
    assert 0 <= next(r.target for r in out if r.source == "big") - big < 1


@pytest.mark.parametrize("block", [1, 7, 64, 5000])
def test_the_block_size_changes_no_sum(documents, block):
    rows = rows_of(random.Random(8), ["a", "b", "b", "b", "c"], 120)
    taken = lambda **args: sorted((r.doc_id, r.taken) for r in mixing.mixed(documents(rows), **args).collect())
    assert taken(block_words=block) == taken()


def test_schedule_is_even_and_ends_at_the_targets(spark, documents):
    from tillage.llm.common import Scratch

    goals = spark.createDataFrame([(0, "a", 4000, 9, 6000.0), (1, "b", 3000, 9, 2500.5), (2, "c", 10, 2, 15.0), (3, "d", 0, 1, 0.0)], "sid long, source string, source_size long, n_rows long, target double")
    out = sorted(mixing.schedule(goals, 20, Scratch(spark, "t-mix")).collect())
    assert len({r.slot for r in out}) == len(out)
    for sid, reach in ((0, 6000), (1, 2500), (2, 15)):
        own = [r for r in out if r.sid == sid]
        assert sum(r.words for r in own) == reach and [r.rank for r in own] == list(range(len(own))) and all(r.start == 20 * r.rank for r in own)
    drawn = [r.sid for r in out if r.slot < 426]
    for lo in range(0, 360, 60):  # any run of slots holds the sources in nearly their shares
        assert abs(sum(s == 0 for s in drawn[lo : lo + 60]) - 60 * 6000 / 8515.5) < 4


def test_materialized_repeats_whole_documents(documents):
    rows = rows_of(random.Random(7), ["a", "b"], 80) + [(None, "x y", "a"), (None, "z", "b")]
    df = documents(rows)
    taken = {r.doc_id if r.doc_id is not None else r.source: r.taken / r.size for r in mixing.mixed(df).collect() if r.size}
    out = mixing.materialized(df)
    assert out.columns == df.columns
    count = {}
    for r in out.collect():
        name = r.doc_id if r.doc_id is not None else r.source
        count[name] = count.get(name, 0) + 1
    assert count == {i: int(t + 0.5) for i, t in taken.items() if int(t + 0.5)}


def test_materialized_repeated_rows_and_clashing_columns(documents):
    from pyspark.sql import functions as F

    rows = [(1, "a b c d", "s")] * 6 + [(1, "other text of it", "s"), (2, "e f", "s"), (None, "g", "s"), (None, "g", "s")] + [(10 + k, "w " * 40, "t") for k in range(20)]
    df = documents(rows).withColumns({c: F.lit(c) for c in ("row_key", "rows", "copies", "same", "copy", "copies_", "Digest_")})
    out = mixing.materialized(df)
    assert out.columns == df.columns
    got = out.groupBy("doc_id", "text").count().collect()
    whole = mixing.mixed(df).where("size > 0").groupBy("doc_id", "size").agg((F.sum("taken") / F.first("size")).alias("c")).collect()
    assert sum(r["count"] for r in got) == pytest.approx(sum(r.c for r in whole), abs=3)
    assert out.select("row_key", "copies", "copy").distinct().collect() == [("row_key", "copies", "copy")]
    assert mixing.materialized(documents([])).collect() == []
