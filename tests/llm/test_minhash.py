from __future__ import annotations

import numpy as np
import pytest
from plain import components_of, prose, shingles_of

from tillage.llm import minhash, shingles


def similar(percent):
    return lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)


def brute(rows, words=3, percent=85):
    sets = {i: shingles_of(t, words) for i, t in rows}
    return {i: (len(sets[i]), c, c == i) for i, c in components_of(sets, similar(percent)).items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_groups_match_all_pairs(documents, rng):
    texts = [" ".join(prose(rng, 30)) for _ in range(40)]
    for edits in (1, 2, 4):
        texts += variants(rng, prose(rng, 80), 40, edits)
    texts += [texts[3], texts[3].upper(), texts[50] + " "] + ["", None, "one", "One", "one two", "\t\n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 10))
    assert got(minhash.near_duplicates(documents(rows))) == brute(rows)


def test_a_large_group_is_dealt_in_blocks(documents, rng, monkeypatch):
    # most pairs of this group are near the threshold, so hubs don't join all of it
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = list(enumerate(variants(rng, prose(rng, 120), 150, 6)))
    assert got(minhash.near_duplicates(documents(rows))) == brute(rows)


def test_words_split_at_ascii_blanks_only(documents):
    rows = [(1, "a b c d"), (2, "A\x0bB\x0cC\rD"), (3, "a b c d"), (4, "Ä b c d"), (5, "ä b c d")]
    assert got(minhash.near_duplicates(documents(rows))) == brute(rows)


def test_null_ids_and_repeated_rows(documents):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (2, "q r s t"), (2, "a b c d"), (9, "q r s t"), (7, None)]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(rows)).collect()), key=str)
    assert len(out) == len(rows)
    assert [r for r in out if r[0] is None] == [(None, 2, None, True)]
    assert {(d, c) for d, _, c, _ in out if d is not None} == {(5, 2), (2, 2), (9, 2), (7, 7)}


def test_a_doc_id_on_different_texts_is_linked_by_each(documents, rng):
    t1, t2, t3 = (prose(rng, n) for n in (60, 140, 90))
    near = lambda t: " ".join([*t[:-1], "other"])
    rows = [(5, " ".join(t1)), (5, " ".join(t2)), (5, " ".join(t2).upper()), (9, near(t1)), (7, near(t2)), (3, near(t3)), (8, " ".join(t3)), (8, near(t2)), (20, "x y z"), (4, " ".join(t3)), (30, "x y z"), (30, "q r s t")]
    out = minhash.near_duplicates(documents(rows)).collect()
    assert len(out) == len(rows) and {r.doc_id: r.component_id for r in out} == {5: 3, 9: 3, 7: 3, 3: 3, 8: 3, 4: 3, 20: 20, 30: 20}
    huge = (1 << 62) + 5
    out = minhash.near_duplicates(documents([(huge, "a b c d"), (huge, "e f g h"), (huge + 1, "e f g h"), (-7, "a b c d")])).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(huge, -7), (huge + 1, -7), (-7, -7)}


def test_deduplicate_keeps_other_texts_of_an_id(documents):
    rows = [(5, "one text of five words here"), (5, "quite another text of the same id"), (5, "quite another text of the same id"), (9, "one text of five words here")]
    assert sorted((r.doc_id, r.text) for r in minhash.deduplicate(documents(rows)).collect()) == sorted(set(rows[:2]))


def test_deduplicate_keeps_other_texts_of_an_id_that_goes(documents, rng):
    near = "one text of six words here"
    rows = [(1, near), (5, f"{near} too"), (5, "a wholly different text of that id")]
    assert sorted((r.doc_id, r.text) for r in minhash.deduplicate(documents(rows), percent=50).collect()) == [rows[0], rows[2]]
    # against all pairs, where ids repeat on all kinds of texts: of each group of (doc_id, text) the first stays
    rows = []
    for _ in range(12):
        rows += [(rng.randrange(30), t) for t in variants(rng, prose(rng, 80), 6, 3)]
    rows += [rows[0], rows[5], (None, rows[0][1]), (None, rows[0][1]), (3, None), (3, ""), (40, None)]
    nodes = sorted({(i, t) for i, t in rows if i is not None and t})
    groups = components_of({k: shingles_of(t, 5) for k, (_, t) in enumerate(nodes)}, similar(80))
    assert len(set(groups.values())) < len(nodes)
    want = sorted(nodes[c][0] for c in set(groups.values()))
    out = minhash.deduplicate(documents(rows)).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None and r.text) == want
    assert len([r for r in out if r.doc_id is None]) == 2 and sorted(r.doc_id for r in out if not r.text) == [3, 3, 40]
    kept = {(r.doc_id, r.text) for r in out}
    for c in set(groups.values()):
        assert len([k for k, g in groups.items() if g == c and nodes[k] in kept]) == 1


@pytest.mark.parametrize("together, hot_keys", [(1, 10**9), (4, 5), (10**9, 1)])
def test_split_joins_are_left_joins(spark, monkeypatch, together, hot_keys):
    from tillage.llm import common

    monkeypatch.setattr(common, "TOGETHER", together)
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    many = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(90)] + [(7, 100), (8, None)], "k long, v long")
    one = spark.createDataFrame([(k, f"n{k}") for k in (0, 1, 7, 9)] + [(None, "none")], "k long, name string")
    assert sorted(map(str, common.split_join(many, one, "k", "v").collect())) == sorted(map(str, many.join(one, "k", "left").collect()))


def test_hot_buckets_and_hubs_are_dealt_to_cells(documents, rng, monkeypatch):
    from tillage.llm import common

    monkeypatch.setattr(common, "TOGETHER", 4)
    monkeypatch.setattr(common, "HOT_KEYS", 10**6)
    rows = list(enumerate(variants(rng, prose(rng, 100), 60, 3) + ["the same text of all"] * 30))
    assert got(minhash.near_duplicates(documents(rows))) == brute(rows)


def test_empty_table_and_very_long_text(documents, rng):
    assert minhash.near_duplicates(documents([])).collect() == []
    long = " ".join(prose(rng, 60_000, 50_000))
    out = got(minhash.near_duplicates(documents([(1, long), (2, long + " end"), (3, "short one here")])))
    assert out[2][1] == 1 and out[3][1] == 3 and out[1][0] == len(shingles_of(long, 3))


def test_deduplicate_keeps_one_of_each_group_with_all_columns(documents, rng):
    base = prose(rng, 60)
    rows = [(4, " ".join(base)), (2, " ".join(base[:-1])), (8, "other words of this text here"), (8, "other words of this text here"), (None, " ".join(base)), (3, None)]
    df = documents(rows)
    out = minhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: -1 if x is None else x) == [None, 2, 3, 8]


@pytest.mark.parametrize("n", [1, 3, 5])
def test_shingle_hashes_count_distinct_shingles(n, rng):
    texts = [" ".join(prose(rng, k, 6)) for k in range(0, 40)] + [None, "É è\tÉ", "\ud800 x"]
    for t, s in zip(texts, shingles.shingle_sets(texts, n, block=64)):
        assert len(s) == len(shingles_of(t, n)) and (np.diff(s.astype(object)) > 0).all()


def test_signature_agreement_estimates_similarity():
    draw = np.random.default_rng(1)
    a = np.unique(draw.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    for keep in (0.95, 0.8, 0.5):
        b = np.unique(np.concatenate([a[: int(keep * len(a))], draw.integers(0, 1 << 63, int((1 - keep) * len(a)), dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = minhash.signatures([a, b], 512)
        assert abs((x == y).mean() - true) < 0.08
