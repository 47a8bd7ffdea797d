from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.llm import quality_cnn as q


def texts(rng, n):
    """Good texts are varied words, bad ones repeat or are all marks."""
    rows = []
    for i in range(n):
        y = i % 2
        if y:
            t = " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 200)))
        else:
            t = rng.choice([" ".join(["buy now"] * rng.randrange(10, 90)), "".join(rng.choice("#$%&*@!") for _ in range(rng.randrange(50, 900)))])
        rows.append((i, t, y))
    return rows


def labelled(spark, rows):
    return spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_contract(spark, documents):
    rows = texts(random.Random(1), 300)
    df = documents([(i, t) for i, t, _ in rows])
    out = {r.doc_id: r for r in q.quality_scores(df, labelled(spark, rows), steps=120).collect()}
    assert len(out) == 300
    held = [i for i in out if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(out[i].held_out == (i in set(held)) for i in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert np.mean([out[i].predicted == rows[i][2] for i in held]) > 0.9


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, documents):
    rows = texts(random.Random(2), 120)
    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, t, y in rows]
    a = q.quality_scores(documents([(i, t) for i, t, _ in rows]), labelled(spark, rows), steps=30)
    b = q.quality_scores(documents([(i, t, "other") for i, t, _ in rows], extra=False).withColumn("lang", F.lit(None).cast("string")), labelled(spark, flipped), steps=30)
    assert {r.doc_id: r.score for r in a.collect()} == {r.doc_id: r.score for r in b.collect()}


def test_defined_cases(spark, documents):
    rows = texts(random.Random(3), 60)
    cases = [(1000, None), (1001, ""), (None, "some words"), (7, "again"), (7, "again"), (1002, "x" * 200_000)]
    labels = labelled(spark, rows).union(spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int"))
    out = q.quality_scores(documents([(i, t) for i, t, _ in rows if i != 7] + cases), labels, steps=20).collect()
    assert len(out) == 59 + len(cases)
    by = {r.doc_id: r for r in out}
    assert by[1000].score == by[1001].score and by[None].held_out is False
    assert len({r.score for r in out if r.doc_id == 7}) == 1


def test_no_labels_and_empty_table(spark, documents):
    none = labelled(spark, [])
    assert [r.score for r in q.quality_scores(documents([(1, "a"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert q.quality_scores(documents([]), none).collect() == []
    df = documents([(1, "a"), (2, None)])
    assert q.accept(df, none).count() == 2 and q.accept(df, none).columns == df.columns


def test_chunks_cover_every_byte():
    some = ["", None, "a" * 31, "b" * 512, "c" * 513, "é" * 700, "d" * 5000]
    chunks, at = q.chunked(some)
    step = q.CHUNK - q.SHARED
    for k, t in enumerate(some):
        own = chunks[at[k] : at[k + 1]]
        joined = bytes(own[0]) + b"".join(bytes(c[q.SHARED :]) for c in own[1:])
        assert joined.rstrip(b"\0") == (t or "").encode() and len(own) * step + q.SHARED >= len((t or "").encode())


def test_scores_do_not_depend_on_the_batch():
    rows = texts(random.Random(4), 40) + [(40, "", 0), (41, "x" * 3000, 0), (42, "é" * 999, 1)]
    given = [t for _, t, _ in rows]
    net = q.train(given, np.array([y for *_, y in rows], np.float32), 0.5, steps=20)
    alone = [q.scores(net, [t])[0] for t in given]
    for size in (2, 3, 7, 16, 43):
        assert [s for lo in range(0, 43, size) for s in q.scores(net, given[lo : lo + size])] == alone
    assert list(q.scores(net, given[::-1])) == alone[::-1]


@pytest.mark.parametrize("scale", [0.01, 1, 30, 500])
def test_sums_under_filters_are_exact(scale):
    net = q.new_net(8, np.random.default_rng(10))
    net.filters *= np.float32(scale)
    net = q.rounded(net)
    chunks, _ = q.chunked(["".join(random.Random(11).choice("abc \xe9") for _ in range(4000))])
    w = q.windows(net, chunks).reshape(-1, q.WIDTH * q.CHANNELS)
    want = w.astype(np.float64) @ net.filters.astype(np.float64)
    for order in (np.arange(w.shape[1]), np.arange(w.shape[1])[::-1], np.random.default_rng(12).permutation(w.shape[1])):
        assert (np.cumsum(w[:500, order, None] * net.filters[order], axis=1, dtype=np.float32)[:, -1] == want[:500]).all()
        assert (w[:, order] @ net.filters[order] == want).all()


def plain_logit(net, text):
    """One window, one filter at a time."""
    data = text.encode()
    n = max(1, math.ceil((len(data) - q.SHARED) / (q.CHUNK - q.SHARED)))
    data += bytes(n * (q.CHUNK - q.SHARED) + q.SHARED - len(data))
    tops = []
    for c in range(n):
        chunk = data[c * (q.CHUNK - q.SHARED) :][: q.CHUNK]
        again = [float(i >= 3 and any(chunk[i - 3 : i + 1]) and any(i - 3 - lag >= 0 and chunk[i - 3 - lag : i + 1 - lag] == chunk[i - 3 : i + 1] for lag in range(3, q.LAGS + 1))) for i in range(q.CHUNK)]
        seen = np.array([[*net.embed[b], r] for b, r in zip(chunk, again)], np.float64)
        tops.append([max(0.0, max((seen[p : p + q.WIDTH].ravel() * f).sum() for p in range(0, q.CHUNK - q.WIDTH + 1, q.STEP)) + b) for f, b in zip(net.filters.T.astype(np.float64), net.bias)])
    tops = np.array(tops)
    return float(np.concatenate([tops.max(0), tops.mean(0)]) @ net.dense + net.base[0])


def some_net(filters=3):
    rng = np.random.default_rng(8)
    net = q.new_net(filters, rng)
    net.dense, net.bias, net.base = (rng.standard_normal(n).astype(np.float32) for n in (2 * filters, filters, 1))
    return net


def test_forward_pass_equals_a_plain_one():
    net, given = some_net(), ["", "short", "abcabcabc " * 90, "".join(random.Random(6).choice("abcdé ") for _ in range(1500))]
    want = [1 / (1 + math.exp(-plain_logit(net, t))) for t in given]
    assert np.allclose(q.scores(net, given), want, atol=1e-5)


def test_gradient_equals_small_differences():
    net, given = some_net(), ["ab cd " * 30, "".join(random.Random(7).choice("abcdef ") for _ in range(700))]
    labels, weight = np.array([1.0, 0.0]), np.array([1.5, 0.5])
    grad = q.gradient(net, given, labels, weight)

    def loss():
        p = q.scores(net, given)
        return float((-weight * np.log(np.where(labels == 1, p, 1 - p))).mean())

    rng = np.random.default_rng(9)
    for name, g in grad.items():
        value, d = getattr(net, name), 2e-3
        places = np.argwhere(g != 0)
        for at in map(tuple, rng.permutation(places)[:6]):
            held = value[at]
            value[at] = held + d
            up = loss()
            value[at] = held - d
            down = loss()
            value[at] = held
            assert abs((up - down) / (2 * d) - g[at]) < 0.05 * abs(g[at]) + 2e-3, (name, at)
