from __future__ import annotations

import random
import re

from plain import prose

from tillage.llm import decontam


def grams(text, n=5):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, items, percent=80):
    out = {}
    for d, t in docs:
        for k, u in items:
            if d is None or k is None or not grams(u):
                continue
            m, n = len(grams(t) & grams(u)), len(grams(u))
            if 100 * m >= percent * n:
                out[d, k] = max(out.get((d, k), (0, 0, 0)), (m / n, n, m))
    return {k: (n, m, c) for k, (c, n, m) in out.items()}


def benchmark(spark, items):
    from pyspark.sql import functions as F

    return spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("item", F.lit("clash"))


def got(df):
    return {(r.doc_id, r.item_id): (r.n_item, r.n_shared, r.containment) for r in df.collect()}


def test_matches_all_pairs(spark, documents):
    rng = random.Random(2)
    items = [(k, " ".join(prose(rng, rng.randrange(1, 60)))) for k in range(40)] + [(50, None), (51, ""), (None, "a b c d e f"), (52, "Two Words"), (53, items_text := "x y z x y z x y z x y z")]
    docs = []
    for d in range(120):
        w = prose(rng, rng.randrange(0, 400))
        if rng.random() < 0.6:
            part = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(w) + 1)
            w = w[:at] + [x.upper() + rng.choice(["", ",", "."]) for x in part] + w[at:]
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, "two, WORDS!"), (203, items_text), (203, "nothing"), (204, items[3][1] + " " + items[4][1])]
    df = documents(docs)
    assert got(decontam.contained(df, benchmark(spark, items))) == brute(docs, items)
    clean = decontam.clean(df, benchmark(spark, items))
    held = {n for n, _ in brute([(n, t) for n, (_, t) in enumerate(docs)], [(k, u) for k, (_, u) in enumerate(items)])}  # by row, whatever the ids
    assert clean.columns == df.columns and sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted((str(d), str(t)) for n, (d, t) in enumerate(docs) if n not in held)


def test_clean_looks_at_rows_not_ids(spark, documents):
    item = "the quick brown fox jumps over the lazy dog"
    rows = [(None, f"so {item} again"), (None, "nothing of it"), (1, item), (1, "another text of that id"), (2, None), (3, f"{item} and {item}"), (4, "no id of this item is known here")]
    clean = decontam.clean(documents(rows), benchmark(spark, [(7, item), (None, rows[6][1])]))
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted((str(d), str(t)) for d, t in (rows[1], rows[3], rows[4]))


def test_empty_tables(spark, documents):
    assert decontam.contained(documents([]), benchmark(spark, [(1, "a b c d e")])).collect() == []
    assert decontam.contained(documents([(1, "a b c d e")]), benchmark(spark, [])).collect() == []


def test_short_item_in_a_very_long_document(spark, documents):
    rng = random.Random(4)
    item = "the quick brown fox jumps over the lazy dog again"
    long = " ".join(prose(rng, 40_000, 9000) + item.split() + prose(rng, 40_000, 9000))
    assert set(got(decontam.contained(documents([(1, long), (2, long.replace("fox", "cat"))]), benchmark(spark, [(7, item)])))) == {(1, 7)}


def test_plan_is_native(spark, documents):
    plan = decontam.contained(documents([(1, "a b c d e f")]), benchmark(spark, [(1, "a b c d e f")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonSQL", ""))
