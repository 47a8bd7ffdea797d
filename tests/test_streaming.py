from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tillage.streaming import events as s
from tillage.streaming.keyed import KeyedTable, upserts


def rows(spark, *data):
    return spark.createDataFrame([(i, ts, u, k, v, "{}") for i, ts, u, k, v in data], s.EVENTS)


def test_daily_counts_drop_repeats_and_late_events(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    t = lambda d, h=1, m=0: datetime(2026, 5, d, h, m)

    def land(*data):
        rows(spark, *data).coalesce(1).write.mode("append").parquet(src)
        q = s.append_available(s.daily_counts(s.event_stream(spark, src)), out, cp)
        q.awaitTermination()

    land((1, t(1), 7, "error", 1.5), (1, t(1), 7, "error", 1.5), (2, t(1, 2), 7, "error", 2.25), (3, t(1, 3), 8, "view", 1.0))
    land((4, t(3, 5), 7, "error", 1.0))
    land((5, t(1, 9), 7, "error", 100.0), (6, t(5, 9), 7, "error", 1.0))  # the first comes days late
    land((7, t(9), 1, "view", 0.0))
    got = {(r.day, r.user_id, r.event_type): (r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert got[date(2026, 5, 1), 7, "error"] == (2, 3.75) and got[date(2026, 5, 1), 8, "view"] == (1, 1.0)
    assert got[date(2026, 5, 3), 7, "error"] == (1, 1.0) and got[date(2026, 5, 5), 7, "error"] == (1, 1.0)


def test_rolling_intensity_is_what_the_events_give(spark):
    day = "day date, user_id long, event_type string, n long, total double"
    days = spark.createDataFrame([(date(2026, 5, 1), 1, "error", 100, 0.0), (date(2026, 4, 1), 1, "error", 50, 0.0), (date(2026, 1, 1), 1, "error", 9, 0.0), (date(2026, 5, 1), 1, "view", 9, 0.0)], day)
    r = s.rolling_intensity(days, F.lit("2026-05-30").cast("date")).collect()
    assert [(x.user_id, x.events_last_30d, x.events_last_90d, x.intensity_score) for x in r] == [(1, 100, 150, 20.0)]


def test_sliding_windows_over_several_runs(spark, tmp_path):
    """State is kept between runs: each window comes out once, when its last day is over, and holds what all runs brought."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    t = lambda d, h=1: datetime(2026, 5, d, h)

    def land(*data):
        rows(spark, *data).coalesce(1).write.mode("append").parquet(src)
        s.append_available(s.sliding_intensity(s.event_stream(spark, src), short=2, long=3, baseline=4.0), out, cp).awaitTermination()
        return {(r.as_of.day, r.user_id): (r.events_short, r.events_long, r.value_short, r.intensity_score) for r in spark.read.parquet(out).collect()} if any((tmp_path / "out").glob("*.parquet")) else {}

    assert land((1, t(1), 7, "error", 1.5), (1, t(1), 7, "error", 1.5), (2, t(1), 7, "view", 9.0), (3, t(1, 20), 8, "error", 1.0)) == {}
    got = land((4, t(2), 7, "error", 2.25), (5, t(2, 2), 7, "error", None))
    assert got == {(2, 7): (1, 1, 1.5, 25.0), (2, 8): (1, 1, 1.0, 25.0)}
    got = land((6, t(6), 9, "error", 0.0), (1, t(6), 9, "error", 0.0))  # an id may come again once the watermark is past it
    assert got == {(2, 7): (1, 1, 1.5, 25.0), (2, 8): (1, 1, 1.0, 25.0), (3, 7): (3, 3, 3.75, 75.0), (3, 8): (1, 1, 1.0, 25.0), (4, 7): (2, 3, 2.25, 50.0), (4, 8): (0, 1, 0.0, 0.0), (5, 7): (0, 2, 0.0, 0.0)}


SCHEMA = "iso3 string, year int, value double"


def keyed(spark, tmp_path, **more):
    return KeyedTable(spark, str(tmp_path / "t"), ["iso3"], ["year", "value"], SCHEMA, **more), lambda *r: spark.createDataFrame(list(r), SCHEMA)


def held(table, number=None):
    return {tuple(r) for r in table.current(number).collect()}


def test_upserts_keep_the_newest_and_can_run_again(spark, tmp_path):
    table, batch = keyed(spark, tmp_path)
    assert table.current().count() == 0 and table.rows() == 0
    table.merge(batch(("A", 2024, 1.0), ("B", 2024, 2.0)), 0)
    table.merge(batch(("A", 2023, 9.0), ("B", 2025, 3.0), ("C", 2025, None)), 1)
    table.merge(batch(("A", 2023, 9.0), ("B", 2025, 3.0), ("C", 2025, None)), 1)
    want = {("A", 2024, 1.0), ("B", 2025, 3.0), ("C", 2025, None)}
    assert held(table) == want and table.rows() == 3
    table.merge(batch(("A", 2030, 0.0)), 2)  # however small, a batch adds to the table
    want = {("A", 2030, 0.0), ("B", 2025, 3.0), ("C", 2025, None)}
    assert held(table) == want
    table.merge(batch(), 3)
    assert held(table) == want and table.numbers() == [2, 3]


def test_a_batch_writes_only_the_buckets_that_it_touches(spark, tmp_path):
    table, batch = keyed(spark, tmp_path, buckets=16, versions=3)
    table.merge(batch(*((f"k{k}", 2020, float(k)) for k in range(200))), 0)
    before = table._places(0)
    table.merge(batch(("k7", 2021, -1.0), ("new", 2021, 0.5)), 1)
    after = table._places(1)
    moved = {b for b in after if before.get(b) != after[b]}
    assert len(before) == 16 and 1 <= len(moved) <= 2 and table.rows() == 201
    written = [p for p in (tmp_path / "t" / "data").glob("v000000001-*/*") if p.is_dir()]
    assert len(written) == len(moved)
    # a replay makes its version from the ones below, whatever it or a later one left
    table.merge(batch(("k7", 2030, -2.0)), 2)
    table.merge(batch(("k7", 2021, -1.0), ("new", 2021, 0.5)), 1)
    assert ("k7", 2021, -1.0) in held(table, 1) and ("k7", 2030, -2.0) in held(table, 2) and len(held(table, 1)) == len(held(table, 2)) == 201


def test_versions_go_with_the_data_that_only_they_name(spark, tmp_path):
    table, batch = keyed(spark, tmp_path, buckets=4, versions=2)
    for n in range(5):
        table.merge(batch(*((f"k{k}", n, float(n)) for k in range(0, 40, n + 1))), n)
    assert table.numbers() == [3, 4] and {r[0]: r[1] for r in held(table)} == {f"k{k}": max(n for n in range(5) if k % (n + 1) == 0) for k in range(40)}
    named = {p for n in (3, 4) for p, _ in table._places(n).values()}
    assert {f"data/{p.parent.name}/{p.name}" for p in (tmp_path / "t" / "data").glob("*/bucket__=*")} == named


def test_a_poor_snapshot_leaves_the_table(spark, tmp_path):
    table, batch = keyed(spark, tmp_path, buckets=4, versions=3)
    assert table.replace(batch(*((f"k{k}", 1, 0.0) for k in range(9))), 0)
    assert not table.replace(batch(("k1", 2, 0.0)), 1) and table.numbers() == [0, 1] and table.rows() == 9
    assert table.replace(batch(*((f"j{k}", 1, 0.0) for k in range(6))), 2) and {r[0] for r in held(table)} == {f"j{k}" for k in range(6)}
    assert table.replace(batch(*((f"k{k}", 1, 0.0) for k in range(3))), 1) is False  # again, and from the version below it
    assert table.rows() == 6 and table.replace(batch(("k1", 3, 0.0)), 0)  # the first one again has nothing below it
    table.replace(batch(*((f"k{k}", 1, 0.0) for k in range(9))), 3)
    with pytest.raises(ValueError, match="gone"):
        table.merge(batch(("k1", 2, 0.0)), 1)


def test_upserts_of_a_stream(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "t")
    put = upserts(root, ["iso3"], ["year"], SCHEMA, buckets=8)
    table, batch = keyed(spark, tmp_path)
    for r in ((("A", 1, 1.0), ("B", 1, 1.0)), (("A", 2, 2.0),), (("C", 1, 3.0), ("B", 0, 9.0))):
        batch(*r).coalesce(1).write.mode("append").parquet(src)
        spark.readStream.schema(SCHEMA).parquet(src).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(put).start().awaitTermination()
    assert held(table) == {("A", 2, 2.0), ("B", 1, 1.0), ("C", 1, 3.0)}
