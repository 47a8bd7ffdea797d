from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tillage.llm.common import Scratch, hadoop_path
from tillage.llm.compaction import ShardStore, sharded


def rows(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_documents_come_back_whole(spark, documents):
    data = [(k, f"text {k}", f"s{k % 3}") for k in range(300)] + [(None, None, None), (5, "text 5", "s2"), (7, "", "s"), (8, "y" * 200_000, "s")]
    df = documents(data)
    store = sharded(df, Scratch(spark, "t-compact").root)
    assert rows(store.read()) == rows(df)
    tiers = store.manifest().groupBy("tier").agg(F.count_distinct("run").alias("runs")).collect()
    assert all(r.runs < store.fanout for r in tiers)
    assert store.manifest().agg(F.sum("n_rows")).first()[0] == len(data)
    assert set(df.columns) <= set(store.read().columns)


def test_versions_stay_readable_and_commit_is_atomic(spark, documents):
    store = ShardStore(spark, Scratch(spark, "t-versions").root)
    assert store.version() == 0 and store.manifest().count() == 0
    for k in range(5):
        store.append(documents([(k, "t")]).coalesce(1))
    assert store.version() == 5 and store.read().count() == 5 and store.read(2).count() == 2
    before = store.version()
    assert store.compact() and store.version() == before + 1
    assert store.read().count() == 5 and store.read(before).count() == 5
    with pytest.raises(Py4JJavaError):  # another writer was first
        store.commit(store.manifest(), before)
    assert store.version() == before + 1 and store.read().count() == 5
    assert store.vacuum() > 0 and store.read().count() == 5


def test_files_have_the_target_size(spark, documents):
    store = ShardStore(spark, Scratch(spark, "t-size").root, target_bytes=20_000)
    for k in range(4):
        store.append(documents([(k * 1000 + i, f"{(k * 1000 + i) * 7919 % 104729} text") for i in range(1000)], extra=False).repartition(5))
    assert store.manifest().count() == 20
    assert store.compact_all() == 1
    sizes = [r.n_bytes for r in store.manifest().collect()]
    assert len(sizes) < 10 and store.read().select("doc_id").distinct().count() == 4000


def test_empty_table(spark, documents):
    store = sharded(documents([]), Scratch(spark, "t-empty").root)
    assert store.version() >= 1 and store.manifest().count() == 0


def test_query_on_an_empty_table(spark, documents, tmp_path):
    from tillage.llm.queries import op8_compaction

    documents([], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    out = op8_compaction(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text_md5", "lang", "source", "n_chars"] and out.collect() == []
    store = sharded(documents([]), Scratch(spark, "t-empty-read").root)
    empty = store.read()
    store.append(documents([(1, "a")]))
    assert empty.collect() == [] and empty.dtypes == store.read().dtypes and rows(store.read()) == [(1, "a", "s")]


def test_added_columns(spark, documents):
    store = ShardStore(spark, Scratch(spark, "t-columns").root)
    store.append(documents([(1, "a")], extra=False))
    store.append(documents([(2, "b")], extra=False).withColumn("new", F.lit(3)))
    assert {r.doc_id: r.new for r in store.read().collect()} == {1: None, 2: 3}


def test_clashing_columns_are_kept(spark, documents):
    df = documents([(k, f"t{k}") for k in range(40)], extra=False).withColumns({"shard": F.lit("a"), "run": F.col("doc_id"), "Tier": F.lit(2), "arrival": F.lit("b"), "arrival_": F.lit("c"), "_metadata_": F.lit("d")})
    out = sharded(df, Scratch(spark, "t-clash").root).read()
    assert out.columns == ["shard_", *df.columns, "run_", "tier_"]
    assert sorted(map(str, out.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert out.where("shard_ like 'run-%' and run_ = substring_index(shard_, '/', 1)").count() == 40


def test_a_writer_that_dies_leaves_no_version(spark, documents):
    store = ShardStore(spark, Scratch(spark, "t-dies").root)
    store.append(documents([(1, "a")]))
    half = hadoop_path(spark, f"{store.root}/committed/begun-00000002-x")[1]
    store.fs.create(half, False).close()  # begun, not filled, not renamed
    assert store.version() == 1 and store.read().count() == 1
    assert store.append(documents([(2, "b")])) == 2 and store.read().count() == 2
    store.vacuum(age_seconds=-60)
    assert not store.fs.exists(half) and store.read().count() == 2


def test_vacuum_spares_what_a_writer_has_yet_to_commit(spark, documents):
    store = ShardStore(spark, Scratch(spark, "t-two").root)
    for k in range(4):
        store.append(documents([(k, "t")]).coalesce(1))
    documents([(9, "t")]).write.parquet(f"{store.root}/data/run-other")  # another writer's run, before its commit
    base = store.version()
    store.compact()
    assert store.vacuum() == 4 and store.version() == base + 1
    names = lambda f: [s.getPath().getName() for s in store.fs.listStatus(hadoop_path(spark, f"{store.root}/{f}")[1])]
    assert len([n for n in names("manifest") if not n.startswith(".")]) == 1 and [n for n in names("committed") if n.isdigit()] == ["00000005"]
    assert store.commit(store.manifest().union(store._listed(["run-other"])), store.version()) == 6
    assert sorted(r.doc_id for r in store.read().collect()) == [0, 1, 2, 3, 9]


def test_of_two_writers_one_wins(spark, documents):
    store = ShardStore(spark, Scratch(spark, "t-race").root)
    store.append(documents([(1, "a")]))
    rows = store.manifest()
    assert store.commit(rows, 1) == 2
    with pytest.raises(Py4JJavaError):
        store.commit(rows, 1)
    assert store.version() == 2 and store.read().count() == 1


def test_an_append_that_loses_a_race_commits_on_the_version_that_won(spark, documents, monkeypatch):
    root = Scratch(spark, "t-append-race").root
    store, other = ShardStore(spark, root), ShardStore(spark, root)
    store.append(documents([(1, "a")]))
    listed, left = store._listed, [2, 3]

    def late(runs):  # while this writer lists its run, others commit theirs
        out = listed(runs)
        while left:
            other.append(documents([(left.pop(), "b")]))
        return out

    monkeypatch.setattr(store, "_listed", late)
    assert store.append(documents([(4, "c")])) == 4
    assert sorted(r.doc_id for r in store.read().collect()) == [1, 2, 3, 4] and store.manifest().select("run").distinct().count() == 4
    assert sorted(r.doc_id for r in store.read(3).collect()) == [1, 2, 3]


def test_a_commit_that_fails_without_a_race_raises(spark, documents, monkeypatch):
    store = ShardStore(spark, Scratch(spark, "t-append-fails").root)
    store.append(documents([(1, "a")]))

    def broken(rows, base):
        raise OSError("no space")

    monkeypatch.setattr(store, "commit", broken)
    with pytest.raises(OSError, match="no space"):
        store.append(documents([(2, "b")]))
    assert store.version() == 1 and store.read().count() == 1
