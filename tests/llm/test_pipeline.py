from __future__ import annotations

import zlib

import numpy as np
import pytest
from plain import components_of, shingles_of
from pyspark.sql import functions as F
from test_decontam import brute as leaks
from test_minhash import similar

import corpus_pipeline
from tillage.llm import mixing, quality_cnn, sstable
from tillage.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """What each stage gets and gives on the smallest tables, written and read in between."""
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{root}/{name}")
        kept = spark.read.parquet(f"{root}/{name}")
        out[name] = (docs, kept)
        docs = kept
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stage_names_and_columns(stages, spark, small):
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_leaks", "mixing", "token_shards"]
    assert all(kept.columns == columns for name, (_, kept) in stages.items() if name != "token_shards")


def test_quality_keeps_what_the_classifier_predicts(stages, spark, small):
    given, kept = stages["quality"]
    scored = quality_cnn.quality_scores(given, table(spark, small, "labels"))
    assert ids(kept) == sorted(r.doc_id for r in scored.where("predicted = 1").collect())
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").join(kept, "doc_id", "left_anti").count()
    assert good <= 0.03 * given.count()


def test_near_duplicates_keep_the_first_of_each_group(stages):
    given, kept = stages["near_duplicates"]
    groups = components_of({r.doc_id: shingles_of(r.text, 5) for r in given.collect()}, similar(80))
    assert ids(kept) == sorted(set(groups.values()))


def test_leaks_go_and_nothing_else(stages, spark, small):
    given, kept = stages["benchmark_leaks"]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    held = {d for d, _ in leaks([(r.doc_id, r.text) for r in given.collect()], items)}
    assert ids(kept) == [d for d in ids(given) if d not in held]


def test_mixing_takes_documents_as_often_as_the_mix_says(stages):
    given, kept = stages["mixing"]
    want = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mixed(given).collect() if r.size}
    got = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in want.items() if n}


def test_tokens_are_those_of_the_texts_in_order(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(sstable.default_tokenizer())
    given, kept = stages["token_shards"]
    start, want = 0, []
    for r in sorted(given.collect(), key=lambda r: r.doc_id):
        x = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in kept.collect()) == sorted(want)


def test_stages_take_odd_documents(spark, small, documents):
    rows = [(None, "some words here"), (1, None), (2, ""), (3, "plain words of no import at all"), (3, "plain words of no import at all"), (4, "w " * 50_000)]
    for name, stage in corpus_pipeline.STAGES:
        df = documents(rows).withColumn("n_chars", F.lit(None).cast("long"))
        assert stage(spark, df, small).count() <= 2 * len(rows), name
        assert stage(spark, documents([]), small).count() == 0, name
