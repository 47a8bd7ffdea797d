from __future__ import annotations

import io
import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillage.llm import sstable
from tillage.llm.common import Scratch


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(sstable.default_tokenizer())


ENCODER = sstable.Encoder(sstable.default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def expected(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*ids_of(tokenizer, text), 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


TEXTS = ["Hello, World! it's 2024", "", None, "don't  DO\tthat\n\n", "naïve Éclair ß ÀÉ", "日本語のテキスト", "a" * 3000, "<|endoftext|> x", "tab\x1cfs \x85nel\xa0nbsp", "é combining", "İstanbul ſ K", "1234567 ..!!", "'S 'LL 'sx", "­ soft", "fi ligature"]


@pytest.mark.parametrize("text", TEXTS)
def test_encoder_gives_the_tokenizers_ids(tokenizer, text):
    assert np.frombuffer(ENCODER(text or ""), "<u2").tolist() == ids_of(tokenizer, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), st.sampled_from("'s't<|>\x1c\x85\xa0́İ")), max_size=60))
def test_encoder_gives_the_tokenizers_ids_for_any_text(text):
    assert np.frombuffer(ENCODER(text), "<u2").tolist() == ENCODER.whole.encode(text, add_special_tokens=False).ids


def test_only_the_known_definition_takes_the_quick_way(tmp_path):
    spec = json.loads(open(sstable.default_tokenizer(), encoding="utf-8").read())
    assert sstable.by_pieces(spec) and ENCODER.fast
    other = json.loads(json.dumps(spec))
    other["normalizer"]["normalizers"].pop(0)
    assert not sstable.by_pieces(other)
    for part, value in (("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}), ("post_processor", {"type": "x"}), ("model", spec["model"] | {"dropout": 0.1})):
        assert not sstable.by_pieces(spec | {part: value})
    (tmp_path / "other.json").write_text(json.dumps(spec | {"normalizer": {"type": "Lowercase"}}))
    encode = sstable.Encoder(str(tmp_path / "other.json"))
    assert not encode.fast and np.frombuffer(encode("Two  Words"), "<u2").tolist() == encode.whole.encode("Two  Words", add_special_tokens=False).ids


def test_tasks_follow_the_size(spark, documents):
    scratch = Scratch(spark, "t-tasks")
    manifest = sstable.write_shards(documents([(k, "some words " * 50) for k in range(400)]), scratch.path("s"), scratch, sstable.default_tokenizer(), task_bytes=5000)
    assert 40 <= manifest.select("partition").distinct().count() <= 44


def test_equal_rows_are_dealt_to_many_tasks(spark, documents):
    scratch = Scratch(spark, "t-equal")
    manifest = sstable.write_shards(documents([(5, "the same text")] * 300 + [(6, "t")]).repartition(6), scratch.path("s"), scratch, sstable.default_tokenizer())
    rows = [r.n_docs for r in manifest.collect()]
    assert sum(rows) == 301 and max(rows) < 150


def test_table_matches_the_tokenizer(documents, tokenizer, rng):
    rows = [(k * 7 - 30, t) for k, t in enumerate(TEXTS)] + [(10_000 + k, " ".join(f"word{rng.randrange(999)}" for _ in range(rng.randrange(300)))) for k in range(60)]
    out = sstable.token_table(documents(rows), shard_bytes=4000)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out.collect()) == sorted(expected(tokenizer, rows))
    assert out.select("shard").distinct().count() > 1


def test_null_and_repeated_ids(documents, tokenizer):
    rows = [(None, "first"), (3, "b"), (3, "b"), (3, "other text"), (1, None)]
    out = sorted(sstable.token_table(documents(rows)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 3, 3, 3]
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1]]
    assert sum(r.n_tokens for r in out) == sum(len(ids_of(tokenizer, t)) + 1 for _, t in rows)


def test_empty_table(documents):
    assert sstable.token_table(documents([])).collect() == []


def test_lookup_finds_documents_by_id(spark, documents, tokenizer):
    rows = [(k * 3, f"text number {k}") for k in range(200)] + [(30, "again")]
    scratch = Scratch(spark, "lookup")
    manifest = sstable.write_shards(documents(rows), scratch.path("s"), scratch, sstable.default_tokenizer(), shard_bytes=500)
    found = {(r.doc_id, tuple(r.ids)) for r in sstable.lookup(spark, manifest, scratch.path("s"), [30, 31, 597, -5]).collect()}
    assert found == {(d, (*ids_of(tokenizer, t), 2)) for d, t in rows if d in (30, 597)}


def write(entries, block=200):
    out = io.BytesIO()
    out.close, kept = (lambda: None), out
    w = sstable.Writer(out, 2, block)
    for k, v in entries:
        w.add(sstable.key_of(k), np.array(v, "<u2").tobytes())
    w.close()
    kept.size = lambda: len(kept.getvalue())
    return kept


def test_shard_round_trip_and_search():
    entries = [(None, [9]), *((k, list(range(k % 50))) for k in range(-500, 500, 2)), (498, [1, 2])]
    r = sstable.Reader(write(entries))
    assert [(sstable.id_of(k), np.frombuffer(v, "<u2").tolist()) for k, v in r] == entries
    assert r.n == len(entries) and r.tokens == sum(len(v) for _, v in entries) and len(r.blocks) > 5
    assert [x.tolist() for x in r.get(498)] == [list(range(48)), [1, 2]] and r.get(497) == [] and [x.tolist() for x in r.get(None)] == [[9]]
    present = sum(bool(r.get(k)) for k in range(-499, 500, 2))
    assert present == 0


def test_damage_is_noticed():
    data = write([(k, [k]) for k in range(100)])
    raw = bytearray(data.getvalue())
    raw[struct.calcsize("<Q") * -6 - 30] ^= 255
    broken = io.BytesIO(bytes(raw))
    broken.size = lambda: len(raw)
    with pytest.raises(ValueError):
        sstable.Reader(broken)


def test_queries_columns(documents):
    df = documents([(1, "a b")]).withColumn("k", F.lit(1)).withColumn("base", F.lit(2))
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(sstable.token_table(df).columns)
