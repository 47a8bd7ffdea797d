"""Operator 2: token ids in sorted-string-table shards, keyed by document."""

from __future__ import annotations

import bisect
import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.llm.common import Scratch

MAGIC = b"TILLSST1"
#: index offset and length, Bloom filter offset and length, entries, tokens, bytes of an id, crc32 of index and filter, magic.
FOOTER = struct.Struct("<QQQQQQII8s")
INDEX = struct.Struct("<QIIQH")
MANIFEST = "partition int, seq int, path string, n_docs long, n_tokens long, n_bytes long"
ROWS = "path string, doc_id string, start long, n_tokens long, ids_crc32 long"


# --- tokens -----------------------------------------------------------------------------------------------------------

#: The definition, beside vocabulary and merges, of the kind of tokenizer whose pieces can be encoded one by one.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BY_PIECES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


def by_pieces(spec: dict) -> bool:
    """Whether a tokenizer file says, in all its parts, what Encoder's quick way does; its added tokens must begin with <|."""
    model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
    return {**{k: spec.get(k) for k in BY_PIECES}, "model": model} == BY_PIECES and all(t["content"].startswith("<|") for t in spec["added_tokens"])


class Encoder:
    """Ids of whole texts, the same as the tokenizer's encode(); pieces between white space are looked up in a bounded cache.

    Text in Latin-1 is normal under NFC, and its pieces don't touch across ASCII white space; any other text, text with the
    tokenizer's special strings and any tokenizer that isn't defined as BY_PIECES go to encode() itself.
    """

    def __init__(self, path: str, width: str = "<u2", cache: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.width, self.limit = width, cache
        self.model, self.split = self.whole.model, regex.compile(SPLIT)
        with open(path, encoding="utf-8") as file:
            self.fast = by_pieces(json.load(file))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= self.limit:
            self.pieces.clear()
        out = b""
        for part in self.split.findall(piece):
            ids = self.parts.get(part)
            if ids is None:
                if len(self.parts) >= self.limit:
                    self.parts.clear()
                ids = np.array([t.id for t in self.model.tokenize("".join(self.shown[b] for b in part.encode()))], self.width).tobytes()
                self.parts[part] = ids
            out += ids
        self.pieces[piece] = out
        return out

    def __call__(self, text: str) -> bytes:
        fast = self.fast and "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f\x85\xa0")
        if fast and not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                fast = False
        if not fast:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.width).tobytes()
        get, make = self.pieces.get, self._piece
        return b"".join([ids if (ids := get(w)) is not None else make(w) for w in text.lower().split()])


# --- file format ------------------------------------------------------------------------------------------------------


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as doc_id does, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + k * b) % bits for k in range(7)]


class Writer:
    """One shard: prefix-compressed blocks, sparse index (a block's last key and place), Bloom filter, footer. Keys come in order."""

    def __init__(self, out, width: int, block: int = 1 << 16):
        self.out, self.width, self.block = out, width, block
        self.at = self.n = self.tokens = 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self._new()

    def _new(self) -> None:
        self.entries, self.size, self.count, self.last, self.block_tokens = [], 0, 0, b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        same = 0
        while same < min(len(key), len(self.last)) and key[same] == self.last[same]:
            same += 1
        self.entries += [struct.pack("<BBI", same, len(key) - same, len(ids)), key[same:], ids]
        self.size += 6 + len(key) - same + len(ids)
        self.last, self.count = key, self.count + 1
        self.block_tokens += len(ids) // self.width
        self.keys.append(key)
        if self.size >= self.block:
            self._flush()

    def _flush(self) -> None:
        if not self.count:
            return
        data = pa.compress(b"".join(self.entries), codec="zstd", asbytes=True)
        self.out.write(data)
        self.index.append(INDEX.pack(self.at, len(data), self.size, self.tokens, len(self.last)) + self.last)
        self.at += len(data)
        self.n += self.count
        self.tokens += self.block_tokens
        self._new()

    def close(self) -> tuple[int, int, int]:
        self._flush()
        index, bits = b"".join(self.index), max(64, 10 * self.n)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        packed = np.packbits(bloom, bitorder="little").tobytes()
        tail = struct.pack("<Q", bits) + packed
        self.out.write(index + tail + FOOTER.pack(self.at, len(index), self.at + len(index), len(tail), self.n, self.tokens, self.width, zlib.crc32(index + tail), MAGIC))
        self.out.close()
        return self.n, self.tokens, self.at + len(index) + len(tail) + FOOTER.size


class Reader:
    """A shard: walk it in key order, or get() one key by Bloom filter, binary search of the index and one block."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        f = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if f[-1] != MAGIC:
            raise ValueError("not a shard")
        index, tail = self._read(f[0], f[1]), self._read(f[2], f[3])
        if zlib.crc32(index + tail) != f[7]:
            raise ValueError("damaged index")
        self.n, self.tokens, self.width = f[4], f[5], f[6]
        self.bits, self.bloom = struct.unpack_from("<Q", tail)[0], tail[8:]
        self.blocks, self.lasts, at = [], [], 0
        while at < len(index):
            *place, n = INDEX.unpack_from(index, at)
            at += INDEX.size
            self.blocks.append(place)
            self.lasts.append(index[at : at + n])
            at += n

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, n, size, _ = self.blocks[k]
        data = pa.decompress(self._read(at, n), decompressed_size=size, codec="zstd", asbytes=True)
        p, key = 0, b""
        while p < size:
            same, more, m = struct.unpack_from("<BBI", data, p)
            p += 6
            key = key[:same] + data[p : p + more]
            p += more
            yield key, data[p : p + m]
            p += m

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self._entries(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that doc_id, in order."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        found, k = [], bisect.bisect_left(self.lasts, key)
        while k < len(self.blocks):
            found += [np.frombuffer(v, f"<u{self.width}") for x, v in self._entries(k) if x == key]
            if self.lasts[k] > key:
                break
            k += 1
        return found


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a folder that all executors share."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


# --- Spark ------------------------------------------------------------------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_shards(docs: DataFrame, folder: str, scratch: Scratch, tokenizer: str, end_id: int = 2, shard_bytes: int = 64 << 20, task_bytes: int = 128 << 20) -> DataFrame:
    """Encodes whole texts and writes them in ascending doc_id order as shards in a shared folder; returns the manifest, saved.

    A range of keys is one task; there are as many as texts of task_bytes make, and no fewer than the session's shuffle partitions,
    so that a task and what a lost executor costs stay the same size. A task rolls to a new shard at shard_bytes, so its memory does not grow. Names are unique to the
    attempt, and only the manifest says which files count, so a task that runs again leaves no harm. Null text: empty;
    null doc_id: first; rows that repeat a doc_id stay together or in neighbouring shards, ordered by a hash of the text.
    """
    wide = 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part, name = Encoder(tokenizer), TaskContext.get().partitionId(), uuid.uuid4().hex
        width = 2 if encode.whole.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else wide
        encode.width = f"<u{width}"
        end = np.array([end_id], encode.width).tobytes()
        store, root = open_fs(folder)
        writer, seq, rows, path = None, 0, [], ""
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                if writer is None:
                    store.create_dir(root)
                    path = f"shard-{part:06d}-{seq:04d}-{name}.sst"
                    writer = Writer(store.open_output_stream(f"{root}/{path}"), width)
                writer.add(key_of(None if doc_id is None else int(doc_id)), encode(text or "") + end)
                if writer.at >= shard_bytes:
                    rows.append((part, seq, path, *writer.close()))
                    writer, seq = None, seq + 1
        if writer is not None:
            rows.append((part, seq, path, *writer.close()))
        yield pd.DataFrame(rows, columns=["partition", "seq", "path", "n_docs", "n_tokens", "n_bytes"])

    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("u"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / task_bytes))
    order = F.asc_nulls_first("k"), F.asc("h"), F.asc("u")  # u splits rows of one id and text, however many they are
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return scratch.save(ordered.select("doc_id", "text").mapInPandas(run, MANIFEST), "manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the shards of a manifest back: a row per document with its place, length and crc32 of its ids.

    The place counts from the shard's begin, or from base where the manifest has it (ids of all shards before).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_fs(folder)
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"].tolist()):
                rows, start = [], base
                with store.open_input_file(f"{root}/{path}") as file:
                    reader = Reader(file)
                    for key, value in reader:
                        ids = np.frombuffer(value, f"<u{reader.width}")
                        rows.append((path, id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= 10_000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    base = F.col("base") if "base" in manifest.columns else F.lit(0)
    spread = manifest.select("path", base.cast("long").alias("base")).repartition(max(1, manifest.count()))  # a shard is a task
    return spread.mapInPandas(run, ROWS).withColumn("doc_id", F.col("doc_id").cast("long"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["path", "doc_id", "start", "n_tokens", "ids_crc32"])
    return out.assign(doc_id=[None if r[1] is None else str(r[1]) for r in rows])


def lookup(spark: SparkSession, manifest: DataFrame, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents, by binary search in each shard; a shard whose filter lacks a key is not searched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_fs(folder)
        for batch in batches:
            for path in batch["path"]:
                with store.open_input_file(f"{root}/{path}") as file:
                    reader = Reader(file)
                    hits = [(d, ids.astype(np.int64).tolist()) for d in doc_ids for ids in reader.get(d)]
                yield pd.DataFrame(hits, columns=["doc_id", "ids"])

    return manifest.select("path").mapInPandas(run, "doc_id long, ids array<long>")


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = 64 << 20) -> DataFrame:
    """Writes documents as shards and reads them back: doc_id, start (ids of all documents before), n_tokens, ids_crc32, shard.

    Offsets come from a running sum over the manifest, which has a row per shard. An empty table gives no shards and no rows.
    """
    scratch = Scratch(docs.sparkSession, "sstable")
    folder = scratch.path("shards")
    manifest = write_shards(docs, folder, scratch, tokenizer or default_tokenizer(), end_id, shard_bytes)
    before = Window.orderBy("partition", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return read_shards(placed, folder).select("doc_id", "start", "n_tokens", "ids_crc32", F.col("path").alias("shard"))
