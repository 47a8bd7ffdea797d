"""Operator 12: exact duplicates by Patricia tries whose terminal nodes own their text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import Scratch, free_names, hot_limit, split_join, tasks

#: Bytes that a trie holds before it spills; text that a task of a pass is given; members of a terminal before it is begun anew.
BUDGET, EACH, MEMBERS = 64 << 20, 64 << 20, 4096
#: What a node takes beside its label.
_NODE = 240
#: Kinds of rows: a document and its terminal; a terminal and its whole text; a terminal that is another's; a terminal's final owner.
MEMBER, TEXT, LINK, OWNER = range(4)
_ROWS = "kind int, key long, doc_id long, row long, n long, n_bytes long, hash long, text binary"
_PASS = f"{_ROWS}, parent long, sha string"


class _Node:
    __slots__ = ("label", "children", "end")

    def __init__(self, label: bytes):
        self.label, self.children, self.end = label, {}, None


#: Stands where a subtree was spilled: what belongs there follows it.
_SPILLED = object()


class Trie:
    """A radix trie of byte strings, compressed: each edge has the longest label that all below it share."""

    def __init__(self):
        self.root, self.held, self.ends = _Node(b""), 0, 0

    def place(self, text: bytes) -> _Node | None:
        """The node at which the text ends, made if there is none; None if its subtree was spilled."""
        node, i = self.root, 0
        while i < len(text):
            below = node.children.get(text[i])
            if below is None:
                node.children[text[i]] = below = _Node(text[i:])
                self.held += _NODE + len(text) - i
                return below
            if not text.startswith(below.label, i):
                low, high = 1, min(len(below.label), len(text) - i)  # the first byte is the same
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if text.startswith(below.label[:mid], i) else (low, mid - 1)
                upper = _Node(below.label[:low])
                upper.children[below.label[low]] = below
                below.label = below.label[low:]
                node.children[text[i]] = below = upper
                self.held += _NODE
            if below.end is _SPILLED:
                return None
            node, i = below, i + len(below.label)
        return node

    @staticmethod
    def terminals(node: _Node, before: bytes) -> Iterator[tuple[bytes, list]]:
        """(text, what the terminal holds) of a subtree; before: the text above the node's label."""
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            before += node.label
            if node.end is not None and node.end is not _SPILLED:
                yield before, node.end
            stack.extend((x, before) for x in node.children.values())

    def __iter__(self) -> Iterator[tuple[bytes, list]]:
        return self.terminals(self.root, b"")

    def _weights(self) -> dict[int, tuple[int, int]]:
        """Bytes and terminals of each subtree."""
        order, weights = [self.root], {}
        for node in order:
            order.extend(node.children.values())
        for node in reversed(order):
            parts = [weights[id(x)] for x in node.children.values()]
            weights[id(node)] = _NODE + len(node.label) + sum(p[0] for p in parts), (node.end is not None and node.end is not _SPILLED) + sum(p[1] for p in parts)
        return weights

    def spill(self, most: int, mark: bool) -> Iterator[tuple[bytes, list]]:
        """Takes subtrees out, the heaviest first, until at most so many bytes are held or one terminal is left; yields their terminals.

        With a mark, what comes later and belongs into a spilled subtree finds it gone.
        """
        while self.held > most and self.ends > 1:
            weights, node, before = self._weights(), self.root, b""
            while True:  # down to where no branch has more than half
                heavy = max(node.children.values(), key=lambda x: weights[id(x)][0])
                if weights[id(heavy)][0] * 2 <= self.held or not weights[id(heavy)][1] or not heavy.children:
                    break
                node, before = heavy, before + heavy.label
            ends = self.ends
            for x in sorted(node.children.values(), key=lambda x: -weights[id(x)][0]):
                size, held = weights[id(x)]
                if self.held <= most:
                    break
                if not held or held >= self.ends:
                    continue
                yield from self.terminals(x, before)
                self.held -= size
                self.ends -= held
                if mark:
                    stub = node.children[x.label[0]] = _Node(x.label[:1])
                    stub.end = _SPILLED
                    self.held += _NODE + 1
                else:
                    del node.children[x.label[0]]
            if ends == self.ends:
                return


def _better(smallest: bool) -> Callable[[int | None, int], tuple]:
    """Sorts owners: the first one stays; rows without an id come last, and of rows with one id the one of the smaller number first."""
    return lambda doc_id, row: (doc_id is None, 0 if doc_id is None else doc_id if smallest else -doc_id, row)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


class _Out:
    """Rows on their way out, in batches of bounded size."""

    def __init__(self, schema: str):
        self.schema = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in schema.split(", ")])
        self.rows, self.size = [], 0

    def add(self, **row) -> None:
        self.rows.append(row)
        self.size += 100 + len(row.get("text") or b"")

    def batches(self, least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            rows, self.rows, self.size = self.rows, [], 0
            yield pa.RecordBatch.from_pylist(rows, self.schema)


def _local(texts: DataFrame, smallest: bool, budget: int) -> DataFrame:
    """The distinct texts of each input task and its documents, each with its terminal; a trie that is full is handed on in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better, trie, out, number = _better(smallest), Trie(), _Out(_ROWS), TaskContext.get().partitionId() << 40

        def text_row(text: bytes, end: list) -> dict:
            return {"kind": TEXT, "key": end[0], "doc_id": end[1], "row": end[2], "n": end[3], "n_bytes": len(text), "hash": end[4], "text": text}

        for batch in batches:
            for doc_id, text, h in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "hash"))):
                number, node = number + 1, trie.place(text)
                if node.end is None:
                    node.end = [number, doc_id, number, 0, h]
                    trie.ends += 1
                end = node.end
                out.add(kind=MEMBER, key=end[0], doc_id=doc_id, row=number)
                end[3] += 1
                if better(doc_id, number) < better(end[1], end[2]):
                    end[1:3] = doc_id, number
                if end[3] == MEMBERS:
                    out.add(**text_row(text, end))
                    node.end = None
                    trie.ends -= 1
                if trie.held > budget:
                    for one in trie.spill(budget // 2, mark=False):
                        out.add(**text_row(*one))
                        yield from out.batches()
                yield from out.batches()
        for one in trie:
            out.add(**text_row(*one))
            yield from out.batches()
        yield from out.batches(0)

    return texts.mapInArrow(run, _ROWS)


def _merged(rows: DataFrame, smallest: bool, budget: int) -> DataFrame:
    """One trie a task: rows of equal texts are linked to the first one's terminal, which comes out as owner, or as text if it meets more later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better, trie, out = _better(smallest), Trie(), _Out(_PASS)

        def text_row(text: bytes, end: list) -> dict:
            return {"kind": TEXT, "key": end[0], "doc_id": end[1], "row": end[2], "n": end[3], "n_bytes": len(text), "hash": end[4], "text": text}

        for batch in batches:
            for key, doc_id, row, n, h, text, final in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "row", "n", "hash", "text", "final"))):
                node = trie.place(text)
                if node is None:
                    out.add(**text_row(text, [key, doc_id, row, n, h]))
                elif node.end is None:
                    node.end = [key, doc_id, row, n, h, final]
                    trie.ends += 1
                else:
                    end = node.end
                    out.add(kind=LINK, key=key, parent=end[0])
                    end[3] += n
                    if better(doc_id, row) < better(end[1], end[2]):
                        end[1:3] = doc_id, row
                if trie.held > budget:
                    for one in trie.spill(budget // 2, mark=True):
                        out.add(**text_row(*one))
                        yield from out.batches()
                yield from out.batches()
        for text, end in trie:
            if end[5]:
                out.add(kind=OWNER, key=end[0], doc_id=end[1], row=end[2], n=end[3], sha=hashlib.sha256(text).hexdigest())
            else:
                out.add(**text_row(text, end))
            yield from out.batches()
        yield from out.batches(0)

    return rows.mapInArrow(run, _PASS)


def owners(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, budget: int = BUDGET, each: int = EACH) -> DataFrame:
    """For each row of documents(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal if their texts are, byte by byte in UTF-8, after `normalise` (by default as they are). Of equal rows, the one with
    the "smallest" or "largest" doc_id stays: keep_id is its doc_id, and kept is true for one row of each group.

    Each input task folds its own rows in a trie first. The distinct texts that remain are dealt out by length and a hash of
    their content, whole byte strings go into one trie a task, and a terminal holds its best id so far. A trie above `budget` bytes
    spills its heaviest subtrees: they go into the next pass, and so does whatever follows them. A pass settles half a budget
    at least in each task (or one text, if that is longer), so passes end. A key of length and hash that more rows have than hot_limit
    is dealt to several tasks and meets again in the next pass, when each has made one row of its own.
    Nothing is compared by hash alone; a terminal has at most 4096 members of a task.

    Defined cases: a null text is an empty one; rows without doc_id take part, and stay only in a group where none has one (keep_id is
    null then); of rows that repeat a doc_id and text one stays; extra columns are ignored; an empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark, smallest = docs.sparkSession, keep == "smallest"
    scratch = Scratch(spark, "exact-dedup")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (normalise(text) if normalise else text).cast("string").alias("text"))
    texts = texts.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("hash"))
    local = scratch.save(_local(texts, smallest, budget), "local")
    rows, passes = local.where(F.col("kind") == TEXT).drop("kind"), []
    while True:
        rows = rows.withColumn("place", F.xxhash64("n_bytes", "hash"))
        count, size = rows.agg(F.count("*"), F.sum("n_bytes")).first()
        if not count:
            break
        k, limit = len(passes), hot_limit(count)
        hot = F.broadcast(rows.groupBy("place").agg(F.count("*").alias("held")).where(F.col("held") > limit))  # HOT_KEYS rows at most
        dealt = rows.join(hot, "place", "left").withColumn("final", F.col("held").isNull())
        dealt = dealt.withColumn("cell", F.expr(f"pmod(xxhash64(key), greatest(1, ceil(coalesce(held, 0) / {limit})))"))
        dealt = dealt.repartition(tasks(spark, size, each), F.xxhash64("place", "cell", F.lit(k))).select("key", "doc_id", "row", "n", "hash", "text", "final")
        passes.append(scratch.save(_merged(dealt, smallest, budget), f"pass-{k}"))
        rows = passes[-1].where(F.col("kind") == TEXT).drop("kind", "parent", "sha")
    members = local.where(F.col("kind") == MEMBER).select("key", "doc_id", "row")
    if not passes:
        return members.select("doc_id", F.col("doc_id").alias("keep_id"), F.col("row").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"))
    known = None
    for k, done in enumerate(passes):
        part = done.where(F.col("kind") == OWNER).select("key", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"), F.col("sha").alias("text_sha256"))
        known = part if known is None else known.union(part)
    for k, done in reversed(list(enumerate(passes))):
        links = done.where(F.col("kind") == LINK).select(F.col("key").alias("child"), F.col("parent").alias("key"))
        known = scratch.save(known, f"known-{k}") if k else known
        known = known.union(split_join(links, known, "key", "child").select(F.col("child").alias("key"), "keep_id", "keep_row", "group_size", "text_sha256"))
    return members.join(known, "key").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of documents that stay, one of each group of equal texts, with all their columns (see owners)."""
    doc_id, sha, at = free_names(docs.columns, "stays_id", "stays_sha", "stays_at")
    stay = owners(docs, keep, normalise).where("kept").select(F.col("doc_id").alias(doc_id), F.col("text_sha256").alias(sha))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.withColumn(sha, F.sha2((normalise(text) if normalise else text).cast("string").cast("binary"), 256))
    same = own.withColumn(at, F.col("doc_id").cast("long")).join(stay, [sha], "inner").where(F.col(at).eqNullSafe(F.col(doc_id)))
    return same.dropDuplicates([sha]).select(docs.columns)


#: DuckDB SQL of the query's rows.
ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
