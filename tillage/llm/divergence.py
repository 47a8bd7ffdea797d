"""Operator 11: how the words of each source differ from the others' of its language, by a vocabulary automaton in two passes."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.common import Scratch, tasks

#: A term is a run of letters A to Z and of characters beyond ASCII; A-Z are lower-cased, and all else becomes a space.
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of text in a block, and in a task before its blocks are closed; distinct terms of a block; sources of a block that meets others; postings of a meeting, about.
BLOCK, OPEN, TERMS, SOURCES, POSTINGS = 8 << 20, 16 << 20, 400_000, 256, 400_000
#: The terms of most blocks, at most so many of at most so many bytes, go to all tasks; the others go to the blocks that have them.
COMMON, LONGEST = 100_000, 256
#: Counts that a task gathers before they go out.
GATHERED = 3_000_000
ONE = 1_000_000_000
#: Kinds of rows of the first pass: how often (times) a source has which of a block's terms (text; both packed, n is the length of its text here), a block's different terms as a packed text,
#: and a term with how many documents (n) have it here for the first time.
TIMES, TEXT, TERM = 0, 1, 2
_FIRST = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("text", pa.binary()), ("times", pa.binary()), ("term", pa.binary()), ("n", pa.int64())])
_SECOND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("number", pa.int64()), ("count", pa.int64())])


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of a text of about so many bytes, cut at spaces."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _rows(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    """So many rows; what is no list or array stands in each, and columns that aren't given are null."""
    full = lambda f: columns.get(f.name) if isinstance(columns.get(f.name), (list, np.ndarray)) else [columns.get(f.name)] * rows
    return pa.RecordBatch.from_arrays([pa.array(full(f), f.type) for f in schema], schema=schema)


class _Block:
    """Documents of one language: their different terms by number, and the numbers of each part of a document, with its source."""

    def __init__(self):
        self.terms: dict[bytes, int] = defaultdict(count().__next__)
        self.parts, self.sources, self.lengths, self.again, self.size = [], [], Counter(), [], 0

    def add(self, source: str, part: bytes, terms: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.terms.__getitem__, terms), np.int32, len(terms)))
        self.sources.append(source)
        self.lengths[source] += len(part)
        self.size += len(part)

    def batches(self, block: int, lang: str) -> Iterator[pa.RecordBatch]:
        pack, terms, many = zstandard.ZstdCompressor(level=3), list(self.terms), len(self.terms)
        yield _rows(_FIRST, 1, kind=TEXT, block=block, lang=lang, source="", text=[pack.compress(b" ".join(terms))])
        of, docs = {s: k for k, s in enumerate(self.lengths)}, -np.bincount(np.concatenate([np.empty(0, np.int32), *self.again]), minlength=many)
        lengths, numbers = [len(p) for p in self.parts], np.concatenate(self.parts).astype(np.int64)
        pairs = np.sort(np.repeat(np.arange(len(lengths)), lengths) * many + numbers)
        docs += np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]]] % many, minlength=many)
        found, times = np.unique(np.repeat([of[s] for s in self.sources], lengths) * many + numbers, return_counts=True)
        marks = np.searchsorted(found, np.arange(len(of) + 1) * many)
        for (source, k), lo, hi in zip(of.items(), marks, marks[1:]):
            own = (found[lo:hi] - k * many).astype(np.int32)
            yield _rows(_FIRST, 1, kind=TIMES, block=block, lang=lang, source=source, text=[pack.compress(own.tobytes())], times=[pack.compress(times[lo:hi].astype(np.int64).tobytes())], n=self.lengths[source])
        docs = docs.tolist()
        terms.sort()
        for lo in range(0, many, 50_000):
            some = terms[lo : lo + 50_000]
            yield _rows(_FIRST, len(some), kind=TERM, block=block, lang=lang, term=some, n=[docs[self.terms[t]] for t in some])


def _first_pass(docs: DataFrame) -> DataFrame:
    """Blocks of bounded size, each with its texts and with every term that occurs in it; a document counts in the first block that has the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_, held = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for text, lang, source in zip(*(batch[c].to_pylist() for c in ("text", "lang", "source"))):
                seen, parts = set(), list(pieces(text.translate(_LETTERS), BLOCK // 2))
                for part in parts:
                    terms = part.split()
                    if not terms:
                        continue
                    block = open_.setdefault(lang, _Block())
                    block.add(source, part, terms)
                    if len(parts) > 1:
                        known = seen.intersection(terms)
                        block.again.append(np.fromiter(map(block.terms.__getitem__, known), np.int32, len(known)))
                        seen.update(terms)
                    held += len(part)
                    if held >= OPEN or block.size >= BLOCK or len(block.terms) >= TERMS:
                        for name in list(open_) if held >= OPEN else [lang]:
                            closed, number = open_.pop(name), number + 1
                            held -= closed.size
                            yield from closed.batches(number, name)
        for name, block in open_.items():
            number += 1
            yield from block.batches(number, name)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    given = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *named)
    return given.mapInArrow(run, "kind int, block long, lang string, source string, text binary, times binary, term binary, n long")


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds the terms with a space on either side; the value of each is its place in the list."""
    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word(f" {term} ", k)
    found.make_automaton()
    return found


def occurrences(found: ahocorasick.Automaton, text: str) -> Counter:
    """How often each term of an automaton stands in a text of terms and spaces that begins and ends with one; neighbours share a space."""
    return Counter(map(itemgetter(1), found.iter(text)))


def places(found: ahocorasick.Automaton, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The terms of an automaton in a text of different terms with one space around each, and which of the text's terms they are."""
    flat = np.fromiter(chain.from_iterable(found.iter(text)), np.int64)
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    return flat[1::2], np.searchsorted(spaces, flat[0::2]) - 1  # a match ends at the space behind its term


def _text(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


class _Gathered:
    """Counts by lang, source and term, added up in a task until they are many."""

    def __init__(self):
        self.parts, self.size = {}, 0

    def add(self, lang: str, source: str, numbers: np.ndarray, counts: np.ndarray) -> None:
        self.parts.setdefault((lang, source), []).append((numbers, counts))
        self.size += len(numbers)

    def batches(self, most: int) -> Iterator[pa.RecordBatch]:
        if self.size <= most:
            return
        self.size = 0
        for key, parts in self.parts.items():
            numbers, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.zeros(len(numbers), np.int64)
            np.add.at(counts, at, np.concatenate([p[1] for p in parts]))
            self.parts[key] = [(numbers, counts)]
            self.size += len(numbers)
        if self.size > most // 2:
            for (lang, source), [(numbers, counts)] in self.parts.items():
                for lo in range(0, len(numbers), 100_000):
                    some = slice(lo, lo + 100_000)
                    yield _rows(_SECOND, len(numbers[some]), lang=lang, source=source, number=numbers[some], count=counts[some])
            self.parts, self.size = {}, 0


def _second_pass(blocks: DataFrame, common: Broadcast) -> DataFrame:
    """Counts of the kept terms by source: rows come block by block, its kept terms that aren't common ones first, then the text of its terms, then how often sources have these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, terms, numbers, kept, gathered, unpack = None, [], [], np.empty(0, np.int64), _Gathered(), zstandard.ZstdDecompressor()
        of_lang: dict[str, tuple[ahocorasick.Automaton, np.ndarray]] = {}
        for batch in batches:
            for block, kind, lang, source, text, times, term, number in zip(*(batch[c].to_pylist() for c in ("block", "kind", "lang", "source", "text", "times", "term", "number"))):
                if block != at:
                    at, terms, numbers = block, [], []
                if kind == TERM:
                    terms.append(_text(term))
                    numbers.append(number)
                    continue
                if kind == TIMES:
                    held = kept[np.frombuffer(unpack.decompress(text), np.int32)]
                    gathered.add(lang, source, held[held >= 0], np.frombuffer(unpack.decompress(times), np.int64)[held >= 0])
                    yield from gathered.batches(GATHERED)
                    continue
                if lang not in of_lang:
                    if len(of_lang) >= 8:
                        of_lang.pop(next(iter(of_lang)))
                    listed = common.value.get(lang, [])
                    of_lang[lang] = automaton([_text(t) for t, _ in listed]), np.array([n for _, n in listed], np.int64)
                own = automaton(terms), np.array(numbers, np.int64)
                parts = []  # the numbers of the block's terms, -1 for those that aren't kept
                for part in pieces(unpack.decompress(text), 1 << 20):
                    padded = f" {_text(part.strip())} "
                    parts.append(np.full(padded.count(" ") - 1, -1, np.int64))
                    for found, named in (of_lang[lang], own):
                        if len(named):
                            which, place = places(found, padded)
                            parts[-1][place] = named[which]
                kept = np.concatenate(parts)
        yield from gathered.batches(GATHERED)
        yield from gathered.batches(0)

    return blocks.mapInArrow(run, "lang string, source string, number long, count long")


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total) in whole numbers, for 0 <= count < total < 9 * 10^15."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _meeting(groups: dict[int, tuple[bool, bool, int, int]], postings: dict[str, np.ndarray], base: bool) -> Iterator[tuple[int, int, int]]:
    """(left, right, value) of all pairs of two blocks of sources, over the terms given.

    groups: number -> (stands left, stands right, N + V, V). A pair's value is V * f(zero, zero) (if this meeting gives the base), and
    for each posting of the left source what its count adds to f with zero on the right, for each of the right source the like, and for
    terms that both have what is still missing.
    """
    left = np.array(sorted(g for g, x in groups.items() if x[0]))
    right = np.array(sorted(g for g, x in groups.items() if x[1]))
    total = {g: x[2] for g, x in groups.items()}
    vocabulary = next(iter(groups.values()))[3]
    if not vocabulary:
        yield from ((a, b, 0) for a in left.tolist() for b in right.tolist() if a != b)
        return
    of_left, of_right = (np.array([total[g] for g in side], np.int64) for side in (left, right))
    p0, q0 = shares(np.zeros_like(of_left), of_left), shares(np.zeros_like(of_right), of_right)
    none = distance(p0[:, None], q0[None, :])
    out = none * vocabulary if base else np.zeros_like(none)
    order = np.argsort(postings["term"], kind="stable")
    term, group, count = (postings[c][order] for c in ("term", "group", "count"))
    row, column = np.searchsorted(left, group), np.searchsorted(right, group)
    is_left = left[np.minimum(row, len(left) - 1)] == group
    is_right = right[np.minimum(column, len(right) - 1)] == group
    share = shares(count, np.array([total[g] for g in group.tolist()], np.int64)) if len(group) else count
    for at, mine, zero, n in ((row, is_left, q0, len(left)), (column, is_right, p0, len(right))):
        for k in range(n):  # what one side's counts add, by distinct share
            values, times = np.unique(share[mine & (at == k)], return_counts=True)
            if len(values) and zero is q0:
                out[k] += ((distance(values[:, None], q0[None, :]) - none[k]) * times[:, None]).sum(0)
            elif len(values):
                out[:, k] += ((distance(p0[None, :], values[:, None]) - none[:, k]) * times[:, None]).sum(0)
    begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
    end = np.r_[begin[1:], len(term)]
    run = np.repeat(np.arange(len(begin)), end - begin)
    for k in range(len(left)):  # terms that both sides have
        mine = np.flatnonzero(is_left & (row == k))
        if not len(mine):
            continue
        lengths = (end - begin)[run[mine]]
        other = np.repeat(begin[run[mine]], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        p, own = np.repeat(share[mine], lengths), is_right[other]
        p, q, c = p[own], share[other[own]], column[other[own]]
        np.add.at(out[k], c, distance(p, q) - distance(p, q0[c]) - distance(p0[k], q) + none[k][c])
    for i, a in enumerate(left.tolist()):
        for j, b in enumerate(right.tolist()):
            if a != b:
                yield a, b, int(out[i, j])


_PAIRS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int64())])


def _pairs(dealt: DataFrame) -> DataFrame:
    """Partial values of pairs of sources; the rows of a meeting stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, groups, parts = None, {}, []

        def done() -> Iterator[pa.RecordBatch]:
            if groups:
                postings = {c: np.concatenate([p[c] for p in parts]) if parts else np.empty(0, np.int64) for c in ("term", "group", "count")}
                rows = list(_meeting(groups, postings, at[3] == 0))
                if rows:
                    yield _rows(_PAIRS, len(rows), lang=at[0], **{c: list(x) for c, x in zip(("a", "b", "part"), zip(*rows))})

        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("lang", "x", "y", "bucket"))))
            marks = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(marks, marks[1:]):
                if hi == lo:
                    continue
                if keys[lo] != at:
                    yield from done()
                    at, groups, parts = keys[lo], {}, []
                own = batch.slice(lo, hi - lo)
                fixed = own.filter(pa.compute.equal(own["kind"], 0))
                for g, x, y, total, v in zip(*(fixed[c].to_pylist() for c in ("group", "is_left", "is_right", "total", "v"))):
                    groups[g] = (x, y, total, v)
                some = own.filter(pa.compute.equal(own["kind"], 1))
                parts.append({c: some[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("term", "group", "count")})
        yield from done()

    return dealt.mapInArrow(run, "lang string, a long, b long, part long")


def _exact_share(count: str, total: str) -> Column:
    """shares() as a Column; products beyond a long are decimals."""
    return F.expr(f"1 + CASE WHEN {count} < {8 * ONE} THEN {ONE}L * ({count} + 1) div {total} ELSE (CAST({ONE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST({total} AS DECIMAL(20,0)) END")


def _common(kept: DataFrame) -> DataFrame:
    """The terms of kept that stand in most blocks, COMMON at most; of those that stand in about as many as the last, none or all. So no other short term has many blocks."""
    step = F.floor(F.log2("blocks") * 16).cast("int")
    short = kept.where(F.length("term") <= LONGEST).withColumn("step", step)
    room, least = COMMON, 1 << 20
    for r in sorted(short.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):  # about a thousand steps at most
        if r["n"] > room:
            break
        room, least = room - r["n"], r["step"]
    return short.where(F.col("step") >= least).drop("step")


def _groups(docs: DataFrame, kept: DataFrame, postings: DataFrame) -> DataFrame:
    """Each (lang, source), numbered within its lang: n occurrences, v terms kept, total = n + v, n_lang, and into how many blocks and buckets its lang is dealt."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*names).distinct()
    groups = groups.join(postings.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("held")), ["lang", "source"], "left")
    groups = groups.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").na.fill(0, ["n", "held", "v"])
    lang = Window.partitionBy("lang")
    groups = groups.withColumn("group", F.row_number().over(lang.orderBy("source")).cast("long") - 1).withColumn("total", F.col("n") + F.col("v"))
    return groups.withColumns(
        {"n_lang": F.sum("n").over(lang), "blocks": F.ceil(F.count("*").over(lang) / SOURCES), "buckets": F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("held").over(lang) / POSTINGS))}
    )


def _dealt(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of meetings (lang, x, y, bucket): of sources in block x, which stand left, and in block y, which stand right, over a bucket of terms.

    A posting goes to the meetings of its own source's block, a group's row (kind 0) to all buckets of these.
    """
    met = F.expr(
        "explode(concat(transform(sequence(0L, blocks - 1), y -> named_struct('x', mine, 'y', y, 'is_left', true, 'is_right', y = mine)),"
        " transform(filter(sequence(0L, blocks - 1), x -> x <> mine), x -> named_struct('x', x, 'y', mine, 'is_left', false, 'is_right', true))))"
    )
    groups = groups.withColumn("mine", F.floor(F.col("group") / SOURCES))
    zero = F.lit(0).cast("long")
    fixed = groups.withColumn("met", met).withColumn("bucket", F.explode(F.expr("sequence(0L, buckets - 1)")))
    fixed = fixed.select("lang", "met.x", "met.y", "bucket", F.lit(0).alias("kind"), "group", "met.is_left", "met.is_right", "total", "v", zero.alias("term"), zero.alias("count"))
    found = postings.join(groups.select("lang", "source", "group", "mine", "blocks", "buckets"), ["lang", "source"])
    found = found.withColumn("bucket", F.pmod(F.xxhash64("number"), F.col("buckets"))).select("lang", "bucket", "group", "number", "count", met.alias("met"))
    found = found.select("lang", "met.x", "met.y", "bucket", F.lit(1).alias("kind"), "group", "met.is_left", "met.is_right", zero.alias("total"), zero.alias("v"), F.col("number").alias("term"), "count")
    rows = groups.agg(F.sum(F.expr("held * blocks * 2"))).first()[0] or 0
    meeting = ["lang", "x", "y", "bucket"]
    return fixed.unionByName(found).repartition(tasks(groups.sparkSession, rows, POSTINGS), *meeting).sortWithinPartitions(*meeting, "kind")


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """How each (lang, source) of documents(text, lang, source) differs: lang, source, part, item, value, rank.

    Terms are runs of letters A-Z (lower-cased) and characters beyond ASCII. A lang keeps the V terms that at least `least_docs` of its documents
    have. A group (lang, source), and a lang as a whole, gives a kept term with so many occurrences p = 1 + floor(10^9 * (count + 1) / (N + V)),
    N the counts' sum over kept terms; f(p, q) = floor((p - q)^2 / q). Part "pair": each other source of the lang, f summed over all kept terms.
    Part "term": the kept terms that the group has and that have a greater p there than in the lang, by f, the first `top`. Ranks go by
    falling value, then by the item's bytes.

    First pass: documents become blocks of bounded size of one lang, with their distinct terms, and exact document frequencies are summed. Second
    pass: the different terms of a block, padded with spaces, are met by two automata of kept terms, and each source's counts there go by these: one of the 100,000 terms of most blocks, which all tasks
    get, and one of each block's other kept terms, which go to the blocks that have them; so no task or broadcast holds the whole vocabulary. Pairs come from postings (term, source, count), dealt by term and by blocks of 256 sources, without
    a row for a term and pair: what a zero on one or both sides gives is added by distinct count. All numbers are whole.

    Defined cases: null text, lang and source are ''; groups without terms still give pairs; a lang without kept terms gives pairs of value 0; rows
    that repeat count each; texts are whole, and one longer than a block is cut between terms and counted as one document; extra columns are
    ignored; an empty table gives no rows. Sums of counts are to stay below 9 * 10^15.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    first = scratch.save(_first_pass(docs), "blocks", compression="zstd")
    terms = first.where(F.col("kind") == TERM).select("block", "lang", "term", "n")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).where(F.col("n") >= least_docs)
    kept = scratch.save(kept.select("lang", "term", "blocks", F.monotonically_increasing_id().alias("number")), "kept")
    common = _common(kept)
    listed: dict[str, list[tuple[bytes, int]]] = {}
    for r in common.collect():  # COMMON rows at most
        listed.setdefault(r.lang, []).append((bytes(r.term), r.number))
    rest = terms.join(F.broadcast(common.select("lang", "term")), ["lang", "term"], "left_anti")  # COMMON rows at most
    wanted = rest.select("block", "lang", "term").join(kept.join(F.broadcast(common.select("number")), "number", "left_anti"), ["lang", "term"])
    texts = first.where(F.col("kind") != TERM).select("block", "kind", "lang", "source", "text", "times", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("number"))
    second = texts.unionByName(wanted.select("block", F.lit(TERM).alias("kind"), "lang", F.lit("").alias("source"), F.lit(None).cast("binary").alias("text"), F.lit(None).cast("binary").alias("times"), "term", "number"))
    size = first.where(F.col("kind") == TIMES).agg(F.sum("n")).first()[0] or 0
    second = second.repartition(tasks(spark, size, 64 << 20), "block").sortWithinPartitions("block", F.col("kind").desc())
    postings = _second_pass(second, spark.sparkContext.broadcast(listed)).groupBy("lang", "source", "number").agg(F.sum("count").alias("count"))
    postings = scratch.save(postings, "postings")
    groups = scratch.save(_groups(docs, kept, postings), "groups")
    scratch.drop("blocks")
    sums = _pairs(_dealt(postings, groups)).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    a, b = (groups.select("lang", F.col("group").alias(k), F.col("source").alias(name)) for k, name in (("a", "source"), ("b", "item")))
    pairs = sums.join(a, ["lang", "a"]).join(b, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    held = postings.join(groups.select("lang", "source", "total", F.expr("n_lang + v").alias("total_lang")), ["lang", "source"])
    held = held.withColumn("count_lang", F.sum("count").over(Window.partitionBy("number")))
    held = held.withColumns({"p": _exact_share("count", "total"), "q": _exact_share("count_lang", "total_lang")}).where("p > q")
    held = held.join(kept.select("number", F.col("term").cast("string").alias("item")), "number")
    own = held.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    return pairs.unionByName(own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))


#: DuckDB SQL of the query's rows: every pair of sources over every kept term.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS t FROM d),
k AS MATERIALIZED (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, t, count(*) AS c FROM w JOIN k USING (lang, t) GROUP BY lang, source, t),
g AS MATERIALIZED (SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.t, coalesce(c.c, 0) AS c, CAST(1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (n + v) AS HUGEINT) AS p FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
q AS (SELECT lang, t, CAST(1 + 1000000000::HUGEINT * (sum(c) + 1) // (any_value(nl) + any_value(v)) AS HUGEINT) AS q FROM p JOIN (SELECT lang, sum(n) AS nl, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, t),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS sa, y.source AS sb, sum((x.p - y.p) * (x.p - y.p) // y.p) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL) z ON z.lang = a.lang AND sa = a.source AND sb = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
