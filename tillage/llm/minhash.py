"""Operator 1: near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import Scratch, Split, cells, hot_limit, split_join, tasks
from tillage.llm.components import connected_components
from tillage.llm.shingles import mix64, shingle_sets

_U32 = np.uint32
FEATURES = "doc_id string, text_key long, n_shingles long, set_id binary, bands array<long>, sketch binary"
#: Bit patterns that make other members of a bucket its smallest; each gives one more hub a bucket.
HUBS = (0, 0x2AAAAAAAAAAAAAAA, 0x5555555555555555)
BLOCK = 512


def _permute(x: np.ndarray, a: int, b: int, scratch: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit values, in place."""
    for shift, by in ((16, a), (13, b), (16, None)):
        np.right_shift(x, _U32(shift), out=scratch)
        np.bitwise_xor(x, scratch, out=x)
        if by is not None:
            np.multiply(x, _U32(by), out=x)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash: a first permutation of the universe, then the minimum under one second permutation shifted by 1, 2, ... size.

    A row for each set, which must not be empty. Coordinate k of a set S is min over v in S of second(first(v) + k mod 2**32).
    """
    out = np.empty((len(sets), size), np.uint32)
    begin = 0
    while begin < len(sets):  # in runs that stay in the cache
        end, total = begin + 1, len(sets[begin])
        while end < len(sets) and total + len(sets[end]) <= 1 << 16:
            total += len(sets[end])
            end += 1
        first = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *(len(s) for s in sets[begin : end - 1])])
        x, spare = np.empty_like(first), np.empty_like(first)
        first = _permute(first, 0x7FEB352D, 0x846CA68B, spare)
        for k in range(size):
            np.add(first, _U32(k + 1), out=x)
            out[begin:end, k] = np.minimum.reduceat(_permute(x, 0x85EBCA6B, 0xC2B2AE35, spare), at)
        begin = end
    return out


def features(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """For each row: a hash of its text, its set's size, digest, band keys and one byte of each signature coordinate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mult = np.random.default_rng(7).integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.iloc[lo : lo + 1024]
                sets = list(shingle_sets(part["text"].tolist(), words))
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full], bands * rows) if full else np.empty((0, bands * rows), np.uint32)
                keys = mix64((sig.reshape(-1, bands, rows).astype(np.uint64) * mult).sum(2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                low = (sig & _U32(255)).astype(np.uint8)
                where = dict(zip(full, range(len(full))))
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "text_key": part["text_key"],
                        "n_shingles": [len(s) for s in sets],
                        "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        "bands": [keys[where[i]] if i in where else [] for i in range(len(sets))],
                        "sketch": [low[where[i]].tobytes() if i in where else b"" for i in range(len(sets))],
                    }
                )

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInPandas(run, FEATURES).withColumn("doc_id", F.col("doc_id").cast("long"))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets meet the similarity; a hub of many pairs is split."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                left = list(shingle_sets(part["text_a"].tolist(), words))
                right = list(shingle_sets(part["text_b"].tolist(), words))
                good = []
                for x, y in zip(left, right):
                    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)) or not len(x):
                        good.append(False)
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.loc[good, ["a", "b"]]

    of_a, of_b = Split(pairs, "a", "b"), Split(pairs, "b", "a")
    left, right = (s.copy(texts.select(F.col("id").alias(s.key), F.col("text").alias(f"text_{s.key}"))).hint("merge") for s in (of_a, of_b))
    both = of_b.deal(of_a.deal(pairs)).join(left, of_a.on).join(right, of_b.on)
    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def _grams(texts: DataFrame, words: int) -> DataFrame:
    """id, grams: the whole shingle set of each text, as bytes of sorted 64-bit hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                yield pd.DataFrame({"id": part["id"], "grams": [s.tobytes() for s in shingle_sets(part["text"].tolist(), words)]})

    return texts.select("id", "text").mapInPandas(run, "id long, grams binary")


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the other sets has of the one; none is empty, all are sorted."""
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    return np.add.reduceat(one[at] == flat, np.cumsum([0, *(len(o) for o in others[:-1])]))


def _spanning(rows: pd.DataFrame, percent: int, least: int) -> list[tuple[int, int]]:
    """Links between left and right rows that join components which nothing here joined before; checked on whole sets.

    Partners come by falling agreement of their sketches, those under `least` bytes never; a link merges its two components,
    and pairs inside one are passed over, so there are fewer links than rows.
    """
    left, right = rows["left"].to_numpy(), rows["right"].to_numpy()
    codes = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
    sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
    n, ids, part = np.array([len(s) for s in sets]), rows["id"].to_numpy(), rows["component"].to_numpy().copy()
    found, j = [], np.flatnonzero(right)
    for a in np.flatnonzero(left):
        to = j[(part[j] != part[a]) & (100 * np.minimum(n[j], n[a]) >= percent * np.maximum(n[j], n[a]))]
        to = to[(ids[to] > ids[a]) | ~left[to]]  # a block with itself: each pair once
        if not len(to):
            continue
        same = (codes[to] == codes[a]).sum(1)
        to = to[same >= least][np.argsort(-same[same >= least], kind="stable")]
        while len(to):
            some, to = to[:32], to[32:]
            both = _shared(sets[a], [sets[b] for b in some])
            for b in some[100 * both >= percent * (n[some] + n[a] - both)]:
                if part[b] != part[a]:
                    found.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
                    part[part == part[b]] = part[a]
            to = to[part[to] != part[a]]
    return found


def _near(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """The rows that have a partner on the other side, in another component, whose sketch agrees in at least so many bytes."""
    left, right, part = rows["left"].to_numpy(), rows["right"].to_numpy(), rows["component"].to_numpy()
    codes = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
    j, keep = np.flatnonzero(right), np.zeros(len(rows), bool)
    for a in np.flatnonzero(left):
        to = j[part[j] != part[a]]
        to = to[(codes[to] == codes[a]).sum(1) >= least]
        keep[to] = True
        keep[a] |= len(to) > 0
    return rows.loc[keep, MEETING]


MEETING = ["key", "kind", "x", "y", "left", "right", "id", "component"]


def _met(dealt: DataFrame, one: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int) -> DataFrame:
    """one() of each meeting of dealt(key, kind, x, y, ...), in so many tasks; the rows of a meeting are at most two blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        at = None
        for batch in batches:  # sorted, so a meeting's rows stand together
            for key, rows in batch.groupby(["key", "kind", "x", "y"], sort=False):
                if key != at and held:
                    yield one(pd.concat(held, ignore_index=True))
                    held = []
                at = key
                held.append(rows)
        if held:
            yield one(pd.concat(held, ignore_index=True))

    return dealt.repartition(parts, "key", "kind", "x", "y").sortWithinPartitions("key", "kind", "x", "y").mapInPandas(run, schema)


def _meetings(placed: DataFrame, limit: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """key, kind, x, y, left, right, id, component of placed(key, cell, id, component), for the keys that hold several components; and how many rows these are.

    A key's largest component need not meet itself. The other rows are dealt into blocks by a hash, each of which meets each
    other and itself (kind 0) and each block of the largest component (kind 1).
    """
    per = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    keys = per.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("top")).where("parts > 1")
    keys = keys.select("key", "m", F.col("top.component").alias("largest"), F.col("top.m").alias("m_largest"), F.ceil((F.col("m") - F.col("top.m")) / BLOCK).alias("others"), F.ceil(F.col("top.m") / BLOCK).alias("blocks"))
    keys = scratch.save(keys, "keys")
    dealt = keys.agg(F.sum(F.expr("(m - m_largest) * (others + blocks) + m_largest * others"))).first()[0] or 0
    rows = placed.join(keys.withColumn("cell", F.explode(cells(F.col("m"), limit))), ["key", "cell"]).withColumn("big", F.col("component") == F.col("largest"))
    rows = rows.withColumn("block", F.expr("pmod(xxhash64(id), if(big, blocks, others))"))
    own = F.expr("transform(sequence(0L, others - 1), j -> named_struct('kind', 0, 'x', least(block, j), 'y', greatest(block, j), 'left', block <= j, 'right', block >= j))")
    to_big = F.expr("transform(sequence(0L, blocks - 1), k -> named_struct('kind', 1, 'x', block, 'y', k, 'left', true, 'right', false))")
    from_big = F.expr("transform(sequence(0L, others - 1), i -> named_struct('kind', 1, 'x', i, 'y', block, 'left', false, 'right', true))")
    met = F.explode(F.when(F.col("big"), from_big).otherwise(F.concat(own, to_big))).alias("t")
    return rows.select("key", "id", "component", met).select("key", "t.*", "id", "component"), int(dealt)


def _vertices(usable: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, bool]:
    """(set_id, rep, vertex) with a row a distinct set; the doc_ids that stand on several sets, or None; whether any stands on several rows.

    A set's rep is its smallest doc_id, and that is its vertex too, but for sets whose rep stands on several sets: all but one of
    these get a number that is no doc_id.
    """
    repeated = usable.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("n > 1")
    repeated = scratch.save(repeated, "repeated")
    several = repeated.where("lo <> hi").select("doc_id")
    reps = scratch.save(usable.groupBy("set_id").agg(F.min("doc_id").alias("rep")).withColumn("vertex", F.col("rep")), "reps")
    if several.isEmpty():
        return reps, None, not repeated.isEmpty()
    shared = reps.join(reps.groupBy("rep").agg(F.count("*").alias("sets"), F.min("set_id").alias("first")).where("sets > 1"), "rep").where("set_id <> first")
    low, high = reps.agg(F.min("rep"), F.max("rep")).first()
    number = F.monotonically_increasing_id()
    number = F.lit(high) + 1 + number if high < 1 << 62 else F.lit(low) - 1 - number
    shared = scratch.save(shared.select("set_id", number.alias("number")), "shared")
    return scratch.save(reps.join(shared, "set_id", "left").select("set_id", "rep", F.coalesce("number", "vertex").alias("vertex")), "vertices"), several, True


def _graph(docs: DataFrame, scratch: Scratch, words: int, percent: int, bands: int, rows: int, slack: float, tied: bool) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, text_key, n_shingles, rep, vertex) of each row; (id, component) of linked vertices; whether a doc_id stands on several rows.

    tied: rows of one doc_id are one node, and components are named by their smallest doc_id. Else each distinct set is a node of its own.
    """
    spark = docs.sparkSession
    feat = scratch.save(features(docs, words, bands, rows), "features")
    usable = feat.where("n_shingles > 0 and doc_id is not null")
    reps, several, repeated = _vertices(usable, scratch)
    own = reps.select(F.col("rep").alias("doc_id"), "set_id", F.col("vertex").alias("id")).hint("merge")
    nodes = usable.join(own, ["doc_id", "set_id"]).select("id", "doc_id", "text_key", F.col("n_shingles").alias("n"), "bands", "sketch")
    nodes = scratch.save(nodes.dropDuplicates(["id"]) if repeated else nodes, "nodes")
    sizes = nodes.select("id", "n")
    spread = nodes.select(F.explode("bands").alias("key"), "id", "n")
    hubs = spread.groupBy("key").agg(F.count("*").alias("m"), *(F.min(F.col("id").bitwiseXOR(F.lit(h))).bitwiseXOR(F.lit(h)).alias(f"hub{k}") for k, h in enumerate(HUBS))).where("m > 1")
    hubs = scratch.save(hubs, "hubs")
    limit = hot_limit(nodes.count() * bands)
    hot = F.broadcast(hubs.where(F.col("m") > limit).select("key", F.col("m").alias("held")))  # HOT_KEYS rows at most
    spread = spread.join(hot, "key", "left").withColumn("cell", F.expr(f"cast(pmod(xxhash64(id), greatest(1, ceil(coalesce(held, 0) / {limit}))) as int)")).drop("held")
    members = scratch.save(spread.join(hubs.withColumn("cell", F.explode(cells(F.col("m"), limit))), ["key", "cell"]), "members")
    met = members.select("id", "n", F.explode(F.array_distinct(F.array(*(f"hub{k}" for k in range(len(HUBS)))))).alias("hub")).where("id <> hub").distinct()
    met = split_join(scratch.save(met, "met"), sizes.toDF("hub", "n_hub"), "hub", "id").where(f"100 * least(n, n_hub) >= {percent} * greatest(n, n_hub)")
    pairs = scratch.save(met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "pairs")
    wanted = nodes.select("id", "doc_id", "text_key").join(members.select("id").distinct(), "id", "left_semi").hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text")).join(wanted, ["doc_id", "text_key"]).select("id", "text")
    texts = scratch.save(texts.dropDuplicates(["id"]) if repeated else texts, "texts")
    links = scratch.save(_verified(pairs, texts, words, percent), "links-0")
    groups = connected_components(links, scratch, "cc-0")
    placed = members.select("key", "cell", "id").join(groups, "id", "left").select("key", "cell", "id", F.coalesce("component", "id").alias("component"))
    placed = scratch.save(placed, "placed")
    least = int(bands * rows * (percent / 100 - slack))
    sketches = nodes.select("id", "sketch")
    dealt, count = _meetings(placed, limit, scratch)
    met = _met(dealt.join(sketches, "id"), lambda g: _near(g, least), "key long, kind int, x long, y long, left boolean, right boolean, id long, component long", tasks(spark, count, 8192))
    met = scratch.save(met, "meetings")
    open_ids = met.select("id").distinct()
    whole = _grams(texts.join(open_ids.hint("merge"), "id", "left_semi"), words).join(sketches, "id")
    more = _met(met.join(whole.hint("merge"), "id"), lambda g: pd.DataFrame(_spanning(g, percent, least), columns=["a", "b"]), "a long, b long", tasks(spark, met.count(), 2048))
    more = scratch.save(more, "across")
    links = links.union(more).distinct()
    of = scratch.save(split_join(feat.select("doc_id", "text_key", "n_shingles", "set_id"), reps, "set_id", "doc_id").drop("set_id"), "of")
    if tied and several is not None:  # a doc_id on rows of several sets ties their vertices together
        tied = of.where("vertex is not null and doc_id is not null").join(several, "doc_id", "left_semi")
        first = tied.groupBy("doc_id").agg(F.min("vertex").alias("b"))
        links = links.union(tied.join(first, "doc_id").where("vertex <> b").select(F.col("vertex").alias("a"), "b").distinct())
    groups = connected_components(scratch.save(links, "links-1"), scratch, "cc-1")
    if tied and several is not None:  # components are named by their smallest doc_id
        names = of.groupBy("vertex").agg(F.min("rep").alias("rep")).join(groups.withColumnRenamed("id", "vertex"), "vertex").groupBy("component").agg(F.min("rep").alias("name"))
        groups = scratch.save(split_join(groups, names, "component", "id").select("id", F.col("name").alias("component")), "named")
    scratch.drop("members", "texts", "pairs", "meetings", "across", "nodes", "hubs", "met", "placed", "keys", "links-0", "links-1")
    return of, groups, repeated

def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, bands: int = 20, rows: int = 6, slack: float = 0.15) -> DataFrame:
    """Near-duplicate groups of documents(doc_id, text).

    Words are runs of other than white space, A-Z lower-cased; a document's set holds its distinct shingles of so many words
    (fewer words: the whole sequence as one). Documents are linked if 100 * intersection >= percent * union, always checked on
    full sets. Returns for each row doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    Equal sets fold into one vertex. Vertices that share a band meet first with their bucket's hubs. In buckets
    that then hold several components, the rows meet in blocks of bounded size. A first pass keeps those with a partner in
    another component whose one-byte sketch agrees in nearly enough places (slack under the wanted similarity; a true link
    misses that about once in a million); a second one has their whole sets and checks such pairs until the components there
    are one or the pairs are used up.
    A pair of similarity 0.85 shares none of 20 bands of 6 with probability 8e-5.
    Buckets, hubs, sets and components that hold many rows are dealt to several tasks (see Split), and the tasks of the two passes
    follow the number of rows that meet.

    Defined cases: a null or empty text has an empty set and is its own component; a null doc_id is linked with nothing, its
    component_id is null and it is kept; rows that repeat a doc_id are one node of the graph, linked by each of their texts, and come
    out once each; extra columns are ignored; an empty table gives an empty result.
    """
    of, groups, _ = _graph(docs, Scratch(docs.sparkSession, "minhash"), words, percent, bands, rows, slack, tied=True)
    out = split_join(of, groups.withColumnRenamed("id", "vertex"), "vertex", "doc_id")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "rep", "doc_id"), "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, slack: float = 0.15) -> DataFrame:
    """One document of each near-duplicate group of documents, with all its columns: the one of the smallest doc_id.

    A document is a doc_id with a text: other texts under a doc_id are documents of their own, in groups of their own, whether it stays or goes;
    of one doc_id's texts in a group one stays, and so does one of rows that repeat both. Rows without doc_id are linked with nothing and stay.
    A pair of similarity 0.8 shares none of 30 bands of 5 with probability 7e-6.
    """
    of, groups, repeated = _graph(docs, Scratch(docs.sparkSession, "minhash"), words, percent, bands, rows, slack, tied=False)
    placed = split_join(of.where("vertex is not null and doc_id is not null"), groups.withColumnRenamed("id", "vertex"), "vertex", "doc_id").withColumn("component", F.coalesce("component", "vertex"))
    if not repeated:  # each component is named by its smallest doc_id
        return docs.join(placed.where("doc_id <> component").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    placed = placed.select("doc_id", "text_key", "component")
    stays = placed.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("stays"))
    goes = split_join(placed, stays, "component", "doc_id").where(F.struct("doc_id", "text_key") != F.col("stays")).select(F.col("doc_id").alias("goes_id__"), F.col("text_key").alias("goes_key__")).distinct()
    on = (F.col("doc_id").cast("long") == F.col("goes_id__")) & (F.xxhash64("text") == F.col("goes_key__"))
    kept = docs.join(goes, on, "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))
