"""Operator 5: mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.common import WORD, Scratch, free_names

#: Fraction of the golden ratio: slot n lies at the fraction of (n + 0.5) times this.
GOLDEN = 0.6180339887498949
#: Slots ranked together; rows of a source laid out together.
RUN, PILE = 4096, 4096
#: Words of a block at least, and blocks of a mix: its blocks grow with it, so its schedule does not.
LEAST_WORDS, SLOTS = 64, 1 << 18


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sid, source, source_size, n_rows, target for sized(source, size).

    Sources by code point, null last, weigh as listed, again and again, and share so many times all words; no target passes cap
    times its source's size, and what it may not take goes to the others by weight until none is above. The windows run over
    one row per source.
    """
    of = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    listed = F.array(*(F.lit(float(w)) for w in weights))
    of = of.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long") - 1)
    of = of.withColumn("w", F.element_at(listed, (F.col("sid") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(cap))
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("most") / F.col("w"), "sid")
    of = of.withColumn("all_words", F.sum("source_size").over(every) * F.lit(share))
    rest = F.col("all_words") - F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    of = of.withColumn("level", rest / open_w)  # per unit of weight, if all that fill up sooner are full
    # the level rises while sources fill up and falls past the first that doesn't: the highest one holds for all
    level = F.max("level").over(every)
    return of.select("sid", "source", "source_size", "n_rows", F.least(F.col("most"), F.col("w") * level).alias("target"))


def _name() -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))


def laid_out(sized: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """Each row's place `start` on its source's line of words; rows stand in the order of a hash, in piles of bounded size."""
    piles = F.ceil(F.col("n_rows") / PILE)
    named = sized.withColumn("s", _name()).join(goals.withColumn("s", _name()).drop("source"), "s").drop("s")
    named = named.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest").cast("binary")))
    named = named.withColumn("pile", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * piles / F.lit(4294967296.0)).cast("long"))
    within = Window.partitionBy("sid", "pile").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("sid").orderBy("pile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = named.groupBy("sid", "pile").agg(F.sum("size").alias("words")).select("sid", "pile", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    named = named.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return named.join(offsets, ["sid", "pile"]).withColumn("start", F.col("offset") + F.col("inner")).drop("pile", "offset", "inner", "h")


def schedule(goals: DataFrame, block_words: int, scratch: Scratch) -> DataFrame:
    """slot, sid, rank (within the source), source_size, start and words of the block that the slot takes from its source's line, unrolled.

    Slot n goes to the source whose stretch of the cumulative targets holds the fraction of (n + 0.5) * golden ratio, so any run
    of slots holds each source in nearly its share. Block rank of a source begins at rank * block_words; the line begins anew
    when it ends. A source's last block is cut where its target ends; where its slots fall short of the target (by the few blocks
    that the points are uneven, or because the source is smaller than a block), blocks at the schedule's end make up for it.
    The source's stretches are found by range bins: a slot's bin holds the few sources that begin in it or before it.
    """
    spark = goals.sparkSession
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    slots = -(-int(total) // block_words)
    running = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    goals = goals.where("target > 0").withColumn("reach", F.floor("target"))
    ends = goals.withColumn("lo", F.coalesce(F.sum("target").over(running), F.lit(0.0)) / F.lit(total or 1.0))
    ends = ends.withColumn("hi", F.coalesce(F.lead("lo").over(Window.orderBy("sid")), F.lit(1.0)))
    bins = 1024
    ends = ends.select("sid", "source_size", "reach", "lo", "hi", F.explode(F.expr(f"sequence(cast(lo * {bins} as long), cast(least(hi * {bins}, {bins - 1}) as long))")).alias("bin"))
    points = spark.range(slots).withColumn("u", (F.col("id") + 0.5) * GOLDEN).withColumn("u", F.col("u") - F.floor("u")).withColumn("bin", (F.col("u") * bins).cast("long"))
    drawn = points.join(ends, "bin").where("u >= lo and u < hi").select(F.col("id").alias("slot"), "sid", "source_size", "reach", F.floor(F.col("id") / RUN).alias("run"))
    drawn = scratch.save(drawn, "drawn")
    earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.groupBy("sid", "run").count()
    counts = runs.select("sid", "run", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    ranked = drawn.withColumn("inner", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1).join(counts, ["sid", "run"])
    ranked = ranked.select("slot", "sid", "source_size", "reach", (F.col("base") + F.col("inner")).alias("rank"))
    short = goals.join(runs.groupBy("sid").agg(F.sum("count").alias("had")), "sid", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    short = short.where(F.col("had") * block_words < F.col("reach")).withColumn("rank", F.explode(F.expr(f"sequence(had, (reach - 1) div {block_words})")))
    closing = short.select((F.row_number().over(Window.orderBy(F.col("rank") - F.col("had"), "sid")) + (slots - 1)).cast("long").alias("slot"), "sid", "source_size", "reach", "rank")
    placed = ranked.unionByName(closing).withColumn("start", F.col("rank") * block_words)
    return placed.withColumn("words", F.least(F.lit(block_words), F.col("reach") - F.col("start"))).where("words > 0").select("slot", "sid", "rank", "source_size", "start", "words")


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _row_key(digest: str = "digest") -> Column:
    """Equal for rows of the same doc_id, source and text's digest; never null."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return F.md5(F.concat_ws("\x1f", known("doc_id"), known("source"), digest).cast("binary"))


def _taken(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int | None = None, seed: int = 17) -> DataFrame:
    """What mixed() returns, and digest."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), _digest().alias("digest")), "sized")
    goals = scratch.save(targets(sized, weights, share, cap), "goals")
    if block_words is None:
        block_words = max(LEAST_WORDS, math.ceil((goals.agg(F.sum("target")).first()[0] or 0.0) / SLOTS))
    line = scratch.save(laid_out(sized, goals, seed), "line")
    slots = schedule(goals, block_words, scratch)
    # a block lies in two cells of its source's line at most, or at the line's end and its beginnings
    at = slots.select("sid", "source_size", (F.col("start") % F.col("source_size")).alias("p"), "words")
    parts = at.withColumn("part", F.explode(F.expr("""transform(sequence(0L, (p + words - 1) div source_size),
        k -> named_struct('lo', if(k = 0, p, 0L), 'hi', least(source_size, p + words - k * source_size)))""")))
    taken = parts.select("sid", F.col("part.lo").alias("lo"), F.col("part.hi").alias("hi")).withColumn("cell", F.explode(F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})")))
    lines = line.where("size > 0").withColumn("cell", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    met = lines.select("sid", "start", "size", "cell").join(taken, ["sid", "cell"])
    over = F.least(F.col("start") + F.col("size"), F.col("hi"), (F.col("cell") + 1) * block_words) - F.greatest("start", "lo", F.col("cell") * block_words)
    sums = met.groupBy("sid", "start").agg(F.sum(F.greatest(over, F.lit(0))).alias("taken")).withColumn("some", F.lit(True))
    out = line.withColumn("some", F.col("size") > 0).join(sums, ["sid", "start", "some"], "left")
    names = goals.select("sid", "source")
    return out.drop("source").join(names, "sid").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "digest")


def mixed(docs: DataFrame, **args) -> DataFrame:
    """How many words a mix takes of each document: doc_id, source, size, source_size, target, taken.

    size: words (runs of other than white space) of the whole text. Each source's rows are shuffled by a hash into one line of
    words, cut into equal blocks (of block_words, or as many words as make SLOTS blocks of the mix, LEAST_WORDS at least); the
    schedule's slots take a source's blocks in turn. taken is at most cap times size, and a source's sum is its target, rounded
    down. Reruns agree. Arguments: weights, share, cap, block_words, seed.

    Defined cases: null text: size 0, taken 0; null source: a source of its own, last; null doc_id and rows that repeat a doc_id
    are rows like others; extra columns are ignored; no words at all: target and taken 0; an empty table gives no rows.
    """
    return _taken(docs, Scratch(docs.sparkSession, "mixing"), **args).drop("digest")


def materialized(docs: DataFrame, **args) -> DataFrame:
    """documents as the mix takes them: each row as often as its taken words make whole copies, rounded; rows not taken go.

    A source's line is taken round by round, so only the document at which the mix stops is rounded; the others are taken whole.
    Rows of the same doc_id, source and text are taken together: they share their copies by how often each stands in the table.
    Null doc_ids and repeated rows are in the mix like others; columns keep their names, whatever they are; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    key, n, copies, m, one = free_names(docs.columns, "row_key", "rows", "copies", "same", "copy")
    of = _taken(docs, scratch, **args).where("size > 0").groupBy(_row_key().alias(key)).agg(F.count("*").alias(n), F.round(F.sum("taken") / F.first("size")).cast("int").alias(copies))
    of = scratch.save(of, "copies")
    (digest,) = free_names(docs.columns, "digest")
    keyed = docs.withColumn(digest, _digest()).withColumn(key, _row_key(digest)).drop(digest).join(of.where(F.col(copies) > 0), key)
    out = keyed.where(F.col(n) == 1).select(*docs.columns, copies)
    if not of.where(F.col(n) > 1).isEmpty():
        folded = keyed.where(F.col(n) > 1).groupBy(*docs.columns, n, copies).agg(F.count("*").alias(m))
        out = out.unionByName(folded.select(*docs.columns, F.round(F.col(copies) * F.col(m) / F.col(n)).cast("int").alias(copies)))
    return out.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*docs.columns)


#: DuckDB SQL of the query's rows, with each line in one window: its blocks, in turn, are the line up to the target.
ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
num AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM per),
wt AS (SELECT *, CAST(list_extract([5, 2, 1], CAST(sid % 3 + 1 AS INT)) AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS most FROM num),
lev AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY most / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM wt),
fix AS (SELECT *, max(rest / open_w) OVER () AS level FROM lev),
goals AS (SELECT sid, source, source_size, least(most, w * level) AS target FROM fix),
line AS (SELECT sized.*, goals.sid, goals.source_size, goals.target,
  coalesce(sum(size) OVER (PARTITION BY goals.sid ORDER BY md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, source, size, source_size, target,
  CAST(size * (CAST(floor(target) AS BIGINT) // greatest(source_size, 1)) + greatest(0, least(start + size, CAST(floor(target) AS BIGINT) % greatest(source_size, 1)) - start) AS BIGINT) AS taken
FROM line
"""
