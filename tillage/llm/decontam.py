"""Operator 7: benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import Scratch, free_names


def tokens(text: str = "text") -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(words: Column, n: int) -> Column:
    return F.sequence(F.lit(0), F.size(words) - n)


def hashed(words: Column, n: int) -> Column:
    """Hashes of the n-word shingles; fewer words: of the whole sequence as one; none: empty."""
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) >= n, F.transform(_starts(words, n), lambda i: F.xxhash64(*(words[i + k] for k in range(n))))).otherwise(short)


def spelled(words: Column, n: int) -> Column:
    """The distinct shingles themselves, as hashed() takes them."""
    short = F.when(F.size(words) > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(words) >= n, F.transform(_starts(words, n), lambda i: F.concat_ws(" ", F.slice(words, i + 1, n)))).otherwise(short))


def sketches(items: DataFrame, words: int, percent: int) -> DataFrame:
    """(item, n_item, shingles, sketch) of items(item, text): the distinct shingles, and the smallest of their hashes.

    Items are partitioned by size in powers of two; all of a partition keep as many minima as its largest item may lack
    shingles, and one more. A text that holds percent of an item's shingles so holds one of its minima.
    """
    w = items.select("item", tokens().alias("w")).select("item", spelled(F.col("w"), words).alias("shingles"), F.array_sort(F.array_distinct(hashed(F.col("w"), words))).alias("hashes"))
    w = w.withColumn("n_item", F.size("shingles")).where("n_item > 0")
    largest = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    lacking = F.floor(largest * (100 - percent) / 100).cast("int")
    return w.select("item", "n_item", "shingles", F.slice("hashes", 1, lacking + 1).alias("sketch"))


def _pairs(own: DataFrame, items: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, item, n_item, n_shared) of own(key, text) whose text holds percent of the shingles of items(item, text)."""
    scratch = Scratch(own.sparkSession, "decontam")
    items = scratch.save(sketches(items, words, percent), "items")
    wanted = items.select("item", F.explode("sketch").alias("h")).distinct()
    probes = own.select("key", tokens().alias("w")).select("key", F.explode(hashed(F.col("w"), words)).alias("h"))
    found = scratch.save(probes.join(wanted, "h").select("key", "item").distinct(), "candidates")
    texts = own.join(found.select("key").distinct(), "key").select("key", tokens().alias("w")).select("key", spelled(F.col("w"), words).alias("held"))
    pairs = texts.join(found, "key").join(items.select("item", "n_item", "shingles"), "item")
    shared = F.size(F.array_intersect("shingles", "held"))
    return pairs.select("key", "item", "n_item", shared.alias("n_shared")).where(f"100 * n_shared >= {percent} * n_item")


def contained(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Which benchmark items documents hold: doc_id, item_id, n_item, n_shared, containment.

    Words are lower-cased runs of letters and digits, shingles are distinct runs of so many words (fewer: the whole sequence as
    one, found only in a text that is the same sequence). A pair is returned if the document's whole text holds percent of the
    item's shingles. Search: each item keeps MinHash minima by its size partition, and every shingle of every document is looked
    up among them; no contained item is missed. Check: candidates' full shingle sets are compared as strings.

    The document side moves nothing but (doc_id, hash) pairs that match; Spark broadcasts the minima where they are small and
    shuffles where they aren't. Defined cases: null, empty or wordless texts hold nothing and are held nowhere; null doc_ids or
    item_ids are not reported; rows that repeat an id count as the one that holds or is held most; extra columns are ignored;
    empty tables give no rows.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").alias("key"), "text")
    items = benchmark.where("item_id is not null").select(F.col("item_id").alias("item"), "text").distinct()
    pairs = _pairs(own, items, words, percent)
    best = pairs.groupBy("key", "item").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("best"))
    return best.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.col("best.n_item").cast("long").alias("n_item"), F.col("best.n_shared").cast("long").alias("n_shared"), "best.containment")


def clean(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, as contained() finds them.

    A row goes by its text, so rows without doc_id, and other texts of one, are each judged by what they hold; items count with or without item_id.
    """
    key = free_names(docs.columns, "text_digest")[0]
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    held = _pairs(docs.select(digest.alias("key"), "text"), benchmark.select(digest.alias("item"), "text").distinct(), words, percent)
    return docs.withColumn(key, digest).join(held.select(F.col("key").alias(key)).distinct(), key, "left_anti").select(docs.columns)


#: DuckDB SQL of the query's rows: every shingle of every text against every item's.
ORACLE = """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
its AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""
