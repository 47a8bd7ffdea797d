"""The queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import compaction, decontam, divergence, dual_tree, exact_dedup, licenses, lsh_forest, minhash, mixing, quality_cnn, secrets, sstable, urlfilter
from tillage.llm.common import Scratch, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(table(spark, sf_dir, "documents"))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return lsh_forest.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = compaction.sharded(table(spark, sf_dir, "documents"), Scratch(spark, "compaction").root)
    return store.read().select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark), licenses.known_digests(spark))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.owners(table(spark, sf_dir, "documents"), keep="largest")


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_minhash, op2_sstable, op3_lsh_forest, op4_quality_cnn, op5_mixing, op6_secrets, op7_decontamination, op8_compaction, op9_url_filter, op10_licenses, op11_divergence, op12_exact_dedup, op13_dual_tree)
}

#: op1's rows: all pairs of documents that share a shingle, counted, then components by recursion.
_OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id WHERE r.c < u.b),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""

ORACLES = {
    "op1_minhash": _OP1,
    "op5_mixing": mixing.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op8_compaction": "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents",
    "op10_licenses": licenses.oracle(),
    "op11_divergence": divergence.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_dual_tree": dual_tree.oracle(),
}
