"""Company disclosures: nested commodities and sourcing claims, flattened and rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.text import url_host
from tillage.operators.shares import most_frequent

SCHEMA = """company string, headquarters string, ownership string, fiscal_year_end string, latest_disclosure_year int, last_updated string, research_status string, notes string"""
CLAIM = "struct<iso3:string, country:string, role:string, share_pct:double, evidence:string, evidence_strength:string, citation_url:string, as_of:string, entity:string>"
#: One document a company.
DOCUMENT = f"_meta struct<{', '.join(c.strip().replace(' ', ':') for c in SCHEMA.split(','))}>, commodities array<struct<name:string, entity:string, evidence_strength:string, sourcing_countries:array<{CLAIM}>>>, evidence_gaps array<string>"


def claims(documents: DataFrame) -> DataFrame:
    """A row for each claim: company, file, pos, commodity, iso3, country, role, share_pct, evidence_strength, evidence, citation_url, as_of, entity.

    file: of the documents (null where they have none); claims stand in the order of file and pos.

    A claim without evidence strength takes its commodity's, else medium; without role origin; claims without iso3 are left out.
    """
    per = documents.select(F.coalesce("_meta.company", F.lit("Unknown")).alias("company"), (F.col("file") if "file" in documents.columns else F.lit(None).cast("string")).alias("file"), F.posexplode("commodities").alias("i", "c"))
    rows = per.select("company", "file", "i", F.coalesce("c.name", F.lit("Unknown")).alias("commodity"), F.coalesce("c.evidence_strength", F.lit("medium")).alias("usual"), F.posexplode("c.sourcing_countries").alias("j", "s"))
    return rows.where("s.iso3 is not null and s.iso3 <> ''").select(
        "company", "file", (F.col("i") * 100_000 + F.col("j")).alias("pos"), "commodity", "s.iso3", "s.country", F.coalesce("s.role", F.lit("origin")).alias("role"), "s.share_pct",
        F.coalesce("s.evidence_strength", "usual").alias("evidence_strength"), "s.evidence", "s.citation_url", "s.as_of", "s.entity",
    )


def rollup(documents: DataFrame) -> DataFrame:
    """A row a company: its facts, n_countries, n_commodities, n_claims, iso_set, data_quality, primary_citation (the host cited most, the first seen of equals).

    sourced: research is complete, or a claim is strong and there are five or more; else partial.
    """
    flat = claims(documents)
    per = flat.groupBy("company").agg(F.array_sort(F.collect_set("iso3")).alias("iso_set"), F.count("*").alias("n_claims"), F.bool_or(F.col("evidence_strength") == "strong").alias("strong"))
    cited = most_frequent(flat.withColumn("host", url_host("citation_url")), ["company"], "host", F.struct("file", "pos")).select("company", F.col("host").alias("primary_citation"))
    facts = documents.select(
        F.coalesce("_meta.company", F.lit("Unknown")).alias("company"), F.col("_meta.ownership").alias("ownership"), F.col("_meta.headquarters").alias("hq"), F.col("_meta.fiscal_year_end").alias("fy_end"),
        F.col("_meta.latest_disclosure_year").alias("latest_disclosure"), F.col("_meta.last_updated").alias("last_updated"), F.coalesce("_meta.research_status", F.lit("scaffolded")).alias("research_status"),
        F.size(F.coalesce("commodities", F.array().cast(documents.schema["commodities"].dataType))).cast("long").alias("n_commodities"), F.transform("commodities", lambda c: F.coalesce(c["name"], F.lit("Unknown"))).alias("commodities"), "evidence_gaps",
    )
    out = facts.join(per, "company", "left").join(cited, "company", "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))
    quality = F.when((F.col("research_status") == "complete") | (F.coalesce("strong", F.lit(False)) & (F.col("n_claims") >= 5)), "sourced").otherwise("partial")
    return out.withColumn("n_countries", F.size(F.coalesce("iso_set", F.array().cast("array<string>"))).cast("long")).withColumn("data_quality", quality).drop("strong")
