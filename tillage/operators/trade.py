"""Trade: balances, panels, flows on the map, mirrored statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.numeric import round_half_up

#: Weights by rank of listed imports, exports and, for states, flows; destinations where none are listed.
IMPORT_WEIGHTS, EXPORT_WEIGHTS, STATE_WEIGHTS = (35, 25, 18, 12, 10), (40, 28, 16, 10, 6), (40, 28, 16)
USUAL_DESTINATIONS = ("China", "Japan", "Germany", "USA", "Netherlands")
#: Fixed value: the weight of a supplier without a share.
USUAL_SHARE = 20.0


def by_rank(rank: Column, weights: tuple[float, ...], default: float | None = None) -> Column:
    """The weight of a rank (from 1); beyond the list the default."""
    out = F.lit(default).cast("double")
    for k, w in reversed(list(enumerate(weights, 1))):
        out = F.when(rank == k, F.lit(float(w))).otherwise(out)
    return out


def panel(balances: DataFrame) -> DataFrame:
    """key, net, is_exporter, imports_bn, exports_bn (one decimal; 0 on the other side), bar_width of balances(key, net in millions)."""
    net = F.col("net")
    return balances.select(
        "key", "net", (net >= 0).alias("is_exporter"), round_half_up(F.abs(F.least(net, F.lit(0.0))) / 1000, 1).alias("imports_bn"),
        round_half_up(F.greatest(net, F.lit(0.0)) / 1000, 1).alias("exports_bn"), F.least(F.abs(net) / 2000, F.lit(45.0)).alias("bar_width"),
    )


def import_bars(balances: DataFrame) -> DataFrame:
    """key, rank, value: a guessed value for each of five imports, at least 10, from the balance's import side."""
    base = F.when(F.col("net") < 0, F.abs("net") * 0.8).otherwise(500.0)
    ranks = F.explode(F.sequence(F.lit(1), F.lit(len(IMPORT_WEIGHTS)))).alias("rank")
    out = balances.select("key", base.alias("base"), ranks)
    return out.select("key", F.col("rank").cast("long").alias("rank"), F.greatest(round_half_up(F.col("base") * (by_rank(F.col("rank"), IMPORT_WEIGHTS) / 100.0) / 100.0), F.lit(10.0)).alias("value"))


def flows(records: DataFrame, places: DataFrame) -> DataFrame:
    """key, type, rank, partner, weight and the ends' lat and lon: edges of records(key, suppliers, shares, destinations).

    A country has five import edges at most, weighed by its suppliers' shares, and four export edges, weighed by rank, to the
    usual destinations where it lists none; a US state three of each, weighed by rank. Edges to names that places(name, lat, lon)
    lacks are dropped, and so are those of keys it lacks.
    """
    state = F.col("key").startswith("US-")
    usual = F.array(*map(F.lit, USUAL_DESTINATIONS))
    to = F.when(F.size(F.coalesce("destinations", F.array().cast("array<string>"))) > 0, F.col("destinations")).otherwise(usual)
    imports = records.select("key", F.lit("import").alias("type"), F.posexplode("suppliers").alias("k", "partner"), F.get("shares", F.col("k")).alias("share"))
    exports = records.withColumn("to", to).select("key", F.lit("export").alias("type"), F.posexplode("to").alias("k", "partner"), F.lit(None).cast("double").alias("share"))
    edges = imports.union(exports).withColumn("rank", F.col("k") + 1)
    edges = edges.where(F.col("rank") <= F.when(state, 3).when(F.col("type") == "import", 5).otherwise(4))
    own = F.coalesce(F.nullif(F.col("share"), F.lit(0.0)), F.lit(USUAL_SHARE))
    weight = F.when(state, by_rank(F.col("rank"), STATE_WEIGHTS, 10)).when(F.col("type") == "import", own).otherwise(by_rank(F.col("rank"), IMPORT_WEIGHTS, 10))
    here = places.select(F.col("name").alias("key"), F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    there = places.select(F.col("name").alias("partner"), F.col("lat").alias("partner_lat"), F.col("lon").alias("partner_lon"))
    return edges.withColumn("weight", weight).join(there, "partner").join(here, "key").select("key", "type", F.col("rank").cast("long").alias("rank"), "partner", "weight", "lat", "lon", "partner_lat", "partner_lon")


def mirrored(imports: DataFrame) -> DataFrame:
    """exporter, partner, mirror_value, own_value, gap_pct: what the partners say they import from each exporter, beside what the exporter
    says it imports from them, of imports(importer, supplier, value), a row per pair."""
    theirs = imports.select(F.col("supplier").alias("exporter"), F.col("importer").alias("partner"), F.col("value").alias("mirror_value"))
    own = imports.select(F.col("importer").alias("exporter"), F.col("supplier").alias("partner"), F.col("value").alias("own_value"))
    out = theirs.join(own, ["exporter", "partner"], "left")
    return out.withColumn("gap_pct", F.when(F.col("own_value") > 0, round_half_up((F.col("mirror_value") - F.col("own_value")) / F.col("own_value") * 100.0, 1)))
