"""Feed health, data quality and the daily summary."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tillage.functions.dates import months_apart
from tillage.functions.numeric import or_zero

#: Phrases in a feed's source or notes that tell its state.
SETUP_PHRASES = ("not configured", "set acled_api_key", "set comtrade_api_key", "registration pending", "secret to enable", "api key needed", "setup required", "key not provided")
REFUSED_PHRASES = ("could not obtain guest token", "403")
#: Fixed value: months after which a monthly release counts as stale.
STALE_MONTHS = 2


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def manifest(feeds: DataFrame, today: Column) -> DataFrame:
    """feeds with status, reason and age_days.

    feeds: feed, mode (auto, manual or static_helper), present, source, notes, n_rows, period (a date or null), monthly,
    snapshot (whether it is a manual annual snapshot), generated_at. The first rule that fits decides.
    """
    said = F.lower(F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("notes", F.lit(""))))
    stale = F.col("monthly") & (months_apart(today, F.col("period")) > STALE_MONTHS)
    rules = (
        (F.col("mode") == "static_helper", "manual", F.lit("static deep-link helper (curated lookup)")),
        (~F.coalesce("present", F.lit(False)), "failed", F.lit("missing file")),
        (_any(said, SETUP_PHRASES), "setup_required", F.lit("setup or approval required")),
        (_any(said, REFUSED_PHRASES), "degraded", F.lit("upstream auth or access failure")),
        (F.coalesce("n_rows", F.lit(0)) == 0, "degraded", F.when(F.col("mode") == "manual", "manual source has no rows").otherwise("empty payload")),
        (F.coalesce(stale, F.lit(False)), "degraded", F.concat(F.lit("stale release ("), F.date_format("period", "yyyy-MM"), F.lit(")"))),
        (F.coalesce("snapshot", F.lit(False)), "manual", F.lit("manual annual snapshot")),
    )
    status, reason = F.lit("ok"), F.lit("healthy")
    for fits, state, why in reversed(rules):
        status, reason = F.when(fits, state).otherwise(status), F.when(fits, why).otherwise(reason)
    return feeds.withColumn("status", status).withColumn("reason", reason).withColumn("age_days", F.datediff(today, F.col("generated_at").cast("date")).cast("long"))


def manifest_summary(rows: DataFrame) -> DataFrame:
    """One row: counts by status, healthy_sources (ok and manual), loaded_at, headline_status."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = rows.agg(
        F.count("*").alias("total_sources"), count("ok").alias("ok_sources"), count("manual").alias("manual_sources"), count("degraded").alias("degraded_sources"),
        count("setup_required").alias("setup_required_sources"), count("failed").alias("failed_sources"), F.max("generated_at").alias("loaded_at"),
    )
    bad = F.col("degraded_sources") + F.col("setup_required_sources") + F.col("failed_sources")
    return out.withColumn("healthy_sources", F.col("ok_sources") + F.col("manual_sources")).withColumn("headline_status", F.when(bad == 0, "healthy").otherwise("attention"))


def shape_problem(kind: Column, parsed: Column, has_meta: Column, has_data: Column, entries: Column, is_object: Column) -> Column:
    """What is wrong with a feed's document, or null: the checks of a shape class, first failure first.

    kind: dict_nonempty, dict_or_empty, list_nonempty, object or flexible. entries: keys or elements of the data, null for null data.
    """
    empty_allowed = kind == "dict_or_empty"
    rules = (
        (~parsed, "JSON parse error"), (~has_meta, "missing _meta envelope"), (~has_data, "missing data envelope"),
        ((kind == "dict_nonempty") & ~F.coalesce(is_object, F.lit(False)), "data is no object"), ((kind == "dict_nonempty") & (entries == 0), "data dict is empty"),
        ((kind == "list_nonempty") & F.coalesce(is_object, F.lit(True)), "data is no list"), ((kind == "list_nonempty") & (entries == 0), "data list is empty"),
        (~empty_allowed & entries.isNull(), "data is null"),
    )
    out = F.lit(None).cast("string")
    for fails, what in reversed(rules):
        out = F.when(fails, what).otherwise(out)
    return out


def checked(name: str, rows: DataFrame, found: Column, passes: Column) -> DataFrame:
    """One row of a quality report: check, found (a count), passed."""
    return rows.agg(found.cast("long").alias("found")).select(F.lit(name).alias("check"), "found", passes.alias("passed"))


def at_least(name: str, rows: DataFrame, n: int) -> DataFrame:
    return checked(name, rows, F.count("*"), F.col("found") >= n)


def known_in(name: str, rows: DataFrame, column: str, n: int) -> DataFrame:
    """Whether at least n rows know a column."""
    return checked(name, rows, F.count(column), F.col("found") >= n)


def none_missing(name: str, required: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Whether every required key has a row; found says how many have none."""
    return checked(name, required.join(rows.select(key).distinct(), key, "left_anti"), F.count("*"), F.col("found") == 0)


def none_bad(name: str, rows: DataFrame, bad: Column) -> DataFrame:
    return checked(name, rows, F.count_if(F.coalesce(bad, F.lit(False))), F.col("found") == 0)


def no_swaps(name: str, rows: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
    """Whether no row is one of the pairs known to be wrong."""
    return checked(name, rows.join(pairs, on, "left_semi"), F.count("*"), F.col("found") == 0)


def names_agree(name: str, rows: DataFrame, canonical: DataFrame, key: str, label: str) -> DataFrame:
    """Whether every row whose label has a canonical key stands under that key. canonical(label, expected)."""
    other = rows.join(canonical, label).where(F.col(key) != F.col("expected"))
    return checked(name, other, F.count("*"), F.col("found") == 0)


class Rule(NamedTuple):
    """What a table must keep: a count that one pass over its rows can add up, and its bounds (null: none)."""

    check: str
    found: Column
    least: int | None = None
    most: int | None = None

    def passes(self, found: int) -> bool:
        return (self.least is None or found >= self.least) and (self.most is None or found <= self.most)


def rows_at_least(n: int) -> Rule:
    return Rule(f"at least {n} rows", F.count("*"), least=n)


def known_at_least(column: str, n: int) -> Rule:
    return Rule(f"{column} known in at least {n} rows", F.count(column), least=n)


def no_rows(what: str, bad: Column) -> Rule:
    """No row may fulfil a condition; one that it can't be told of does not."""
    return Rule(what, F.count_if(F.coalesce(bad, F.lit(False))), most=0)


def within(column: str, low: float, high: float) -> Rule:
    return no_rows(f"{column} within {low} and {high}", (F.col(column) < low) | (F.col(column) > high))


def keys_present(column: str, required: list[str]) -> Rule:
    """Every required key has a row; found says how many have none. Meant for a few keys: each is an aggregate of its own."""
    missing = F.lit(0)
    for key in required:
        missing = missing + F.lit(1) - F.coalesce(F.max(F.when(F.col(column) == key, 1)), F.lit(0))
    return Rule(f"{len(required)} keys of {column} present", missing, most=0)


class Watched:
    """Rows whose rules are told by the pass that writes them: write `rows`, then ask for `report()`. Nothing is read again."""

    def __init__(self, rows: DataFrame, rules: list[Rule]):
        self.rules, self.seen = rules, Observation()
        self.rows = rows.observe(self.seen, F.count("*").alias("rows"), *(r.found.cast("long").alias(f"rule{k}") for k, r in enumerate(rules)))

    def counts(self) -> list[int]:
        return [int(self.seen.get[f"rule{k}"] or 0) for k in range(len(self.rules))]

    def failed(self) -> list[str]:
        return [r.check for r, n in zip(self.rules, self.counts()) if not r.passes(n)]

    def report(self) -> DataFrame:
        """check, found, passed: a row a rule."""
        rows = [(r.check, n, r.passes(n)) for r, n in zip(self.rules, self.counts())]
        return self.rows.sparkSession.createDataFrame(rows, "check string, found long, passed boolean")


def gate(report: DataFrame, critical: int = 4) -> DataFrame:
    """One row: failures, and whether they stay under the number that fails a run."""
    return report.agg(F.count_if(~F.col("passed")).alias("failures")).withColumn("ok", F.col("failures") < critical)


def daily_summary(counts: DataFrame) -> DataFrame:
    """counts with headline, subhead and bullets (six at most).

    counts: one row of movers, top_name, top_adjustment, high_ipc, worst_ipc_name, worst_ipc_pct, drought, flood, fire, fx,
    ffpi_mom_pct, high_inform, top_inform_name, top_inform. Bullets without anything to say are left out.
    """
    n = lambda c: F.col(c).cast("string")
    flags = or_zero("drought") + or_zero("flood") + or_zero("fire")
    some = lambda c: F.col(c) > 0
    headline = (
        F.when(some("movers"), F.concat(n("movers"), F.lit(" countries with active nowcast pressure; "), F.col("top_name"), F.lit(" leads.")))
        .when(some("high_ipc"), F.concat(n("high_ipc"), F.lit(" countries in active IPC Phase 3+ crisis; quiet day on the nowcast layer.")))
        .when(flags > 0, "Quiet on FDRS movements; environmental signals firing across multiple regions.")
        .otherwise("No major shocks today; structural FDRS unchanged at most countries.")
    )
    bits = F.concat_ws(
        " · ", F.when(some("movers"), F.concat(n("movers"), F.lit(" country nowcast moves"))), F.when(some("high_ipc"), F.concat(n("high_ipc"), F.lit(" IPC Phase 3+ crises"))),
        F.when(flags > 0, F.concat(flags.cast("long").cast("string"), F.lit(" environmental flags"))), F.when(some("fx"), F.concat(n("fx"), F.lit(" currency shocks"))),
    )
    environment = F.concat_ws(
        ", ", F.when(some("drought"), F.concat(n("drought"), F.lit(" drought-flagged"))), F.when(some("flood"), F.concat(n("flood"), F.lit(" flood-flagged"))),
        F.when(some("fire"), F.concat(n("fire"), F.lit(" fire-active"))),
    )
    mom = F.col("ffpi_mom_pct")
    bullets = F.array(
        F.when(some("movers"), F.concat(n("movers"), F.lit(" countries on +8 or worse nowcast adjustment vs structural baseline today. Top mover: "), F.col("top_name"), F.lit(" at +"), n("top_adjustment"), F.lit("."))),
        F.when(some("high_ipc"), F.concat(n("high_ipc"), F.lit(" countries with ≥25% population in IPC Phase 3+ food crisis. Worst: "), F.col("worst_ipc_name"), F.lit(" at "), F.printf(F.lit("%.0f"), "worst_ipc_pct"), F.lit("%."))),
        F.when(F.abs(mom) >= 1.5, F.concat(F.lit("FAO Food Price Index "), F.when(mom > 0, "up").otherwise("down"), F.lit(" "), F.printf(F.lit("%.1f"), F.abs(mom)), F.lit("% month-on-month."))),
        F.when(flags > 0, F.concat(F.lit("Active environmental signals: "), environment, F.lit(" countries today."))),
        F.when(some("fx"), F.concat(n("fx"), F.lit(" countries with currency shock flag (>10% drop vs USD in 90d)."))),
        F.when(some("high_inform"), F.concat(n("high_inform"), F.lit(" countries at INFORM Risk ≥ 7.5/10 (severe humanitarian risk). Top of list: "), F.col("top_inform_name"), F.lit(" ("), F.printf(F.lit("%.1f"), "top_inform"), F.lit(")."))),
    )
    subhead = F.when(bits != "", F.concat(F.lit("Today: "), bits, F.lit("."))).otherwise("All sources nominal.")
    return counts.withColumn("headline", headline).withColumn("subhead", subhead).withColumn("bullets", F.slice(F.array_compact(bullets), 1, 6))
