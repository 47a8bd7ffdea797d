"""Values put into named bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends (included) and names of the risk bands, their colours, and the names of outlook phases.
RISK = ((25, "Resilient"), (50, "Exposed"), (75, "Dependent"), (None, "Structurally Vulnerable"))
RISK_COLOURS = ((25, "#6ba36b"), (50, "#c9a957"), (75, "#d27a3e"), (88, "#c44b3c"), (None, "#7a2922"))
#: Our reading of the five bands that scenarios speak of, whose ends are not given: those of the colours; the last name is ours.
FIVE = ((25, "Resilient"), (50, "Exposed"), (75, "Dependent"), (88, "Structurally Vulnerable"), (None, "Critical"))
PHASES = {1: "Minimal (1)", 2: "Stressed (2)", 3: "Crisis (3)", 4: "Emergency (4)", 5: "Famine (5)"}
#: Supplier concentration above which a tier is named.
CONCENTRATION = ((60, "High concentration risk"), (30, "Moderate concentration"))


def banded(x: Column | str, bands: tuple[tuple[float | None, str], ...]) -> Column:
    """The name of the first band whose upper end is not below x; null for null."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.lit(bands[-1][1])
    for end, name in reversed(bands[:-1]):
        out = F.when(x <= end, F.lit(name)).otherwise(out)
    return F.when(x.isNotNull(), out)


def risk_label(score: Column | str) -> Column:
    return banded(score, RISK)


def five_bands(score: Column | str) -> Column:
    return banded(score, FIVE)


def risk_colour(score: Column | str) -> Column:
    return banded(score, RISK_COLOURS)


def phase_label(phase: Column | str) -> Column:
    """The name of a phase from 1 to 5; a dash for any other, null for null."""
    phase = F.col(phase) if isinstance(phase, str) else phase
    out = F.lit("—")
    for k, name in PHASES.items():
        out = F.when(phase == k, F.lit(name)).otherwise(out)
    return F.when(phase.isNotNull(), out)


def concentration_tier(hhi: Column | str) -> Column:
    hhi = F.col(hhi) if isinstance(hhi, str) else hhi
    (high, a), (some, b) = CONCENTRATION
    return F.when(hhi > high, a).when(hhi > some, b).when(hhi.isNotNull(), "Well diversified")
