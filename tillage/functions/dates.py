"""Calendar arithmetic and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def months_apart(later: Column, earlier: Column) -> Column:
    """Whole calendar months between two dates, days ignored."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def period_label(start: Column, end: Column) -> Column:
    """Jan–Mar 2026, or Nov 2025 – Jan 2026 across years; null if an end is missing."""
    same = F.concat(F.date_format(start, "MMM"), F.lit("–"), F.date_format(end, "MMM yyyy"))
    return F.when(F.year(start) == F.year(end), same).otherwise(F.concat(F.date_format(start, "MMM yyyy"), F.lit(" – "), F.date_format(end, "MMM yyyy")))
