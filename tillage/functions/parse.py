"""Lenient parsing of text cells: what can't be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the feeds write for a missing number.
MISSING = ("", "..", "NA", "N/A", "x", "N.D.", "…", "...", "-", "null", "-999999")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str, missing: tuple[str, ...] = MISSING) -> Column:
    """A text cell as a double; null for the missing marks, for what is no number and for NaN."""
    text = F.trim(_col(x).cast("string"))
    out = F.when(~text.isin(*missing), text).try_cast("double")
    return F.when(~F.isnan(out), out)


def integer(x: Column | str) -> Column:
    """A text cell as a whole number, cut toward zero."""
    return number(x).try_cast("bigint")


def month_start(x: Column | str) -> Column:
    """The first day of a month written 2026-04, Apr-26 or 2026M04."""
    text = F.trim(_col(x))
    shapes = ((r"^\d{4}-\d{2}$", "yyyy-MM"), (r"^[A-Za-z]{3}-\d{2}$", "MMM-yy"), (r"^\d{4}M\d{2}$", "yyyy'M'MM"))
    return F.coalesce(*(F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)).cast("date")) for shape, form in shapes))


def month_token(x: Column | str) -> Column:
    """2026M04 as 2026-04; null for anything else."""
    text = F.trim(_col(x))
    return F.when(text.rlike(r"^\d{4}M\d{2}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 6, 2)))


def iso_date(x: Column | str) -> Column:
    """The date that an ISO text begins with."""
    return F.substring(_col(x), 1, 10).try_cast("date")


def country_key(x: Column | str) -> Column:
    """Upper-cased three-letter key; null for anything else."""
    key = F.upper(F.trim(_col(x)))
    return F.when(key.rlike("^[A-Z]{3}$"), key)
