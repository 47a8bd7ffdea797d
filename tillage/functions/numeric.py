"""Number rules that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x: Column | str, places: int = 0) -> Column:
    """floor(x * 10**places + 0.5) / 10**places as a double; the same in any engine that has IEEE doubles. Null stays null."""
    scale = F.lit(float(10**places))
    return F.floor(_col(x) * scale + F.lit(0.5)).cast("double") / scale


def money(x: Column | str) -> Column:
    """The sum of a column of cents-exact amounts, added as decimals so that its order can't matter, as a double."""
    return F.sum(_col(x).cast("decimal(12,2)")).cast("double")


def percent_change(new: Column | str, old: Column | str, above: float | None = 0.0) -> Column:
    """(new - old) / old in percent; null where old is null or not above a floor (None: where it is 0)."""
    new, old = _col(new), _col(old)
    return F.when(old != 0 if above is None else old > above, (new - old) / old * 100.0)


def percent_of(part: Column | str, whole: Column | str) -> Column:
    """part as percent of whole; null where whole is null or not positive."""
    part, whole = _col(part), _col(whole)
    return F.when(whole > 0, part / whole * 100.0)


def clamp(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null (least and greatest alone would skip it)."""
    x = _col(x)
    out = x if low is None else F.greatest(x, F.lit(low))
    return F.when(x.isNotNull(), out if high is None else F.least(out, F.lit(high)))


def known(condition: Column) -> Column:
    """A flag that is false, not null, where its input is missing."""
    return F.coalesce(condition, F.lit(False))


def or_zero(x: Column | str) -> Column:
    return F.coalesce(_col(x), F.lit(0.0))


def first_truthy(*columns: Column | str) -> Column:
    """The first of some numbers that is neither null nor 0; the last one's value if none is."""
    *heads, last = map(_col, columns)
    return F.coalesce(*(F.nullif(h, F.lit(0)) for h in heads), last)


def by_unit(value: Column | str, code: Column | str, places: dict[str, int], default: int = 2) -> Column:
    """Rounded to the places that a code's unit calls for."""
    out = round_half_up(value, default)
    for p in sorted(set(places.values())):
        out = F.when(_col(code).isin(*(k for k, v in places.items() if v == p)), round_half_up(value, p)).otherwise(out)
    return out
