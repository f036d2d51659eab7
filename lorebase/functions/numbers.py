"""Numbers out of text, and comparisons that hold for NaN and zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions.text import strip


def to_double(c: Column) -> Column:
    """Text as a double, or null where a strict reader would refuse it.

    The SQL cast takes type suffixes (``1.0d``); those are refused here. Underscores between
    digits are allowed, as in ``1_000``.
    """
    text = F.regexp_replace(strip(c.cast("string")), r"(?<=[0-9])_(?=[0-9])", "")
    suffix = text.rlike(r"[dDfF]$") & ~F.lower(text).rlike(r"(inf)$")
    return F.when(suffix, F.lit(None).cast("double")).otherwise(text.try_cast("double"))


def to_score(c: Column) -> Column:
    """A score as INT: whole numbers in text as they are, numbers with a fraction only if the
    column is numeric (then cut towards zero), anything else null."""
    return strip(c.cast("string")).try_cast("int")


def relative_gap(new: Column, old: Column) -> Column:
    """|new - old| / |old|; null where old is zero, null or either is NaN."""
    new, old = new.cast("double"), old.cast("double")
    sane = (old != 0) & ~F.isnan(old) & ~F.isnan(new)
    return F.when(sane, F.abs(new - old) / F.abs(old))


def conflicts(new: Column, old: Column, tolerance: float = 0.05) -> Column:
    """Strictly more than the tolerance apart; never for a zero, null or NaN."""
    return F.coalesce(relative_gap(new, old) > F.lit(float(tolerance)), F.lit(False))


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))
