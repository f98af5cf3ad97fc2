"""Null and infinity rules shared by the numeric operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite_or_null(c: Column) -> Column:
    """NaN becomes null; infinities stay."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """Float division without ANSI errors: x/0 is a signed infinity, 0/0 is null."""
    return (
        F.when(b != 0, F.try_divide(a, b))
        .when((b == 0) & (a > 0), F.lit(INF))
        .when((b == 0) & (a < 0), F.lit(-INF))
    )


def rounded(c: Column, digits: int = 6) -> Column:
    """Round for output; the small shift keeps exact halves from depending on the last bit."""
    return F.round(c + F.lit(float(f"3.71e-{digits + 3}")), digits) + F.lit(0.0)


def rounded_double(c: Column, digits: int = 6) -> Column:
    """`rounded` by double arithmetic: no decimal number is made for each value.  For values whose scaled form is finite."""
    scale = F.lit(float(10**digits))
    return F.rint((c + F.lit(float(f"3.71e-{digits + 3}"))) * scale) / scale + F.lit(0.0)


def number_or_null(c: Column) -> Column:
    """Text to double: trimmed, empty or `none` is null, bad text is null."""
    t = F.trim(c)
    return F.when((t == "") | (F.lower(t) == "none"), F.lit(None).cast("double")).otherwise(t.try_cast("double"))


def pair_corr(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation over complete pairs; null without spread."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
