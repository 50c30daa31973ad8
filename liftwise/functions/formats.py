"""Rounding and display of aggregated metrics.

Rounding is exact and half away from zero, independent of how a division would be
carried out in floating point: decimal sums are divided exactly, and percentages are
rounded with integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftwise.functions.metrics import MONEY


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millions(x: Column | str, digits: int = 2) -> Column:
    """round(x / 1,000,000, digits) in exact decimal (F7 + F3)."""
    return F.round(_col(x).cast(MONEY) / 1_000_000, digits).cast(MONEY)


# The suffix of money shown in millions (Q10 writes it with a space).
MILLIONS_SUFFIX = "M"


def money_text(x: Column | str, suffix: str = MILLIONS_SUFFIX) -> Column:
    """Money in millions as text with two places and a suffix (M10, T8): 12.30M."""
    return F.concat(millions(x).cast("decimal(18,2)").cast("string"), F.lit(suffix))


def pct(num: Column | str, den: Column | str, scale: int = 0) -> Column:
    """round(num / den * 100, 2) as DOUBLE; NULL when den is 0 or NULL.

    ``num`` and ``den`` hold at most ``scale`` decimal places.  Both are turned into
    integers of the same unit and the quotient is rounded half away from zero with
    integer division, so the result is the exact rounding of the true ratio.
    """
    unit = 10**scale
    n = (_col(num) * unit).cast("decimal(38,0)")
    d = (_col(den) * unit).cast("decimal(38,0)")
    a = F.abs(n) * 20000 + F.abs(d)
    b = F.abs(d) * 2
    hundredths = ((a - a % b) / b).cast("bigint")
    signed = F.when((n < 0) != (d < 0), -hundredths).otherwise(hundredths)
    return F.when(d != 0, signed.cast("double") / 100)


# Base-10^9 digits behind the point that tell any two ratios of 28-digit numbers apart:
# they differ by 10^-56 at least.
RATIO_DIGITS = 7


def exact_ratio(num: Column | str, den: Column | str, scale: int = 2) -> Column:
    """num / den as an exact ordering key: its whole part and ``RATIO_DIGITS`` base-10^9 digits.

    ``num`` and ``den`` hold at most ``scale`` decimal places.  Long division in whole
    numbers (rounded down, so the key orders negative ratios too); equal ratios have equal
    keys.  NULL when ``den`` is 0 or an input is NULL.
    """
    unit = 10**scale
    n, d = ((_col(c) * unit).cast("decimal(38,0)") for c in (num, den))
    n, d = F.when(d < 0, -n).otherwise(n), F.abs(d)

    def divided(pair: Column) -> Column:
        top, by = pair["n"], pair["d"]
        rest = ((top % by + by) % by).cast("decimal(38,0)")
        first = F.struct(rest.alias("rest"), F.array(((top - rest) / by).cast("decimal(38,0)")).alias("digits"))

        def step(held: Column, _: Column) -> Column:
            shifted = (held["rest"] * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,0)")
            left = (shifted % by).cast("decimal(38,0)")
            return F.struct(left.alias("rest"), F.concat(held["digits"], F.array(((shifted - left) / by).cast("decimal(38,0)"))).alias("digits"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(RATIO_DIGITS)), first, step, lambda held: held["digits"])

    # One-element arrays name a value once; a zero divisor leaves none.
    pairs = F.filter(F.array(F.struct(n.alias("n"), d.alias("d"))), lambda p: (p["d"] != 0) & p["n"].isNotNull())
    keys = F.transform(
        F.transform(pairs, divided),
        lambda a: F.struct(a[0].alias("d0"), *[a[i].cast("bigint").alias(f"d{i}") for i in range(1, RATIO_DIGITS + 1)]),
    )
    return F.get(keys, F.lit(0))


def leading_value(key: str) -> Column:
    """The ratio cut after nine places, from an :func:`exact_ratio` column; never out of its order."""
    return F.col(f"{key}.d0") + F.col(f"{key}.d1").cast("decimal(10,0)") * F.lit("0.000000001").cast("decimal(10,9)")
