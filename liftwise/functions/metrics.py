"""Row-level promotion metrics (M1-M3, M8, M9) as Spark Column expressions.

Everything here is a built-in expression, so it stays inside whole-stage codegen.
Money is exact: per row and in sums it is carried as whole cents in BIGINT (every
promotion factor is a whole number of hundredths), and turned into DECIMAL(28,2) once
per group.  A sum is kept as two BIGINTs, of the cents' lower 20 bits and of the rest
(:func:`sum_parts`): fast in codegen, unlike DECIMAL sum buffers, and a group may hold
8 trillion rows and 10^24 cents before ANSI mode raises ARITHMETIC_OVERFLOW.  Integer
products are widened before multiplying for the same reason (T17).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The promotion rules of the analysed data set.
# promo_type -> (multiplier on units after, multiplier on base price, amount off each unit).
# A type not listed here, and NULL, earns no revenue after the promotion (T3) and counts
# its units once.  Names are compared byte for byte.
PROMO_RULES: dict[str, tuple[int, Decimal, int]] = {
    "BOGOF": (2, Decimal("0.5"), 0),
    "500 Cashback": (1, Decimal("1"), 500),
    "50% OFF": (1, Decimal("0.5"), 0),
    "33% OFF": (1, Decimal("0.67"), 0),
    "25% OFF": (1, Decimal("0.75"), 0),
}

# Exact money per fact row, and summed money.
ROW_MONEY = T.DecimalType(18, 2)
MONEY = T.DecimalType(28, 2)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def adjusted_units_after(promo: Column | str, q_after: Column | str) -> Column:
    """M1: units after the promotion, a free unit counted for each BOGOF unit sold."""
    promo, q = _col(promo), _col(q_after).cast("bigint")
    out = q
    for name, (units, _, _) in reversed(list(PROMO_RULES.items())):
        if units != 1:
            out = F.when(promo == name, q * units).otherwise(out)
    return out


def _cents_per_unit(factor: Decimal) -> int:
    cents = factor * 100
    if cents != cents.to_integral_value():
        raise ValueError(f"price factor {factor} is not a whole number of hundredths")
    return int(cents)


def net_revenue_after_cents(promo: Column | str, price: Column | str, q_after: Column | str) -> Column:
    """M2 in whole cents (BIGINT): every rule's factor is a whole number of hundredths."""
    promo, p, q = _col(promo), _col(price).cast("bigint"), _col(q_after).cast("bigint")
    out = F.lit(0).cast("bigint")
    for name, (units, factor, off) in reversed(list(PROMO_RULES.items())):
        unit_cents = p * _cents_per_unit(factor)
        if off:
            unit_cents = unit_cents - off * 100
        sold = q if units == 1 else q * units
        out = F.when(promo == name, unit_cents * sold).otherwise(out)
    return out


def revenue_before_cents(price: Column | str, q_before: Column | str) -> Column:
    """M3 in whole cents (BIGINT)."""
    return _col(price).cast("bigint") * _col(q_before) * 100


# Sums of whole numbers in two BIGINT parts: the lower bits, never negative, and the rest.
LOW_BITS = 20


def sum_parts(name: str, whole: Column) -> dict[str, Column]:
    """The two parts of a BIGINT row value, to be summed separately as ``name_hi`` and ``name_lo``."""
    return {
        f"{name}_hi": F.shiftright(whole, LOW_BITS),
        f"{name}_lo": whole.bitwiseAND(F.lit((1 << LOW_BITS) - 1)),
    }


def whole_sum(name: str) -> Column:
    """The sum whose parts are ``name_hi`` and ``name_lo``, as an exact DECIMAL(38,0)."""
    high = F.col(f"{name}_hi").cast("decimal(24,0)") * F.lit(1 << LOW_BITS).cast("decimal(8,0)")
    return (high + F.col(f"{name}_lo").cast("decimal(19,0)")).cast("decimal(38,0)")


def cents_to_money(cents: Column | str, money: T.DecimalType = MONEY) -> Column:
    """Whole cents to an exact decimal with two places."""
    return (_col(cents).cast("decimal(38,0)") / 100).cast(money)


def net_revenue_after(promo: Column | str, price: Column | str, q_after: Column | str) -> Column:
    """M2: revenue after the promotion at the discounted price, exact to the cent."""
    return cents_to_money(net_revenue_after_cents(promo, price, q_after), ROW_MONEY)


def revenue_before(price: Column | str, q_before: Column | str) -> Column:
    """M3: revenue before the promotion at the base price."""
    return cents_to_money(revenue_before_cents(price, q_before), ROW_MONEY)


def gross_revenue_delta(price: Column | str, q_before: Column | str, q_after: Column | str) -> Column:
    """Row part of M8: base price times units after minus base price times units before."""
    p = _col(price).cast("bigint")
    return p * _col(q_after) - p * _col(q_before)


def units_delta(q_before: Column | str, q_after: Column | str) -> Column:
    """Row part of M9: units after minus units before, not adjusted for BOGOF."""
    return _col(q_after).cast("bigint") - _col(q_before)
