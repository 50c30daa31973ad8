"""Column expressions: promotion rules and row metrics, exact rounding and display."""

from liftwise.functions.formats import exact_ratio, leading_value, millions, money_text, pct
from liftwise.functions.metrics import (
    PROMO_RULES,
    adjusted_units_after,
    gross_revenue_delta,
    net_revenue_after,
    net_revenue_after_cents,
    revenue_before,
    revenue_before_cents,
    units_delta,
)

__all__ = [
    "PROMO_RULES",
    "adjusted_units_after",
    "exact_ratio",
    "gross_revenue_delta",
    "leading_value",
    "millions",
    "money_text",
    "net_revenue_after",
    "net_revenue_after_cents",
    "pct",
    "revenue_before",
    "revenue_before_cents",
    "units_delta",
]
