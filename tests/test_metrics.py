"""Row metrics and formatting on the hand-worked rows."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from liftwise.functions import metrics as M
from liftwise.functions.formats import millions, money_text, pct
from tests.conftest import FACT_ROWS, make_tables

# event -> (units after adjusted, revenue before, revenue after)
EXPECTED_ROWS = {
    "e1": (40, Decimal("1000"), Decimal("2000")),
    "e2": (8, Decimal("15000"), Decimal("20000")),
    "e3": (15, Decimal("1000"), Decimal("750")),
    "e4": (6, Decimal("12000"), Decimal("12060")),
    "e5": (4, Decimal("808"), Decimal("303")),
    "e6": (9, Decimal("700"), Decimal("0")),
    "e7": (3, Decimal("800"), Decimal("-300")),
    "e8": (5, Decimal("0"), Decimal("0")),
}


def test_row_metrics(hand):
    rows = hand.fact.select(
        "event_id",
        M.adjusted_units_after("promo_type", "quantity_sold_after_promo").alias("units"),
        M.revenue_before("base_price", "quantity_sold_before_promo").alias("before"),
        M.net_revenue_after("promo_type", "base_price", "quantity_sold_after_promo").alias("after"),
    ).collect()
    got = {r.event_id: (r.units, r.before, r.after) for r in rows}
    assert got == EXPECTED_ROWS


def test_gross_row_metrics(hand):
    rows = hand.fact.select(
        "event_id",
        M.gross_revenue_delta("base_price", "quantity_sold_before_promo", "quantity_sold_after_promo").alias("g"),
        M.units_delta("quantity_sold_before_promo", "quantity_sold_after_promo").alias("u"),
    ).collect()
    got = {r.event_id: (r.g, r.u) for r in rows}
    assert got["e1"] == (1000, 10)
    assert got["e5"] == (-404, -4)
    assert got["e8"] == (3000, 5)


def test_int_overflow_is_widened(spark):
    # 2,000,000 x 2,000 does not fit in an int (T17); every metric widens first.
    t = make_tables(spark, [("big", "S1", "C1", "X", 2_000_000, "BOGOF", 2_000, 2_000)])
    r = t.fact.select(
        M.revenue_before("base_price", "quantity_sold_before_promo").alias("b"),
        M.net_revenue_after("promo_type", "base_price", "quantity_sold_after_promo").alias("a"),
        M.gross_revenue_delta("base_price", "quantity_sold_before_promo", "quantity_sold_after_promo").alias("g"),
    ).first()
    assert r.b == Decimal("4000000000") and r.a == Decimal("4000000000") and r.g == 0


def _exact_pct(n: int, d: int) -> float | None:
    if d == 0:
        return None
    q = (Decimal(n) * 100 / Decimal(d)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    return float(q)


def test_pct_fixed_cases(spark):
    cases = [(1, 8), (1, 20000), (-1, 20000), (-2245, 14308), (5, 0), (0, 5), (2, 3), (-2, 3), (1, -3), (575000, 1700000)]
    df = spark.createDataFrame(cases, "n long, d long")
    got = [r.p for r in df.select(pct("n", "d").alias("p")).collect()]
    assert got == [_exact_pct(n, d) for n, d in cases]
    assert got[1] == 0.01 and got[2] == -0.01 and got[3] == -15.69 and got[4] is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**12, 10**12), st.integers(-10**9, 10**9)), min_size=1, max_size=200))
def test_pct_is_exact_half_away_from_zero(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r.p for r in df.select(pct("n", "d").alias("p")).collect()]
    assert got == [_exact_pct(n, d) for n, d in pairs]


def test_pct_on_money_scale(spark):
    df = spark.createDataFrame([(Decimal("5750.00"), Decimal("17000.00"))], "a decimal(28,2), b decimal(28,2)")
    assert df.select(pct("a", "b", 2).alias("p")).first().p == 33.82


def test_money_text(spark):
    values = ["17000", "-2245", "12300000", "-12345000", "0", "12344999.99"]
    df = spark.createDataFrame([(Decimal(v),) for v in values], "x decimal(28,2)")
    got = [r.t for r in df.select(money_text("x").alias("t")).collect()]
    assert got == ["0.02M", "0.00M", "12.30M", "-12.35M", "0.00M", "12.34M"]
    spaced = df.select(money_text("x", " M").alias("t")).first().t
    assert spaced == "0.02 M"
    assert df.select(millions("x").alias("m")).first().m == Decimal("0.02")


def test_rules_are_whole_cents():
    for name, (_, factor, _) in M.PROMO_RULES.items():
        assert (factor * 100) == int(factor * 100), name


def test_fact_rows_fixture_has_eight_rows():
    assert len(FACT_ROWS) == 8
