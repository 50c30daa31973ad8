"""global_rank equals the window rank it replaces, ties and NULLs included."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from liftwise.functions.formats import exact_ratio, leading_value
from liftwise.operators.ranking import global_rank
from liftwise.operators.star import summarise
from liftwise.plans import reports as R
from tests.conftest import make_tables


def window_rank(df, value, descending, dense):
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)
    fn = F.dense_rank() if dense else F.rank()
    return df.withColumn("rk", fn.over(Window.orderBy(order)).cast("bigint"))


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.integers(-20, 20)), min_size=0, max_size=120),
    st.booleans(),
    st.booleans(),
)
def test_equals_window_rank(spark, values, descending, dense):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    got = global_rank(df, "v", name="rk", descending=descending, dense=dense, ranges=4)
    assert bag(got.select("id", "v", "rk")) == bag(window_rank(df, "v", descending, dense).select("id", "v", "rk"))


def test_reports_rank_like_a_window(small):
    cities = R.city_ir_rank(small)
    assert bag(cities) == bag(R.city_ir_rank(small, ranges=3))
    summed = summarise(small, ["city"]).select("city", "IR")
    want = {r.city: r.rk for r in window_rank(summed, "IR", True, False).collect()}
    assert {r.city: r.city_rank for r in cities.collect()} == want


def test_no_single_task_holds_the_groups(small):
    """Only the sizes of the ranges (and the cuts) meet in one task."""
    for df in (R.city_ir_rank(small), R.category_isu(small, "Diwali"), R.product_ir_pct_rank(small)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window" in line and not line.split("windowspecdefinition", 1)[1].startswith("(_range#") or "SinglePartition" in line:
                assert "_offset" in line or "_size" in line, line


def test_exact_ratio_tells_close_ratios_apart(spark):
    big = 10**26
    pairs = [(-1, 3), (-33, 99), (1, 3), (big + 1, 3 * big), (big, 3 * big), (1, 0), (None, 1), (7, 2), (-7, 2), (0, 5), (big - 1, big), (big - 2, big - 1), (-1, -3)]
    df = spark.createDataFrame([(i, None if n is None else Decimal(n), Decimal(d)) for i, (n, d) in enumerate(pairs)], "i int, n decimal(28,0), d decimal(28,0)")
    keyed = df.select("i", exact_ratio("n", "d", 0).alias("k")).withColumn("lead", F.when(F.col("k").isNotNull(), leading_value("k")))
    rows = {r.i: r for r in keyed.collect()}
    exact = {i: Fraction(n, d) for i, (n, d) in enumerate(pairs) if n is not None and d}
    assert {i for i, r in rows.items() if r.k is None} == set(range(len(pairs))) - set(exact)
    for a in exact:
        for b in exact:
            assert (tuple(rows[a].k) < tuple(rows[b].k)) == (exact[a] < exact[b])
            assert exact[a] > exact[b] or rows[a].lead <= rows[b].lead


def test_equal_ratios_share_a_rank(spark):
    """33% off with unchanged units is -33/100 whatever the revenue."""
    facts = [(f"e{i}", "S1", "C1", code, price, "33% OFF", 1, 1) for i, (code, price) in enumerate([("X", 50), ("Y", 51), ("Z", 52)])]
    products = [("X", "Pa", "A"), ("Y", "Pb", "A"), ("Z", "Pc", "A")]
    t = make_tables(spark, facts, products=products)
    assert [(r.product_name, r.ranking) for r in R.product_top_ir_pct(t).collect()] == [("Pa", 1), ("Pb", 1), ("Pc", 1)]
    assert sorted((r.product_name, r.ranking) for r in R.product_ir_pct_rank(t).collect()) == [("Pa", 1), ("Pb", 1), ("Pc", 1)]
