"""ordered_ranks equals the window functions: mixed keys, groups of any size, ties, NULLs, any number of ranges."""

from __future__ import annotations

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from liftwise.operators.ranking import Key, ordered_ranks
from liftwise.plans import catalog, reports
from liftwise.plans.catalog import CATALOG

METHODS = {"rk": "rank", "dr": "dense_rank", "rn": "row_number"}
FUNCTIONS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}
SCHEMA = "i long, g string, a double, b string, d decimal(20,2)"


def bag(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def by_window(df, keys, ranks, group=()):
    w = Window.partitionBy(*group).orderBy(*[k.order() for k in keys])
    return df.select("*", *[FUNCTIONS[m]().over(w).cast("bigint").alias(n) for n, m in ranks.items()])


@settings(max_examples=8, deadline=None, phases=[Phase.generate])  # a failing example costs Spark jobs to shrink
@given(
    st.lists(st.tuples(st.sampled_from([None, "p", "q", "Q"]), st.sampled_from([None, -1.5, 0.0, 2.0, float("inf"), float("nan")]), st.sampled_from([None, "", "x", "ä", "X"])), max_size=70),
    st.lists(st.tuples(st.booleans(), st.sampled_from([None, True, False])), min_size=2, max_size=2),
    st.sampled_from([(), ("g",)]),
    st.sampled_from([1, 2, 5, 40]),
)
def test_equals_the_windows(spark, rows, directions, group, ranges):
    df = spark.createDataFrame([(i, g, a, b, None) for i, (g, a, b) in enumerate(rows)], SCHEMA).repartition(3)
    keys = [Key(c, *d) for c, d in zip(("a", "b"), directions)]
    ties = {n: m for n, m in METHODS.items() if m != "row_number"}
    assert bag(ordered_ranks(df, keys, ties, group, ranges)) == bag(by_window(df, keys, ties, group))
    whole = [*keys, Key("i", True)]
    assert bag(ordered_ranks(df, whole, METHODS, group, ranges)) == bag(by_window(df, whole, METHODS, group))


def test_one_group_holds_most_rows_and_one_value_a_third(spark):
    df = spark.range(3000).selectExpr("id AS i", "IF(id % 50 = 0, 'small', 'big') AS g", "CAST(IF(id % 3 = 0, 7, id % 500) AS DOUBLE) AS a", "'x' AS b", "CAST(NULL AS DECIMAL(20,2)) AS d")
    got = ordered_ranks(df, [Key("a", True)], {"rk": "rank", "dr": "dense_rank"}, ["g"], ranges=16)
    assert bag(got) == bag(by_window(df, [Key("a", True)], {"rk": "rank", "dr": "dense_rank"}, ["g"]))


def test_both_dense_ranks_from_one_pass(spark):
    df = spark.createDataFrame([(i, None, float(i % 37 // 2), None, None) for i in range(200)], SCHEMA)
    got = ordered_ranks(df, [Key("a", True)], {"top": "dense_rank", "bottom": "dense_rank_from_end"}, ranges=7)
    up = {r.i: r.dr for r in by_window(df, [Key("a")], {"dr": "dense_rank"}).collect()}
    down = {r.i: r.dr for r in by_window(df, [Key("a", True)], {"dr": "dense_rank"}).collect()}
    assert {r.i: (r.top, r.bottom) for r in got.collect()} == {i: (down[i], up[i]) for i in up}


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ordered_ranks(none, [Key("a")], METHODS).count() == 0 and ordered_ranks(none, [Key("a")], METHODS, ["g"]).columns == [*none.columns, *METHODS]
    with pytest.raises(ValueError):
        ordered_ranks(none, [Key("a")], {"x": "ntile"})
    with pytest.raises(ValueError):
        ordered_ranks(none, [Key("a")], {"x": "dense_rank_from_end"}, ["g"])


def test_rows_per_range_are_even(spark):
    df = spark.range(20_000).selectExpr("id AS i", "CAST(id AS STRING) AS b")
    from liftwise.operators.ranking import _range_cuts, _range_of

    cut = df.select("*", _range_cuts(df, [Key("b", True)], 16).alias("_cuts"), F.struct(F.col("b").alias("k0")).alias("_key"))
    keyed = cut.withColumn("r", _range_of([Key("b", True)], 16))
    sizes = [r["count"] for r in keyed.groupBy("r").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4 * 20_000 / 16


@pytest.mark.parametrize("name", ["store_count_by_city_order", "category_isu_order", "promo_isu_order", "promo_ir_isu_order", "category_ir_text_order", "sql_city_rank", "city_ir_rank", "product_ir_dense_ranks"])
def test_no_window_over_all_groups(small, name):
    """The only windows without a key of the rows run over one row for each range."""
    plan = CATALOG[name](small)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "windowspecdefinition(_range" in line or "_total" in line, line


@pytest.mark.parametrize("name", ["campaign_store_ranks", "campaign_product_ranks"])
def test_a_campaign_is_no_window_partition(small, name):
    plan = getattr(reports, name)(small)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "rank(" in line]
    assert windows and all("windowspecdefinition(_range" in line for line in windows)
    assert name in catalog.CATALOG
