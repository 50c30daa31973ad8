
from __future__ import annotations

import contextlib
import io
import re
import tempfile

from liftwise.plans import reports as R
from liftwise.sources.parquet import read_tables, write_tables


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def ops(p: str, name: str) -> int:
    """Number of operators called ``name`` in a formatted plan (its numbered detail lines)."""
    return len(re.findall(rf"^\(\d+\) {name}\b", p, flags=re.M))


def test_view_joins_are_broadcast(small):
    p = plan(R.sales_summary(small))
    assert p.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in p


def test_top_n_is_take_ordered(small):
    assert "TakeOrderedAndProject" in plan(R.store_top_ir(small))
    assert "TakeOrderedAndProject" in plan(R.store_bottom_isu(small))


def test_rank_filter_uses_group_limit(small):
    assert "WindowGroupLimit" in plan(R.campaign_top_stores(small))
    assert "WindowGroupLimit" in plan(R.campaign_top_products(small))


def test_top_bottom_has_no_global_window(small):
    p = plan(R.product_top_bottom_ir(small))
    assert "Window " not in p and "TakeOrderedAndProject" in p


def test_scan_prunes_columns_and_campaign_filter_prunes_partitions(spark, small):
    path = tempfile.mkdtemp(prefix="liftwise-plan-")
    write_tables(small, path)
    t = read_tables(spark, path)
    p = plan(R.category_isu_diwali(t))
    assert "dynamicpruningexpression" in p.lower()
    fact_scan = [line for line in p.splitlines() if line.startswith("ReadSchema") and "quantity_sold" in line]
    assert fact_scan and "event_id" not in fact_scan[0]


def test_verified_keys_drop_unused_joins(spark, small):
    from liftwise.sources.checks import verify_keys

    path = tempfile.mkdtemp(prefix="liftwise-plan-")
    write_tables(small, path)
    loaded = read_tables(spark, path)
    assert ops(plan(R.promo_isu(loaded)), "BroadcastHashJoin") == 3
    verified = verify_keys(loaded)
    assert "Join" not in plan(R.promo_isu(verified))
    assert ops(plan(R.campaign_revenue(verified)), "BroadcastHashJoin") == 1
    assert ops(plan(R.sales_summary(verified)), "BroadcastHashJoin") == 3


def test_top_bottom_reuses_the_rollup(small):
    """Both cut-offs of Q14 and Q15 read the shuffle of the report's own roll-up."""
    for report in (R.product_top_bottom_ir, R.product_top_bottom_isu):
        df = report(small)
        df.collect()
        assert ops(plan(df), "ReusedExchange") >= 2


def test_distinct_before_the_join(small):
    lines = R.high_value_bogof(small)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    kinds = [next((k for k in ("Aggregate", "Join") if k in line), "") for line in lines]
    kinds = [k for k in kinds if k]
    assert kinds[:3] == ["Aggregate", "Join", "Aggregate"]
