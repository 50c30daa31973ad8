"""Appends keep the view's sums up; catalog tables join by their buckets; the stored view outlives its session."""

from __future__ import annotations

import glob
import tempfile

import pytest

from liftwise.operators.star import sales_summary, star_join
from liftwise.plans import reports as R
from liftwise.sources.parquet import append_facts, mark_verified, read_tables, write_summary, write_tables
from liftwise.sources.warehouse import drop_warehouse, save_warehouse, stored_report, warehouse_tables
from tests.conftest import FACT_ROWS, make_tables


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="liftwise-test-")


def test_load_and_appends_equal_a_full_load(spark, hand, path):
    write_tables(make_tables(spark, FACT_ROWS[:3]), path)
    assert mark_verified(spark, path).keys_verified
    write_summary(spark, path)
    append_facts(spark, path, make_tables(spark, FACT_ROWS[3:6]).fact)
    t = append_facts(spark, path, make_tables(spark, FACT_ROWS[6:]).fact.selectExpr("*", "1 AS more"))
    assert t.keys_verified and t.summary is not None
    assert bag(t.fact.select(hand.fact.columns)) == bag(hand.fact)
    assert bag(sales_summary(t)) == bag(sales_summary(hand)) == bag(sales_summary(t.with_summary(None)))
    assert bag(R.promo_ir(read_tables(spark, path))) == bag(R.promo_ir(hand))


def test_old_facts_are_not_read_for_the_merge(spark, hand, path):
    """The sums stay right after the facts of the first load are gone from where they were."""
    write_tables(make_tables(spark, FACT_ROWS[:4]), path)
    write_summary(spark, path)
    (first,) = glob.glob(f"{path}/*/fact")
    for f in glob.glob(f"{first}/*/*.parquet"):
        open(f, "w").close()  # no reader gets past an empty file
    t = append_facts(spark, path, make_tables(spark, FACT_ROWS[4:]).fact)
    assert bag(sales_summary(t)) == bag(sales_summary(hand))


def test_an_orphan_clears_the_check_and_a_failed_append_changes_nothing(spark, path):
    write_tables(make_tables(spark, FACT_ROWS), path)
    mark_verified(spark, path)
    before = bag(read_tables(spark, path).fact)
    bad = make_tables(spark, [("e9", "S1", "", "X", 1, None, 1, 1)]).fact
    with pytest.raises(Exception, match="empty campaign_id"):
        append_facts(spark, path, bad)
    assert bag(read_tables(spark, path).fact) == before and read_tables(spark, path).keys_verified
    t = append_facts(spark, path, make_tables(spark, [("e9", "S9", "C1", "X", 1, None, 1, 1)]).fact)
    assert not t.keys_verified and t.summary is None and t.fact.count() == len(before) + 1


def test_nothing_appended(spark, hand, path):
    write_tables(hand, path)
    write_summary(spark, path)
    t = append_facts(spark, path, hand.fact.filter("false"))
    assert bag(sales_summary(t)) == bag(sales_summary(hand))


@pytest.fixture(scope="module")
def stored(spark, hand):
    database = "lw_" + tempfile.mkdtemp(prefix="").rsplit("/", 1)[1].replace("-", "_")
    save_warehouse(hand, database, tempfile.mkdtemp(prefix="liftwise-wh-"), buckets=3)
    yield database
    drop_warehouse(spark, database)


def fact_exchanges(df):
    """Shuffles in the plan that have the fact's scan below them before any aggregate."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            indent = len(line) - len(line.lstrip(" :+-"))
            below = []
            for later in lines[i + 1 :]:
                if len(later) - len(later.lstrip(" :+-")) <= indent:
                    break
                below.append(later)
            if any("fact_events" in b for b in below) and not any("Aggregate" in b for b in below):
                found.append(line)
    return found


def test_bucketed_join_moves_no_fact(spark, hand, stored):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = warehouse_tables(session, stored, broadcast_max_bytes=-1)
    assert t.shuffled_dims == {"stores", "campaigns", "products"}
    joined = star_join(t, ["stores"])
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert fact_exchanges(joined) == [] and fact_exchanges(star_join(t, ["products"])) != []
    plan = R.store_top_ir(t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # neither the sums by store nor the join with stores
    assert bag(R.store_top_ir(t)) == bag(R.store_top_ir(hand))
    assert bag(R.campaign_top_products(t)) == bag(R.campaign_top_products(hand))


def test_another_session_reads_the_view(spark, hand, stored):
    other = spark.newSession()
    assert bag(other.table(f"`{stored}`.sales_summary")) == bag(sales_summary(hand))
    assert other.table(f"`{stored}`.sales_summary").columns == sales_summary(hand).columns
    assert bag(stored_report(other, stored, "stored_campaign_revenue")) == bag(R.campaign_revenue(hand))
    assert bag(stored_report(other, stored, "stored_promo_ir")) == bag(R.promo_ir(hand))
    assert stored in [d.name for d in other.catalog.listDatabases()]
