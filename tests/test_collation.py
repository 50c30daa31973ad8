"""Declared collation: joins, groups, distinct rows, ranks and rules fold case and accents."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from liftwise.functions.collation import byte_strings, collate_tables, collated, distinct, grouped
from liftwise.operators.star import broadcast_small_dims, sales_summary
from liftwise.plans import reports as R
from liftwise.sources.checks import check_keys
from tests.conftest import make_tables

FACTS = [
    ("e1", "s1", "c1", "x", 100, "bogof", 10, 20),
    ("e2", "S1", "C1", "X", 100, "BÓGOF", 1, 2),
    ("e3", "ś2", "C1", "Y", 600, "500 CASHBACK", 5, 8),
    ("e4", "S3", "c1", "y", 600, None, 4, 6),
]
STORES = [("S1", "Köln"), ("S2", "KOLN"), ("S3", "Bonn")]
CAMPAIGNS = [("C1", "Alpha", date(2023, 1, 1), date(2023, 1, 2))]
PRODUCTS = [("X", "Café", "a"), ("Y", "CAFE", "A")]


def tables(spark):
    return make_tables(spark, FACTS, STORES, CAMPAIGNS, PRODUCTS)


def test_joins_groups_and_rules_fold(spark):
    for t in (tables(spark), broadcast_small_dims(tables(spark)), broadcast_small_dims(tables(spark), max_bytes=-1)):
        assert sales_summary(t).filter("promo_type = 'bogof'").count() == 0  # bytes differ without the collation
        rows = byte_strings(sales_summary(collate_tables(t))).select("city", "product_name", "category", "promo_type", "ISU", "IR").collect()
        assert sorted(map(tuple, rows), key=repr) == [
            ("Bonn", "CAFE", "A", None, 2, Decimal("-2400.00")),
            ("KOLN", "CAFE", "A", "500 CASHBACK", 3, Decimal("-2200.00")),
            ("Köln", "Café", "a", "BÓGOF", 33, Decimal("1100.00")),
        ]


def test_the_first_spelling_in_byte_order_is_shown(spark):
    rows = {r.city: r.total_stores for r in byte_strings(R.store_count_by_city(collate_tables(tables(spark)))).collect()}
    assert rows == {"KOLN": 2, "Bonn": 1}
    df = spark.createDataFrame([("b", 1), ("B", 2), ("ß", 3), (None, 4), ("", 5)], "k string, n int").repartition(5)
    assert {tuple(r) for r in byte_strings(distinct(collated(df).select("k"))).collect()} == {("B",), ("ß",), (None,), ("",)}
    assert {tuple(r) for r in grouped(collated(df), ["k"], [F.sum("n").alias("n")]).collect()} == {("B", 3), ("ß", 3), (None, 4), ("", 5)}


def test_ranks_fold_their_partition(spark):
    facts = [("e1", "S1", "C1", "X", 9000, None, 0, 1000), ("e2", "S2", "c1", "X", 9000, None, 0, 3000), ("e3", "S3", "C2", "X", 9000, None, 0, 2000)]
    t = collate_tables(make_tables(spark, facts, STORES, [*CAMPAIGNS, ("C2", "ÁLPHA", date(2023, 1, 1), date(2023, 1, 2))], PRODUCTS))
    rows = {r.store_id: r.store_rank for r in R.campaign_top_stores(t, k=3).collect()}
    assert rows == {"S2": 1, "S3": 2, "S1": 3}


def test_keys_equal_up_to_case_are_duplicates(spark):
    t = make_tables(spark, FACTS, [*STORES, ("s1", "x")], CAMPAIGNS, PRODUCTS)

    def bad(t):
        return {(r.check_name, r.column_name): r.violations for r in check_keys(t).collect() if r.violations}

    assert bad(t) == {("orphan", "campaign_id"): 2, ("orphan", "product_code"): 2, ("orphan", "store_id"): 1}
    assert bad(collate_tables(t)) == {("duplicate_key", "store_id"): 1}


def test_plain_tables_keep_their_plan(hand):
    plan = R.promo_isu(hand)._jdf.queryExecution().optimizedPlan().toString()
    assert "collate" not in plan.lower()


def test_spellings_are_folded_once_not_row_by_row(spark):
    """Facts meet dimensions and rules by the bytes of their spelling, and no sort sees them."""
    odd = [("e5", None, "C1", "X", 100, "bogof", 1, 1), ("e6", "s3", "Ć1", "x", 200, "no rule", 3, 4), ("e7", "S9", "C1", "X", 100, "bogof", 1, 1)]
    stores = [*STORES, ("s1", "kÖln"), ("ß", None)]
    t = collate_tables(make_tables(spark, [*FACTS, *odd, FACTS[0]], stores, CAMPAIGNS, PRODUCTS))
    rows = byte_strings(sales_summary(t)).select("city", "promo_type", "quantity_sold_before_promo", "ISU").collect()
    assert sorted(map(tuple, rows), key=repr) == [("Bonn", "no rule", 3, 1), ("Bonn", None, 4, 2), ("KOLN", "500 CASHBACK", 5, 3), ("Köln", "BÓGOF", 42, 126)]
    plan = sales_summary(t)._jdf.queryExecution().optimizedPlan().toString()
    inner, outer = (sum(line.lstrip(" :+-").startswith(w) for line in plan.splitlines()) for w in ("Join", "Aggregate"))
    assert "_bytes" in plan and inner == 4 and outer == 2
