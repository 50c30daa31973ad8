"""Shared fixtures: a local session and the hand-worked rows (FIXTURES.md section 4)."""

from __future__ import annotations

import os
import sys
from datetime import date

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from liftwise.schemas import CAMPAIGNS, FACT, PRODUCTS, STORES  # noqa: E402
from liftwise.session import local_session  # noqa: E402
from liftwise.tables import Tables  # noqa: E402

DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"

STORE_ROWS = [("S1", "North"), ("S2", "North"), ("S3", "South")]
CAMPAIGN_ROWS = [("C1", "Alpha", date(2023, 11, 12), date(2023, 11, 18)), ("C2", "Beta", date(2024, 1, 10), date(2024, 1, 16))]
PRODUCT_ROWS = [("X", "Widget", "A"), ("Y", "Gadget", "B"), ("Z", "Widget", "A")]

# The eight hand-worked facts: event, store, campaign, product, price, promo, before, after.
FACT_ROWS = [
    ("e1", "S1", "C1", "X", 100, "BOGOF", 10, 20),
    ("e2", "S2", "C1", "Y", 3000, "500 Cashback", 5, 8),
    ("e3", "S3", "C1", "X", 100, "50% OFF", 10, 15),
    ("e4", "S1", "C2", "Y", 3000, "33% OFF", 4, 6),
    ("e5", "S2", "C2", "Z", 101, "25% OFF", 8, 4),
    ("e6", "S3", "C2", "X", 100, None, 7, 9),
    ("e7", "S3", "C2", "Y", 400, "500 Cashback", 2, 3),
    ("e8", "S3", "C2", "Y", 600, "bogof", 0, 5),
]


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4, app="liftwise-tests")


def nullable(schema: T.StructType) -> T.StructType:
    """As files are read: every column nullable, so checks can see NULLs."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def make_tables(spark, fact_rows, stores=STORE_ROWS, campaigns=CAMPAIGN_ROWS, products=PRODUCT_ROWS) -> Tables:
    return Tables(
        fact=spark.createDataFrame(fact_rows, nullable(FACT)),
        stores=spark.createDataFrame(stores, nullable(STORES)),
        campaigns=spark.createDataFrame(campaigns, nullable(CAMPAIGNS)),
        products=spark.createDataFrame(products, nullable(PRODUCTS)),
    )


@pytest.fixture(scope="session")
def hand(spark) -> Tables:
    return make_tables(spark, FACT_ROWS)


@pytest.fixture(scope="session")
def small(spark) -> Tables:
    from liftwise.sources.fixture import from_testdata

    return from_testdata(spark, SF_SMALL)
