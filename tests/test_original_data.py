"""A whole load, from a dump and CSV files to the reports, on the test suite's own small dump.

Set LIFTWISE_ORIGINAL_DATA to a folder with another dump (``*.sql``) and its three dimension
CSVs to run the ingest checks on those as well.
"""

from __future__ import annotations

import glob
import os

import pytest

from liftwise.operators.star import broadcast_small_dims
from liftwise.plans import reports as R
from liftwise.sources.checks import check_keys
from liftwise.sources.csv import read_campaigns_csv, read_products_csv, read_stores_csv
from liftwise.sources.sqldump import read_dump_tables
from liftwise.tables import Tables
from tests.conftest import DATA

FOLDERS = [DATA, *filter(None, [os.environ.get("LIFTWISE_ORIGINAL_DATA")])]


def one(folder: str, pattern: str) -> str:
    (path,) = glob.glob(os.path.join(folder, pattern))
    return path


@pytest.mark.parametrize("folder", FOLDERS)
def test_ingest_and_keys(spark, folder):
    t = broadcast_small_dims(Tables(**read_dump_tables(spark, one(folder, "*.sql"))))
    readers = {"campaigns": read_campaigns_csv, "products": read_products_csv, "stores": read_stores_csv}
    for name, read in readers.items():
        from_csv = set(map(tuple, read(spark, one(folder, f"*{name}*.csv")).collect()))
        assert from_csv <= set(map(tuple, getattr(t, name).collect())), name
    assert t.fact.count() > 0
    assert check_keys(t).filter("violations > 0").count() == 0


def test_reports_of_the_small_dump(spark):
    t = Tables(**read_dump_tables(spark, one(DATA, "*.sql")))
    assert [(r.city, r.total_stores) for r in R.store_count_by_city(t).collect()] == [("North", 2), ("South", 1)]
    units = {r.promo_type: (r.quantity_before_promo, r.quantity_after_promo) for r in R.promo_isu(t).collect()}
    assert units == {"BOGOF": (10, 40), "500 Cashback": (5, 8), "50% OFF": (10, 15), "33% OFF": (4, 6), None: (7, 9)}
