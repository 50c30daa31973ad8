"""CSV and dump ingest, Parquet load and key checks."""

from __future__ import annotations

import glob
import os
import tempfile
from datetime import date
from decimal import Decimal

import pytest

from liftwise.operators.star import broadcast_small_dims, materialize_summary, summarise
from liftwise.plans import reports as R
from liftwise.schemas import FACT, STORES
from liftwise.session import ensure_checkpoint_dir
from liftwise.sources.checks import check_keys, verify_keys
from liftwise.sources.csv import read_campaigns_csv, read_products_csv, read_stores_csv
from liftwise.sources.parquet import mark_verified, read_tables, write_tables
from liftwise.sources.sqldump import parse_insert_lines, read_dump_tables
from liftwise.tables import Tables
from tests.conftest import DATA, FACT_ROWS, make_tables


def test_campaign_csv_day_first_dates(spark):
    rows = read_campaigns_csv(spark, f"{DATA}/campaigns.csv").collect()
    assert [tuple(r) for r in rows] == [
        ("C1", "Alpha", date(2023, 11, 12), date(2023, 11, 18)),
        ("C2", "Beta", date(2024, 1, 10), date(2024, 1, 16)),
    ]


def test_product_and_store_csv(spark):
    products = [tuple(r) for r in read_products_csv(spark, f"{DATA}/products.csv").collect()]
    assert products[0] == ("X", "Widget (1KG)", "Home & Kitchen")
    assert products[1] == ("Y", "Gadget, large", "B")
    stores = [tuple(r) for r in read_stores_csv(spark, f"{DATA}/stores.csv").collect()]
    assert stores == [("S1", "North"), ("S2", "North"), ("S3", "South")]


def test_dump_rows(spark):
    t = read_dump_tables(spark, f"{DATA}/mini_dump.sql")
    fact = sorted(tuple(r) for r in t["fact"].collect())
    assert len(fact) == 5
    assert ("7.5E+11", "S2", "C1", "Y", 3000, "500 Cashback", 5, 8) in fact
    assert ("e6", "S3", "C2", "X", 100, None, 7, 9) in fact
    assert t["fact"].columns[-2:] == ["quantity_sold_before_promo", "quantity_sold_after_promo"]
    products = {r.product_code: r.product_name for r in t["products"].collect()}
    assert products == {"X": "Widget (1KG)", "Y": "Gadget, large", "Z": "Widget (1KG)", "Q": "Bob's (big) box"}
    camps = [tuple(r) for r in t["campaigns"].orderBy("campaign_id").collect()]
    assert camps[1] == ("C2", "Beta", date(2024, 1, 10), date(2024, 1, 16))
    assert t["stores"].count() == 3


def test_parquet_round_trip_partitions_fact_by_campaign(spark, hand):
    path = tempfile.mkdtemp(prefix="liftwise-test-")
    write_tables(hand, path, records_per_file=2)
    (fact,) = glob.glob(f"{path}/*/fact")
    assert {"campaign_id=C1", "campaign_id=C2"} <= set(os.listdir(fact))
    back = read_tables(spark, path)
    cols = hand.fact.columns
    assert sorted(map(tuple, back.fact.select(cols).collect()), key=repr) == sorted(map(tuple, FACT_ROWS), key=repr)
    assert back.stores.count() == 3


def _checks(t: Tables) -> dict:
    return {(r.check_name, r.table_name, r.column_name): r.violations for r in check_keys(t).collect()}


def test_check_keys_clean(hand):
    checks = _checks(hand)
    assert len(checks) == 22 and all(v == 0 for v in checks.values())


def test_check_keys_finds_violations(spark):
    t = make_tables(
        spark,
        FACT_ROWS + [("e9", "S9", "C1", "X", 100, None, 1, 1), ("e10", None, "C1", "Q", 100, None, 1, 1)],
        stores=[("S1", "North"), ("S1", "East"), ("S2", "North"), ("S3", "South")],
    )
    checks = _checks(t)
    assert checks[("duplicate_key", "stores", "store_id")] == 1
    assert checks[("null", "fact", "store_id")] == 1
    assert ("null", "fact", "promo_type") not in checks  # promo_type may be NULL
    assert checks[("orphan", "fact", "store_id")] == 2
    assert checks[("orphan", "fact", "product_code")] == 1


def test_verify_keys(spark, hand):
    from liftwise.sources.checks import verify_keys

    assert verify_keys(hand).keys_verified
    orphan = make_tables(spark, FACT_ROWS + [("e9", "S9", "C1", "X", 100, None, 1, 1)])
    assert not verify_keys(orphan).keys_verified
    dup = make_tables(spark, FACT_ROWS, products=[("X", "Widget", "A"), ("X", "Other", "A"), ("Y", "Gadget", "B"), ("Z", "Widget", "A")])
    assert not verify_keys(dup).keys_verified


def test_legacy_column_names_are_normalised(spark):
    from liftwise.schemas import FACT, conform

    df = spark.createDataFrame(
        [("e1", "S1", "C1", "X", "100", "BOGOF", "10", "20")],
        "event_id string, store_id string, campaign_id string, product_code string, base_price string, "
        "promo_type string, `quantity_sold(before_promo)` string, `quantity_sold(after_promo)` string",
    )
    out = conform(df, FACT)
    assert out.columns == [f.name for f in FACT.fields]
    assert tuple(out.first()) == ("e1", "S1", "C1", "X", 100, "BOGOF", 10, 20)


def test_promo_folding_maps_to_rule_names(spark):
    from pyspark.sql import functions as F

    from liftwise.schemas import normalise_promo_type

    df = spark.createDataFrame([(" bogof",), ("500 CASHBACK",), ("25% off ",), ("Loyalty",), (None,)], "p string")
    got = [r.q for r in df.select(normalise_promo_type(F.col("p")).alias("q")).collect()]
    assert got == ["BOGOF", "500 Cashback", "25% OFF", "Loyalty", None]


def test_dump_tuple_boundaries_inside_quotes(spark, tmp_path):
    from liftwise.schemas import PRODUCTS
    from liftwise.sources.sqldump import read_insert_rows

    text = (
        "INSERT INTO `dim_products` VALUES ('A','Pack (2),(3)','x'),('B','It\\'s \\\\ ok','y'),"
        "('C',NULL,'z'),('D','','w');\n"
        "INSERT INTO `other_table` VALUES ('E','not me','v');\n"
        "INSERT INTO `dim_products` VALUES ('F','last','u');\n"
    )
    path = tmp_path / "dump.sql"
    path.write_text(text)
    rows = {r.product_code: (r.product_name, r.category) for r in read_insert_rows(spark, str(path), "dim_products", PRODUCTS).collect()}
    assert rows["A"] == ("Pack (2),(3)", "x")
    assert rows["B"] == ("It's \\ ok", "y")
    assert rows["C"] == (None, "z")
    assert rows["F"] == ("last", "u")
    assert set(rows) == {"A", "B", "C", "D", "F"}


STORE_DDL = "value string"


def _stores_of(spark, *texts):
    lines = spark.createDataFrame([(t,) for t in texts], STORE_DDL)
    return [tuple(r) for r in parse_insert_lines(lines, "dim_stores", STORES).collect()]


@pytest.mark.parametrize(
    "text, rows",
    [
        ("INSERT INTO `dim_stores` VALUES ('a','b')", [("a", "b")]),
        ("insert into dim_stores values('a','b') , ('c','d');", [("a", "b"), ("c", "d")]),
        ("INSERT INTO `dim_stores` (`city`, `store_id`) VALUES ('b','a')", [("a", "b")]),
        ("INSERT INTO dim_stores(city) VALUES ('b')", [(None, "b")]),
        ("INSERT IGNORE INTO shop.dim_stores VALUES\n('a','b'),\n ('c','d')", [("a", "b"), ("c", "d")]),
        ("UNLOCK TABLES;\r\nINSERT INTO `dim_stores` VALUES ('a','b');\r\nINSERT INTO dim_stores VALUE ('c','d');\r\nLOCK x (1);\r\n", [("a", "b"), ("c", "d")]),
        (r"INSERT INTO dim_stores VALUES ('NULL',NULL),('it''s','a\\b\'c\nd, (e); f')", [("NULL", None), ("it's", "a\\b'c\nd, (e); f")]),
        ("INSERT INTO dim_stores VALUES ('','  ')", [("", "  ")]),
        ("INSERT INTO `dim_stores_old` VALUES ('a','b')", []),
        ("INSERT INTO other SELECT * FROM dim_stores", []),
        ("DELETE FROM dim_stores", []),
    ],
)
def test_insert_forms(spark, text, rows):
    assert _stores_of(spark, text) == rows


@pytest.mark.parametrize(
    "text, message",
    [
        ("INSERT INTO dim_stores SELECT * FROM x", "not a list of value tuples"),
        ("INSERT INTO dim_stores VALUES ('a','b'),('c',", "not a list of value tuples"),
        ("INSERT INTO dim_stores VALUES ('a','b') ON DUPLICATE KEY UPDATE city = 1", "not a list of value tuples"),
        ("INSERT INTO dim_stores VALUES ('a')", "wrong length"),
        ("INSERT INTO dim_stores (store_id) VALUES ('a','b')", "wrong length"),
    ],
)
def test_unread_inserts_are_errors(spark, text, message):
    with pytest.raises(Exception, match=message):
        _stores_of(spark, text)


def test_malformed_values_are_errors(spark):
    lines = spark.createDataFrame([("INSERT INTO fact_events VALUES ('e','s','c','p','abc',NULL,1,2)",)], STORE_DDL)
    with pytest.raises(Exception, match="not a int for fact_events.base_price"):
        parse_insert_lines(lines, "fact_events", FACT).collect()


def test_csv_header_must_name_the_columns(spark):
    path = tempfile.mkdtemp(prefix="liftwise-csv-") + "/stores.csv"
    with open(path, "w") as f:
        f.write("city,store_id\nNorth,S1\n")
    with pytest.raises(Exception):
        read_stores_csv(spark, path).collect()


def test_load_keeps_ids_as_they_are(spark):
    facts = [("e1", "S1", i, "X", 100, "BOGOF", 10, 20) for i in ("01", "1", "C2", None)]
    t = make_tables(spark, facts, campaigns=[(i, n, date(2024, 1, 1), date(2024, 1, 2)) for i, n in [("01", "a"), ("1", "b"), ("C2", "")]])
    path = tempfile.mkdtemp(prefix="liftwise-test-")
    write_tables(t, path)
    back = read_tables(spark, path)
    assert sorted((r.campaign_id for r in back.fact.collect()), key=str) == ["01", "1", "C2", None]
    assert {(r.campaign_name, r.revenue_before_million) for r in R.campaign_revenue(back).collect()} == {(n, "0.00M") for n in ("a", "b", "")}
    shared = materialize_summary(back, path + "/view")
    assert {r.campaign_name for r in R.campaign_revenue(shared).collect()} == {"a", "b", ""}
    empty = make_tables(spark, [("e1", "S1", "", "X", 100, "BOGOF", 10, 20)])
    with pytest.raises(Exception, match="empty campaign_id"):
        write_tables(empty, path)
    assert read_tables(spark, path).fact.count() == 4  # the failed load left the last one in use


def test_a_check_is_recorded_for_its_version_only(spark, hand):
    path = tempfile.mkdtemp(prefix="liftwise-test-")
    write_tables(hand, path)
    assert not read_tables(spark, path).keys_verified
    assert mark_verified(spark, path).keys_verified and read_tables(spark, path).keys_verified
    write_tables(make_tables(spark, FACT_ROWS + [("e9", "S9", "C1", "X", 100, None, 1, 1)]), path)
    assert not read_tables(spark, path).keys_verified and not mark_verified(spark, path).keys_verified


def test_marks_do_not_outlive_their_data(spark, hand):
    verified = verify_keys(hand)
    orphan = make_tables(spark, [("e1", "S9", "C1", "X", 100, "BOGOF", 10, 500), ("e2", "S1", "C1", "X", 100, "BOGOF", 10, 5)]).fact
    assert {r.quantity_after_promo for r in R.promo_isu(verified.with_fact(orphan)).collect()} == {10}
    shared = materialize_summary(hand, tempfile.mkdtemp(prefix="liftwise-test-") + "/view")
    assert R.promo_isu(shared.with_fact(hand.fact.limit(0))).count() == 0
    assert not verified.with_campaigns(hand.campaigns).keys_verified


def test_sums_beyond_bigint_cents(spark):
    """Group sums over 9.2e18 cents are exact, from the fact and from the shared view."""
    facts = [(f"e{i}", "S1", "C1", "X", 2_000_000_000, "25% OFF", 20_000_000, 10_000_001) for i in range(7)]
    t = make_tables(spark, facts)
    before, after = 7 * Decimal(2_000_000_000) * 20_000_000, 7 * Decimal(2_000_000_000) * 10_000_001 * Decimal("0.75")
    for tables in (t, materialize_summary(t, tempfile.mkdtemp(prefix="liftwise-test-") + "/view"), broadcast_small_dims(t, max_bytes=-1)):
        (row,) = summarise(tables, ["campaign_name"]).collect()
        assert (row.revenue_before_promo, row.revenue_after_promo, row.IR) == (before, after, after - before)
    (store,) = R.store_top_ir(t).collect()
    assert store.incremental_revenue_mln == round(7 * Decimal(2_000_000_000) * (10_000_001 - 20_000_000) / 1_000_000, 2)


def test_no_local_scratch_on_a_cluster():
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session(spark_master="spark://host:7077"))
    shared = Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "/shared/x"})
    assert ensure_checkpoint_dir(shared) == "/shared/x"
