"""Declared types at load, with rejected rows kept; definitions read from CREATE TABLE text."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from liftwise.schemas import FACT, PRODUCTS
from liftwise.sources.ddl import drift, parse_create_table, read_definitions
from liftwise.sources.rejects import reason_counts, split_rows

TEXT = ", ".join(f"`{n}` string" for n in FACT.names)
GOOD = ("e1", "S1", "C1", "X", "100", "BOGOF", "1", "2")


def changed(**values):
    return tuple(values.get(n, v) for n, v in zip(FACT.names, GOOD))


ROWS = [
    GOOD,
    changed(promo_type=None),
    changed(event_id=None, base_price="ten"),
    changed(event_id="é" * 10),
    changed(event_id="é" * 11),
    changed(store_id="S" * 11, quantity_sold_after_promo=None),
    changed(base_price="99999999999"),
    changed(promo_type="x" * 51),
]


def test_rejected_rows_and_reasons(spark):
    df = spark.createDataFrame(ROWS, TEXT).repartition(3)
    good, bad = split_rows(df, "fact")
    assert good.schema.names == FACT.names and [f.dataType for f in good.schema.fields] == [f.dataType for f in FACT.fields]
    assert good.count() + bad.count() == len(ROWS)
    assert sorted(r.event_id for r in good.collect()) == ["e1", "e1", "é" * 10]
    reasons = {tuple(r.reasons) for r in bad.collect()}
    assert reasons == {
        ("event_id: null", "base_price: not int"),
        ("event_id: over 10 characters",),
        ("store_id: over 10 characters", "quantity_sold_after_promo: null"),
        ("base_price: not int",),
        ("promo_type: over 50 characters",),
    }
    assert {r.base_price for r in bad.collect()} >= {"ten", "99999999999"}  # as they were
    counts = {r.reason: r.n for r in reason_counts(df, "fact").collect()}
    assert counts["accepted"] == 3 and sum(counts.values()) == len(ROWS)


def test_bracketed_names_typed_input_and_no_rows(spark):
    df = spark.createDataFrame([GOOD], TEXT).withColumnsRenamed({"quantity_sold_before_promo": "quantity_sold(before_promo)", "quantity_sold_after_promo": "quantity_sold(after_promo)"})
    assert [tuple(r) for r in split_rows(df, "fact")[0].collect()] == [("e1", "S1", "C1", "X", 100, "BOGOF", 1, 2)]
    typed = spark.createDataFrame([("X", None, "A")], T.StructType([T.StructField(f.name, f.dataType) for f in PRODUCTS.fields]))
    assert [r.reasons for r in split_rows(typed, "products")[1].collect()] == [["product_name: null"]]
    assert reason_counts(typed.filter("false"), "products").count() == 0


DDL = """-- a dump; with a comment: CREATE TABLE no (a int);
/*!40101 SET NAMES utf8mb4 */;
DROP TABLE IF EXISTS `dim_products`;
CREATE TABLE `dim_products` (
  `product_code` varchar(10) NOT NULL,
  `product_name` varchar(255) NOT NULL COMMENT 'a, (b); NOT NULL',
  `category` varchar(50) NOT NULL,
  PRIMARY KEY (`product_code`),
  KEY `by_name` (`product_name`(20),`category`)
) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4 COLLATE=utf8mb4_0900_ai_ci;
INSERT INTO `dim_products` VALUES ('P1','; CREATE TABLE `trap` (x int);','c');
create table if not exists shop.fact_events (event_id varchar(10) not null, `store_id` varchar(10) NOT NULL, `campaign_id` varchar(20) NOT NULL,
  `product_code` varchar(10) NOT NULL, `base_price` int NOT NULL, `promo_type` varchar(50) DEFAULT NULL,
  `quantity_sold(before_promo)` int NOT NULL, `quantity_sold(after_promo)` int NOT NULL);
CREATE TABLE `other` (`a` decimal(12,3) DEFAULT '1.5', `b` bigint unsigned, `c` date NOT NULL, `d` int PRIMARY KEY, `e` text);
"""


@pytest.mark.parametrize("block", [None, 150])
def test_definitions_of_a_dump(spark, tmp_path, block):
    (tmp_path / "d.sql").write_text(DDL)
    found = read_definitions(spark, str(tmp_path / "d.sql"), block)
    assert set(found) == {"dim_products", "fact_events", "other"}
    assert found["dim_products"].schema == PRODUCTS and found["fact_events"].schema == FACT
    assert found["dim_products"].primary_key == ("product_code",) and found["dim_products"].collation == "utf8mb4_0900_ai_ci"
    assert found["dim_products"].lengths == {"product_code": 10, "product_name": 255, "category": 50}
    assert drift(found["dim_products"], "products") == [] and drift(found["fact_events"], "fact") == []
    other = found["other"]
    assert [f.dataType.simpleString() for f in other.schema.fields] == ["decimal(12,3)", "bigint", "date", "int", "string"]
    assert [f.nullable for f in other.schema.fields] == [True, True, False, False, True] and other.primary_key == ("d",)


def test_drift_is_named():
    text = "CREATE TABLE dim_products (product_code varchar(12) NOT NULL, category int, product_name varchar(255) NOT NULL)"
    assert drift(parse_create_table(text), "products") == [
        "columns ['product_code', 'category', 'product_name'], declared ['product_code', 'product_name', 'category']",
        "product_code: length 12, declared 10",
        "category: int, declared string",
        "category: NULL, declared otherwise",
        "category: length None, declared 50",
        "primary key (), declared ('product_code',)",
    ]


def test_unreadable_definitions_are_errors():
    for text in ("CREATE VIEW v AS SELECT 1", "CREATE TABLE t (a geometry)", "CREATE TABLE t (a int"):
        with pytest.raises(ValueError):
            parse_create_table(text)
