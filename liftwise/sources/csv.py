"""Dimension tables from CSV files with a header line.

Schemas are given, never inferred, and the header line must name their columns in order
(``enforceSchema=false``).  Campaign dates are day-first (``dd-MM-yyyy``) in
these files (T18).  ``mode='FAILFAST'`` makes a malformed line an error instead of a
row of NULLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from liftwise.schemas import CAMPAIGNS, PRODUCTS, STORES

# The date format of the campaign CSV (day first).
CAMPAIGN_DATE_FORMAT = "dd-MM-yyyy"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST", **options) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", mode)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.csv(path)


def read_campaigns_csv(spark: SparkSession, path: str, date_format: str = CAMPAIGN_DATE_FORMAT) -> DataFrame:
    """campaign_id, campaign_name, start_date, end_date."""
    return read_csv(spark, path, CAMPAIGNS, dateFormat=date_format)


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """product_code, product_name, category."""
    return read_csv(spark, path, PRODUCTS)


def read_stores_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: store_id, city."""
    return read_csv(spark, path, STORES)
