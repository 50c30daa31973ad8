"""The tables in Spark's catalog: bucketed for shuffled joins (S10), with a view that outlives its session.

A fact and a dimension bucketed alike on their key meet bucket by bucket: where the
dimension is past the broadcast bound, neither the join nor a grouping by that key moves
the fact.  The view is stored as SQL text over catalog tables, so any session of the
catalog can query it; what it names are tables, not DataFrames of the session that made it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftwise.functions.metrics import PROMO_RULES
from liftwise.operators.star import DEFAULT_BROADCAST_MAX_BYTES, DIM_KEYS, broadcast_small_dims
from liftwise.plans.views import VIEW_NAMES
from liftwise.tables import Tables


def save_warehouse(t: Tables, database: str, location: str, bucketed_on: str = "stores", buckets: int | None = None) -> None:
    """Write the four tables into ``database`` (made at ``location``, a shared folder), then its view.

    The fact and the dimension ``bucketed_on`` are bucketed and sorted by that dimension's
    key; ``buckets`` (default: the shuffle partitions) should make buckets of a few hundred
    MB.  Rows are dealt to their buckets by one shuffle, so a bucket is one file.
    """
    spark = t.fact.sparkSession
    key = DIM_KEYS[bucketed_on]
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{location}'")
    for name, table in VIEW_NAMES.items():
        df = getattr(t, name)
        target = f"`{database}`.`{table}`"
        if name in ("fact", bucketed_on):
            df.repartition(n, key).write.bucketBy(n, key).sortBy(key).mode("overwrite").option("path", f"{location}/{table}").saveAsTable(target)
        else:
            df.write.mode("overwrite").option("path", f"{location}/{table}").saveAsTable(target)
    create_view(spark, database)


def warehouse_tables(spark: SparkSession, database: str, broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES) -> Tables:
    """The tables of ``database``; small dimensions are broadcast, others joined by their buckets."""
    frames = {name: spark.table(f"`{database}`.`{table}`") for name, table in VIEW_NAMES.items()}
    return broadcast_small_dims(Tables(**frames), broadcast_max_bytes)


def view_sql(database: str) -> str:
    """The ``sales_summary`` view as SQL over the tables of ``database``; money in whole cents until the last step."""
    units = " ".join(f"WHEN promo_type = '{name}' THEN CAST(quantity_sold_after_promo AS BIGINT) * {u}" for name, (u, _, _) in PROMO_RULES.items() if u != 1)
    cents = " ".join(
        f"WHEN promo_type = '{name}' THEN (CAST(base_price AS BIGINT) * {int(factor * 100)} - {off * 100}) * quantity_sold_after_promo * {u}" for name, (u, factor, off) in PROMO_RULES.items()
    )
    before = "SUM(CAST(CAST(base_price AS BIGINT) * quantity_sold_before_promo * 100 AS DECIMAL(28,0)))"
    after = f"SUM(CAST(CASE {cents} ELSE 0 END AS DECIMAL(28,0)))"
    units_after = f"SUM(CASE {units} ELSE CAST(quantity_sold_after_promo AS BIGINT) END)"
    money = "CAST({} / 100 AS DECIMAL(28,2))"
    return f"""
        SELECT campaign_name, city, product_name, category, promo_type,
               SUM(CAST(quantity_sold_before_promo AS BIGINT)) AS quantity_sold_before_promo,
               {units_after} AS quantity_sold_after_promo,
               {money.format(before)} AS revenue_before_promo,
               {money.format(after)} AS revenue_after_promo,
               {units_after} - SUM(CAST(quantity_sold_before_promo AS BIGINT)) AS ISU,
               {money.format(f"({after} - {before})")} AS IR
        FROM `{database}`.fact_events JOIN `{database}`.dim_stores USING (store_id)
             JOIN `{database}`.dim_campaigns USING (campaign_id) JOIN `{database}`.dim_products USING (product_code)
        GROUP BY campaign_name, city, product_name, category, promo_type"""


def create_view(spark: SparkSession, database: str) -> None:
    """Create or replace the persistent view ``database.sales_summary``."""
    spark.sql(f"CREATE OR REPLACE VIEW `{database}`.sales_summary AS {view_sql(database)}")


def drop_warehouse(spark: SparkSession, database: str) -> None:
    """Forget the database; its files stay where they were written."""
    spark.sql(f"DROP VIEW IF EXISTS `{database}`.sales_summary")
    for table in VIEW_NAMES.values():
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{table}`")
    spark.sql(f"DROP DATABASE IF EXISTS `{database}`")


def text_millions(total: str, suffix: str = "M") -> str:
    """SQL for money in millions as text with two places."""
    return f"CONCAT(CAST(ROUND(CAST({total} AS DECIMAL(28,2)) / 1000000, 2) AS DECIMAL(18,2)), '{suffix}')"


def text_percent(part: str, whole: str) -> str:
    """SQL for a percentage with two places; NULL where ``whole`` is 0."""
    return f"CAST(ROUND(CAST({part} AS DECIMAL(28,2)) * 100 / NULLIF(CAST({whole} AS DECIMAL(28,2)), 0), 2) AS DOUBLE)"


# Reports of the original in SQL over the stored view, in Spark's dialect.
STORED_REPORTS = {
    "stored_campaign_revenue": f"""
        SELECT campaign_name, {text_millions("SUM(revenue_before_promo)")} AS revenue_before_million,
               {text_millions("SUM(revenue_after_promo)")} AS revenue_after_million,
               {text_millions("SUM(IR)")} AS IR, {text_percent("SUM(IR)", "SUM(revenue_before_promo)")} AS `IR%`
        FROM {{database}}.sales_summary GROUP BY campaign_name""",
    "stored_promo_ir": f"""
        SELECT promo_type, {text_millions("SUM(revenue_before_promo)", " M")} AS revenue_before_promo,
               {text_millions("SUM(revenue_after_promo)", " M")} AS revenue_after_promo,
               {text_millions("SUM(IR)", " M")} AS incremental_revenue, {text_percent("SUM(IR)", "SUM(revenue_before_promo)")} AS `IR%`
        FROM {{database}}.sales_summary GROUP BY promo_type ORDER BY `IR%` DESC""",
    "stored_category_ir": f"""
        SELECT category, {text_millions("SUM(revenue_before_promo)")} AS revenue_before_promo,
               {text_millions("SUM(revenue_after_promo)")} AS revenue_after_promo,
               {text_millions("SUM(IR)")} AS incremental_revenue, {text_percent("SUM(IR)", "SUM(revenue_before_promo)")} AS `IR%`
        FROM {{database}}.sales_summary GROUP BY category""",
}


def stored_report(spark: SparkSession, database: str, name: str) -> DataFrame:
    """A report of ``STORED_REPORTS`` over the stored view."""
    return spark.sql(STORED_REPORTS[name].format(database=f"`{database}`"))

