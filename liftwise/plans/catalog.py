"""Every registered query: the single-operator keys of the inventory plus the reports.

Each entry is a function of :class:`~liftwise.tables.Tables` returning a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from liftwise.functions import metrics as M
from liftwise.functions.collation import byte_strings, collate_tables, distinct
from liftwise.operators.ranking import Key, asc, desc, global_rank, ordered_ranks
from liftwise.operators.star import broadcast_small_dims, materialize_summary, sales_summary, star_join
from liftwise.plans import reports as R
from liftwise.plans.reports import REPORTS
from liftwise.plans.views import register_views
from liftwise.schemas import CAMPAIGNS, FACT, PRODUCTS, STORES
from liftwise.session import scratch_dir
from liftwise.sources.checks import check_keys, verify_keys
from liftwise.sources.csv import CAMPAIGN_DATE_FORMAT, read_campaigns_csv, read_products_csv, read_stores_csv
from liftwise.sources.parquet import append_facts, read_tables, write_summary, write_tables
from liftwise.sources.rejects import reason_counts
from liftwise.sources.sqldump import parse_insert_lines, read_insert_rows
from liftwise.sources.warehouse import STORED_REPORTS, save_warehouse, stored_report, warehouse_tables
from liftwise.tables import Tables

FACT_COLUMNS = [
    "event_id",
    "store_id",
    "campaign_id",
    "product_code",
    "base_price",
    "promo_type",
    "quantity_sold_before_promo",
    "quantity_sold_after_promo",
]


def scan_fact(t: Tables) -> DataFrame:
    """The fact table with its declared columns."""
    return t.fact.select(*FACT_COLUMNS)


def project(t: Tables) -> DataFrame:
    """A projection with renamed columns."""
    return t.fact.select(
        "event_id",
        "store_id",
        "product_code",
        F.col("base_price").alias("unit_price"),
        F.col("quantity_sold_before_promo").alias("units_before"),
    )


def join_fact_store(t: Tables) -> DataFrame:
    """J1."""
    return star_join(t, ["stores"]).select(*FACT_COLUMNS, "city")


def join_fact_campaign(t: Tables) -> DataFrame:
    """J2."""
    return star_join(t, ["campaigns"]).select(*FACT_COLUMNS, "campaign_name")


def join_fact_product(t: Tables) -> DataFrame:
    """J3."""
    return star_join(t, ["products"]).select(*FACT_COLUMNS, "product_name", "category")


def star_join_rows(t: Tables) -> DataFrame:
    """The fact with all three dimensions."""
    return star_join(t).select(*FACT_COLUMNS, "city", "campaign_name", "product_name", "category")


def promo_units_rows(t: Tables) -> DataFrame:
    """M1, F1: units after the promotion, BOGOF counted twice, per fact row."""
    return t.fact.select(
        "event_id",
        "promo_type",
        "quantity_sold_after_promo",
        M.adjusted_units_after("promo_type", "quantity_sold_after_promo").alias("units_after_adjusted"),
    )


def promo_revenue_rows(t: Tables) -> DataFrame:
    """M2, F2: revenue after the promotion at the discounted price, per fact row."""
    return t.fact.select(
        "event_id",
        "promo_type",
        "base_price",
        "quantity_sold_after_promo",
        M.net_revenue_after("promo_type", "base_price", "quantity_sold_after_promo").alias("revenue_after_promo"),
    )


def sales_summary_eager(t: Tables) -> DataFrame:
    """V0 with the fact grouped by the joined keys first, as for dimensions that are not broadcast."""
    return sales_summary(t, eager=True)


def city_ir_rank_distributed(t: Tables) -> DataFrame:
    """Q6 ranked in three ranges."""
    return R.city_ir_rank(t, ranges=3)


def category_isu_diwali_distributed(t: Tables) -> DataFrame:
    """Q4a ranked in three ranges."""
    return R.category_isu(t, R.CAMPAIGN_Q4A, ranges=3)


def campaign_revenue_keys_verified(t: Tables) -> DataFrame:
    """Q3 after ``verify_keys``: only the campaign dimension is joined."""
    return R.campaign_revenue(verify_keys(t))


def promo_isu_keys_verified(t: Tables) -> DataFrame:
    """Q9 after ``verify_keys``: no dimension is joined."""
    return R.promo_isu(verify_keys(t))


def category_ir_keys_verified(t: Tables) -> DataFrame:
    """Q12 after ``verify_keys``: only the product dimension is joined."""
    return R.category_ir(verify_keys(t))


def _unhinted(t: Tables) -> Tables:
    """``t`` as if every dimension were past the broadcast bound."""
    return broadcast_small_dims(t, max_bytes=-1)


def store_top_ir_shuffled(t: Tables) -> DataFrame:
    """Q7 with a dimension past the broadcast bound."""
    return R.store_top_ir(_unhinted(t))


def campaign_top_products_shuffled(t: Tables) -> DataFrame:
    """Q17 with dimensions past the broadcast bound."""
    return R.campaign_top_products(_unhinted(t))


def campaign_revenue_shared_view(t: Tables) -> DataFrame:
    """Q3 from the view's sums, written once to the shared folder."""
    return R.campaign_revenue(materialize_summary(t, scratch_dir(t.fact.sparkSession, "sales-summary")))


def _placed(df: DataFrame, order: list[Key]) -> DataFrame:
    """The rows with their place in the report's order, by which it can be checked."""
    return ordered_ranks(df, order, {"place": "row_number"})


def store_count_by_city_order(t: Tables) -> DataFrame:
    """O1."""
    return _placed(R.store_count_by_city(t), [desc("total_stores"), asc("city")])


def category_isu_order(t: Tables) -> DataFrame:
    """O3."""
    return _placed(R.category_isu_report(t), [desc("incremental_sold_units"), asc("category")])


def promo_isu_order(t: Tables) -> DataFrame:
    """O2."""
    return _placed(R.promo_isu(t), [desc("ISU%"), asc("promo_type")])


def promo_ir_isu_order(t: Tables) -> DataFrame:
    """O4."""
    return _placed(R.promo_ir_isu(t), [desc("IR"), desc("ISU"), asc("promo_type")])


def category_ir_text_order(t: Tables) -> DataFrame:
    """Q12 in the order of the formatted text."""
    return _placed(R.category_ir(t, text_order=True), [desc("incremental_revenue"), asc("category")])


def product_top_bottom_ir_text_order(t: Tables) -> DataFrame:
    """Q14 in the order of the formatted text."""
    return _placed(R.product_top_bottom_ir(t, text_order=True), [desc("IR"), asc("product_name"), asc("category")])


def _quoted(df: DataFrame, c: str) -> Column:
    text = F.col(c).cast("string")
    if not isinstance(df.schema[c].dataType, IntegralType):  # a whole number has nothing to escape
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))


def insert_lines(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Rows of ``df`` as INSERT statements of a dump, one for each row."""
    row = F.concat(F.lit(f"INSERT INTO `{table}` VALUES ("), F.concat_ws(",", *[_quoted(df, c) for c in columns]), F.lit(")"))
    return df.select(row.alias("value"))


def dump_rows(t: Tables) -> DataFrame:
    """The fact through INSERT text and back."""
    return parse_insert_lines(insert_lines(t.fact, "fact_events", FACT_COLUMNS), "fact_events", FACT)


def _write_statement(df: DataFrame, table: str, columns: list[str], path: str, line_end: str) -> None:
    """``df`` as dump files of one INSERT statement each: all tuples of a write task in one list."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    row = F.concat(F.lit("("), F.concat_ws(",", *[_quoted(df, c) for c in columns]), F.lit(")"))
    head = F.when(first, F.lit(f"INSERT INTO `{table}` VALUES ")).otherwise(F.lit(","))
    df.select(F.concat(head, row).alias("value")).write.option("lineSep", line_end).text(path)


def dump_file_rows(t: Tables) -> DataFrame:
    """The fact through dump files, each one statement without line ends, read by byte ranges of 64 KB."""
    path = scratch_dir(t.fact.sparkSession, "dump-file")
    _write_statement(t.fact, "fact_events", FACT_COLUMNS, path, " ")
    return read_insert_rows(t.fact.sparkSession, path, "fact_events", FACT, block_bytes=64 << 10)


def dump_dimensions(t: Tables) -> DataFrame:
    """Stores and products through INSERT text and back, as (table, key, a, b)."""
    stores = parse_insert_lines(insert_lines(t.stores, "dim_stores", STORES.names), "dim_stores", STORES)
    products = parse_insert_lines(insert_lines(t.products, "dim_products", PRODUCTS.names), "dim_products", PRODUCTS)
    none = F.lit(None).cast("string")
    return stores.select(F.lit("stores").alias("table"), F.col("store_id").alias("key"), F.col("city").alias("a"), none.alias("b")).unionByName(
        products.select(F.lit("products").alias("table"), F.col("product_code").alias("key"), F.col("product_name").alias("a"), F.col("category").alias("b"))
    )


def csv_dimensions(t: Tables) -> DataFrame:
    """Stores and products through CSV files on the shared folder and back."""
    spark, path = t.fact.sparkSession, scratch_dir(t.fact.sparkSession, "csv-dimensions")
    for name in ("stores", "products"):
        getattr(t, name).write.option("header", True).csv(f"{path}/{name}")
    none = F.lit(None).cast("string")
    stores, products = read_stores_csv(spark, f"{path}/stores"), read_products_csv(spark, f"{path}/products")
    return stores.select(F.lit("stores").alias("table"), F.col("store_id").alias("key"), F.col("city").alias("a"), none.alias("b")).unionByName(
        products.select(F.lit("products").alias("table"), F.col("product_code").alias("key"), F.col("product_name").alias("a"), F.col("category").alias("b"))
    )


def _odd_spellings(t: Tables) -> Tables:
    """The tables with keys, cities and promotions in several spellings, and the declared collation."""
    head = F.when(F.col("event_id") % 3 == 0, "STORE-").when(F.col("event_id") % 3 == 1, "störe-").otherwise("store-")
    promo = F.when(F.col("event_id") % 2 == 0, F.lower("promo_type")).otherwise(F.col("promo_type"))
    accents = F.translate("city", "AEIOU", "ÁÉÍÓÚ")
    city = F.when(F.col("store_id") % 3 == 0, F.col("city")).when(F.col("store_id") % 3 == 1, F.lower("city")).otherwise(accents)
    fact = t.fact.withColumns({"store_id": F.concat(head, F.col("store_id").cast("string")), "promo_type": promo})
    stores = t.stores.withColumns({"city": city, "store_id": F.concat(F.lit("Store-"), F.col("store_id").cast("string"))})
    return collate_tables(replace(t, fact=fact, stores=stores))


def collated_city_ir(t: Tables) -> DataFrame:
    """S6 under the declared collation: Q6, stores joined and cities grouped across spellings, ranked."""
    return byte_strings(R.city_ir_rank(_odd_spellings(t)))


def collated_promo_isu(t: Tables) -> DataFrame:
    """S6 under the declared collation: Q9, promotions matched and grouped across spellings."""
    return byte_strings(R.promo_isu(_odd_spellings(t)))


def collated_top_stores(t: Tables) -> DataFrame:
    """S6 under the declared collation: Q16, stores joined and ranked across spellings."""
    return byte_strings(R.campaign_top_stores(_odd_spellings(t)))


def collated_cities(t: Tables) -> DataFrame:
    """S6 under the declared collation: distinct cities."""
    return byte_strings(distinct(_odd_spellings(t).stores.select("city")))


def bulk_load_rows(t: Tables) -> DataFrame:
    """The fact through a load and back."""
    spark, path = t.fact.sparkSession, scratch_dir(t.fact.sparkSession, "bulk-load")
    write_tables(t, path)
    return read_tables(spark, path).fact.select(*FACT_COLUMNS)


def appended_view(t: Tables) -> DataFrame:
    """The view's stored sums, kept up by an append; facts loaded before are not read again."""
    spark, path = t.fact.sparkSession, scratch_dir(t.fact.sparkSession, "append")
    later = F.pmod("event_id", F.lit(3)) == 0
    write_tables(replace(t, fact=t.fact.filter(~later)), path)
    write_summary(spark, path)
    return sales_summary(append_facts(spark, path, t.fact.filter(later)))


def _warehouse(t: Tables) -> tuple[SparkSession, str]:
    """The tables saved to a database of their own, and a second session to query it."""
    spark = t.fact.sparkSession
    location = scratch_dir(spark, "warehouse")
    database = location.rstrip("/").rsplit("/", 1)[1].replace("-", "_")
    save_warehouse(t, database, location)
    return spark.newSession(), database


def store_top_ir_bucketed(t: Tables) -> DataFrame:
    """Q7 over bucketed tables with stores past the broadcast bound: the fact is not shuffled."""
    spark, database = _warehouse(t)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # of the second session: as if stores were large
    return R.store_top_ir(warehouse_tables(spark, database, broadcast_max_bytes=-1))


def stored_view(t: Tables) -> DataFrame:
    """The persistent view, read by another session than the one that made it."""
    spark, database = _warehouse(t)
    return spark.table(f"`{database}`.sales_summary")


def _stored(name: str) -> Callable[[Tables], DataFrame]:
    """A report in SQL over the persistent view."""

    def run(t: Tables) -> DataFrame:
        return stored_report(*_warehouse(t), name)

    run.__name__ = name
    return run


def rejected_rows(t: Tables) -> DataFrame:
    """Facts as text, some against the declaration, counted by what they break."""
    n = F.col("event_id")
    text = t.fact.select(*[F.col(c).cast("string").alias(c) for c in FACT_COLUMNS]).withColumns(
        {
            "store_id": F.when(F.pmod(n, F.lit(7)) == 0, F.concat(F.lit("a store too long "), "store_id")).otherwise(F.col("store_id")),
            "base_price": F.when(F.pmod(n, F.lit(11)) == 0, F.lit(None)).when(F.pmod(n, F.lit(13)) == 0, F.lit("12 or so")).otherwise(F.col("base_price")),
            "event_id": F.when(F.pmod(n, F.lit(17)) == 0, F.lit(None)).otherwise(F.substring("event_id", 1, 10)),
        }
    )
    return reason_counts(text, "fact")


def _store_campaigns(t: Tables) -> DataFrame:
    """A campaign for each store and campaign that facts name, its days moved by the store's number."""
    held = star_join(t, ["campaigns"], t.fact.select("campaign_id", "store_id").distinct())
    days = F.pmod("store_id", F.lit(300)).cast("int")
    return held.select(
        F.concat_ws("-", "campaign_id", "store_id").alias("campaign_id"),
        F.concat_ws(" ", "campaign_name", "store_id").alias("campaign_name"),
        F.date_add("start_date", days).alias("start_date"),
        F.date_add("end_date", days).alias("end_date"),
    )


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


def csv_campaigns(t: Tables) -> DataFrame:
    """Campaigns through CSV files with day-first dates and back."""
    spark, path = t.fact.sparkSession, scratch_dir(t.fact.sparkSession, "csv-campaigns")
    _store_campaigns(t).write.option("header", True).option("dateFormat", CAMPAIGN_DATE_FORMAT).csv(path)
    return _dates_as_text(read_campaigns_csv(spark, path))


def dump_campaigns(t: Tables) -> DataFrame:
    """Campaigns through INSERT text and back."""
    return _dates_as_text(parse_insert_lines(insert_lines(_store_campaigns(t), "dim_campaigns", CAMPAIGNS.names), "dim_campaigns", CAMPAIGNS))


def _sql(statement: str) -> Callable[[Tables], DataFrame]:
    """A report as SQL over the registered tables and view."""

    def run(t: Tables) -> DataFrame:
        register_views(t.fact.sparkSession, t)
        return t.fact.sparkSession.sql(statement)

    run.__name__ = "sql_report"
    return run


# Reports in SQL over the view, written for Spark: percentages by exact integer rounding are
# the DataFrame reports' own, so these keep to sums, ranks and orders.
SQL_REPORTS = {
    "sql_campaign_units": """
        SELECT campaign_name, SUM(quantity_sold_before_promo) AS units_before, SUM(ISU) AS ISU, SUM(IR) AS IR
        FROM sales_summary GROUP BY campaign_name""",
    "sql_promo_ir": """
        SELECT promo_type, SUM(IR) AS IR, SUM(ISU) AS ISU FROM sales_summary GROUP BY promo_type""",
    "sql_store_units": """
        SELECT s.store_id, s.city, SUM(f.`quantity_sold(after_promo)` - f.`quantity_sold(before_promo)`) AS units
        FROM fact_events f JOIN dim_stores s ON f.store_id = s.store_id GROUP BY s.store_id, s.city""",
}

_CITY_TOTALS = _sql("SELECT city, SUM(IR) AS incremental_revenue FROM sales_summary GROUP BY city")


def sql_city_rank(t: Tables) -> DataFrame:
    """Totals in SQL over the view, ranked in ranges (a window in SQL would take all cities into one task)."""
    return global_rank(_CITY_TOTALS(t), "incremental_revenue", name="city_rank")


OPERATORS: dict[str, Callable[[Tables], DataFrame]] = {
    "scan_fact": scan_fact,
    "check_keys": check_keys,
    "project": project,
    "join_fact_store": join_fact_store,
    "join_fact_campaign": join_fact_campaign,
    "join_fact_product": join_fact_product,
    "star_join": star_join_rows,
    "promo_units_rows": promo_units_rows,
    "promo_revenue_rows": promo_revenue_rows,
    "sales_summary_eager": sales_summary_eager,
    "city_ir_rank_distributed": city_ir_rank_distributed,
    "category_isu_diwali_distributed": category_isu_diwali_distributed,
    "campaign_revenue_keys_verified": campaign_revenue_keys_verified,
    "promo_isu_keys_verified": promo_isu_keys_verified,
    "category_ir_keys_verified": category_ir_keys_verified,
    "store_top_ir_shuffled": store_top_ir_shuffled,
    "campaign_top_products_shuffled": campaign_top_products_shuffled,
    "campaign_revenue_shared_view": campaign_revenue_shared_view,
    "product_ir_pct_rank": R.product_ir_pct_rank,
    "product_ir_dense_ranks": R.product_ir_dense_ranks,
    "product_isu_dense_ranks": R.product_isu_dense_ranks,
    "campaign_store_ranks": R.campaign_store_ranks,
    "campaign_product_ranks": R.campaign_product_ranks,
    "sql_city_rank": sql_city_rank,
    "store_count_by_city_order": store_count_by_city_order,
    "promo_isu_order": promo_isu_order,
    "category_isu_order": category_isu_order,
    "promo_ir_isu_order": promo_ir_isu_order,
    "category_ir_text_order": category_ir_text_order,
    "product_top_bottom_ir_text_order": product_top_bottom_ir_text_order,
    "dump_rows": dump_rows,
    "dump_file_rows": dump_file_rows,
    "dump_dimensions": dump_dimensions,
    "dump_campaigns": dump_campaigns,
    "csv_dimensions": csv_dimensions,
    "csv_campaigns": csv_campaigns,
    "bulk_load_rows": bulk_load_rows,
    "appended_view": appended_view,
    "store_top_ir_bucketed": store_top_ir_bucketed,
    "stored_view": stored_view,
    **{name: _stored(name) for name in STORED_REPORTS},
    "rejected_rows": rejected_rows,
    "collated_city_ir": collated_city_ir,
    "collated_promo_isu": collated_promo_isu,
    "collated_top_stores": collated_top_stores,
    "collated_cities": collated_cities,
    **{name: _sql(statement) for name, statement in SQL_REPORTS.items()},
}

CATALOG: dict[str, Callable[[Tables], DataFrame]] = {**OPERATORS, **REPORTS}
