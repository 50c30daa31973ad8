"""The view and the seventeen reports (V0, Q1-Q17) as DataFrame compositions.

Each report takes a :class:`~liftwise.tables.Tables` and returns a lazy DataFrame.
Reports over the view roll the joined fact straight up to their own grain
(:func:`~liftwise.operators.star.summarise`); the sums are additive, so the result
equals summing the view.  Two metric families are kept apart by name (T2): *net*
(discounted price, BOGOF units doubled: ``IR``, ``ISU``) and *gross* (base price,
raw units: ``gross_ir``, ``raw_isu``).

Choices where the original leaves the result open, or would fail on Spark:

* ties under ``LIMIT`` are broken by the grouping keys (T11); Q5 first by the
  unrounded ratio, compared exactly, so that ranks can be computed on the kept rows alone (T13);
* reports sorted by formatted text (Q12, Q14) sort by the number; ``text_order=True``
  sorts by the text (T9);
* a division by zero gives NULL (T7); money texts have two places, ``12.30M`` (T8);
* Q13's after-promotion units are named ``quantity_sold_after_promo`` (T10);
* the global ranks of Q4 and Q6 come from ``global_rank``, for any number of groups;
* reports whose grain is a foreign key (Q7, Q8, Q16, Q17) sum the fact by key first and
  join one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftwise.functions.collation import distinct, grouped
from liftwise.functions.formats import exact_ratio, millions, money_text, pct
from liftwise.functions.metrics import whole_sum
from liftwise.operators.ranking import (
    desc,
    global_rank,
    ordered_ranks,
    top_bottom_k,
    top_n,
    top_n_per_group,
    top_n_with_rank,
)
from liftwise.operators.star import gross_measures, rollup, sales_summary, star_join, summarise
from liftwise.tables import Tables

# Fixed values of the reports, as the original states them: the promotion and the
# price threshold of Q1, the campaigns of Q4a and Q4b, the sizes of the top lists
# (Q5, Q7, Q8, Q14 and Q15, Q16, Q17) and the suffix of money in millions in Q10.
HIGH_VALUE_PROMO = "BOGOF"
HIGH_VALUE_MIN_PRICE = 500
CAMPAIGN_Q4A = "Diwali"
CAMPAIGN_Q4B = "Sankranti"
TOP_IR_PCT_PRODUCTS = 5
TOP_STORES = 10
BOTTOM_STORES = 10
TOP_BOTTOM_PRODUCTS = 3
TOP_STORES_PER_CAMPAIGN = 3
TOP_PRODUCTS_PER_CAMPAIGN = 5
PROMO_MONEY_SUFFIX = " M"


def high_value_bogof(t: Tables, promo: str = HIGH_VALUE_PROMO, min_price: int = HIGH_VALUE_MIN_PRICE) -> DataFrame:
    """Q1: distinct product names and base prices sold under ``promo`` above ``min_price``."""
    fact = t.fact.filter((F.col("promo_type") == promo) & (F.col("base_price") > min_price))
    joined = star_join(t, ["products"], distinct(fact.select("product_code", "base_price")))
    return distinct(joined.select("product_name", "base_price"))


def store_count_by_city(t: Tables) -> DataFrame:
    """Q2: number of stores in each city, most first."""
    counts = grouped(t.stores, ["city"], [F.count("store_id").alias("total_stores")])
    return counts.orderBy(F.desc("total_stores"), F.asc("city"))


def campaign_revenue(t: Tables) -> DataFrame:
    """Q3: revenue before and after, net IR in millions as text, and IR% per campaign."""
    s = summarise(t, ["campaign_name"])
    return s.select(
        "campaign_name",
        money_text("revenue_before_promo").alias("revenue_before_million"),
        money_text("revenue_after_promo").alias("revenue_after_million"),
        money_text("IR").alias("IR"),
        pct("IR", "revenue_before_promo", 2).alias("IR%"),
    )


def category_isu(t: Tables, campaign_name: str, ranges: int | None = None) -> DataFrame:
    """Q4: units before and after, ISU% and its rank per category for one campaign."""
    s = summarise(t, ["category"], where={"campaign_name": campaign_name}).select(
        "category",
        F.col("quantity_sold_before_promo").alias("quantity_before_promo"),
        F.col("quantity_sold_after_promo").alias("quantity_after_promo"),
        pct("ISU", "quantity_sold_before_promo").alias("ISU%"),
    )
    return global_rank(s, "ISU%", name="Ranking", ranges=ranges)


def category_isu_diwali(t: Tables) -> DataFrame:
    """Q4a."""
    return category_isu(t, CAMPAIGN_Q4A)


def category_isu_sankranti(t: Tables) -> DataFrame:
    """Q4b."""
    return category_isu(t, CAMPAIGN_Q4B)


def _product_ir_pct(t: Tables) -> DataFrame:
    return summarise(t, ["product_name", "category"]).select(
        "product_name",
        "category",
        pct("IR", "revenue_before_promo", 2).alias("IR%"),
        exact_ratio("IR", "revenue_before_promo").alias("_ratio"),
    )


def product_top_ir_pct(t: Tables, n: int = TOP_IR_PCT_PRODUCTS) -> DataFrame:
    """Q5: the ``n`` products with the highest IR%, with their rank among all products."""
    order = [F.desc_nulls_last("IR%"), F.desc_nulls_last("_ratio"), F.asc("product_name"), F.asc("category")]
    ranked = top_n_with_rank(_product_ir_pct(t), n, order, [F.desc_nulls_last("_ratio")], name="ranking")
    return ranked.orderBy(*order).drop("_ratio")


def product_ir_pct_rank(t: Tables) -> DataFrame:
    """Q5 without the limit: every product's IR% and its rank by the exact ratio."""
    return global_rank(_product_ir_pct(t), "_ratio", name="ranking").drop("_ratio")


def city_ir_rank(t: Tables, ranges: int | None = None) -> DataFrame:
    """Q6: revenue before, after and net IR per city as text, ranked by IR."""
    s = summarise(t, ["city"]).select(
        "city",
        money_text("revenue_before_promo").alias("revenue_before_promo"),
        money_text("revenue_after_promo").alias("revenue_after_promo"),
        money_text("IR").alias("incremental_revenue"),
        F.col("IR").alias("_ir"),
    )
    ranked = global_rank(s, "_ir", name="city_rank", ranges=ranges)
    return ranked.orderBy(F.desc("_ir"), F.asc("city")).drop("_ir")


def _store_rollup(t: Tables) -> DataFrame:
    return rollup(t, ["store_id", "city"], gross_measures(), dims=["stores"], eager=True)


def store_top_ir(t: Tables, n: int = TOP_STORES) -> DataFrame:
    """Q7: the ``n`` stores with the highest gross IR, in millions."""
    s = _store_rollup(t).select("store_id", "city", millions(whole_sum("gross_ir")).alias("incremental_revenue_mln"))
    return top_n(s, n, [F.desc("incremental_revenue_mln"), F.asc("store_id"), F.asc("city")])


def store_bottom_isu(t: Tables, n: int = BOTTOM_STORES) -> DataFrame:
    """Q8: the ``n`` stores with the lowest raw incremental units."""
    s = _store_rollup(t).select("store_id", "city", F.col("raw_isu").alias("incremental_sold_quantity"))
    return top_n(s, n, [F.asc("incremental_sold_quantity"), F.asc("store_id"), F.asc("city")])


def promo_isu(t: Tables) -> DataFrame:
    """Q9: units before and after, ISU and ISU% per promotion type."""
    s = summarise(t, ["promo_type"])
    out = s.select(
        "promo_type",
        F.col("quantity_sold_before_promo").alias("quantity_before_promo"),
        F.col("quantity_sold_after_promo").alias("quantity_after_promo"),
        F.col("ISU").alias("incremental_sold_units"),
        pct("ISU", "quantity_sold_before_promo").alias("ISU%"),
    )
    return out.orderBy(F.desc_nulls_last("ISU%"), F.asc_nulls_first("promo_type"))


def promo_ir(t: Tables) -> DataFrame:
    """Q10: revenue before, after and net IR as text (suffix ' M'), and IR% per promotion type."""
    s = summarise(t, ["promo_type"])
    out = s.select(
        "promo_type",
        money_text("revenue_before_promo", PROMO_MONEY_SUFFIX).alias("revenue_before_promo"),
        money_text("revenue_after_promo", PROMO_MONEY_SUFFIX).alias("revenue_after_promo"),
        money_text("IR", PROMO_MONEY_SUFFIX).alias("incremental_revenue"),
        pct("IR", "revenue_before_promo", 2).alias("IR%"),
    )
    return out.orderBy(F.desc_nulls_last("IR%"), F.asc_nulls_first("promo_type"))


def promo_ir_isu(t: Tables) -> DataFrame:
    """Q11: net IR in millions and ISU per promotion type."""
    s = summarise(t, ["promo_type"]).select("promo_type", millions("IR").alias("IR"), "ISU")
    return s.orderBy(F.desc("IR"), F.desc("ISU"), F.asc_nulls_first("promo_type"))


def category_ir(t: Tables, text_order: bool = False) -> DataFrame:
    """Q12: revenue before, after and net IR as text, and IR% per category.

    Sorted by IR; ``text_order`` sorts by the IR text instead, character by character,
    as the original does (T9).  The rows are the same either way.
    """
    s = summarise(t, ["category"]).select(
        "category",
        money_text("revenue_before_promo").alias("revenue_before_promo"),
        money_text("revenue_after_promo").alias("revenue_after_promo"),
        money_text("IR").alias("incremental_revenue"),
        pct("IR", "revenue_before_promo", 2).alias("IR%"),
        F.col("IR").alias("_ir"),
    )
    first = F.desc("incremental_revenue") if text_order else F.desc("_ir")
    return s.orderBy(first, F.asc("category")).drop("_ir")


def category_isu_report(t: Tables) -> DataFrame:
    """Q13: units before and after, ISU and ISU% per category."""
    s = summarise(t, ["category"]).select(
        "category",
        "quantity_sold_before_promo",
        "quantity_sold_after_promo",
        F.col("ISU").alias("incremental_sold_units"),
        pct("ISU", "quantity_sold_before_promo").alias("ISU%"),
    )
    return s.orderBy(F.desc("incremental_sold_units"), F.asc("category"))


def _product_summary(t: Tables) -> DataFrame:
    return summarise(t, ["product_name", "category"])


def product_top_bottom_ir(t: Tables, k: int = TOP_BOTTOM_PRODUCTS, text_order: bool = False) -> DataFrame:
    """Q14: products in the top ``k`` or bottom ``k`` distinct net IR values; IR as text.

    Sorted by IR; ``text_order`` sorts by the IR text instead (T9).
    """
    s = _product_summary(t).select("product_name", "category", F.col("IR").alias("_ir"))
    kept = top_bottom_k(s, "_ir", k)
    out = kept.select("product_name", "category", money_text("_ir").alias("IR"), "_ir")
    first = F.desc("IR") if text_order else F.desc("_ir")
    return out.orderBy(first, F.asc("product_name"), F.asc("category")).drop("_ir")


def product_top_bottom_isu(t: Tables, k: int = TOP_BOTTOM_PRODUCTS) -> DataFrame:
    """Q15: products in the top ``k`` or bottom ``k`` distinct net ISU values."""
    s = _product_summary(t).select("product_name", "category", "ISU")
    kept = top_bottom_k(s, "ISU", k)
    return kept.orderBy(F.desc("ISU"), F.asc("product_name"), F.asc("category"))


def product_ir_dense_ranks(t: Tables) -> DataFrame:
    """Q14 before its filter: every product's net IR with its dense rank from the top and from the bottom."""
    s = _product_summary(t).select("product_name", "category", "IR")
    return ordered_ranks(s, [desc("IR")], {"top_rank": "dense_rank", "bottom_rank": "dense_rank_from_end"})


def product_isu_dense_ranks(t: Tables) -> DataFrame:
    """Q15 before its filter: every product's net ISU with both dense ranks."""
    s = _product_summary(t).select("product_name", "category", "ISU")
    return ordered_ranks(s, [desc("ISU")], {"top_rank": "dense_rank", "bottom_rank": "dense_rank_from_end"})


def _campaign_stores(t: Tables) -> DataFrame:
    g = rollup(t, ["campaign_name", "store_id", "city"], gross_measures(), dims=["campaigns", "stores"], eager=True)
    return g.select("campaign_name", "store_id", "city", millions(whole_sum("gross_ir")).alias("incremental_revenue_mln"))


def _campaign_products(t: Tables) -> DataFrame:
    by = ["campaign_name", "product_name", "category"]
    g = rollup(t, by, gross_measures(), dims=["campaigns", "products"], eager=True)
    return g.select(*by, millions(whole_sum("gross_ir")).alias("incremental_revenue_mln"))


def campaign_store_ranks(t: Tables) -> DataFrame:
    """Q16 before its cut: every store's rank in its campaign (W5), in ranges inside the campaigns."""
    return ordered_ranks(_campaign_stores(t), [desc("incremental_revenue_mln")], {"store_rank": "rank"}, group=["campaign_name"])


def campaign_product_ranks(t: Tables) -> DataFrame:
    """Q17 before its cut: every product's rank in its campaign."""
    return ordered_ranks(_campaign_products(t), [desc("incremental_revenue_mln")], {"product_rank": "rank"}, group=["campaign_name"])


def campaign_top_stores(t: Tables, k: int = TOP_STORES_PER_CAMPAIGN) -> DataFrame:
    """Q16: per campaign, the stores ranked ``k`` or better by gross IR in millions."""
    return top_n_per_group(_campaign_stores(t), ["campaign_name"], [F.desc("incremental_revenue_mln")], k, name="store_rank")


def campaign_top_products(t: Tables, k: int = TOP_PRODUCTS_PER_CAMPAIGN) -> DataFrame:
    """Q17: per campaign, the products ranked ``k`` or better by gross IR in millions."""
    return top_n_per_group(_campaign_products(t), ["campaign_name"], [F.desc("incremental_revenue_mln")], k, name="product_rank")


# Report key -> function of the tables, in the original's order.
REPORTS = {
    "sales_summary": sales_summary,
    "high_value_bogof": high_value_bogof,
    "store_count_by_city": store_count_by_city,
    "campaign_revenue": campaign_revenue,
    "category_isu_diwali": category_isu_diwali,
    "category_isu_sankranti": category_isu_sankranti,
    "product_top5_ir_pct": product_top_ir_pct,
    "city_ir_rank": city_ir_rank,
    "store_top_ir": store_top_ir,
    "store_bottom_isu": store_bottom_isu,
    "promo_isu": promo_isu,
    "promo_ir": promo_ir,
    "promo_ir_isu": promo_ir_isu,
    "category_ir": category_ir,
    "category_isu": category_isu_report,
    "product_top_bottom_ir": product_top_bottom_ir,
    "product_top_bottom_isu": product_top_bottom_isu,
    "campaign_top_stores": campaign_top_stores,
    "campaign_top_products": campaign_top_products,
}
