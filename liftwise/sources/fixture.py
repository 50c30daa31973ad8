"""The four promotion tables derived from the generated TPC-H-style test tables.

The test tables have no promotions, so every column is derived row by row with
expressions that Spark and DuckDB evaluate alike (see FIXTURES.md section 3).  The
mapping is plain column arithmetic over ``lineitem``, plus a join with ``part`` for
the base price and one with ``nation`` for the city; its work grows with the tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftwise.operators.star import DEFAULT_BROADCAST_MAX_BYTES, broadcast_small_dims, sized_broadcast, sizes_in_bytes
from liftwise.tables import Tables

# The two campaigns of the analysed data set.
CAMPAIGN_ROWS = [
    ("CAMP_DIW_01", "Diwali", date(2023, 11, 12), date(2023, 11, 18)),
    ("CAMP_SAN_01", "Sankranti", date(2024, 1, 10), date(2024, 1, 16)),
]

# Fixed values of the test mapping: line status -> campaign id.
LINESTATUS_CAMPAIGN = {"O": "CAMP_DIW_01", "F": "CAMP_SAN_01"}

# Fixed values of the test mapping: discount in whole percent -> promotion type.
# 0 has no promotion (NULL); 10 is a type the rules do not know.
DISCOUNT_PROMO = {
    1: "25% OFF",
    2: "25% OFF",
    3: "33% OFF",
    4: "33% OFF",
    5: "50% OFF",
    6: "50% OFF",
    7: "BOGOF",
    8: "BOGOF",
    9: "500 Cashback",
    10: "LOYALTY",
}

# Fixed values of the test mapping: base price per unit of part size, and the
# modulus and offset that move the units sold after the promotion up or down.
PRICE_PER_SIZE = 60
AFTER_MODULUS = 41
AFTER_OFFSET = 15


def _lookup(c: Column, table: dict) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def campaigns_frame(spark: SparkSession) -> DataFrame:
    """The fixed campaign rows as a small JVM-side relation."""
    rows = [
        F.struct(
            F.lit(cid).alias("campaign_id"),
            F.lit(name).alias("campaign_name"),
            F.lit(start).alias("start_date"),
            F.lit(end).alias("end_date"),
        )
        for cid, name, start, end in CAMPAIGN_ROWS
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def from_testdata(
    spark: SparkSession, sf_dir: str, broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES
) -> Tables:
    """Fact, stores, campaigns and products from ``{sf_dir}/*.parquet``.

    Nation, part and the derived stores are measured in one small job; each is
    broadcast only within ``broadcast_max_bytes``.  The campaigns are a fixed table of
    two rows and always broadcast.
    """

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    nation = read("nation").select("n_nationkey", "n_name")
    supplier = read("supplier").select("s_suppkey", "s_nationkey")
    part = read("part")

    def stores_with(nations: DataFrame) -> DataFrame:
        return supplier.join(nations, supplier.s_nationkey == nations.n_nationkey).select(
            F.col("s_suppkey").alias("store_id"), F.col("n_name").alias("city")
        )

    parts = part.select("p_partkey", "p_name", "p_type")
    counts = sizes_in_bytes({"nation": nation, "part": parts, "stores": stores_with(nation)})
    stores = stores_with(sized_broadcast(nation, counts["nation"], broadcast_max_bytes))
    products = part.select(
        F.col("p_partkey").alias("product_code"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
    )

    sizes = sized_broadcast(part.select("p_partkey", "p_size"), counts["part"], broadcast_max_bytes)
    line = read("lineitem")
    before = F.col("l_quantity").cast("int")
    shift = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % AFTER_MODULUS
    fact = line.join(sizes, line.l_partkey == sizes.p_partkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        F.col("l_suppkey").alias("store_id"),
        _lookup(F.col("l_linestatus"), LINESTATUS_CAMPAIGN).alias("campaign_id"),
        F.col("l_partkey").alias("product_code"),
        (F.col("p_size") * PRICE_PER_SIZE).alias("base_price"),
        _lookup(F.round(F.col("l_discount") * 100).cast("int"), DISCOUNT_PROMO).alias("promo_type"),
        before.alias("quantity_sold_before_promo"),
        F.greatest(F.lit(0), before + shift - AFTER_OFFSET).cast("int").alias("quantity_sold_after_promo"),
    )
    tables = Tables(fact, stores, campaigns_frame(spark), products)
    known = {"stores": counts["stores"], "products": counts["part"], "campaigns": 0}
    return broadcast_small_dims(tables, broadcast_max_bytes, known)
