"""Table definitions of the promotion star schema (S6) and the column-name normaliser.

Nullability follows the declared DDL.  File sources in Spark read every column as
nullable whatever the schema says, so NOT NULL is verified by
:func:`liftwise.sources.checks.check_keys`, not trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAMPAIGNS = T.StructType(
    [
        T.StructField("campaign_id", T.StringType(), False),
        T.StructField("campaign_name", T.StringType(), False),
        T.StructField("start_date", T.DateType(), False),
        T.StructField("end_date", T.DateType(), False),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_code", T.StringType(), False),
        T.StructField("product_name", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
    ]
)

STORES = T.StructType(
    [
        T.StructField("store_id", T.StringType(), False),
        T.StructField("city", T.StringType(), False),
    ]
)

FACT = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("store_id", T.StringType(), False),
        T.StructField("campaign_id", T.StringType(), False),
        T.StructField("product_code", T.StringType(), False),
        T.StructField("base_price", T.IntegerType(), False),
        T.StructField("promo_type", T.StringType(), True),
        T.StructField("quantity_sold_before_promo", T.IntegerType(), False),
        T.StructField("quantity_sold_after_promo", T.IntegerType(), False),
    ]
)

# Primary keys as declared; the fact table has none.
PRIMARY_KEYS = {
    "campaigns": "campaign_id",
    "products": "product_code",
    "stores": "store_id",
}

# Foreign keys of the fact table: fact column -> dimension.
FOREIGN_KEYS = {
    "store_id": "stores",
    "campaign_id": "campaigns",
    "product_code": "products",
}

# The older spelling of the two quantity columns, mapped to the one used here.
LEGACY_COLUMN_NAMES = {
    "quantity_sold(before_promo)": "quantity_sold_before_promo",
    "quantity_sold(after_promo)": "quantity_sold_after_promo",
}


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename the bracketed quantity columns to their underscore spelling."""
    renames = {old: new for old, new in LEGACY_COLUMN_NAMES.items() if old in df.columns}
    return df.withColumnsRenamed(renames) if renames else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Normalise names, keep the schema's columns in order and cast to its types."""
    df = normalise_columns(df)
    return df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def normalise_promo_type(promo: Column) -> Column:
    """Optional case and blank folding of promotion names.

    A name equal to a known promotion up to case and surrounding blanks becomes that
    promotion's spelling; any other name is only trimmed.  The original collation
    compares case-insensitively, Spark compares bytes: folding once at the source
    keeps every later comparison a cheap binary one.
    """
    from liftwise.functions.metrics import PROMO_RULES

    key = F.upper(F.trim(promo))
    out = F.trim(promo)
    for name in reversed(list(PROMO_RULES)):
        out = F.when(key == name.upper(), F.lit(name)).otherwise(out)
    return out
