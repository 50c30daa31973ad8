"""Declared types, lengths and NOT NULL, enforced at load (S6, S11): accepted rows and rejected ones with reasons.

The original's server refuses a row that breaks a declaration; Spark writes it, or turns
it into NULLs.  :func:`checked_rows` marks every row with what it breaks, in one pass of
column expressions, and :func:`split_rows` makes two tables of it: no row is lost, and the
rejected ones keep their values as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftwise.schemas import CAMPAIGNS, FACT, PRODUCTS, STORES, normalise_columns

# The declared lengths in characters.
LENGTHS = {
    "campaigns": {"campaign_id": 20, "campaign_name": 50},
    "products": {"product_code": 10, "product_name": 255, "category": 50},
    "stores": {"store_id": 15, "city": 50},
    "fact": {"event_id": 10, "store_id": 10, "campaign_id": 20, "product_code": 10, "promo_type": 50},
}
SCHEMAS = {"campaigns": CAMPAIGNS, "products": PRODUCTS, "stores": STORES, "fact": FACT}


def _reasons(f: T.StructField, most: int | None) -> list[Column]:
    given = F.col(f"`{f.name}`")
    typed = given.cast("string") if isinstance(f.dataType, T.StringType) else given.try_cast(f.dataType)
    out = []
    if not f.nullable:
        out.append(F.when(given.isNull(), F.lit(f"{f.name}: null")))
    if not isinstance(f.dataType, T.StringType):
        out.append(F.when(given.isNotNull() & typed.isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString()}")))
    if most is not None:
        out.append(F.when(F.length(typed) > most, F.lit(f"{f.name}: over {most} characters")))
    return out


def checked_rows(df: DataFrame, table: str, lengths: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``reasons``: what each row breaks of the declaration of ``table``, by column.

    Lengths are counted in characters, blanks at the end included.  A value that is not of
    its column's type is one reason, NULL in a NOT NULL column another.
    """
    lengths = LENGTHS[table] if lengths is None else lengths
    broken = [r for f in SCHEMAS[table].fields for r in _reasons(f, lengths.get(f.name))]
    return normalise_columns(df).withColumn("reasons", F.filter(F.array(*broken), lambda r: r.isNotNull()))


def split_rows(df: DataFrame, table: str, lengths: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with the declared types, rejected rows as text with their ``reasons``)."""
    checked = checked_rows(df, table, lengths)
    fields = SCHEMAS[table].fields
    good = checked.filter(F.size("reasons") == 0).select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
    bad = checked.filter(F.size("reasons") > 0).select([F.col(f"`{f.name}`").cast("string").alias(f.name) for f in fields] + ["reasons"])
    return good, bad


def reason_counts(df: DataFrame, table: str, lengths: dict[str, int] | None = None) -> DataFrame:
    """``reason``, ``n``: rows by what they break; ``accepted`` for those that break nothing.

    A row with several reasons counts once, under all of them joined.
    """
    checked = checked_rows(df, table, lengths)
    name = F.when(F.size("reasons") == 0, "accepted").otherwise(F.array_join("reasons", "; "))
    return checked.groupBy(name.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
