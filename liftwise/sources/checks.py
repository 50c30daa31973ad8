"""Declared constraints, verified as a Spark job.

Spark does not enforce primary keys, NOT NULL on file sources or foreign keys, so the
constraints the original declares are checked here, one result row per check:

* ``duplicate_key``: number of primary-key values held by more than one row;
* ``null``: number of NULLs in a column declared NOT NULL;
* ``orphan``: number of fact rows whose key has no dimension row (a NULL key
  included); these are the rows the reports' inner joins drop;
The fact's keys are counted first (one narrow scan and a partial aggregate for each), so
a NULL or hot key is one row by the time it meets its dimension.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.schemas import CAMPAIGNS, FACT, FOREIGN_KEYS, PRIMARY_KEYS, PRODUCTS, STORES
from liftwise.tables import Tables

TABLE_SCHEMAS = {"fact": FACT, "stores": STORES, "campaigns": CAMPAIGNS, "products": PRODUCTS}
DIMENSIONS = ("stores", "campaigns", "products")


def not_null_columns(table: str, df: DataFrame) -> list[str]:
    return [f.name for f in TABLE_SCHEMAS[table].fields if not f.nullable and f.name in df.columns]


def _rows(counts: DataFrame, table: str, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Unpivot one row of counts into result rows; ``names``: alias -> (check, column)."""
    long = counts.unpivot([], list(names), "_alias", "violations")

    def pick(i: int) -> Column:
        return F.coalesce(*[F.when(F.col("_alias") == a, F.lit(v[i])) for a, v in names.items()])

    return long.select(
        pick(0).alias("check_name"),
        F.lit(table).alias("table_name"),
        pick(1).alias("column_name"),
        F.col("violations").cast("bigint").alias("violations"),
    )


def check_keys(t: Tables) -> DataFrame:
    """One row per check: check_name, table_name, column_name, violations."""
    parts = []
    for table, key in PRIMARY_KEYS.items():
        dup = getattr(t, table).groupBy(key).count().filter(F.col("count") > 1)
        parts.append(
            dup.agg(
                F.lit("duplicate_key").alias("check_name"),
                F.lit(table).alias("table_name"),
                F.lit(key).alias("column_name"),
                F.count(F.lit(1)).cast("bigint").alias("violations"),
            )
        )
    for table in ("fact", *DIMENSIONS):
        df = getattr(t, table)
        cols = not_null_columns(table, df)
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
        parts.append(_rows(nulls, table, {f"n{i}": ("null", c) for i, c in enumerate(cols)}))
    parts.append(orphans(t))
    return reduce(DataFrame.unionByName, parts)


def orphans(t: Tables) -> DataFrame:
    """The orphan checks alone, one row for each foreign key of the fact."""
    parts = []
    for key, dim in FOREIGN_KEYS.items():
        held = t.fact.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        missing = held.join(getattr(t, dim).select(key), key, "left_anti")
        parts.append(_rows(missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("o")), "fact", {"o": ("orphan", key)}))
    return reduce(DataFrame.unionByName, parts)


def verify_keys(t: Tables) -> Tables:
    """``t`` marked ``keys_verified`` when no dimension key repeats and every fact finds its rows.

    Only then may a query leave out a dimension it takes no column from.
    """
    bad = check_keys(t).filter(F.col("check_name").isin("duplicate_key", "orphan")).agg(F.sum("violations")).first()[0]
    return replace(t, keys_verified=bad == 0)
