"""The tables and the view under their original names, for ``spark.sql``.

After :func:`register_views`, reports written in SQL against ``fact_events``,
``dim_stores``, ``dim_campaigns``, ``dim_products`` and ``sales_summary`` run on Spark
unchanged but for the dialect (Spark quotes names with backticks).  The fact is
exposed under both spellings of the quantity columns (T1); ``sales_summary`` is the
DataFrame of :func:`~liftwise.operators.star.sales_summary`, inlined into every query
that names it, like a non-materialised view.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from liftwise.operators.star import sales_summary
from liftwise.schemas import LEGACY_COLUMN_NAMES
from liftwise.tables import Tables

VIEW_NAMES = {
    "fact": "fact_events",
    "stores": "dim_stores",
    "campaigns": "dim_campaigns",
    "products": "dim_products",
}


def register_views(spark: SparkSession, t: Tables, prefix: str = "") -> list[str]:
    """Create (or replace) the temporary views; returns their names."""
    legacy = [F.col(new).alias(old) for old, new in LEGACY_COLUMN_NAMES.items()]
    frames = {
        "fact": t.fact.select("*", *legacy),
        "stores": t.stores,
        "campaigns": t.campaigns,
        "products": t.products,
    }
    names = []
    for key, df in frames.items():
        name = prefix + VIEW_NAMES[key]
        df.createOrReplaceTempView(name)
        names.append(name)
    sales_summary(t).createOrReplaceTempView(prefix + "sales_summary")
    names.append(prefix + "sales_summary")
    return names
