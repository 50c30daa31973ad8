"""Connected components of a link table by alternating large-star and small-star steps.

Only minima per node are aggregated (with map-side combination), no neighbour list is ever
built, and a join's hot keys can be split by AQE: a hub's neighbours stay spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftwise.llm.common import saved


def _edges(df: DataFrame) -> DataFrame:
    """(u, v) with u > v, each once."""
    return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) for every node of ``links`` (``u``, ``v``): the least node reachable.

    Rows may repeat, come in either direction or link a node to itself (which alone yields no
    row); an empty table gives an empty result.  Rounds end when the link table no longer
    changes; each is written to the shared folder, so a lost executor never goes back further.
    """
    now = saved(_edges(links), "cc-links")
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1000003).alias("s")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        # Large star: the larger neighbours of u go to the least node around u.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Rows (v, u) with v > u, so `now` read backwards holds exactly the larger neighbours.
        large = _edges(now.select(F.col("v").alias("c"), F.col("u").alias("w")).join(least.withColumnRenamed("u", "c"), "c").select(F.col("w").alias("u"), F.col("m").alias("v")))
        # Small star: u and its smaller neighbours go to the least of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u")
        now = saved(_edges(moved.select("v", "m").toDF("u", "v").unionByName(lower.toDF("u", "v"))), "cc-links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
