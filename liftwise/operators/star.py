"""Star join (J1-J5) and roll-up of the promotion metrics to any grain.

Design for scale:

* Dimensions are broadcast only after their size in bytes has been checked against a
  bound (:func:`broadcast_small_dims`).  Before a join with a dimension above it, the
  fact is grouped by the foreign keys of the joined dimensions: the partial aggregate
  flattens hot keys, and the shuffle moves sums instead of facts.
* Reports do not read the five-key view and then group it again.  All metrics are
  sums, so :func:`summarise` goes from the joined fact straight to the report's own
  grain: the partial aggregate before the shuffle then emits one row per report
  group per task instead of one per view group.
* ``eager=True`` groups by the joined keys first whatever the dimensions' size; reports
  whose grain is a foreign key always do.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from liftwise.functions import metrics as M
from liftwise.functions.collation import BINARY, byte_strings, grouped, is_collated
from liftwise.session import scratch_dir
from liftwise.tables import Tables

DIM_KEYS = {"stores": "store_id", "campaigns": "campaign_id", "products": "product_code"}
ALL_DIMS = ("stores", "campaigns", "products")
VIEW_KEYS = ("campaign_name", "city", "product_name", "category", "promo_type")

# Broadcast a dimension only up to this many bytes of values.
DEFAULT_BROADCAST_MAX_BYTES = 64 << 20


def sizes_in_bytes(frames: Mapping[str, DataFrame]) -> dict[str, int]:
    """Bytes of each frame's values (text as UTF-8, 8 bytes for any other), all in one job."""
    parts = []
    for name, df in frames.items():
        texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, StringType)]
        width = reduce(lambda a, b: a + b, texts, F.lit(8 * len(df.columns))).cast("bigint")
        parts.append(df.agg(F.lit(name).alias("frame"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")))
    return {r["frame"]: r["bytes"] for r in reduce(DataFrame.unionByName, parts).collect()}


def sized_broadcast(df: DataFrame, size: int, max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast when ``size`` (measured bytes) is at most ``max_bytes``, else leave a shuffle join."""
    return F.broadcast(df) if size <= max_bytes else df


def broadcast_small_dims(
    t: Tables, max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES, sizes: Mapping[str, int] | None = None
) -> Tables:
    """Broadcast each dimension whose measured size is within ``max_bytes``.

    The measurement is a separate small job over the dimensions; it is what makes the
    broadcast safe when a dimension grows with the data, in rows or in width.  ``sizes``
    may carry sizes that are already known.
    """
    known = dict(sizes or {})
    missing = {d: getattr(t, d) for d in ALL_DIMS if d not in known}
    if missing:
        known.update(sizes_in_bytes(missing))
    return replace(
        t,
        stores=sized_broadcast(t.stores, known["stores"], max_bytes),
        campaigns=sized_broadcast(t.campaigns, known["campaigns"], max_bytes),
        products=sized_broadcast(t.products, known["products"], max_bytes),
        shuffled_dims=frozenset(d for d in ALL_DIMS if known[d] > max_bytes),
    )


def star_join(t: Tables, dims: Sequence[str] = ALL_DIMS, fact: DataFrame | None = None) -> DataFrame:
    """Inner equi-join of the fact with the named dimensions, in the given order.

    Facts without a matching dimension row are dropped, as an inner join does;
    :func:`liftwise.sources.checks.check_keys` reports them.
    """
    out = t.fact if fact is None else fact
    for dim in dims:
        key = DIM_KEYS[dim]
        if fact is None and is_collated(t.fact.schema[key].dataType) and not t.fact.isStreaming:
            out = _join_spellings(out, t.fact, getattr(t, dim), key)
        else:
            out = out.join(getattr(t, dim), key, "inner")
    return out


def _by_spelling(fact: DataFrame, column: str, folded: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``folded`` of the distinct spellings of the fact's ``column`` (with their bytes as ``_bytes``), stored once.

    Collation keys and comparisons cost far more than bytes, so rows meet their spelling's
    result by its bytes; it is broadcast within the usual bound.
    """
    spark = fact.sparkSession
    spelled = fact.select(F.collate(column, BINARY).alias("_bytes")).distinct()
    found = folded(spelled.withColumn(column, F.collate("_bytes", fact.schema[column].dataType.collation)))
    path = scratch_dir(spark, "spellings")
    found.write.parquet(path)
    stored = spark.read.schema(found.schema).parquet(path)
    return sized_broadcast(stored, sizes_in_bytes({column: stored})[column])


def _join_spellings(left: DataFrame, fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """``left.join(dim, key)`` for a collated ``key`` of ``fact``."""
    kinds = {f.name: f.dataType for f in dim.schema.fields if f.name != key and is_collated(f.dataType)}
    matches = _by_spelling(fact, key, lambda s: byte_strings(s.join(dim, key, "inner").drop(key)))
    matches = matches.withColumns({c: F.collate(c, k.collation) for c, k in kinds.items()}) if kinds else matches
    out = left.join(matches, F.collate(left[key], BINARY) == matches["_bytes"], "inner")
    return out.select(key, *[c for c in left.columns if c != key], *[c for c in dim.columns if c != key])


def _grouped_by_bytes(joined: DataFrame, fact: DataFrame, by: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Sums of ``measures`` by the bytes of ``by``: few rows are left to be grouped under a collation.

    The promotion rules are looked up once for each spelling, too.
    """
    kinds = {f.name: f.dataType for f in joined.schema.fields}
    keys = [F.collate(c, BINARY).alias(f"_by_{i}") if is_collated(kinds[c]) else F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)]
    rows = joined.select("*", *keys)
    if is_collated(kinds["promo_type"]):
        rule = reduce(lambda otherwise, name: F.when(F.col("promo_type") == name, name).otherwise(otherwise), M.PROMO_RULES, F.lit(None))
        rules = _by_spelling(fact, "promo_type", lambda s: s.select("_bytes", rule.cast("string").alias("_rule")))
        rows = rows.join(rules, F.collate("promo_type", BINARY) == rules["_bytes"], "left").withColumn("promo_type", F.col("_rule"))
    sums = rows.groupBy(*[f"_by_{i}" for i in range(len(by))]).agg(*[F.sum(e).alias(n) for n, e in measures.items()])
    shown = [F.collate(f"_by_{i}", kinds[c].collation).alias(c) if is_collated(kinds[c]) else F.col(f"_by_{i}").alias(c) for i, c in enumerate(by)]
    return sums.select(*shown, *measures)


def net_measures() -> dict[str, Column]:
    """Row-level inputs of the view's sums (M1-M3); money in two parts each."""
    before = M.revenue_before_cents("base_price", "quantity_sold_before_promo")
    after = M.net_revenue_after_cents("promo_type", "base_price", "quantity_sold_after_promo")
    return {
        "quantity_sold_before_promo": F.col("quantity_sold_before_promo").cast("bigint"),
        "quantity_sold_after_promo": M.adjusted_units_after("promo_type", "quantity_sold_after_promo"),
        **M.sum_parts("revenue_before", before),
        **M.sum_parts("revenue_after", after),
    }


def gross_measures() -> dict[str, Column]:
    """Row-level inputs of the undiscounted sums (M8, M9)."""
    gross = M.gross_revenue_delta("base_price", "quantity_sold_before_promo", "quantity_sold_after_promo")
    return {
        **M.sum_parts("gross_ir", gross),
        "raw_isu": M.units_delta("quantity_sold_before_promo", "quantity_sold_after_promo"),
    }


Where = Mapping[str, object]


def _condition(where: Where) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in where.items()])


def needed_dims(t: Tables, columns: Sequence[str], dims: Sequence[str] = ALL_DIMS) -> list[str]:
    """The dimensions among ``dims`` that provide one of ``columns`` (not found in the fact)."""
    fact_cols = set(t.fact.columns)
    wanted = [c for c in columns if c not in fact_cols]
    out = []
    for dim in dims:
        attrs = set(getattr(t, dim).columns) - {DIM_KEYS[dim]}
        if any(c in attrs for c in wanted):
            out.append(dim)
    return out


def rollup(
    t: Tables,
    by: Sequence[str],
    measures: Mapping[str, Column],
    dims: Sequence[str] = ALL_DIMS,
    eager: bool | None = None,
    where: Where | None = None,
) -> DataFrame:
    """Sum row-level ``measures`` of the star join with ``dims``, grouped by ``by``.

    ``where`` holds equality filters (column -> value) on the joined rows; one on a
    dimension column is pushed by Catalyst to that dimension's side of the join, and
    from there to the fact's partition folders.  When ``t.keys_verified``, only the
    dimensions that provide a column of ``by`` or ``where`` are joined: the others
    would match each fact exactly once.  With ``eager`` the fact is first grouped by
    the foreign keys of the joined dimensions and the fact columns in use (sums are
    additive, so the result is the same); ``eager=None`` does so where a joined
    dimension is not broadcast.
    """
    where = dict(where or {})
    if t.keys_verified:
        dims = needed_dims(t, [*by, *where], dims)
    if eager is None:
        eager = any(d in t.shuffled_dims for d in dims)
    fact = t.fact
    if eager:
        keys = [DIM_KEYS[d] for d in dims]
        own = [k for k in dict.fromkeys([*by, *where]) if k in fact.columns and k not in keys]
        fact = grouped(fact, [*keys, *own], [F.sum(e).alias(n) for n, e in measures.items()])
        summed = {n: F.col(n) for n in measures}
    else:
        summed = dict(measures)
    joined = star_join(t, dims, fact if eager else None)
    if where:
        joined = joined.filter(_condition(where))
    if not eager and not t.fact.isStreaming and any(is_collated(t.fact.schema[c].dataType) for c in ("promo_type", *DIM_KEYS.values())):
        joined = _grouped_by_bytes(joined, t.fact, by, summed)
        summed = {n: F.col(n) for n in measures}
    return grouped(joined, by, [F.sum(e).alias(n) for n, e in summed.items()])


def _uses_summary(t: Tables, by: Sequence[str], where: Where, dims: Sequence[str], eager: bool | None) -> bool:
    return (
        t.summary is not None
        and not eager
        and tuple(dims) == ALL_DIMS
        and set(by) | set(where) <= set(VIEW_KEYS)
    )


def summarise(
    t: Tables,
    by: Sequence[str],
    eager: bool | None = None,
    dims: Sequence[str] = ALL_DIMS,
    where: Where | None = None,
) -> DataFrame:
    """The view's metrics at the grain ``by``: units and revenue before and after, ISU, IR (V0, M4, M5).

    When ``t.summary`` holds the materialised view sums and ``by`` and ``where`` use
    view columns only, the roll-up starts from it instead of the fact.
    """
    where = dict(where or {})
    if _uses_summary(t, by, where, dims, eager):
        base = t.summary.filter(_condition(where)) if where else t.summary
        out = grouped(base, by, [F.sum(n).alias(n) for n in net_measures()])
    else:
        out = rollup(t, by, net_measures(), dims, eager, where)
    return out.select(
        *by,
        "quantity_sold_before_promo",
        "quantity_sold_after_promo",
        M.cents_to_money(M.whole_sum("revenue_before")).alias("revenue_before_promo"),
        M.cents_to_money(M.whole_sum("revenue_after")).alias("revenue_after_promo"),
        (F.col("quantity_sold_after_promo") - F.col("quantity_sold_before_promo")).alias("ISU"),
        M.cents_to_money(M.whole_sum("revenue_after") - M.whole_sum("revenue_before")).alias("IR"),
    )


def sales_summary(t: Tables, eager: bool | None = None) -> DataFrame:
    """V0: the ``sales_summary`` view, one row per campaign, city, product name, category, promotion."""
    return summarise(t, VIEW_KEYS, eager=eager)


def materialize_summary(t: Tables, path: str, spark: SparkSession | None = None) -> Tables:
    """Write the view's sums once (Parquet under ``path``) and let reports share them.

    The view has one row per campaign, city, product name, category and promotion,
    so its size is bounded by those dimensions, not by the fact.  Sums are kept in
    whole units and cents, so every roll-up from it stays exact.  Group values are
    columns, not folder names, so '' and NULL stay apart.  ``path`` is a
    shared folder on a cluster (for example under ``spark.checkpoint.dir``).
    """
    base = rollup(t, VIEW_KEYS, net_measures())
    base.write.mode("overwrite").parquet(path)
    spark = spark or t.fact.sparkSession
    return t.with_summary(spark.read.schema(base.schema).parquet(path))
