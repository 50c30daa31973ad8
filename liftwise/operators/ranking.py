"""Ranks, top-N and top/bottom-K.

None of these sends an unbounded set of rows to one task:

* :func:`top_n` is ``orderBy().limit()``, planned as TakeOrderedAndProject: each
  task keeps its own n best rows, and only those meet in the last step.
* :func:`top_n_per_group` filters a partitioned rank; Catalyst turns the filter into
  a WindowGroupLimit before and after the shuffle, so each task passes on only the
  best rows of each group (ties included).
* :func:`top_bottom_k` finds the k-th highest and k-th lowest distinct value as two
  scalar subqueries (each a distinct + TakeOrderedAndProject) and filters on them,
  instead of two unpartitioned dense ranks, which would sort everything in one task.
* :func:`ordered_ranks` ranks all rows, also inside groups of any size, by several keys of
  mixed direction and type: rows are cut into ranges of the order, ranked inside their
  range, and moved up by what stands in the ranges before.  :func:`global_rank` is its
  form for one column.  :func:`rank_by` without a partition is for the few rows that a
  top-N cut has left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANKERS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}


def rank_by(
    df: DataFrame,
    order: Sequence[Column],
    partition_by: Sequence[str] = (),
    method: str = "rank",
    name: str = "rank",
) -> DataFrame:
    """Add ``name`` = RANK / DENSE_RANK / ROW_NUMBER over ``order`` (per ``partition_by``)."""
    w = Window.partitionBy(*partition_by).orderBy(*order) if partition_by else Window.orderBy(*order)
    return df.withColumn(name, _RANKERS[method]().over(w).cast("bigint"))


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """First ``n`` rows in ``order`` (O6, O7).  Put enough keys in ``order`` to break ties."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    name: str = "rank",
    method: str = "rank",
) -> DataFrame:
    """Rows ranked ``k`` or better inside each group, ties kept (W5 + P11, O8)."""
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(name, _RANKERS[method]().over(w))
    return ranked.filter(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))


def top_n_with_rank(
    df: DataFrame,
    n: int,
    order: Sequence[Column],
    rank_order: Sequence[Column],
    name: str = "rank",
) -> DataFrame:
    """Top ``n`` rows by ``order``, each with its RANK over ``rank_order`` among all rows.

    Exact when every row that ranks strictly above a row also comes before it in
    ``order`` (``order`` refines ``rank_order``): then all rows that count towards a
    kept row's rank are kept too, and the rank is computed on at most ``n`` rows.
    """
    return rank_by(top_n(df, n, order), rank_order, name=name)


def kth_distinct(df: DataFrame, value: str, k: int, highest: bool) -> Column:
    """Scalar subquery: the k-th highest (or lowest) distinct non-NULL ``value``.

    With fewer than k distinct values it is the lowest (highest) one; on no rows, NULL.
    """
    vals = df.select(value).where(F.col(value).isNotNull()).distinct()
    if highest:
        return vals.orderBy(F.desc(value)).limit(k).agg(F.min(value)).scalar()
    return vals.orderBy(F.asc(value)).limit(k).agg(F.max(value)).scalar()


def top_bottom_k(df: DataFrame, value: str, k: int) -> DataFrame:
    """Rows whose ``value`` has DENSE_RANK <= k from the top or from the bottom.

    Same rows as ``dense_rank() over (order by v desc) <= k or dense_rank() over
    (order by v asc) <= k`` for a non-NULL ``value``, without a global window.
    """
    v = F.col(value)
    return df.filter((v >= kth_distinct(df, value, k, True)) | (v <= kth_distinct(df, value, k, False)))


def top_bottom_k_window(df: DataFrame, value: str, k: int) -> DataFrame:
    """The plain form of :func:`top_bottom_k` with two global dense ranks; for comparison only."""
    top = F.dense_rank().over(Window.orderBy(F.desc(value)))
    bottom = F.dense_rank().over(Window.orderBy(F.asc(value)))
    ranked = df.withColumn("_top", top).withColumn("_bottom", bottom)
    return ranked.filter((F.col("_top") <= k) | (F.col("_bottom") <= k)).drop("_top", "_bottom")


@dataclass(frozen=True)
class Key:
    """One key of an order: a column, its direction, and where NULLs stand (default: last if
    descending, first if ascending, as Spark and MySQL place them)."""

    column: str
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def last(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    def order(self) -> Column:
        by = {(True, True): F.desc_nulls_last, (True, False): F.desc_nulls_first, (False, True): F.asc_nulls_last, (False, False): F.asc_nulls_first}
        return by[self.descending, self.last](self.column)


def desc(column: str) -> Key:
    return Key(column, descending=True)


def asc(column: str) -> Key:
    return Key(column)


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _key_struct(keys: Sequence[Key]) -> str:
    """SQL for a struct of the keys' values."""
    return "named_struct(" + ", ".join(f"'k{i}', {_quoted(k.column)}" for i, k in enumerate(keys)) + ")"


def _compared(keys: Sequence[Key], a: str, b: str) -> str:
    """SQL for -1, 0 or 1: which of two structs of the keys' values comes first (as text: one call, not dozens)."""
    out = "0"
    for i, k in reversed(list(enumerate(keys))):
        x, y = f"{a}.k{i}", f"{b}.k{i}"
        null_first = 1 if k.last else -1
        smaller = 1 if k.descending else -1
        out = (
            f"CASE WHEN {x} IS NULL AND {y} IS NULL THEN {out} WHEN {x} IS NULL THEN {null_first} WHEN {y} IS NULL THEN {-null_first}"
            f" WHEN {x} < {y} THEN {smaller} WHEN {x} > {y} THEN {-smaller} ELSE {out} END"
        )
    return out


# Rows sampled for each range; more of them make the ranges more even, not the ranks more exact.
SAMPLED_PER_RANGE = 12


def _range_cuts(df: DataFrame, keys: Sequence[Key], ranges: int) -> Column:
    """Scalar subquery: the orders' values at ``ranges`` - 1 places of a sample, in order.

    The sample is the rows with the smallest hashes, so it is the same whenever and
    wherever it is drawn: every use of the cuts agrees, even if Spark evaluates them twice.
    """
    size = ranges * SAMPLED_PER_RANGE
    sample = df.select(F.expr(_key_struct(keys)).alias("key"), F.xxhash64(*df.columns).alias("h")).orderBy("h", "key").limit(size)
    ordered = f"array_sort(collect_list(key), (x_, y_) -> {_compared(keys, 'x_', 'y_')})"
    held = sample.agg(F.expr(ordered).alias("s"))
    return held.selectExpr(f"transform(filter(sequence(1, {ranges - 1}), i_ -> size(s) > 0), i_ -> get(s, CAST(floor(i_ * size(s) / {ranges}) AS INT))) AS cuts").scalar()


def _range_of(keys: Sequence[Key], ranges: int) -> Column:
    """Number of ``_cuts`` before the row, by halving; rows with equal keys are in one range."""
    steps = ", ".join(str(1 << b) for b in reversed(range(ranges.bit_length())))
    before = _compared(keys, "get(_cuts, at_ + by_ - 1)", "_key")
    return F.expr(f"aggregate(array({steps}), 0, (at_, by_) -> IF(at_ + by_ <= size(_cuts) AND {before} < 0, at_ + by_, at_))")


def ordered_ranks(
    df: DataFrame,
    keys: Sequence[Key],
    ranks: Mapping[str, str],
    group: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """``df`` with the columns ``ranks`` (name -> method), without a window over all rows or a whole group.

    Methods: ``rank``, ``dense_rank``, ``row_number`` over ``keys`` (inside ``group``, if any;
    a NULL group is a group) and, without a group, ``dense_rank_from_end``, the dense
    rank in the opposite order, from the same pass.  Equal to the window functions of
    those names for any number of rows and any split of them over groups: the order of
    (group, keys) is cut into ``ranges`` (default: twice the shuffle partitions, 16 at
    least) at a sample's quantiles, which balance the work and do not affect the
    result.  A range continues one group of the range before at most, so what is
    broadcast is one row for each range.  Nothing runs before the query does.
    """
    bad = set(ranks.values()) - {*_RANKERS, "dense_rank_from_end"}
    if bad or (group and "dense_rank_from_end" in ranks.values()):
        raise ValueError(f"no such rank{' inside groups' if group else ''}: {sorted(bad) or 'dense_rank_from_end'}")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or max(16, 2 * partitions)
    whole = [*[Key(g) for g in group], *keys]
    keyed = df.select("*", _range_cuts(df, whole, ranges).alias("_cuts"), F.expr(_key_struct(whole)).alias("_key")).select(*df.columns, _range_of(whole, ranges).alias("_range"))
    inside = Window.partitionBy("_range", *group).orderBy(*[k.order() for k in keys])
    methods = {*ranks.values()} - {"dense_rank_from_end"} | ({"dense_rank"} if "dense_rank_from_end" in ranks.values() else set())
    local = keyed.withColumns({f"_{m}": _RANKERS[m]().over(inside) for m in sorted(methods)})

    dense = "dense_rank" in methods
    counts = [F.count(F.lit(1)).alias("_rows"), (F.max("_dense_rank") if dense else F.lit(0)).alias("_distinct")]
    sizes = local.groupBy("_range", *group).agg(*counts)
    of_group = Window.partitionBy(*group) if group else Window.partitionBy()
    before = of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = {"_rows": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_distinct": F.coalesce(F.sum("_distinct").over(before), F.lit(0))}
    total = F.sum("_distinct").over(of_group) if "dense_rank_from_end" in ranks.values() else F.lit(0)
    offsets = sizes.select(F.col("_range").alias("_at"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[e.alias(f"{n}_before") for n, e in moved.items()], total.alias("_total"))
    if group:
        offsets = offsets.filter("_rows_before > 0")
    same = F.col("_range") == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(F.broadcast(offsets), same, "left" if group else "inner")

    def moved_up(method: str) -> Column:
        by = F.coalesce(F.col("_distinct_before" if method == "dense_rank" else "_rows_before"), F.lit(0))
        return F.col(f"_{method}") + by

    def value(method: str) -> Column:
        return F.col("_total") + 1 - moved_up("dense_rank") if method == "dense_rank_from_end" else moved_up(method)

    return joined.select(*df.columns, *[value(m).cast("bigint").alias(n) for n, m in ranks.items()])


def global_rank(df: DataFrame, value: str, name: str = "rank", descending: bool = True, dense: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with RANK (or DENSE_RANK) over one column; descending: NULLs last, ascending: first (:func:`ordered_ranks`)."""
    return ordered_ranks(df, [Key(value, descending)], {name: "dense_rank" if dense else "rank"}, ranges=ranges)
