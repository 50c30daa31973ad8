"""Exact dedup with a heavy-hitter split.

A Misra-Gries pass finds the digests that may hold a large share of the rows.  Their exact
counts and winners (at most ``counters`` rows) are broadcast, so copies of a frequent text
are decided where they are read and never meet in one task.  The other digests, none of
which holds more than 1/``counters`` of the rows, go through an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.llm.common import all_of, saved, unused

SUMMARY = "digest string, n long"


def misra_gries(counters: int):
    """A ``mapInArrow`` function that merges (digest, n) batches into one summary.

    A batch is added exactly; when more than ``counters`` digests are held, the
    (counters+1)-th largest count is taken from all and those at zero leave.  Every digest
    with over 1/(counters+1) of the weight stays, in any order and nesting of merges.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"digest": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        for batch in batches:
            got = pa.table({"digest": batch.column("digest").cast(pa.string()), "n": batch.column("n")})
            held = pa.concat_tables([held, got]).group_by("digest").aggregate([("n", "sum")])
            held = pa.table({"digest": held["digest"], "n": held["n_sum"]})
            if held.num_rows > counters:
                cut = pc.sort_indices(held["n"], sort_keys=[("", "descending")])[counters]
                left = pc.subtract(held["n"], held["n"][cut.as_py()])
                held = pa.table({"digest": held["digest"], "n": left}).filter(pc.greater(left, 0))
        yield from held.combine_chunks().to_batches()

    return merge


def frequent_digests(digests: DataFrame, counters: int = 1024, fan_in: int = 16) -> DataFrame:
    """At most ``counters`` digests (``digest``, ``n`` a lower bound), among them every digest
    that holds over 1/(counters+1) of the rows.  Summaries are merged in two steps."""
    merge = misra_gries(counters)
    ones = digests.select("digest", F.lit(1).cast("long").alias("n"))
    parts = ones.mapInArrow(merge, SUMMARY).repartition(fan_in).mapInArrow(merge, SUMMARY)
    return parts.repartition(1).mapInArrow(merge, SUMMARY)


def place() -> Column:
    """What orders the rows of a text: the last stays."""
    return F.struct(F.col("id").isNotNull(), "id", "row")


def keyed_with_winners(docs: DataFrame, id_col: str, text_col: str, counters: int) -> tuple[DataFrame, DataFrame]:
    """The rows as (``id``, ``digest``, ``row``), and of the frequent digests, at most ``counters``,
    the row that stays (``best``) and their exact count (``size``).  Both are written tables."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = saved(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.sha2(text, 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-digests",
    )
    frequent = F.broadcast(frequent_digests(keyed, counters).select("digest"))
    winners = keyed.join(frequent, "digest", "left_semi").groupBy("digest").agg(F.max(place()).alias("best"), F.count("*").alias("size"))
    return keyed, saved(winners, "exact-winners")


def decided(keyed: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of ``keyed`` with ``best`` and ``size`` of their text: those of frequent digests
    by the broadcast ``winners``, the others by a shuffle."""
    marked = keyed.join(F.broadcast(winners), "digest", "left")
    rest = marked.filter(F.col("size").isNull()).select("id", "digest", "row")
    rest = rest.join(rest.groupBy("digest").agg(F.max(place()).alias("best"), F.count("*").alias("size")), "digest")
    cols = ["id", "digest", "row", "best", "size"]
    return marked.filter(F.col("size").isNotNull()).select(cols).unionByName(rest.select(cols))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical; null counts as the empty text.  Of equal texts
    the row with the largest id stays (a null id loses to any other).  Rows that repeat the
    winner's id as well as its text are told apart by their place in the input, so exactly
    one row of a group is kept.  An empty table gives an empty result; other columns of
    ``docs`` are ignored.
    """
    rows = decided(*keyed_with_winners(docs, id_col, text_col, counters))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, all columns unchanged, whatever their names.

    Copies of a frequent text leave where they are read, by the broadcast winners, and are never
    moved.  Rows that share both id and text are one row; rows of null id stay only where their
    whole group has none.  Null counts as the empty text; an empty table gives an empty result.
    """
    keyed, winners = keyed_with_winners(docs, id_col, text_col, counters)
    names = unused(docs, "id", "no_id", "sha")  # plain columns, so that both steps use one shuffle of the texts

    def by_name(df: DataFrame, number: Column, sha: Column) -> DataFrame:
        return df.withColumns(dict(zip(names, [F.coalesce(number, F.lit(0)), number.isNull(), sha])))

    kept = decided(keyed, winners).filter(F.col("row") == F.col("best.row")).select(F.col("id").alias("kept_id"), F.col("digest").alias("kept_sha"))
    keep = by_name(kept, F.col("kept_id"), F.col("kept_sha")).select(names)
    rows = by_name(docs, docs[id_col].cast("long"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    number, no_id, sha = names
    best = winners.select(F.col("digest").alias("best_sha"), F.coalesce("best.id", F.lit(0)).alias("best_id"), F.col("best.id").isNull().alias("best_no_id"))
    beaten = (rows[sha] == best["best_sha"]) & ((rows[number] != best["best_id"]) | (rows[no_id] != best["best_no_id"]))
    left = rows.join(F.broadcast(best), beaten, "left_anti")
    return left.dropDuplicates(names).join(keep, names, "left_semi").select(all_of(docs))
