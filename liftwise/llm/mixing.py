"""Mixing sources to target weights.

Every document gets a hash-random key.  The keys are cut into equal ranges; sums per source
and range give each range's offset (a prefix sum over few rows), and a window inside a range
gives each document's place, so the prefix sum of a source of any size is spread over many
tasks.  A source is cut at its exact budget, after whole repeats (epochs) where the budget
exceeds the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftwise.llm.common import WORD, all_of, quoted, saved, unused, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source (``sk``, ``size``): the words the mix is to take, as ``target``.

    ``share`` of all words is dealt out by weight (repeating over the sources by code point,
    null last).  A source stops at ``most`` times its size and the excess goes to the others
    by weight: with the sources sorted by size/weight, the target is weight x level or the
    cap, where the level is the one at which the targets add up.
    """
    every = Window.orderBy("sk")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(every) - 1) % len(weights) + 1)
    capped = sizes.withColumn("w", w).withColumn("cap", F.col("size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.least(F.sum("size").over(whole) * F.lit(float(share)), F.sum("cap").over(whole))
    # The level if all sources before this one are at their cap.
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    open_ = capped.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    # Levels rise up to the first source that fits and fall from there on.
    shared = F.max(F.when(F.col("fits"), F.col("level"))).over(whole)
    return open_.select("sk", F.least(F.col("cap"), F.coalesce(F.col("w") * shared, F.col("cap"))).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``taken``.

    ``size`` counts words (null text: 0); ``taken`` is how many of them the mix takes,
    repeats counted: size x epochs, and once more those that lie before the cut.  The
    document at the cut is taken in part, so a source's ``taken`` adds up to its target
    rounded to a whole word.  Keys depend on id, text and seed alone, so reruns agree,
    and different texts under one id, null ids too, are spread over the ranges; equal rows are interchangeable.  A null source is
    a source of its own, last in order.  Sources without words and empty tables give zeros
    and no rows.
    """
    sized = saved(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).alias("source"),
            F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("sk"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col)).alias("key"),
        ),
        "mix-sizes",
    )
    count = sized.agg(F.count("*").alias("n")).first()["n"]
    ranges = max(1, int(count**0.5))  # as many ranges as rows in one: both grow with the root of the input
    high = F.shiftrightunsigned("key", 33)  # the key's upper 31 bits, evenly spread
    ranged = sized.withColumn("range", F.shiftright(high * F.lit(min(ranges, 2**31)).cast("long"), 31).cast("int"))

    per_range = ranged.groupBy("sk", "range").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("sk").orderBy("range")
    offsets = per_range.select("sk", "range", (F.sum("words").over(order) - F.col("words")).alias("offset"))
    totals = per_range.groupBy("sk").agg(F.sum("words").alias("size"))
    targets = totals.join(source_targets(totals, weights, share, most), "sk")
    budget = F.round("target").cast("long")
    full = F.when(F.col("size") > 0, F.floor(budget / F.col("size"))).otherwise(0).cast("long")
    targets = targets.select("sk", F.col("size").alias("source_size"), "target", full.alias("epochs"), (budget - full * F.col("size")).alias("left_over"))

    inside = Window.partitionBy("sk", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("through", F.sum("size").over(inside)).join(offsets, ["sk", "range"]).join(targets, "sk")
    start = F.col("offset") + F.col("through") - F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("left_over") - start))
    return placed.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with their columns, each as often as it is taken.

    A document taken twice appears twice; the one at a source's cut appears once more with
    its first words only, joined by single spaces (``chars_col`` follows, if there is one).
    Documents without words are not taken.  Rows that share id and size are taken alike.  The
    columns of ``docs`` may have any names; an empty table gives an empty result.
    """
    mixed = mix(docs, id_col, text_col, **options)
    number, size_name, taken_name, copy_name = unused(docs, "mix_id", "mix_size", "mix_taken", "mix_copy")
    size, taken, copy = F.col(size_name), F.col(taken_name), F.col(copy_name)
    most = mixed.groupBy(F.col("doc_id").alias(number), F.col("size").alias(size_name)).agg(F.max("taken").alias(taken_name))
    same = docs[id_col].cast("long").eqNullSafe(F.col(number)) & (word_count(docs[text_col]) == size)
    rows = docs.join(most.filter(taken > 0), same)
    rows = rows.withColumn(copy_name, F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    words = taken - (copy - 1) * size
    part = words < size
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(words, F.lit(1)).cast("int")), " ")
    text = F.when(part, first).otherwise(F.col(text_col))
    cols = dict(zip(docs.columns, all_of(docs))) | {text_col: text}
    if chars_col in docs.columns:
        cols[chars_col] = F.when(part, F.length(text).cast(docs.schema[chars_col].dataType)).otherwise(F.col(quoted(chars_col)))
    return rows.select(*[v.alias(c) for c, v in cols.items()])
