"""Embedding rows as rows of whole numbers, shared by the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.llm.common import saved

SCALE = 256
# Bound of the sum of squares of a scaled vector: inner products and squared distances of any
# two such vectors then fit in 63 bits.
MOST_SQUARES = 2.0**61


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole_vectors(
    rows: DataFrame, vector_col: str, columns: dict[str, Column], where: Column | None = None, multiple: int = 1
) -> tuple[DataFrame, int]:
    """The usable rows, saved, and the common width of their vectors.

    Columns: ``row`` (a number for each row, fixed from here on), ``columns``, and ``x``, the
    components as ``floor(256 * component)``.  Rows go whose vector is null or holds a null
    or non-finite component, and those that ``where`` does not hold for.  Shorter vectors
    are filled up with zeros to the longest, and that to a multiple of ``multiple``, which
    changes no inner product and no distance.  A vector too long for exact 63-bit results
    (about 1.5 * 10^9 after scaling) is an error.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double") * SCALE)
    kept = rows.select(F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in columns.items()], vector.alias("v"), *([] if where is None else [where.alias("w")]))
    kept = kept.filter(_usable(F.col("v")))
    if where is not None:
        kept = kept.filter("w").drop("w")
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    small = F.when(squares < MOST_SQUARES, F.transform("v", lambda x: F.floor(x)))
    x = F.coalesce(small, F.raise_error(F.lit("a vector is too long for exact whole-number products")))
    kept = saved(kept.select("row", *columns, x.alias("x")), "whole-vectors")
    longest = kept.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    width = max(1, -(-longest // multiple)) * multiple
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x")))
    return kept.withColumn("x", filled), width


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """An array column of whole numbers, all of one length, as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, width)


def matrix_column(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array column."""
    n, width = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).reshape(-1)))
