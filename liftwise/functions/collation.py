"""Declared collation (S6, T16): string columns that compare without regard to case and accents.

The original declares ``utf8mb4_0900_ai_ci`` on every table: equality, grouping, DISTINCT and
joins fold case and accents there.  Spark compares bytes unless a column carries a
collation, so :func:`collate_tables` types the string columns of all four tables with one;
joins then meet on collation keys, and groups, distinct rows, ranks and comparisons with
constants (promotion rules, filters) fold.  It is an option, as byte comparison is
cheaper (hash aggregation and exchange on the bytes themselves).

A group may hold several spellings.  Results show the first in byte order
(:func:`grouped`), so they do not depend on which row came first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from liftwise.tables import Tables

# The counterpart of utf8mb4_0900_ai_ci, and byte comparison.
DECLARED = "UNICODE_CI_AI"
BINARY = "UTF8_BINARY"


def is_collated(kind: DataType) -> bool:
    return isinstance(kind, StringType) and kind.collation != BINARY


def collated(df: DataFrame, collation: str = DECLARED, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with its string columns (or those named) under ``collation``; values unchanged."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and (columns is None or f.name in columns)]
    return df.withColumns({n: F.collate(F.col(f"`{n}`"), collation) for n in names}) if names else df


def collate_tables(t: Tables, collation: str = DECLARED) -> Tables:
    """All four tables under ``collation``.  Keys that folding makes equal were not checked
    as such, and written sums were grouped by bytes, so neither is carried over; the
    dimensions keep their broadcast hints."""
    frames = {}
    for name in ("stores", "campaigns", "products"):
        hinted = F.broadcast if name not in t.shuffled_dims else (lambda df: df)
        frames[name] = hinted(collated(getattr(t, name), collation))
    return replace(t, fact=collated(t.fact, collation), **frames, keys_verified=False, summary=None)


def byte_strings(df: DataFrame) -> DataFrame:
    """``df`` with plain string columns again, for handing over."""
    names = [f.name for f in df.schema.fields if is_collated(f.dataType)]
    return df.withColumns({n: F.collate(F.col(f"`{n}`"), BINARY) for n in names}) if names else df


def grouped(df: DataFrame, by: Sequence[str], sums: Sequence[Column]) -> DataFrame:
    """``df.groupBy(*by).agg(*sums)``; a collated key shows its first spelling in byte order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    folded = [c for c in by if is_collated(kinds[c])]
    if not folded:
        return df.groupBy(*by).agg(*sums) if sums else df.select(*by).distinct()
    first = [F.min(F.collate(c, BINARY)).alias(f"_first_{i}") for i, c in enumerate(folded)]
    out = df.groupBy(*by).agg(*sums, *first)
    shown = {c: F.collate(f"_first_{i}", kinds[c].collation) for i, c in enumerate(folded)}
    return out.withColumns(shown).drop(*[f"_first_{i}" for i in range(len(folded))])


def distinct(df: DataFrame) -> DataFrame:
    """Distinct rows (A8); collated columns show their first spelling."""
    return grouped(df, df.columns, [])
