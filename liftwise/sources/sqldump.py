"""Rows of ``INSERT INTO t [(columns)] VALUES (...),(...);`` statements in a SQL dump.

A Spark job, not a SQL interpreter: the dump is read by byte ranges (many tasks for a large
dump, even of one statement), the tuples of the wanted table's INSERT statements are cut
out, and each is taken apart with regular expressions that skip
brackets and commas inside quoted strings.  Upper or lower case, column lists, a schema
name before the table, line breaks between tuples and several statements in one piece are
all read.  Statements other than INSERT, and other tables, are ignored.

Nothing of a wanted table is dropped: an INSERT that is not a list of value tuples (a
SELECT, an ON DUPLICATE KEY clause, a cut tuple), a tuple of the wrong length and a value
that is not of its column's type are errors.  A quoted 'NULL' is text, a bare NULL is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftwise.schemas import CAMPAIGNS, FACT, LEGACY_COLUMN_NAMES, PRODUCTS, STORES
from liftwise.sources.sqltext import VALUE_ROWS, dump_starts, insert_tuples, read_blocks, text_tuples

# What MySQL writes with a backslash and is not the character itself.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\u0000", "Z": "\u001a"}


def _unescaped(text: Column) -> Column:
    """A quoted value's text: quotes off, doubled quotes and backslash escapes resolved."""
    mark = "\u0002"  # stands for an escaped backslash meanwhile
    out = F.regexp_replace(F.regexp_replace(text, r"(?s)^'|'$", ""), "''", "'")
    out = F.replace(out, F.lit("\\\\"), F.lit(mark))
    for letter, char in ESCAPES.items():
        out = F.replace(out, F.lit("\\" + letter), F.lit(char))
    return F.replace(F.regexp_replace(out, r"(?s)\\(.)", "$1"), F.lit(mark), F.lit("\\"))


def _text(raw: Column) -> Column:
    """A value as written as its text: a bare NULL as NULL, strings without quotes and escapes."""
    inside = F.substring(raw, F.lit(2), F.length(raw) - 2)
    plain = ~(inside.contains("\\") | inside.contains("'") | inside.contains("\u0002"))
    text = F.when(raw.startswith("'"), F.when(plain, inside).otherwise(_unescaped(raw))).otherwise(raw)
    return F.when(raw.isNotNull() & (F.upper(raw) != "NULL"), text)


def _checked(ok: Column, value: Column, message: str, shown: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.substring(F.coalesce(shown, F.lit("")), 1, 200))))


def parse_insert_lines(lines: DataFrame, table: str, schema: T.StructType, column: str = "value") -> DataFrame:
    """Rows of every INSERT into ``table`` in the text ``column`` of ``lines``, typed by ``schema``.

    Without a column list the values go by position; with one, by name (columns of
    ``schema`` that it leaves out are NULL, others are ignored).
    """
    rows = lines.select(F.col(column).alias("text")).mapInArrow(text_tuples(table), VALUE_ROWS)
    return typed_tuples(rows, table, schema)


def typed_tuples(rows: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """``rows`` (``names``: column list or empty, ``v``: values as written) as columns of ``schema``."""
    bare = F.regexp_replace(F.regexp_replace("names", r"(?s)^\(|\)$", ""), r"[`\"\s]", "")
    values = rows.select(F.lower(bare).alias("names"), "v")
    old_names = {new: old for old, new in LEGACY_COLUMN_NAMES.items()}
    names = F.split("names", ",")
    width = F.when(F.col("names") == "", F.lit(len(schema.fields))).otherwise(F.size(names))
    values = values.withColumn("v", _checked(F.size("v") == width, F.col("v"), f"a tuple of {table} has the wrong length", F.array_join("v", ",")))
    # One function over the list instead of the same text functions for every column: these
    # made one method of the generated code, too long for the JVM to compile.
    values = values.withColumn("v", F.transform("v", _text))
    places = []
    for f in schema.fields:
        spellings = [f.name.lower(), *([old_names[f.name].lower()] if f.name in old_names else [])]
        place = F.greatest(*[F.array_position(names, s) for s in spellings], F.lit(0).cast("bigint"))
        places.append(F.get("v", (place - 1).cast("int")))
    texts = values.select(F.when(F.col("names") == "", F.col("v")).otherwise(F.array(*places)).alias("v"))
    out = []
    for i, f in enumerate(schema.fields):
        text = F.get("v", F.lit(i))
        typed = text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)
        out.append(_checked(text.isNull() | typed.isNotNull(), typed, f"not a {f.dataType.simpleString()} for {table}.{f.name}", text).alias(f.name))
    return texts.select(*out)


def read_insert_rows(
    spark: SparkSession, path: str, table: str, schema: T.StructType, block_bytes: int | None = None, starts: dict | None = None
) -> DataFrame:
    """Rows of every INSERT into ``table`` in the dump at ``path``, typed by ``schema``.

    The dump is read in blocks of ``block_bytes`` by as many tasks, also where it is one
    statement or one line (:mod:`liftwise.sources.sqltext`).
    """
    blocks = read_blocks(spark, path, block_bytes)
    return typed_tuples(insert_tuples(blocks, table, starts), table, schema)


def read_dump_tables(spark: SparkSession, path: str, block_bytes: int | None = None) -> dict[str, DataFrame]:
    """The four tables of the promotion dump: fact_events and the three dimensions.

    The blocks' starts are found in one pass and shared by the four tables.
    """
    starts = dump_starts(read_blocks(spark, path, block_bytes))

    def rows(table: str, schema: T.StructType) -> DataFrame:
        return read_insert_rows(spark, path, table, schema, block_bytes, starts)

    return {
        "fact": rows("fact_events", FACT),
        "stores": rows("dim_stores", STORES),
        "campaigns": rows("dim_campaigns", CAMPAIGNS),
        "products": rows("dim_products", PRODUCTS),
    }
