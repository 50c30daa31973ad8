"""Helpers shared by the operators: reading a table, scratch tables on the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftwise.session import scratch_dir

# White space of the word counts and shingles: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again.

    Cuts the lineage with files every executor can read, so a lost executor costs no
    recomputation of what came before and the rows stay the same for every later use.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it no column of ``df`` (case ignored)."""
    have = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        free.append(name)
    return free


def quoted(name: str) -> str:
    """A column's name as it is written in expressions, also where it holds dots or back quotes."""
    return "`" + name.replace("`", "``") + "`"


def all_of(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, to take from what was made of it."""
    return [F.col(quoted(c)) for c in df.columns]


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def word_count(text: Column) -> Column:
    """Number of words (runs without white space) of ``text`` as BIGINT; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
