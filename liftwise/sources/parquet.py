"""Bulk load and scan of the four tables as Parquet.

The fact table is written partitioned by ``campaign_id``: a report that filters on one
campaign then reads only that folder, through dynamic partition pruning on the
broadcast campaign join.  Inside each write task the rows are sorted by promotion type
(a local sort the partitioned write needs anyway, by campaign, extended by one key):
row groups then hold few promotion types, so a pushed-down filter on one type (Q1)
skips the others, and the column compresses better.  ``records_per_file`` bounds each
output file, so that a scan has many splits to run in parallel whatever the layout of
the input was.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from liftwise.operators.star import DEFAULT_BROADCAST_MAX_BYTES, VIEW_KEYS, broadcast_small_dims, net_measures, rollup
from liftwise.sources.checks import orphans, verify_keys
from liftwise.tables import Tables

DIMENSIONS = ("stores", "campaigns", "products")
DEFAULT_RECORDS_PER_FILE = 4_000_000


def write_tables(t: Tables, path: str, records_per_file: int = DEFAULT_RECORDS_PER_FILE) -> None:
    """Write fact and dimensions as a new version under ``path`` (a folder on shared storage on a cluster).

    A version is complete once its manifest names it, the last thing written: a load that
    fails leaves the version before in use.  A folder name cannot tell an empty campaign id
    from NULL, so an empty one is an error.
    """
    version = uuid.uuid4().hex
    _write_fact(t.fact, f"{path}/{version}/fact", records_per_file)
    for dim in DIMENSIONS:
        getattr(t, dim).write.option("maxRecordsPerFile", records_per_file).parquet(f"{path}/{version}/{dim}")
    schemas = {n: getattr(t, n).schema for n in ("fact", *DIMENSIONS)}
    _record(t.fact.sparkSession, path, Load(version, [version], schemas))


def _write_fact(fact: DataFrame, path: str, records_per_file: int) -> None:
    empty = F.col("campaign_id").cast("string") == ""
    kept = F.when(empty, F.raise_error(F.lit("a fact has an empty campaign_id"))).otherwise(F.col("campaign_id"))
    fact = fact.withColumn("campaign_id", kept)
    order = [c for c in ("campaign_id", "promo_type") if c in fact.columns]
    writer = fact.sortWithinPartitions(*order).write.option("maxRecordsPerFile", records_per_file)
    writer.partitionBy("campaign_id").parquet(path)


@dataclass(frozen=True)
class Load:
    """One line of the manifest: which folders under the path make up the tables."""

    version: str  # the dimensions' folder
    facts: list[str]  # folders of the fact: the first load and what was appended
    schemas: dict[str, StructType]
    keys_verified: bool = False
    summary: str | None = None  # folder of the view's sums over exactly these facts


MANIFEST = "version string, keys_verified boolean, written timestamp, facts array<string>, summary string, " + ", ".join(f"{n}_schema string" for n in ("fact", *DIMENSIONS))


def _record(spark: SparkSession, path: str, load: Load) -> None:
    """Make ``load`` the one in use: one more line in the manifest."""
    row = [F.lit(load.version).alias("version"), F.lit(load.keys_verified).alias("keys_verified"), F.current_timestamp().alias("written")]
    row += [F.array(*[F.lit(f) for f in load.facts]).alias("facts"), F.lit(load.summary).cast("string").alias("summary")]
    row += [F.lit(s.json()).alias(f"{n}_schema") for n, s in load.schemas.items()]
    spark.range(1).select(*row).write.mode("append").json(f"{path}/manifest")


def _latest(spark: SparkSession, path: str) -> Load:
    entry = spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy(F.desc("written")).first()
    if entry is None:
        raise FileNotFoundError(f"no complete load under {path}")
    schemas = {n: StructType.fromJson(json.loads(entry[f"{n}_schema"])) for n in ("fact", *DIMENSIONS)}
    return Load(entry["version"], entry["facts"] or [entry["version"]], schemas, entry["keys_verified"], entry["summary"])


def read_tables(spark: SparkSession, path: str, broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES) -> Tables:
    """Read the tables last written under ``path``, with the schemas written beside them.

    Small dimensions are broadcast; ``keys_verified`` holds if :func:`mark_verified` recorded
    a clean check of this very load; the view's sums are used where :func:`write_summary`
    has stored them.
    """
    load = _latest(spark, path)
    parts = [spark.read.schema(load.schemas["fact"]).parquet(f"{path}/{f}/fact").select(load.schemas["fact"].names) for f in load.facts]
    fact = reduce(DataFrame.unionByName, parts)
    dims = {n: spark.read.schema(load.schemas[n]).parquet(f"{path}/{load.version}/{n}").select(load.schemas[n].names) for n in DIMENSIONS}
    summary = spark.read.parquet(f"{path}/{load.summary}/summary") if load.summary else None
    return broadcast_small_dims(Tables(fact=fact, **dims, keys_verified=load.keys_verified, summary=summary), broadcast_max_bytes)


def write_summary(spark: SparkSession, path: str) -> Tables:
    """Store the view's sums of the load in use (S9, A7); later reads of it share them."""
    load, folder = _latest(spark, path), uuid.uuid4().hex
    t = read_tables(spark, path).with_summary(None)
    rollup(t, VIEW_KEYS, net_measures()).write.parquet(f"{path}/{folder}/summary")
    _record(spark, path, replace(load, summary=folder))
    return read_tables(spark, path)


def append_facts(spark: SparkSession, path: str, facts: DataFrame, records_per_file: int = DEFAULT_RECORDS_PER_FILE) -> Tables:
    """Add ``facts`` to the load in use, as a new version that keeps the folders it has.

    Stored sums of the view are kept up: the new facts are summed alone and merged with them,
    so facts loaded before are not read again.  ``keys_verified`` stays if every new fact
    finds its dimension rows (the dimensions are unchanged).  Many small appends make many
    folders; ``write_tables(read_tables(...), path)`` puts them together.
    """
    load, folder = _latest(spark, path), uuid.uuid4().hex
    schema = load.schemas["fact"]
    _write_fact(facts.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]), f"{path}/{folder}/fact", records_per_file)
    before = read_tables(spark, path)
    added = before.with_fact(spark.read.schema(schema).parquet(f"{path}/{folder}/fact").select(schema.names))
    if load.summary:
        new = rollup(added, VIEW_KEYS, net_measures())
        merged = before.summary.unionByName(new).groupBy(*VIEW_KEYS).agg(*[F.sum(n).alias(n) for n in net_measures()])
        merged.write.parquet(f"{path}/{folder}/summary")
    verified = load.keys_verified and orphans(added).agg(F.sum("violations")).first()[0] == 0
    _record(spark, path, replace(load, facts=[*load.facts, folder], keys_verified=verified, summary=folder if load.summary else None))
    return read_tables(spark, path)


def mark_verified(spark: SparkSession, path: str) -> Tables:
    """Check the keys of the last load and, if they hold, record that beside the tables:
    later reads need no further pass over the fact.  Returns the tables as checked."""
    load = _latest(spark, path)
    t = read_tables(spark, path)
    if not t.keys_verified:
        t = verify_keys(t)
        if t.keys_verified:
            _record(spark, path, replace(load, keys_verified=True))
    return t
