"""The ``sales_summary`` view kept current while fact files arrive (Structured Streaming).

The original loads a static dump and has no streaming.  This module adds no new
metric: it runs the same roll-up as :func:`liftwise.operators.star.summarise` on a
file stream of fact Parquet, joined to static dimensions (stream-static inner joins),
in ``complete`` or ``update`` output mode.  The state holds one row per group of the
report grain, so it is bounded by the dimensions, not by the stream.  Progress is
kept under the session's ``spark.checkpoint.dir`` so a restarted query resumes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from liftwise.operators.star import VIEW_KEYS, summarise
from liftwise.session import ensure_checkpoint_dir
from liftwise.tables import Tables


def fact_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame over the fact Parquet files under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_summary(dims: Tables, fact: DataFrame, by: Sequence[str] = VIEW_KEYS) -> DataFrame:
    """The view's metrics at grain ``by`` over a streaming ``fact`` and static dimensions.

    One aggregation only: a stream allows no second one, so eager aggregation is off.  No
    dimension is left out: keys verified on another fact say nothing about the stream.
    """
    return summarise(dims.with_fact(fact), by, eager=False)


def start_summary(
    summary: DataFrame,
    name: str,
    sink: str,
    output_mode: str = "update",
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start the query into ``sink`` (a format name; ``memory`` keeps the whole view on the
    driver and is for tests).  The checkpoint defaults to ``{spark.checkpoint.dir}/{name}``."""
    spark = summary.sparkSession
    location = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    writer = summary.writeStream.outputMode(output_mode).option("checkpointLocation", location).queryName(name)
    return writer.format(sink).start()
