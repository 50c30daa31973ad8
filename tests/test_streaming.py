"""The view over a file stream equals the batch view (Structured Streaming)."""

from __future__ import annotations

import tempfile

from liftwise.operators.star import sales_summary
from liftwise.streaming.summary import fact_stream, start_summary, stream_summary


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_stream_summary_equals_batch(spark, hand):
    scratch = tempfile.mkdtemp(prefix="liftwise-stream-")
    path = scratch + "/fact"
    hand.fact.repartition(3).write.parquet(path)
    stream = fact_stream(spark, path, hand.fact.schema, files_per_trigger=1)
    # A new checkpoint per run: a stable one would resume the previous run's stream.
    query = start_summary(stream_summary(hand, stream), "hand_summary_stream", sink="memory", output_mode="complete", checkpoint=scratch + "/ckpt")
    try:
        query.processAllAvailable()
        got = spark.table("hand_summary_stream").collect()
    finally:
        query.stop()
    assert bag(got) == bag(sales_summary(hand).collect())
