"""A third of all facts on one store, dimensions joined with a shuffle: the fact is summed by
key first, so no hot partition forms, and the results stay equal to the broadcast plan."""

from __future__ import annotations

import contextlib
import io
import tempfile

import pytest
from pyspark.sql import functions as F

from liftwise.operators.star import broadcast_small_dims
from liftwise.plans import reports as R
from liftwise.sources.fixture import from_testdata
from tests.conftest import SF_SMALL

PER_KEY = ["store_top_ir", "store_bottom_isu", "campaign_top_stores", "campaign_top_products"]
SKEW_CONF = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_hot_store_is_split_and_results_hold(spark):
    base = from_testdata(spark, SF_SMALL)
    hot = base.fact.select("store_id").first()[0]
    # A skewed partition is split by ranges of map tasks, so the fact is read from
    # many files, as a loaded fact is.
    path = tempfile.mkdtemp(prefix="liftwise-skew-") + "/fact"
    base.fact.withColumn(
        "store_id", F.when(F.pmod(F.col("event_id"), 3) == 0, F.lit(hot)).otherwise(F.col("store_id"))
    ).write.option("maxRecordsPerFile", 300).parquet(path)
    skewed_fact = spark.read.parquet(path)
    expected = bag(R.sales_summary(base.with_fact(skewed_fact)).collect())
    with conf(spark, SKEW_CONF):
        raw = from_testdata(spark, SF_SMALL, broadcast_max_bytes=0)
        shuffled = broadcast_small_dims(raw.with_fact(skewed_fact), max_bytes=0)
        df = R.sales_summary(shuffled)
        got = bag(df.collect())
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        stores = {name: bag(R.REPORTS[name](shuffled).collect()) for name in PER_KEY}
    assert got == expected
    # The fact is summed by the joined keys before any join, so a hot key is a few partial
    # sums by the time it moves: no join has a skewed side to split.
    joins = [line for line in buf.getvalue().splitlines() if "SortMergeJoin" in line]
    assert joins and "skew=true" not in buf.getvalue()
    late = base.with_fact(skewed_fact)
    assert stores == {name: bag(R.REPORTS[name](late).collect()) for name in PER_KEY}


@pytest.mark.parametrize("name", PER_KEY)
def test_only_sums_are_shuffled(spark, name):
    """Below every exchange of the fact's side there is a partial aggregate."""
    with conf(spark, SKEW_CONF):
        t = broadcast_small_dims(from_testdata(spark, SF_SMALL, broadcast_max_bytes=0), max_bytes=-1)
        plan = R.REPORTS[name](t)._jdf.queryExecution().sparkPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "l_discount" in line or "l_quantity" in line and "Scan" in line or "l_suppkey" in line and "Scan" in line)
    above = [line for line in lines[:scan] if "Join" in line or "Aggregate" in line]
    # From the scan upwards: the mapping's own join with part sizes, then the aggregate, then the dimensions.
    kinds = ["Aggregate" if "Aggregate" in line else "Join" for line in reversed(above)]
    assert "Aggregate" in kinds[:2]
