"""Benchmark: the view and all reports at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Flow, as a deployment would run it: the test tables are mapped to the promotion star
schema and loaded once as Parquet (timed as ``load``), the declared keys are verified
once (``verify_keys``: unused dimension joins may then be left out); every report then
runs against the loaded tables, one warm-up and the median of ``$BENCH_RUNS`` (5) runs, executed in
full through the no-op sink.  Extras: all reports straight from the raw test tables and
from the loaded tables before the check (one run each), the loaded and verified total with load and
check added, the flagship from the raw tables, eager against late aggregation, the two
forms of top/bottom-K, and all reports again
after the view's sums have been written once and shared (``materialize_summary``).

Prints one JSON line.  ``BENCH_EVENT_LOG=1`` also writes Spark's event log to a new
local folder (named on stderr) for offline stage timings.
"""

from __future__ import annotations

import json
import math
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from liftwise.operators.ranking import top_bottom_k_window  # noqa: E402
from liftwise.operators.star import materialize_summary, sales_summary, summarise  # noqa: E402
from liftwise.plans.reports import REPORTS  # noqa: E402
from liftwise.session import local_session, scratch_dir  # noqa: E402
from liftwise.sources.fixture import from_testdata  # noqa: E402
from liftwise.sources.parquet import mark_verified, read_tables, write_tables  # noqa: E402


# Spark settings recorded with the result.
SETTINGS = (
    "spark.master",
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.ansi.enabled",
    "spark.sql.files.maxPartitionBytes",
    "spark.driver.memory",
)


def execute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs: int) -> float:
    fn()
    times = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return round(statistics.median(times), 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None

    extra = {}
    if os.environ.get("BENCH_EVENT_LOG"):  # stage and task times, read offline (no UI)
        log_dir = tempfile.mkdtemp(prefix="liftwise-events-")
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir}
        print(f"event log: {log_dir}", file=sys.stderr)
    spark = local_session(cores=cpus, shuffle_partitions=cpus, app="liftwise-bench", extra=extra)
    work = scratch_dir(spark, "liftwise-bench")

    t0 = time.perf_counter()
    raw = from_testdata(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    per_file = max(10_000, math.ceil(rows / (2 * cpus)))
    write_tables(raw, work, records_per_file=per_file)
    load_sec = round(time.perf_counter() - t0, 4)
    t0 = time.perf_counter()
    loaded = read_tables(spark, work)
    tables = mark_verified(spark, work)
    verify_sec = round(time.perf_counter() - t0, 4)

    queries = {name: timed(lambda fn=fn: execute(fn(tables)), runs) for name, fn in REPORTS.items()}
    total = round(sum(queries.values()), 4)

    t0 = time.perf_counter()
    shared = materialize_summary(tables, f"{work}/sales_summary")
    view_sec = round(time.perf_counter() - t0, 4)
    with_view = {name: timed(lambda fn=fn: execute(fn(shared)), runs) for name, fn in REPORTS.items()}

    product_ir = summarise(tables, ["product_name", "category"]).select("product_name", "category", "IR")
    extras = {
        "flagship_from_raw_tables": timed(lambda: execute(sales_summary(from_testdata(spark, sf_dir))), runs),
        "sales_summary_eager": timed(lambda: execute(sales_summary(tables, eager=True)), runs),
        "top_bottom_k_window_form": timed(lambda: execute(top_bottom_k_window(product_ir, "IR", 3)), runs),
        "raw_reports_total_sec": round(sum(timed(lambda fn=fn: execute(fn(raw)), 1) for fn in REPORTS.values()), 4),
        "loaded_reports_total_sec": round(sum(timed(lambda fn=fn: execute(fn(loaded)), 1) for fn in REPORTS.values()), 4),
        "load_verify_and_reports_sec": round(load_sec + verify_sec + total, 4),
        "materialize_view_sec": view_sec,
        "reports_total_with_shared_view_sec": round(sum(with_view.values()), 4),
        "queries_with_shared_view": with_view,
    }
    print(
        json.dumps(
            {
                "metric": "reports_total_sec",
                "value": total,
                "unit": "sec",
                "queries": queries,
                "sf": sf,
                "cpus": cpus,
                "runs": runs,
                "load_sec": load_sec,
                "verify_keys_sec": verify_sec,
                "keys_verified": tables.keys_verified,
                "fact_rows": rows,
                "settings": {k: spark.conf.get(k) for k in SETTINGS},
                "extras": extras,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
