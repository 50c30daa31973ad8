"""The command line: load a dump with CSV dimensions, check it, run reports."""

from __future__ import annotations

import contextlib
import io
import tempfile

from liftwise.__main__ import main
from tests.conftest import DATA


def run(*argv: str) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        assert main(list(argv)) == 0
    return buf.getvalue()


def test_load_check_report(spark):
    out = tempfile.mkdtemp(prefix="liftwise-cli-") + "/tables"
    run("load", "--dump", f"{DATA}/mini_dump.sql", "--campaigns-csv", f"{DATA}/campaigns.csv", "--out", out)
    checks = run("check", "--tables", out)
    assert "orphan" in checks and "duplicate_key" in checks
    text = run("report", "campaign_revenue", "store_count_by_city", "--tables", out)
    assert "Alpha" in text and "North" in text
    shared = run("report", "promo_isu", "category_isu_diwali", "--tables", out, "--shared-view", out + "-view")
    assert "BOGOF" in shared
    assert "sales_summary" in run("list")
    sql = run("sql", "SELECT promo_type, SUM(ISU) AS isu FROM sales_summary GROUP BY promo_type", "--tables", out)
    assert "BOGOF" in sql and "isu" in sql
    files = tempfile.mkdtemp(prefix="liftwise-cli-")
    run("report", "sales_summary", "promo_isu", "--tables", out, "--out", files)
    assert spark.read.option("header", True).csv(f"{files}/promo_isu").count() == len(run("report", "promo_isu", "--tables", out).splitlines()) - 2
    whole = run("sql", "SELECT id FROM range(3000)", "--tables", out).splitlines()
    assert len(whole) == 3001 and len(run("sql", "SELECT id FROM range(3000)", "--tables", out, "--rows", "5").splitlines()) == 6
