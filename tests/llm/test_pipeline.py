"""The pipeline's stages against brute force, and the entry point without the subpackage."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from liftwise.llm.common import table
from liftwise.llm.exact_dedup import drop_copies
from liftwise.llm.language_id import known_language
from liftwise.llm.mixing import mixed_documents
from liftwise.llm.simhash import keep_one_of_each
from tests.llm.test_mixing import plain_targets, size
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after every stage, the documents first."""
    from liftwise.llm.common import saved

    docs, rows = table(spark, SF, "documents"), []
    rows.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), f"test-{name}")
        rows.append(docs.collect())
    return rows


def test_filters_keep_what_brute_force_keeps(steps):
    raw, known, exact, near, _, _ = steps
    assert Counter(map(tuple, known)) == Counter(tuple(r) for r in raw if re.search(r"[^\W\d_]", r["text"] or ""))
    last: dict[str, int] = {}
    for r in known:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(map(tuple, exact)) == sorted(tuple(r) for r in known if last[r["text"]] == r["doc_id"])
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in exact}
    roots = plain_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert sorted(map(tuple, near)) == sorted(tuple(r) for r in exact if roots[r["doc_id"]] == r["doc_id"])


def test_mix_and_pieces(steps):
    near, mixed, pieces = steps[3:]
    sizes: Counter = Counter()
    for r in near:
        sizes[r["source"]] += size(r["text"])
    want, have = plain_targets(sizes), Counter()
    for r in mixed:
        have[r["source"]] += size(r["text"])
    assert all(abs(have[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    assert all(r["round_trip"] for r in pieces)
    assert Counter(r["doc_id"] for r in pieces if r["sample"] == 0) == Counter(r["doc_id"] for r in mixed)


def test_run_equals_the_stages(spark, steps):
    key = lambda rows: Counter((r["doc_id"], r["sample"], hashlib.sha256(str(r["ids"]).encode()).digest()) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(steps[-1])


OWN = "id no_id sha kept_id kept_sha best_sha best_id best_no_id found mix_id mix_size mix_taken mix_copy digest best size row fp key parts component_id".split()


@pytest.mark.parametrize("stage", [known_language, drop_copies, keep_one_of_each, mixed_documents])
def test_stages_keep_columns_of_any_name(spark, docs, no_docs, stage):
    extra = [*OWN, *(f"_{n}" for n in OWN), *(f"__{n}" for n in OWN), "__Language", "a.b", "a`b"]
    wide = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in extra})
    got = stage(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    for r in rows:
        number = "-" if r["doc_id"] is None else r["doc_id"]
        assert list(r)[len(docs.columns) :] == [f"{c}{number}" for c in extra]
    assert Counter(tuple(r)[: len(docs.columns)] for r in rows) == Counter(map(tuple, stage(docs).collect()))
    assert stage(no_docs).columns == docs.columns and stage(no_docs).count() == 0


def test_language_stage_drops_only_texts_without_letters(spark):
    langs = [f"l{i}" for i in range(24)]  # so many that the best of them has a low probability
    rows = [(i, f"{chr(97 + i % 24)}x river stone {i % 7}", langs[i % 24], "s", 1) for i in range(480)]
    rows += [(1000, "zq", None, "s", 1), (1001, "17 + 4", "l1", "s", 1), (1002, None, "l2", "s", 1)]
    kept = known_language(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {1001, 1002}


def test_copies_of_frequent_texts_leave_by_the_winners(spark):
    rows = [(i, "hot", "en", "s", 3) for i in range(300)] + [(299, "hot", "en", "s", 3)] * 3 + [(None, "hot", None, None, 3), (299, "other", "en", "s", 5), (None, "none", None, None, 4), (None, "none", None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    want = [(299, "hot"), (299, "other"), (None, "none")]
    for counters in (1, 2, 1024):  # none, some or all of the texts are frequent
        assert sorted(((r["doc_id"], r["text"]) for r in drop_copies(docs, counters=counters).collect()), key=str) == sorted(want, key=str)


def test_entry_works_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "liftwise", ".git"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    os.mkdir(tmp_path / "liftwise")
    for name in os.listdir(os.path.join(ROOT, "liftwise")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "liftwise", name), tmp_path / "liftwise" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sales_summary' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)
    code = "import __spark_entry__ as e; q = e.queries(); n = [k.split('_')[0] for k in q if k.startswith('op')]; assert sorted(n) == sorted(f'op{i}' for i in range(1, 14)) and 'pipeline' in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, env=env, check=True)
