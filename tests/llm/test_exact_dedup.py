from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa

from liftwise.llm.exact_dedup import drop_copies, exact_dedup, frequent_digests, misra_gries
from tests.llm.conftest import with_clashes


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    result = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            result.append((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(result)


def test_every_row_its_group(docs):
    rows = docs.collect()
    got = exact_dedup(with_clashes(docs), counters=2).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text"] or "" for r in rows})


def test_hot_and_rare_digests_agree(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}", None, None, 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = exact_dedup(docs, counters=4).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected(docs.collect())


def test_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0
    assert drop_copies(no_docs).columns == no_docs.columns


def test_one_row_of_every_text_stays(docs):
    left = drop_copies(docs).collect()
    assert Counter(r["text"] or "" for r in left) == Counter({r["text"] or "": 1 for r in docs.collect()})
    assert {r["doc_id"] for r in left if r["text"] == docs.filter("doc_id = 1").first()["text"]} == {2}


def test_misra_gries_keeps_the_frequent():
    rng = random.Random(3)
    items = ["a"] * 400 + ["b"] * 300 + [f"x{i}" for i in range(300)]
    rng.shuffle(items)
    batches = [pa.record_batch({"digest": items[i : i + 70], "n": pa.array([1] * len(items[i : i + 70]), pa.int64())}) for i in range(0, 1000, 70)]
    parts = [list(misra_gries(3)(iter(batches[i::4]))) for i in range(4)]
    merged = pa.Table.from_batches([b for p in parts for b in p])
    final = pa.Table.from_batches(list(misra_gries(3)(iter(merged.to_batches())))).to_pydict()
    assert len(final["digest"]) <= 3 and {"a", "b"} <= set(final["digest"])
    assert all(n <= items.count(d) for d, n in zip(final["digest"], final["n"]))


def test_frequent_digests_bound(spark):
    digests = spark.createDataFrame([("hot",)] * 200 + [(f"d{i}",) for i in range(200)], "digest string").repartition(7)
    got = [r["digest"] for r in frequent_digests(digests, counters=5).collect()]
    assert "hot" in got and len(got) <= 5
