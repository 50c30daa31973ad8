from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from liftwise.llm.mixing import mix, mixed_documents
from tests.llm.conftest import with_clashes


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s] + 1e-9}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_cuts(docs):
    rows = mix(with_clashes(docs)).collect()
    source_sizes: dict = {}
    for r in docs.collect():
        source_sizes[r["source"]] = source_sizes.get(r["source"], 0) + size(r["text"])
    want = plain_targets(source_sizes)
    assert len(rows) == docs.count()
    for s, total in source_sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {total}
        assert own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 0.5 + 1e-6
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        # Whole repeats, and at most one document in part.
        assert sum(r["size"] > 0 and r["taken"] % r["size"] != 0 for r in own) <= 1


def test_reruns_and_partitions_agree(docs):
    key = lambda df: Counter(map(tuple, df.select("doc_id", "size", "taken").collect()))
    assert key(mix(docs)) == key(mix(docs.repartition(7)))


def test_mixed_rows_hold_the_words_taken(docs):
    once = docs.dropDuplicates(["doc_id"])
    out = mixed_documents(once)
    assert out.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mix(once).collect()}
    words: Counter = Counter()
    for r in out.collect():
        words[r["doc_id"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"]) or r["doc_id"] is None
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_empty_and_wordless(no_docs, docs):
    assert mix(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0
    blank = docs.withColumn("text", F.lit(" "))
    assert {(r["taken"], r["target"]) for r in mix(blank).collect()} == {(0, 0.0)}
