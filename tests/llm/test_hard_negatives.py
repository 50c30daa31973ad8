"""Strassen products, mergeable lists and mined negatives against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from liftwise.llm.hard_negatives import NONE, Best, mine_hard_negatives, strassen
from tests.llm.conftest import with_clashes

SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(max_examples=60, deadline=None)
@given(st.tuples(*[st.integers(0, 23)] * 3), st.integers(1, 5), st.sampled_from([3, 2**20, 2**29]), st.integers(0, 2**32))
def test_strassen_is_exact(sides, leaf, most, seed):
    rng = np.random.default_rng(seed)
    m, k, n = sides
    a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
    assert (strassen(a, b, leaf).astype(object) == a.astype(object) @ b.astype(object)).all() if k else not strassen(a, b, leaf).any()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.integers(1, 40), st.integers(0, 2**32))
def test_lists_merge_in_any_order(k, n, seed):
    rng = np.random.default_rng(seed)
    entries = [(int(rng.integers(3)), int(rng.integers(-3, 4)), int(rng.integers(2)), int(rng.integers(5)), i) for i in range(n)]
    best = Best(3, k)
    order = rng.permutation(n)
    for part in np.array_split(order, 4):
        best.add(*(np.array([entries[i][c] for i in part], np.int64) for c in range(5)))
    expected = sorted(e for which in range(3) for e in sorted((e for e in entries if e[0] == which), key=lambda e: (-e[1], e[2], e[3], e[4]))[:k])
    assert sorted(zip(*(best.held[c].tolist() for c in ("list", "score", "no_id", "id", "row")))) == expected
    for which in range(3):
        mine = [e[1] for e in expected if e[0] == which]
        assert best.floor[which] == (min(mine) if len(mine) == k else NONE)


def test_offered_tiles_keep_ties(spark):
    scores = np.array([[5, 5, 5, 5, 5, 5, 5, 1, 9, 5]])
    best = Best(1, 3)
    best.offer(scores, np.ones_like(scores, bool), np.array([0]), np.arange(10)[::-1], np.zeros(10, np.int64), np.arange(10))
    assert sorted(best.held["id"].tolist()) == [0, 1, 3] and best.floor[0] == 5  # score 9 has id 1


def plain(rows, every=50, positives=5, negatives=3):
    kept = []
    for place, (i, v, lab) in enumerate(rows):
        if lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((place, i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    result = []
    for a in kept:
        if a[1] is None or a[1] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[3], r[3])), r) for r in kept if r[0] != a[0]]
        scored.sort(key=lambda s: (-s[0], s[1][1] is None, s[1][1] or 0))
        for ps, p in [s for s in scored if s[1][2] == a[2]][:positives]:
            inside = [s for s in scored if s[1][2] != a[2] and 50 * ps <= 100 * s[0] <= 95 * ps][:negatives]
            result += [(a[1], p[1], rank, r[1], ps, ns) for rank, (ns, r) in enumerate(inside, 1)]
    return sorted(result, key=repr)


def got(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % 50 == 0, label=label, **options).collect()), key=repr)


def awkward():
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) + 1).tolist(), i % 4) for i in range(260)]
    rows += [(1000 + i, rows[50][1], 2 if i % 2 else 3) for i in range(60)]  # a hot vector, ties
    rows += [(None, rows[50][1], 2), (None, rows[9][1], 1), (51, None, 2), (52, [1.0, None], 2), (53, [float("nan")] * 6, 2), (54, [float("inf")] * 6, 1), (55, rows[3][1], None)]
    rows += [rows[61], rows[61], (2000, [1.5, 0.5], 1), (2050, [], 1), (2100, [0.0] * 6, 2)]  # repeats, short, empty, zero
    return rows


@pytest.mark.parametrize("slab_bytes", [32 << 20, 100])
def test_equals_brute_force(spark, slab_bytes):
    df = with_clashes(spark.createDataFrame(awkward(), SCHEMA)).coalesce(1).repartition(3)
    assert got(df, slab_bytes=slab_bytes) == plain(awkward())


def test_a_repeated_anchor_is_two_anchors(spark):
    rows = awkward() + [awkward()[100]]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_without_anchors_labels_or_rows(spark):
    rows = awkward()
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([r for r in rows if r[0] is None or r[0] % 50], SCHEMA)) == []
    assert got(spark.createDataFrame([(i, v, 1) for i, v, _ in rows[1:7]] + [(50, rows[0][1], 1)], SCHEMA)) == []
    with pytest.raises(Exception, match="too long for exact"):
        got(spark.createDataFrame([(1, [1e30], 1)], SCHEMA))
