"""Vector codes against plain k-means, bounds against measured distances, awkward rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from liftwise.llm.vector_codes import compress_vectors, group_of, measured, net_displacements
from tests.llm.conftest import with_clashes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """The definition in whole numbers, every part measured against every entry in every round."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wide = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * wide - len(v)), lab) for i, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * wide : (p + 1) * wide] for _, v, _ in first] for p in range(parts)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * wide : (p + 1) * wide], e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        found = [[nearest(v, p)[0] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(first)):
                members = [v[p * wide : (p + 1) * wide] for (_, v, _), f in zip(kept, found) if f[p] == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    coded = [(i, [nearest(v, p) for p in range(parts)], lab) for i, v, lab in kept]
    sums = {}
    for _, c, lab in coded:
        sums[lab] = sums.get(lab, 0) + sum(d for _, d in c)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e, _ in c), sum(d for _, d in c), sums[lab], digest) for i, c, lab in coded), key=repr)


def got(df, **options):
    rows = compress_vectors(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def awkward():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), None if i % 5 == 0 else i % 3) for i in range(60)]
    rows += [(100, None, 1), (101, [0.5, None] * 4, 1), (102, [float("nan")] + [0.0] * 7, 1), (103, [float("inf")] * 8, None), (104, [-float("inf")] * 8, 2)]
    rows += [rows[3], rows[3], (7, rows[20][1], 2), (None, rows[21][1], 1)]  # repeats, one id twice, a null id
    rows += [(200 + i, rows[2][1], 0) for i in range(40)]  # one vector many times
    return rows + [(300, [0.25, -0.25], 1), (301, [], 1)]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_equals_the_plain_rounds(spark, rounds):
    df = with_clashes(spark.createDataFrame(awkward(), SCHEMA)).repartition(5)
    assert got(df, parts=4, entries=16, rounds=rounds) == plain(awkward(), 4, 16, rounds)


def test_fewer_rows_than_entries_and_none(spark):
    few = awkward()[:3]
    assert got(spark.createDataFrame(few, SCHEMA), parts=4) == plain(few, 4, 64, 2)
    empty = compress_vectors(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and {"code", "label_error"} <= set(empty.columns)
    assert compress_vectors(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_a_vector_beyond_whole_numbers_is_an_error(spark):
    with pytest.raises(Exception, match="too long for exact"):
        compress_vectors(spark.createDataFrame([(1, [1e30], 1)], SCHEMA)).collect()


def test_bounds_save_scans(spark):
    """Parts far from all other entries are not measured again."""
    rng = np.random.default_rng(1)
    rows = [(i, ((i % 8) * 10 + rng.normal(scale=0.01, size=4)).tolist(), 0) for i in range(400)]
    out = compress_vectors(spark.createDataFrame(rows, SCHEMA), parts=2, entries=8, rounds=2)
    assert out.agg(F.sum("scans")).first()[0] == 0
    assert got(spark.createDataFrame(rows, SCHEMA), parts=2, entries=8) == plain(rows, 2, 8, 2)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 4), st.integers(0, 2**32))
def test_net_displacement_bounds_hold(entries, groups, seed):
    """A stored bound less the net displacement stays below the distance to every entry of the group."""
    rng = np.random.default_rng(seed)
    history = rng.integers(-50, 50, (4, 1, entries, 3))
    x = rng.integers(-60, 60, (20, 3))
    moved, of = net_displacements(history, groups), group_of(entries, groups)
    drift = sum(np.sqrt(((history[t + 1] - history[t]).astype(float) ** 2).sum(axis=2)) for t in range(3))[0]
    for stamp in range(4):
        code, _, low = measured(x, history[stamp][0], groups)
        now = np.sqrt(((x[:, None] - history[3][0][None]) ** 2).sum(axis=2).astype(float))
        now[np.arange(20), code] = np.inf
        for g in range(groups):
            assert (low[:, g] - moved[stamp, 0, g] <= now[:, of == g].min(axis=1, initial=np.inf) + 1e-3).all()
            if stamp == 0:  # never looser than the sum of drifts
                assert moved[0, 0, g] <= drift[of == g].max(initial=0.0) + 1e-9
