from __future__ import annotations

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from liftwise.llm.components import connected_components
from liftwise.llm.simhash import fingerprint, keep_one_of_each, simhash_components, spanning_links
from tests.llm.conftest import with_clashes


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉß \t\n\x0b\x1c x", max_size=60))
def test_fingerprint_by_definition(text):
    assert fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_components_against_brute_force(docs):
    rows = docs.collect()
    got = simhash_components(with_clashes(docs)).collect()
    prints = {plain_fingerprint(r["text"]) for r in rows}
    roots = plain_components(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    least: dict[int, int] = {}
    for r in rows:
        if r["doc_id"] is not None:
            root = roots[plain_fingerprint(r["text"])]
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    want = sorted((r["doc_id"] or -1, f"{plain_fingerprint(r['text']):016x}", least[roots[plain_fingerprint(r["text"])]]) for r in rows)
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in got) == want


def test_variants_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(40):  # chains and balls around each, at 1 to 6 bits
            x = b
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    from liftwise.llm import simhash as S

    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    keyed = nodes.select("fp", S.F.explode(S.variant_keys(S.F.col("fp"), 4)).alias("key"))
    for run in (1, 32):  # every key by its spanning links, and short runs by shifting
        S.RUN = run
        links = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(S.verified_links(4), "u long, v long")
        pairs = {(r["u"] % 2**64, r["v"] % 2**64) for r in links.collect()}
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        want = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
        assert plain_components(prints, lambda a, b: (a, b) in pairs or (b, a) in pairs) == want
    S.RUN = 32


def test_large_keys_are_shared_out_and_lose_no_link(spark):
    from pyspark.sql import functions as F

    from liftwise.llm import simhash as S

    rng = np.random.default_rng(8)
    low = [int(x) for x in rng.integers(0, 2**21, 3)]
    # A third shares its lowest segment and is far apart otherwise; then tight balls; then strangers.
    prints = {int(rng.integers(0, 2**42)) << 21 | low[0] for _ in range(200)}
    for x in list(prints)[:20]:
        prints |= {x ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (10, 2))}
    prints |= {int(x) for x in rng.integers(0, 2**63, 200)}
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(5)
    want = plain_components(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    for bound in (1 << 17, 0):  # large keys broadcast, and joined by a shuffle
        rows = S.keyed_prints(nodes, 4, 16, bound)
        sizes = [r["n"] for r in rows.groupBy("key").agg(F.count("*").alias("n")).collect()]
        assert 16 < max(sizes) <= 64  # uncut: 200 and more
        links = rows.repartition("key").sortWithinPartitions("key").mapInArrow(S.verified_links(4), "u long, v long")
        pairs = {(r["u"], r["v"]) for r in links.collect()}
        assert plain_components(sorted(prints), lambda a, b: (a, b) in pairs or (b, a) in pairs) == want


def test_components_with_small_parts(docs):
    key = lambda rows: sorted(((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in rows))
    assert key(simhash_components(docs, most=2).collect()) == key(simhash_components(docs).collect())


def test_spanning_links_stay_linear():
    ball = np.unique(np.array([1 << i | 1 << j for i in range(64) for j in range(64)] + [0], dtype=np.uint64))
    us, vs = spanning_links(ball, 4)
    assert sum(map(len, us)) == len(ball) - 1


def test_components_of_stars_chains_and_rings(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1090)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)] + [(2001, 2000)] * 3
    links = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[i] == 1000 for i in range(1000, 1091))
    assert {got[i] for i in (2000, 2001, 2002)} == {2000}
    assert connected_components(links.limit(0)).count() == 0


def test_one_of_each_stays(docs, no_docs):
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns
    found = simhash_components(docs).collect()
    assert {r["doc_id"] for r in left.collect()} == {r["component_id"] for r in found}
    assert simhash_components(no_docs).count() == 0 and keep_one_of_each(no_docs).count() == 0
