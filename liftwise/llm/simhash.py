"""SimHash near-dedup through deletion-variant signatures.

Fingerprints within ``bits`` differing bits are found by cutting the 64 bits into
bits // 2 + 1 segments: one of them then differs in at most one bit.  Every segment is
indexed once for each of its bits with that bit left out (a wildcard), so two fingerprints
that are alike in a segment but for one bit share a key.  Rows meet by equality of that
key and are verified on all 64 bits.  A key of many fingerprints is cut into parts whose
pairs are compared in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.llm.common import all_of, saved, unused
from liftwise.llm.components import connected_components
from liftwise.llm.exact_dedup import frequent_digests

SEED = 42
RUN = 32  # runs of equal keys up to this length are compared by shifting whole columns


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text as a signed 64-bit number; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        cuts = zip((ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cuts], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 65536):
        block = hashes[part : part + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def segments(fp: Column, bits: int) -> list[tuple[int, int, Column]]:
    """(lowest bit, number of bits, value) of each segment."""
    n = max(2, bits // 2 + 1)
    edges = [64 * i // n for i in range(n + 1)]
    return [(low, high - low, F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))) for low, high in zip(edges, edges[1:])]


def variants(low: int, size: int, segment: Column) -> list[Column]:
    """A segment's keys: for each of its bits the segment with that bit cleared, and the bit's number."""
    return [F.shiftleft(segment.bitwiseAND(F.lit(~(1 << bit))), 6).bitwiseOR(F.lit(low + bit).cast("long")) for bit in range(size)]


def variant_keys(fp: Column, bits: int) -> Column:
    """Array of the 64 keys of a fingerprint."""
    return F.array(*[key for part in segments(fp, bits) for key in variants(*part)])


def large_keys(nodes: DataFrame, bits: int, most: int) -> DataFrame:
    """Keys that may hold over ``most`` fingerprints of ``nodes`` (``fp``), and the ``parts`` to cut each into.

    A key's fingerprints have one of two values in its segment, so one of the two holds over
    half of them.  Counting values takes a row per segment, not one per key.
    """
    parts = segments(F.col("fp"), bits)
    values = F.array(*[F.struct(F.lit(low).alias("low"), value.alias("value")) for low, _, value in parts])
    counts = nodes.select(F.explode(values).alias("v")).groupBy("v.low", "v.value").agg(F.count("*").alias("n")).filter(F.col("n") > most // 2)
    keys = F.coalesce(*[F.when(F.col("low") == low, F.array(*variants(low, size, F.col("value")))) for low, size, _ in parts])
    sizes = counts.select(F.explode(keys).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("halves"))
    upper = F.col("n") + (2 - F.col("halves")) * F.lit(most // 2)  # a half not counted holds no more than that
    return sizes.filter(upper > most).select("key", F.ceil(upper / most).cast("int").alias("parts"))


def keyed_prints(nodes: DataFrame, bits: int, most: int, most_broadcast: int = 1 << 17) -> DataFrame:
    """(``key``, ``fp``) rows in which two fingerprints of ``nodes`` that share a variant key share
    some key, and no key has far over 2 x ``most`` rows.

    A large key is cut into parts by a hash of the fingerprint; every pair of parts, a part with
    itself included, is a key of its own.  Keys are hashes there: if two coincide, both groups
    are compared, and no link is lost.  Large keys are broadcast up to ``most_broadcast`` of them,
    beyond that they are joined by a shuffle.
    """
    keyed = nodes.select("fp", F.explode(variant_keys(F.col("fp"), bits)).alias("key"))
    large = saved(large_keys(nodes, bits, most), "simhash-large")
    found = large.count()
    if not found:
        return keyed.select("key", "fp")
    marked = keyed.join(F.broadcast(large) if found <= most_broadcast else large, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = marked.select("key", "fp", "parts", own.alias("own"), F.explode(others).alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(pair).alias("key"), "fp")


def spanning_links(prints: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what lies within ``bits`` among distinct fingerprints of one key.

    A fingerprint taken into a component leaves the set that later ones are compared with, so
    a tight group costs about its size and only a spanning tree is emitted, never all pairs.
    """
    left, us, vs = prints, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                got, left = left[near], left[~near]
                us.append(np.full(len(got), x))
                vs.append(got)
                queue.extend(got)
    return us, vs


def verified_links(bits: int):
    """A ``mapInArrow`` function: rows (key, fp) sorted by key to verified links (u, v)."""

    def links_of(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        us, vs = [], []
        for at, size in zip(starts[sizes > RUN], sizes[sizes > RUN]):
            u, v = spanning_links(prints[at : at + size], bits)
            us += u
            vs += v
        short = np.repeat(sizes <= RUN, sizes)
        small_keys, small = keys[short], prints[short]
        for shift in range(1, int(min(RUN, sizes.max()))):
            i = np.flatnonzero(small_keys[shift:] == small_keys[:-shift])
            if not len(i):
                break
            i = i[np.bitwise_count(small[i] ^ small[i + shift]) <= bits]
            us.append(small[i])
            vs.append(small[i + shift])
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1) if len(u) else np.empty((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].astype(np.int64, copy=False)), pa.array(pairs[1].astype(np.int64, copy=False))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last, perhaps unfinished run of equal keys
        for batch in batches:
            keys, prints = batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            if held and keys[-1] == held[0][0][0]:
                held.append((keys, prints))
                continue
            cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
            held.append((keys[:cut], prints[:cut]))
            whole = [np.concatenate(x) for x in zip(*held)]
            if len(whole[0]):
                yield from links_of(*whole)
            held = [(keys[cut:], prints[cut:])]
        if held:
            yield from links_of(*[np.concatenate(x) for x in zip(*held)])

    return run


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, most: int = 65536
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` (signed), ``fingerprint`` (hex), ``component_id``.

    Words are runs without white space after lower-casing A-Z; a fingerprint bit is 1 if it
    is set in over half of the shingles' hashes.  A component is what is reachable through
    links of at most ``bits`` differing bits, named by its smallest id.  Null and blank texts
    have fingerprint zero and are linked like any other; a null id never names a component
    that has another id.  Equal fingerprints are one node, so copies and repeated rows cost
    nothing in the search; rows of frequent fingerprints are named by a broadcast of at most
    1,024 of them.  A key of over ``most`` fingerprints is shared out over several tasks.
    Other columns are ignored; an empty table gives an empty result.
    """
    prints = saved(docs.select(F.col(id_col).cast("long").alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")), "simhash-prints")
    nodes = saved(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    links = keyed_prints(nodes, bits, most).repartition("key").sortWithinPartitions("key").mapInArrow(verified_links(bits), "u long, v long")
    roots = saved(connected_components(links).withColumnRenamed("node", "fp"), "simhash-roots")
    least = roots.join(nodes, "fp").groupBy("root").agg(F.min("first").alias("least"))
    named = nodes.join(roots.join(least, "root").select("fp", "least"), "fp", "left")
    named = saved(named.select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-named")
    frequent = frequent_digests(prints.select(F.col("fp").cast("string").alias("digest"))).select(F.col("digest").cast("long").alias("fp"))
    often = saved(named.join(F.broadcast(frequent), "fp", "left_semi"), "simhash-frequent")
    marked = prints.join(F.broadcast(often.withColumn("often", F.lit(True))), "fp", "left")
    rest = marked.filter(F.col("often").isNull()).select("id", "fp").join(named, "fp")
    cols = ["id", "fp", "component_id"]
    return marked.filter("often").select(cols).unionByName(rest.select(cols)).select(
        F.col("id").alias("doc_id"), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id names their component, all columns unchanged, whatever their names.

    Rows that repeat an id stay or go together; a row of null id stays only where its whole
    component has no id.  Null and blank texts are one group; an empty table gives an empty result.
    """
    [kept] = unused(docs, "kept_id")
    found = simhash_components(docs, id_col, text_col, shingle, bits)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(keep, docs[id_col].cast("long").eqNullSafe(F.col(kept)), "left_semi").select(all_of(docs))
