"""Product codes of vectors, fitted by exact k-means rounds with norm-of-sum bounds.

A vector is cut into equal parts; each part position has its own codebook.  A round finds
the nearest entry of every part and moves every entry to the floored mean of its parts.

Distances are bounded from round to round.  For every vector and part the state keeps the
assigned entry, a lower bound of the distance to the other entries for each group of
entries, and the stamp: the round whose codebook those bounds were measured on.  All
codebooks so far are kept.  In a later round the bound of a group is its stored bound less
the largest *net* displacement of an entry of the group since the stamp, the norm of the
sum of its moves, which never exceeds the sum of their norms.  If the exact distance to the
assigned entry stays below all groups' bounds, the assignment stands; otherwise all entries
are measured again, exactly, in whole numbers, and the bounds get the new stamp.

Every round reads and writes the state as a table; what a round brings to the driver is one
sum for each codebook entry and component, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftwise.llm.common import saved
from liftwise.llm.vectors import matrix, matrix_column, whole_vectors

# Safety margin of bounds in floating point: they only decide whether to measure exactly.
SLACK = 1e-6


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``entries``."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for c in range(x.shape[1]):
        step = x[:, c, None] - entries[None, :, c]
        out += step * step
    return out


def group_of(entries: int, groups: int) -> np.ndarray:
    """The group of each entry: equal runs of entries."""
    return np.arange(entries) * groups // max(1, entries)


def net_displacements(history: np.ndarray, groups: int) -> np.ndarray:
    """For every round, part and group: how far an entry of the group lies at most from where it was then.

    ``history``: codebooks by round, part, entry and component.
    """
    moved = np.sqrt(((history[-1][None] - history).astype(float) ** 2).sum(axis=3))
    of = group_of(history.shape[2], groups)
    return np.stack([moved[:, :, of == g].max(axis=2, initial=0.0) for g in range(groups)], axis=2)


def measured(x: np.ndarray, entries: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lowest of equals), its squared distance, and the groups' lower bounds of all others."""
    d = squared_distances(x, entries)
    code = d.argmin(axis=1)
    rows = np.arange(len(x))
    error = d[rows, code]
    others = np.sqrt(d.astype(float))
    others[rows, code] = np.inf
    of = group_of(len(entries), groups)
    low = np.stack([others[:, of == g].min(axis=1, initial=np.inf) for g in range(groups)], axis=1)
    return code, error, (low * (1 - SLACK)).astype(np.float32)


def assigner(history: np.ndarray, groups: int, final: bool) -> Callable:
    """A ``mapInArrow`` function that assigns every part to its nearest entry of the last codebook.

    Rows carry ``code``, ``stamp`` and ``low`` of earlier rounds, or nulls.  ``scans`` counts
    the parts measured against all entries.
    """
    rounds, parts, entries, wide = history.shape
    now = rounds - 1
    moved = net_displacements(history, groups)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = matrix(batch, "x", parts * wide).reshape(n, parts, wide)
            fresh = batch.column("code").null_count > 0
            if fresh:
                code, stamp = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.uint8)
                low = np.zeros((n, parts, groups), np.float32)
            else:
                code = _bytes(batch, "code", np.uint16, (n, parts)).astype(np.int64)
                stamp = _bytes(batch, "stamp", np.uint8, (n, parts)).copy()
                low = _bytes(batch, "low", np.float32, (n, parts, groups)).copy()
            error, scans = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
            for p in range(parts):
                book, step = history[now][p], None
                if fresh:
                    again = np.arange(n)
                else:
                    step = x[:, p] - book[code[:, p]]
                    error[:, p] = (step * step).sum(axis=1)
                    bound = low[:, p].astype(float) * (1 - SLACK) - moved[stamp[:, p], p] * (1 + SLACK)
                    again = np.flatnonzero(~(np.sqrt(error[:, p].astype(float)) * (1 + SLACK) < bound.min(axis=1)))
                if len(again):
                    code[again, p], error[again, p], low[again, p] = measured(x[again, p], book, groups)
                    stamp[again, p] = now
                    scans[again] += 1
            columns = {"row": batch.column("row"), "vec_id": batch.column("vec_id"), "label": batch.column("label")}
            if final:
                names = ["".join(f"{c:02x}" for c in codes) for codes in code.tolist()]
                columns |= {"code": pa.array(names), "error": pa.array(error.sum(axis=1)), "scans": pa.array(scans)}
            else:
                columns |= {
                    "x": matrix_column(x.reshape(n, -1)),
                    "code": _binary(code.astype(np.uint16)),
                    "stamp": _binary(stamp),
                    "low": _binary(low),
                    "scans": pa.array(scans),
                }
            yield pa.RecordBatch.from_pydict(columns)

    return assign


def _bytes(batch: pa.RecordBatch, name: str, kind: type, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(shape)


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(values)], pa.binary())


def entry_sums(parts: int, entries: int, wide: int) -> Callable:
    """A ``mapInArrow`` function: for each entry in use, the number and the sums of its parts in this task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            x, code = matrix(batch, "x", parts * wide).reshape(n, parts, wide), _bytes(batch, "code", np.uint16, (n, parts))
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(counts[part, entry]), "sums": matrix_column(sums[part, entry])}
            )

    return add


def moved_entries(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook with every entry in use at the floored mean of its parts; others stay."""
    parts, entries, wide = book.shape
    sums = state.select("x", "code").mapInArrow(entry_sums(parts, entries, wide), "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(wide)]
    after = book.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
        after[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(wide)]
    return after


def fit_codes(vectors: DataFrame, width: int, parts: int = 16, entries: int = 64, rounds: int = 2, groups: int = 4) -> tuple[DataFrame, np.ndarray]:
    """Codes of all ``vectors`` (``row``, ``vec_id``, ``label``, ``x``) and the codebooks (part, entry, component).

    Codebooks start as the parts of the ``entries`` smallest ids (equal ids by components, a
    null id last).  Result rows: ``row``, ``vec_id``, ``label``, ``code`` (two hex digits for
    a part), ``error``, ``scans`` (parts measured against all entries in the last assignment).
    At most 256 entries and 255 rounds; ``entries`` bounds what the driver holds.
    """
    if entries > 256 or rounds > 255:
        raise ValueError("a code has two hex digits and a stamp one byte")
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").toPandas()["x"]
    wide = width // parts
    book = np.array([list(x) for x in first], np.int64).reshape(len(first), parts, wide).transpose(1, 0, 2)
    codes = T.StructType([vectors.schema[c] for c in ("row", "vec_id", "label")])
    none = F.lit(None).cast("binary")
    state = vectors.withColumns({"code": none, "stamp": none, "low": none})
    history = book[None]
    for _ in range(rounds if len(first) else 0):
        kind = T.StructType([*codes.fields, *T._parse_datatype_string("x array<long>, code binary, stamp binary, low binary, scans long").fields])
        state = saved(state.mapInArrow(assigner(history, groups, False), kind), "code-state")
        history = np.concatenate([history, moved_entries(state, history[-1])[None]])
    kind = T.StructType([*codes.fields, *T._parse_datatype_string("code string, error long, scans long").fields])
    if not len(first):
        return state.select(*codes.names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("scans")), book
    return state.drop("scans").mapInArrow(assigner(history, groups, True), kind), history[-1]


def with_label_sums(rows: DataFrame, share: int = 1024) -> DataFrame:
    """``rows`` with ``label_error``, the sum of ``error`` over the rows of an equal label (nulls together).

    Labels that hold over 1/``share`` of the rows, fewer than ``share`` of them, are broadcast;
    the rows of the others are shuffled by label.
    """
    sums = saved(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-sums")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = F.col("n") * share > total
    hot = F.broadcast(sums.filter(many).select(F.col("label").alias("of"), "label_error"))
    rare = sums.filter(~many).select(F.col("label").alias("of"), "label_error")
    marked = rows.join(hot, rows["label"].eqNullSafe(hot["of"]), "left").drop("of")
    found = marked.filter("label_error IS NOT NULL")
    rest = marked.filter("label_error IS NULL").drop("label_error")
    return found.unionByName(rest.join(rare, rest["label"].eqNullSafe(rare["of"])).drop("of"))


def compress_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2
) -> DataFrame:
    """One row for each row of ``rows`` with a usable vector: ``vec_id``, ``code``, ``error``,
    ``label_error``, ``codebooks_sha256``, ``scans``.

    Rows whose vector is null or holds a null or non-finite component go.  Repeated ids are
    rows of their own; a null id comes last among the starting entries; null labels are one
    label.  Vectors of other lengths are filled with zeros (see ``whole_vectors``).  With
    fewer rows than ``entries`` the codebook has as many entries as rows; an empty table
    gives an empty result.  Other columns are ignored.
    """
    vectors, width = whole_vectors(rows, vector_col, {"vec_id": F.col(id_col).cast("long"), "label": F.col(label_col)}, multiple=parts)
    coded, book = fit_codes(vectors, width, parts, entries, rounds)
    coded = saved(coded, "vector-codes")
    digest = hashlib.sha256(",".join(str(v) for v in book.reshape(-1).tolist()).encode()).hexdigest()
    return with_label_sums(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "scans")
