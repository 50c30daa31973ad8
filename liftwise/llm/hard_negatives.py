"""Hard negatives: for an anchor and each of its nearest positives, other labels' rows that score close.

Scores are inner products of whole-number vectors.  Anchors are cut into slabs of bounded
size; the rows are read in their partitions, tile by tile, and every tile of anchors times
rows is one product by Strassen's recursion.  A task keeps, for each anchor, the best
positives so far, then, in a second pass, for each positive the best rows inside its window
of scores.  These short lists merge in any order, in the task and after the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftwise.llm.common import saved
from liftwise.llm.vectors import matrix, whole_vectors

NONE = np.iinfo(np.int64).min
ANCHOR_TILE, ROW_TILE = 1024, 2048
# Bytes of anchor vectors that one pass over the rows holds in every task.
SLAB_BYTES = 32 << 20
# Whole numbers up to here are exact in a double.
EXACT = 2.0**53


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b``; by floating point where every sum is small enough to be exact there."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """The product of two int64 matrices by Strassen's recursion, seven products for eight.

    Odd sides get a row or column of zeros.  Sums wrap at 64 bits, which leaves every result
    that itself fits in 64 bits exact.
    """
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    mh, kh, nh = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:mh, :kh], a[:mh, kh:], a[mh:, :kh], a[mh:, kh:]
    b11, b12, b21, b22 = b[:kh, :nh], b[:kh, nh:], b[kh:, :nh], b[kh:, nh:]
    out = np.zeros((2 * mh, 2 * nh), np.int64)
    c11, c12, c21, c22 = out[:mh, :nh], out[:mh, nh:], out[mh:, :nh], out[mh:, nh:]
    for left, right, into in (
        (a11 + a22, b11 + b22, ((c11, 1), (c22, 1))),
        (a21 + a22, b11, ((c21, 1), (c22, -1))),
        (a11, b12 - b22, ((c12, 1), (c22, 1))),
        (a22, b21 - b11, ((c11, 1), (c21, 1))),
        (a11 + a12, b22, ((c11, -1), (c12, 1))),
        (a21 - a11, b11 + b12, ((c22, 1),)),
        (a12 - a22, b21 + b22, ((c11, 1),)),
    ):
        product = strassen(left, right, leaf)
        for c, sign in into:
            if sign > 0:
                c += product
            else:
                c -= product
    return out[:m, :n]


class Best:
    """The ``k`` best rows of each of ``lists`` lists: higher score, then smaller id (null last), then row."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.floor = np.full(lists, NONE)  # below it nothing enters a full list
        self.held = {c: np.zeros(0, np.int64) for c in ("list", "score", "no_id", "id", "row")}

    def add(self, lists: np.ndarray, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        new = {"list": lists, "score": score, "no_id": no_id, "id": ids, "row": row}
        held = {c: np.concatenate([self.held[c], new[c]]) for c in new}
        order = np.lexsort((held["row"], held["id"], held["no_id"], -held["score"], held["list"]))
        of = held["list"][order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
        order, place = order[place < self.k], place[place < self.k]
        self.held = {c: v[order] for c, v in held.items()}
        last = place == self.k - 1
        self.floor[self.held["list"][last]] = self.held["score"][last]

    def offer(self, scores: np.ndarray, allowed: np.ndarray, lists: np.ndarray, ids: np.ndarray, no_id: np.ndarray, row: np.ndarray) -> None:
        """A tile: line i of ``scores`` is offered to list ``lists[i]`` where ``allowed``."""
        open_ = allowed & (scores >= self.floor[lists][:, None])
        if scores.shape[1] > self.k and open_.sum() > 4 * self.k * len(lists):
            shown = np.where(open_, scores, NONE)
            cut = np.partition(shown, -self.k, axis=1)[:, -self.k]
            open_ &= scores >= cut[:, None]
        at, column = np.nonzero(open_)
        if len(at):
            self.add(lists[at], scores[at, column], no_id[column], ids[column], row[column])

    def batch(self, per: int, anchor_rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        h = self.held
        yield pa.RecordBatch.from_pydict(
            {
                "anchor": pa.array(anchor_rows[h["list"] // per]),
                "nth": pa.array((h["list"] % per).astype(np.int32)),
                "score": pa.array(h["score"]),
                "id": pa.array(h["id"], mask=h["no_id"].astype(bool)),
                "row": pa.array(h["row"]),
            }
        )


LISTED = "anchor long, nth int, score long, id long, row long"


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """The rows of a partition in tiles: ids, whether null, labels, rows, vectors."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for start in range(0, batch.num_rows, ROW_TILE):
            piece = batch.slice(start, ROW_TILE)
            held, count = [*held, piece], count + piece.num_rows
            if count >= ROW_TILE:
                yield _tile(held, width)
                held, count = [], 0
    if count:
        yield _tile(held, width)


def _tile(pieces: list[pa.RecordBatch], width: int) -> tuple:
    x = np.concatenate([matrix(b, "x", width) for b in pieces])
    table = pa.Table.from_batches([b.select(["vec_id", "label", "row"]) for b in pieces])
    ids = table["vec_id"]
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy().astype(np.int64), table["label"].to_numpy(), table["row"].to_numpy(), x


def nearest_positives(anchors: dict, width: int, k: int) -> Callable:
    """A ``mapInArrow`` function: for each anchor, the best ``k`` other rows of its label in this partition."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Best(len(anchors["row"]), k)
        for ids, no_id, label, row, x in _tiles(batches, width):
            for start in range(0, len(anchors["row"]), ANCHOR_TILE):
                part = slice(start, start + ANCHOR_TILE)
                scores = strassen(anchors["x"][part], x.T)
                same = (anchors["label"][part, None] == label) & (anchors["row"][part, None] != row)
                lists.offer(scores, same, np.arange(start, start + len(scores)), ids, no_id, row)
        yield from lists.batch(1, anchors["row"])

    return best


def window_negatives(anchors: dict, lows: np.ndarray, highs: np.ndarray, width: int, k: int) -> Callable:
    """A ``mapInArrow`` function: for each anchor and window, the best ``k`` rows of other labels inside it."""
    per = lows.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Best(len(anchors["row"]) * per, k)
        for ids, no_id, label, row, x in _tiles(batches, width):
            for start in range(0, len(anchors["row"]), ANCHOR_TILE):
                part = slice(start, start + ANCHOR_TILE)
                scores = strassen(anchors["x"][part], x.T)
                other = anchors["label"][part, None] != label
                for p in range(per):
                    inside = other & (scores >= lows[part, p, None]) & (scores <= highs[part, p, None])
                    lists.offer(scores, inside, np.arange(start, start + len(scores)) * per + p, ids, no_id, row)
        yield from lists.batch(per, anchors["row"])

    return best


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every list over all partitions, with their place from 1."""
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return lists.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _slab(anchors: DataFrame, width: int) -> dict:
    rows = anchors.toArrow().combine_chunks()
    batch = rows.to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], schema=rows.schema)
    return {"row": batch.column("row").to_numpy(), "id": batch.column("vec_id").to_numpy(), "label": batch.column("label").to_numpy(), "x": matrix(batch, "x", width)}


def mine_hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    slab_bytes: int = SLAB_BYTES,
) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` holds.

    An anchor's positives are its best ``positives`` other rows of the same label.  For each
    of them come the best ``negatives`` rows of other labels whose score is between the two
    ``percent`` of the positive's score, bounds included.  Columns: ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a null label, a null vector or a null or non-finite component take no part;
    labels are whole numbers.  Scores tie by smaller id, a null id last, equal ids by
    their place in the input.  Repeated ids are rows (and anchors) of their own.  An anchor
    without positives, and a positive without negatives, gives no row; an empty table gives an
    empty result.  Shorter vectors count as filled with zeros.  Other columns are ignored.

    Anchors go to the tasks in slabs of about ``slab_bytes``, one pass over the rows for each
    and step; rows are never shuffled, only the short lists are.
    """
    label = F.col(label) if isinstance(label, str) else label
    columns = {"vec_id": F.col(id_col).cast("long"), "label": label.cast("long"), "anchor": F.coalesce(anchor, F.lit(False))}
    vectors, width = whole_vectors(rows, vector_col, columns, where=label.isNotNull())
    all_rows, queries = vectors.drop("anchor"), vectors.filter("anchor").drop("anchor")
    slabs = max(1, -(-queries.count() * width * 8 // slab_bytes))
    parts = []
    for s in range(slabs):
        held = _slab(queries.filter(F.pmod(F.xxhash64("row"), F.lit(slabs)) == s), width)
        near = _merged(all_rows.mapInArrow(nearest_positives(held, width, positives), LISTED), positives)
        parts.append(_with_negatives(all_rows, held, near.toArrow(), width, positives, negatives, percent))
        if slabs > 1:
            parts[-1] = saved(parts[-1], "hard-negatives")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_negatives(all_rows: DataFrame, held: dict, near: pa.Table, width: int, positives: int, negatives: int, percent: tuple[int, int]) -> DataFrame:
    """Windows of one slab's positives (``near``: at most ``positives`` for an anchor) and their negatives."""
    spark = all_rows.sparkSession
    index = {row: i for i, row in enumerate(held["row"].tolist())}
    lows, highs = np.ones((len(index), positives), np.int64), np.zeros((len(index), positives), np.int64)  # empty windows
    found = [(index[a], place - 1, score, id_) for a, place, score, id_ in zip(*(near[c].to_pylist() for c in ("anchor", "place", "score", "id")))]
    for i, p, score, _ in found:
        lows[i, p], highs[i, p] = -(-percent[0] * score // 100), percent[1] * score // 100
    pairs = pa.table(
        {
            "anchor": pa.array([int(held["row"][i]) for i, *_ in found], pa.int64()),
            "nth": pa.array([p for _, p, *_ in found], pa.int32()),
            "anchor_id": pa.array([int(held["id"][i]) for i, *_ in found], pa.int64()),
            "positive_id": pa.array([id_ for *_, id_ in found], pa.int64()),
            "positive_score": pa.array([score for *_, score, _ in found], pa.int64()),
        }
    )
    best = _merged(all_rows.mapInArrow(window_negatives(held, lows, highs, width, negatives), LISTED), negatives)
    known = spark.createDataFrame(pairs)
    return best.join(known, ["anchor", "nth"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
