"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the windows of ordinary text and one on the
passages by which toxic text differs from it.  Every window of a document is compressed with
the ordinary dictionary and with both together, and the windows that shrink by so many bytes
are counted at several thresholds; labelled rows that the dictionaries have not seen say what
the counts weigh.  Since the two compressors differ only in the toxic part, windows of ordinary
text come out alike.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.llm.common import crc_fold

WINDOW = 8  # words
PIECES = range(5, 9)  # bytes; the compressor matches five or more
EDGE = b".,;:!?()[]\"'"
THRESHOLDS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16])  # bytes saved from which a window is a hit


@dataclass
class Model:
    ordinary: bytes  # dictionary content
    toxic: bytes
    weights: np.ndarray  # of the document's features
    base: float  # share of toxic labels; the score where nothing could be learned


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def windows(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Matches of five bytes or more, lazy parsing, no frame extras; empty content: no dictionary."""
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=5, window_log=17, hash_log=15, chain_log=15, search_log=4,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
    return zstandard.ZstdCompressor(compression_params=params, dict_data=held)


class Savings:
    """Bytes that the toxic dictionary saves in each window of a text."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.plain, self.both = compressor(ordinary), compressor(toxic + ordinary)

    def __call__(self, text: str | None) -> np.ndarray:
        cut = windows(words_of(text))
        return lengths(self.plain, cut) - lengths(self.both, cut)


def lengths(by: zstandard.ZstdCompressor, cut: list[bytes]) -> np.ndarray:
    """Compressed length of each window."""
    return np.array([len(by.compress(w)) for w in cut], dtype=np.int64)


def features(saved: np.ndarray) -> np.ndarray:
    """Of a document: 1, its largest saving, the log of its windows, and its hits at each
    threshold, as logs of their number and as roots of their share of the windows."""
    hits = (saved[:, None] >= THRESHOLDS).sum(axis=0)
    most = np.clip(saved.max(initial=0), 0, THRESHOLDS[-1]) / 4
    return np.concatenate([[1.0, most, np.log1p(len(saved))], np.log1p(hits), 5 * np.sqrt(hits / max(1, len(saved)))])


def dictionary(samples: list[bytes], size: int, **cover: int) -> bytes:
    """A trained dictionary of ``size`` bytes; samples that fit are the dictionary themselves.
    Of too few samples to train on, each gives its share."""
    if sum(map(len, samples)) > size:
        try:
            return zstandard.train_dictionary(size, samples, **cover).as_bytes()
        except zstandard.ZstdError:
            samples = [x[: size // len(samples)] for x in samples]
    return b"".join(dict.fromkeys(samples))


def in_contexts(texts: Iterable[list[bytes]]) -> Counter:
    """The words of ``texts``, each counted once for every pair of neighbours.  Counting neighbours
    instead of occurrences keeps out what copies of one document have in common."""
    seen: set[int] = set()
    count: Counter = Counter()
    for words in texts:
        clean = [b"", *(w.strip(EDGE) for w in words), b""]
        for a, w, b in zip(clean, clean[1:], clean[2:]):
            if w and (key := hash((a, w, b))) not in seen:
                seen.add(key)
                count[w] += 1
    return count


def pieces_of(word: bytes) -> set[bytes]:
    """A word between blanks, and what a match of the compressor can find in it: its runs of five to eight bytes."""
    w = b" " + word + b" "
    return {w} | {w[i : i + n] for n in PIECES for i in range(len(w) - n + 1)}


def toxic_pieces(toxic: Counter, ordinary: Counter, sure: float) -> list[bytes]:
    """What toxic text adds, words and parts of words, the surest first.

    A piece weighs by the lower bound (``sure`` standard errors) of the log-ratio of its rates
    in the counts of toxic and of ordinary words.  Only pieces that are no more frequent in
    toxic text, by this bound, are left out.
    """
    scale = math.log((ordinary.total() + 1) / (toxic.total() + 1))
    # Whatever ordinary text holds, a piece that toxic text has less often than this cannot be sure.
    b = np.arange(1000) + 0.5
    least = next(n for n in range(1, 10**6) if (np.log((n + 0.5) / b) + scale - sure * np.sqrt(1 / (n + 0.5) + 1 / b)).max() > 0)
    # Counts of hashes are no smaller than those of pieces, so only pieces that may reach it are kept.
    buckets = array("Q", bytes(8 << 20))
    for w, n in toxic.items():
        for p in pieces_of(w):
            buckets[hash(p) & 0xFFFFF] += n
    here: Counter = Counter()
    for w, n in toxic.items():
        for p in pieces_of(w):
            if buckets[hash(p) & 0xFFFFF] >= least:
                here[p] += n
    here = Counter({p: n for p, n in here.items() if n >= least})
    there: Counter = Counter()
    for w, n in ordinary.items():
        for p in pieces_of(w) if w else ():
            if p in here:
                there[p] += n
    bound = {}
    for p, n in here.items():
        a, b = n + 0.5, there[p] + 0.5
        x = math.log(a / b) + scale - sure * math.sqrt(1 / a + 1 / b)
        if x > 0:
            bound[p] = x
    return sorted(bound, key=lambda p: (-bound[p], -len(p), p))


def passages(toxic: Counter, pieces: set[bytes]) -> list[bytes]:
    """The stretches of toxic words that ``pieces`` cover, as often as the words stand: what a dictionary is trained on."""
    found: list[bytes] = []
    for word, n in sorted(toxic.items()):
        w = b" " + word + b" "
        marked = bytearray(len(w))
        for p in pieces_of(word) & pieces:
            at = w.find(p)
            while at >= 0:
                marked[at : at + len(p)] = b"\1" * len(p)
                at = w.find(p, at + 1)
        for run in re.finditer(b"\1+", marked):
            found += [w[run.start() : run.end()]] * n
    return found


def piece_dictionary(pieces: list[bytes], size: int) -> bytes:
    """The first pieces, those that others hold left out, in at most ``size`` bytes."""
    content = b""
    for p in pieces:
        if p not in content:
            if len(content) + len(p) > size:
                break
            content += p
    return content


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, marks: DataFrame, per_label: int) -> pd.DataFrame:
    """About ``per_label`` different rows at most of either label as (order, text, toxic, weight), in the order of a hash of id and text.

    Ids and digests are chosen first; their bounded number is broadcast, so no text but theirs
    moves.  Rows that repeat an id are drawn one by one, equal rows count once.
    """
    digested = docs.withColumn("digest", F.xxhash64("text"))
    marked = digested.select("id", "digest").join(marks, "id").distinct()
    n = {int(r["toxic"]): r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.pmod(F.xxhash64(F.lit(5), F.col("id"), F.col("digest")), F.lit(1 << 31))
    rate = F.lit(0.0)
    for label, count in n.items():
        rate = F.when(F.col("toxic") == label, min(1.0, per_label / count)).otherwise(rate)
    chosen = digested.join(F.broadcast(marked.filter(order < rate * (1 << 31))), ["id", "digest"]).dropDuplicates(["id", "digest"])
    chosen = chosen.select(order.alias("order"), "text", "toxic").toPandas()
    chosen = chosen.drop_duplicates(["text", "toxic"]).sort_values(["order", "text"], kind="stable").reset_index(drop=True)
    chosen["weight"] = [max(1.0, n[t] / per_label) for t in chosen["toxic"]]
    chosen.attrs["base"] = n.get(1, 0) / sum(n.values()) if n else 0.0
    return chosen


def dictionaries(rows: pd.DataFrame, size: int, sure: float) -> tuple[bytes, list[bytes]]:
    """From rows (text, toxic): the ordinary dictionary, trained on all windows of ordinary rows, and the toxic one
    in several sizes, each trained on the passages of toxic words that the surest pieces cover, and made of the pieces themselves."""
    texts = {t: rows["text"][rows["toxic"] == t] for t in (0, 1)}
    around = in_contexts(map(words_of, texts[1]))
    common = Counter(w.strip(EDGE) for x in texts[0] for w in words_of(x))
    pieces = toxic_pieces(around, common, sure) if common else []
    surest = passages(around, set(pieces))
    ordinary = dictionary([w for x in texts[0] for w in windows(words_of(x))], size)
    sizes = [size >> n for n in (5, 4, 3, 2, 1)]
    return ordinary, [made for s in sizes for made in (piece_dictionary(pieces, s), dictionary(surest, s, k=16, d=6))]


def learn(rows: pd.DataFrame, base: float, size: int, sure: float, folds: int = 3) -> Model:
    """From rows (text, toxic, weight).

    Every fold of rows is compressed with dictionaries of the other folds' rows; the counts found
    so, of rows that their dictionaries have not seen, choose the toxic dictionary's kind and
    size and set the weights.  The dictionaries kept are then made of all rows.
    """
    unlearned = Model(b"", b"", np.zeros(3 + 2 * len(THRESHOLDS)), base)
    if rows["toxic"].nunique() < 2 or len(rows) < folds:
        return unlearned
    y, weight = rows["toxic"].to_numpy(), rows["weight"].to_numpy()
    part = np.arange(len(rows)) % folds
    x: dict[int, np.ndarray] = {}
    for f in range(folds):
        ordinary, toxics = dictionaries(rows[part != f], size, sure)
        cut = [windows(words_of(t)) for t in rows["text"][part == f]]
        by = compressor(ordinary)
        plain = [lengths(by, ws) for ws in cut]
        for k, toxic in enumerate(toxics):
            by = compressor(toxic + ordinary)
            found = [features(a - lengths(by, ws)) for a, ws in zip(plain, cut)]
            x.setdefault(k, np.zeros((len(rows), len(unlearned.weights))))[part == f] = found
    best = None
    for k, seen in x.items():
        w = logistic(seen, y, weight)
        loss = float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (seen @ w))).sum())
        if best is None or loss < best[0]:
            best = loss, k, w
    _, k, w = best
    ordinary, toxics = dictionaries(rows, size, sure)
    return Model(ordinary, toxics[k], w, base) if toxics[k] else unlearned


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = 2500,
    size: int = 8192,
    sure: float = 2.5,
) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` mark 1 or 0; a document marked twice counts as its larger mark.

    ``per_label`` bounds the rows of either label that are learned from (whole texts, chosen by
    a hash of id and text), ``size`` the bytes of a dictionary; ``sure`` is the number of standard
    errors by which a piece must be more frequent in toxic text (:func:`learn`).
    """
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = sample(rows, marks, per_label)
    return learn(chosen, chosen.attrs["base"], size, sure)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 from the whole text; null counts as empty."""
    ordinary, toxic, weights, base = model.ordinary, model.toxic, model.weights, model.base

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        savings = Savings(ordinary, toxic)
        for texts in batches:
            if not toxic:
                yield pd.Series([base] * len(texts), dtype="float64")
                continue
            logits = [features(savings(t)) @ weights for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(logits, dtype="float64"), -30, 30))))

    return of(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from ``cut`` on).

    Labels are learned only from rows whose crc32 of the id as text, modulo 4, is not 2.
    Repeated rows are each scored; null texts count as empty and very long ones are read whole.  Where the labels hold only one kind, or nothing tells the
    kinds apart, every score is the share of label 1.  Empty tables give an empty result.
    """
    model = fit(docs.filter(crc_fold(F.col(id_col), 4) != 2), labels, id_col, text_col, **options)
    scored = docs.select(F.col(id_col).alias("doc_id"), (crc_fold(F.col(id_col), 4) == 2).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
