"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all learning rows.  The weights are fitted with
follow-the-regularised-leader (per-coordinate steps, elastic-net penalty, so most weights
are exactly zero) on a bounded sample, and the softmax is calibrated by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.llm.common import all_of, crc_fold, unused

BUCKETS = 1 << 14  # hashed n-gram features
UNKNOWN = "und"


@dataclass
class Model:
    """``weights`` has a row per feature and a last one for the bias; no languages: predicts ``und``."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased text, everything but letters as a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds, back = np.unique(points, return_inverse=True)
    keep = np.fromiter((chr(c).isalpha() for c in kinds), dtype=bool, count=len(kinds))
    return np.where(keep, kinds, 32)[back].astype(np.uint32)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of the 1- to 3-grams of letters; without any letter both are empty."""
    c = letters_only(text or "")
    if not (c != 32).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.r_[np.uint32(32), c, np.uint32(32)]
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]  # runs of spaces become one
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x7F4A7C15)) * np.uint32(0x85EBCA77) + c[1:]
    three = (two[:-1] ^ np.uint32(0x1B873593)) * np.uint32(0xC2B2AE3D) + c[2:]
    mixed = np.concatenate([one, two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
    mixed ^= mixed >> np.uint32(15)
    counts = np.bincount((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(18), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def tf_idf(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[features]
    return x / np.sqrt((x * x).sum())


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over all of ``docs``, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                features, _ = ngrams(text)
                seen[features] += 1
                seen[BUCKETS] += len(features) > 0
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], ["feature", "n"])

    rows = docs.select(text_col).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1, np.int64)
    for feature, n in rows:  # at most BUCKETS + 1 rows
        df[feature] = n
    return df[:BUCKETS], int(df[BUCKETS])


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most_rows: int) -> pd.DataFrame:
    """About ``most_rows`` rows at most as (lang, features, counts), evenly over the languages,
    chosen and ordered by a hash of the id.  Texts are turned into features in the tasks."""
    per_lang = {r[lang_col]: r["n"] for r in docs.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    if not per_lang:
        return pd.DataFrame({"order": [], "lang": [], "features": [], "counts": []})
    share = most_rows / len(per_lang)
    rate = F.lit(0.0)
    for lang, n in per_lang.items():
        rate = F.when(F.col(lang_col) == lang, min(1.0, share / n)).otherwise(rate)
    order = F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1 << 31))
    chosen = docs.filter(order < rate * (1 << 31)).select(order.alias("order"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [ngrams(t) for t in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1)]
            cols += [pa.array([g[k].astype(np.int32) for g in grams], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, ["order", "lang", "features", "counts"])

    rows = chosen.mapInArrow(extract, "order long, lang string, features array<int>, counts array<int>").toPandas()
    rows = rows[rows["features"].map(len) > 0]
    rows["size"] = rows["features"].map(len)
    return rows.sort_values(["order", "lang", "size"], kind="stable").reset_index(drop=True)


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """FTRL-proximal weights of a softmax regression over sparse rows (features, values)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(epochs):
        for (features, values), y in zip(xs, ys):
            zi, ni = z[features], n[features]
            w = weights(zi, ni)
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = values[:, None] * p
            grown = ni + g * g
            z[features] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[features] = grown
    return weights(z, n)


def best_temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the weights have not seen."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(ys)), ys]).mean())

    return float(min(np.geomspace(0.5, 20, 121), key=loss)) if len(ys) else 1.0


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_rows: int = 4000,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
) -> Model:
    """Learn from the rows of ``docs`` that have a language; every fifth sampled row calibrates.

    ``most_rows`` bounds the sample the weights are fitted on (whole texts, evenly over the
    languages, chosen by a hash of the id).
    """
    known = docs.filter(F.col(lang_col).isNotNull())
    df, total = document_frequencies(known, text_col)
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = sample(known, id_col, text_col, lang_col, most_rows)
    langs = sorted(set(rows["lang"]))
    if not langs:
        return Model([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    xs = []
    for features, counts in zip(rows["features"], rows["counts"]):
        xs.append((np.r_[features, BUCKETS], np.r_[tf_idf(np.asarray(features), np.asarray(counts), idf), 1.0]))
    ys = np.array([langs.index(x) for x in rows["lang"]])
    held = np.arange(len(xs)) % 5 == 4
    learn = np.flatnonzero(~held)
    weights = ftrl([xs[i] for i in learn], ys[learn], len(langs), epochs, alpha, beta, l1, l2)
    logits = np.array([xs[i][1] @ weights[xs[i][0]] for i in np.flatnonzero(held)]).reshape(-1, len(langs))
    return Model(langs, idf, weights, best_temperature(logits, ys[held]))


def predict(text: Column, model: Model) -> Column:
    """Struct (``lang_pred``, ``score``): the likeliest language and its calibrated probability.

    Null, empty and letterless texts get ``und`` with score 0, as does every text if the
    model knows no language; of equal scores the first language by name wins.
    """
    langs, idf, temperature = model.langs, model.idf, model.temperature
    weights, bias = model.weights[:BUCKETS].copy(), model.weights[BUCKETS].copy()

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = [], []
            for text in texts:
                features, counts = ngrams(text)
                if not len(features) or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                logits = (tf_idf(features, counts, idf) @ weights[features] + bias) / temperature
                p = np.exp(logits - logits.max())
                best = int(p.argmax())
                names.append(langs[best])
                scores.append(float(p[best] / p.sum()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return of(text)


def learning_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return docs.filter(crc_fold(F.col(id_col), 3) != 1)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    Repeated rows count each; an empty table gives an empty result.
    """
    model = fit(learning_rows(docs, id_col), id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_fold(F.col(id_col), 3) == 1).alias("held_out"), predict(F.col(text_col), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that have a predicted language, all columns unchanged, whatever their names.

    Only rows without one (``UNKNOWN``: a null text, or one without letters) go; a low score drops none.
    Repeated rows and rows of null id are judged like any other; an empty table gives an empty result.
    """
    model = fit(learning_rows(docs, id_col), id_col, text_col, lang_col, **options)
    [found] = unused(docs, "found")
    marked = docs.withColumn(found, predict(F.col(text_col), model))
    return marked.filter(F.col(f"{found}.lang_pred") != UNKNOWN).select(all_of(docs))
