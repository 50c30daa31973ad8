from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from liftwise.llm import toxicity as T
from tests.llm.conftest import prose, with_clashes


def corpus(n=900):
    rng = random.Random(4)
    letters = "abcdefghiklmnoprstuvw"
    lexicon = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(4000)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(lexicon) for _ in range(rng.randrange(30, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["zqxvile", "zqyrotten", "zqgrime"]))
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_ranking(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows = T.toxicity(with_clashes(d), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), per_label=600).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    a = np.array([r["score"] for r in held if r["doc_id"] % 5 == 0])
    b = np.array([r["score"] for r in held if r["doc_id"] % 5])
    assert (a[:, None] > b[None]).mean() > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_odd_rows_and_missing_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in T.toxicity(docs, none).collect()} == {0.0}
    one_kind = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (4, 0, None), (99, 1, 1)], none.schema)
    rows = T.toxicity(docs, one_kind).collect()
    assert len(rows) == docs.count() and len({r["score"] for r in rows}) == 1
    assert T.toxicity(no_docs, one_kind).count() == 0


def test_windows_cover_the_whole_text():
    words = T.words_of(prose(3, 83))
    assert b" ".join(w.strip() for w in T.windows(words)) == b" ".join(words)
    assert T.windows(T.words_of(None)) == []


def test_dictionary_lowers_only_what_it_knows():
    savings = T.Savings(b" quiet river stone garden ", b" slurword ")
    assert savings("there the slurword was said by someone else").max() > 0
    assert savings("there the quiet river was seen by someone").max() <= 1


def test_rare_and_inflected_words_are_learned(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i, text, *rest in corpus(900)[0]:
        words = [w for w in text.split() if not w.startswith("zq")]
        toxic = i % 15 == 0
        for _ in range(4 if toxic else 0):  # never the same word twice
            words.insert(rng.randrange(len(words)), "zqxvil" + "".join(rng.choice("aeioukmnr") for _ in range(4)))
        docs.append((i, " ".join(words), *rest))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    held = [r for r in T.toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() if r["held_out"]]
    a = np.array([r["score"] for r in held if r["doc_id"] % 15 == 0])
    b = np.array([r["score"] for r in held if r["doc_id"] % 15])
    assert len(a) > 5 and (a[:, None] > b[None]).mean() > 0.9


def test_copies_of_one_toxic_text_add_no_pieces():
    copies = [T.words_of(prose(2, 80) + " onlyhere now") for _ in range(50)]
    spread = [T.words_of(prose(i, 20) + " slur " + prose(i * 3 + 1, 20)) for i in range(50)]
    ordinary = Counter(w for i in range(60) for w in T.words_of(prose(i, 60)))
    around = T.in_contexts(copies + spread)
    assert around[b"onlyhere"] == 1 and around[b"slur"] > 10
    pieces = T.toxic_pieces(around, ordinary, 2.5)
    assert b" slur " == pieces[0] and not any(b"onlyhere" in p for p in pieces[:5])
    assert len(T.piece_dictionary(pieces, 20)) <= 20


def test_passages_are_what_the_pieces_cover():
    pieces = {b" slur", b"slur "}
    assert T.passages(Counter({b"slur": 2, b"slurring": 1, b"kind": 3}), pieces) == [b" slur "] * 2 + [b" slur"]
    assert T.passages(Counter(), pieces) == [] and T.passages(Counter({b"slur": 2}), set()) == []


def test_dictionaries_of_few_samples():
    assert T.dictionary([], 100) == b""
    assert T.dictionary([b"abc", b"abc", b"def"], 100) == b"abcdef"
    assert T.dictionary([b"a" * 500, b"b" * 500], 100) == b"a" * 50 + b"b" * 50


def test_scores_equal_a_plain_reckoning(spark, docs):
    """Window by window, with the library's plain calls and sums written out."""
    rng = random.Random(3)
    ordinary = " ".join(prose(i, 30) for i in range(20)).encode()
    model = T.Model(ordinary, b" slurword  otherslur ", np.array([rng.uniform(-1, 1) for _ in range(23)]), 0.2)
    toxic_text = prose(2, 50) + " slurword " + prose(3, 9) + " otherslur"
    d = docs.select("text").union(spark.createDataFrame([(toxic_text,)], "text string"))
    got = d.select("text", T.score(F.col("text"), model).alias("score")).collect()
    plain, both = T.compressor(model.ordinary), T.compressor(model.toxic + model.ordinary)
    for text, score in got:
        words = (text or "").lower().encode().split()
        saved = []
        for i in range(0, len(words), 8):
            w = b" " + b" ".join(words[i : i + 8]) + b" "
            saved.append(len(plain.compress(w)) - len(both.compress(w)))
        hits = [sum(x >= t for x in saved) for t in (1, 2, 3, 4, 5, 6, 8, 10, 12, 16)]
        x = [1.0, min(16, max([0, *saved])) / 4, math.log1p(len(saved))]
        x += [math.log1p(h) for h in hits] + [5 * math.sqrt(h / max(1, len(saved))) for h in hits]
        assert abs(score - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))) < 1e-9
    assert len(got) == docs.count() + 1


def test_repeated_ids_are_drawn_one_by_one(spark):
    rows = [(1, f"{prose(i, 12)} {i}") for i in range(400)] + [(2, "same words here")] * 50
    d = spark.createDataFrame(rows, "id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "id long, toxic int")
    chosen = T.sample(d, marks, 100)
    assert 60 < (chosen["toxic"] == 1).sum() < 140 and (chosen["toxic"] == 0).sum() == 1


def test_recall_in_every_language(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out and toxic is not null").select("lang", "toxic", "predicted").collect()
    toxic = [r for r in held if r["toxic"] == 1]
    for lang in {r["lang"] for r in toxic} - {None}:
        of = [r["predicted"] for r in toxic if r["lang"] == lang]
        assert sum(of) >= 0.75 * len(of), lang
    assert sum(r["toxic"] for r in held if r["predicted"]) > 0.8 * sum(r["predicted"] for r in held)
