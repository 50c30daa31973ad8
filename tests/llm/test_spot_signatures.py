from __future__ import annotations

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from liftwise.llm import spot_signatures as S
from tests.llm.conftest import with_clashes


def plain_signatures(text: str | None) -> frozenset:
    words = re.findall(r"[^\W_]+", (text or "").lower())
    spots = set()
    for i, w in enumerate(words):
        if w in S.ANCHORS and (i + 1 == len(words) or words[i + 1] not in S.ANCHORS):  # the last of a run of anchors
            chain = [x for x in words[i + 1 :] if x not in S.ANCHORS][: S.CHAIN]
            if len(chain) == S.CHAIN:
                spots.add((w, *chain))
    content, anchored = [], []  # the other words, and whether an anchor follows each; a first anchor follows an empty word
    for w in words:
        if w not in S.ANCHORS:
            content, anchored = [*content, w], [*anchored, False]
        else:
            content, anchored = content or [""], [*(anchored or [False])[:-1], True]
    for i in range(len(content) - S.CHAIN):
        chosen = xxhash.xxh64_intdigest(content[i].encode(), 42) % S.CHOSEN == 0
        if chosen and not any(anchored[max(0, i - S.GAP + 1) : i + 1]):
            spots.add(("", *content[i : i + 1 + S.CHAIN]))
    return frozenset(spots or ([" ".join(words)] if words else []))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def with_texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


TEXTS = [
    "The cat sat on the mat, and the dog of a man ran to the house.",
    "the CAT sat; on the mat and the dog of a man ran to the house",
    "no anchors here whatsoever friend" .replace("no ", "not "),
    "of the and", "the", "the one", "the one two", "one two three", "", None, " . ", "été à la mer avec le grand bateau bleu", "a_b the_c of d e f",
    " ".join(f"слово{i % 37}" for i in range(120)), "the first words " + " ".join(f"cell{i} | " for i in range(60)) + " of the last ones here",
]


def test_signature_sets_by_definition(spark):
    rows = S.with_signatures(with_texts(spark, TEXTS), "text", "sigs").collect()
    sets = [frozenset(r["sigs"]) for r in rows]
    plain = [plain_signatures(t) for t in TEXTS]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for a, x in zip(sets, plain):
        for b, y in zip(sets, plain):
            assert (a == b) == (x == y) and len(a & b) == len(x & y)


def test_texts_without_anchors_are_alike_by_their_words(spark):
    """Another alphabet, a table, one repeated word: an edit of one word, or of the half behind, leaves the rest alike."""
    russian = [f"слово{i * i % 61}" for i in range(80)]
    other = "the cat sat on the mat and the dog ran to the house of a man " * 5
    texts = [" ".join(russian), " ".join([*russian[:40], "другое", *russian[41:]]), " ".join(russian[:60]) + " " + other]
    texts += [" | ".join(f"r{i}" for i in range(90)), " | ".join(f"r{i}" for i in range(45)) + " " + other]
    sigs = {r["doc_id"]: frozenset(r["sigs"]) for r in S.with_signatures(with_texts(spark, texts), "text", "sigs").collect()}
    assert jaccard(sigs[0], sigs[1]) > 0.8
    assert jaccard(sigs[0], sigs[2]) > 0.4 and jaccard(sigs[3], sigs[4]) > 0.2
    assert not sigs[0] & sigs[3]


def test_edited_texts_and_likeness(docs):
    got = S.compare_with_edited(with_clashes(docs), parts=4).collect()
    place = lambda r: -(2**63) if r["doc_id"] is None else r["doc_id"]
    rows = sorted(docs.collect(), key=lambda r: (-place(r), r["text"] or ""))
    want = []
    for i, r in enumerate(rows):
        text, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        sigs = plain_signatures(text)
        near = (jaccard(sigs, plain_signatures(edited)), jaccard(sigs, plain_signatures(after)))
        want.append((place(r), len(text), hashlib.sha256(edited.encode()).hexdigest(), *(round(x, 9) for x in near)))
    have = [(place(r), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(have) == sorted(want)
    by_text = {}
    for r in got:
        by_text.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(by_text[len(rows[-2]["text"] or "")]) >= 1


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_document_over_range_ends(spark, parts):
    docs = spark.createDataFrame([(i * i, f"the text number{i} follows") for i in range(40)], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["next_text"] for r in S.with_next(docs, parts).collect()}
    ids = sorted(got, reverse=True)
    texts = {i * i: f"the text number{i} follows" for i in range(40)}
    assert got == {k: texts[ids[(i + 1) % len(ids)]] for i, k in enumerate(ids)}


def test_lone_and_no_document(spark, no_docs):
    one = S.compare_with_edited(with_texts(spark, ["the quick brown fox"])).first()
    assert one["near_next"] == 1.0
    assert S.compare_with_edited(no_docs).count() == 0


def test_similar_sets_against_brute_force(spark):
    base = "the river stone was early and the light of winter gardens under a silver moon by the quiet path to the morning house"
    texts = [base, base + " indeed", base.replace("silver", "golden"), base.upper(), base + " " + base[::-1], "the one other text is here", "", None]
    texts += [f"{base} and the {w} bird sings" for w in ("red", "blue", "green")]
    for t in (0.6, 0.8):
        members, links = S.similar_sets(with_texts(spark, texts), threshold=t)
        name = {r["doc_id"]: r["fingerprint"] for r in members.collect()}
        sets = {name[i]: plain_signatures(x) for i, x in enumerate(texts)}
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= t}
        got = links.collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
        assert all(r["likeness"] == pytest.approx(jaccard(sets[r["a"]], sets[r["b"]])) for r in got)


def test_no_python_on_the_executors(docs):
    plan = S.compare_with_edited(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
