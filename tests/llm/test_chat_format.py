"""Chat formatting: reversible escapes, the role automaton, digests read back, long conversations."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from liftwise.llm.chat_format import INST, ChatTemplate, Marks, Reader, chat_text, check_order, escaped, format_turns, formatted_conversations, read_back, unescape, with_probe
from tests.llm.conftest import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "</s>", "[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "[", "<<SYS>>\n", "<<<SYS>>", " [/INST", "\\", "<<ROLE>>user\n", " ", "\n<</SYS>>", "ünï 🙂", "<s><s>", "[\\INST] <\\</SYS>>", "x" * 70_000 + "</s>"]


def key(turn, role, text):
    return (turn is not None, turn or 0, role or "", text or "")


def digests(rows):
    """From the definition: id -> (turns, hash of all turns, learned characters, their hash)."""
    result = {}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, n, r, t in sorted((r for r in rows if r[0] == conv), key=lambda r: key(*r[1:]))]
        learned = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        result[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return result


def awkward():
    rng = random.Random(5)
    rows = [(c, t, ("user", "assistant")[t % 2], rng.choice(ODD) + rng.choice(ODD)) for c in range(30) for t in range(c % 7 + 1)]
    rows += [(50, 0, "system", ODD[2]), (50, 1, "user", None), (50, 2, "assistant", ODD[1])]
    rows += [(51, 0, "tool\n\\<s>", "[INST]"), (51, 1, None, "no role"), (51, None, "user", "no turn"), (51, 1, "", "empty role")]
    rows += [(52, 0, "user", "a"), (52, 0, "user", "a"), (52, 0, "assistant", "same turn"), (None, 0, "user", "no id"), (None, 1, "assistant", None)]
    return rows + [(53, 0, "user", "one"), (53, 1, "user", "two"), (53, 2, "assistant", "three"), (54, 0, "assistant", "first"), (55, 0, "system", "only")]


def test_read_back_equals_the_turns(spark):
    df = with_clashes(spark.createDataFrame(awkward(), SCHEMA)).repartition(7)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in read_back(format_turns(df)).collect()}
    assert got == digests(awkward())


def test_formatted_text(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "[INST]"), (1, 2, "assistant", "a</s>"), (1, 3, "tool", "t")]
    df = format_turns(spark.createDataFrame(rows, SCHEMA))
    shown = [r["t"] for r in df.select("turn", chat_text("segments").alias("t")).orderBy("turn").collect()]
    assert shown == ["<<SYS>>\ns\n<</SYS>>\n", "[INST] [\\INST] [/INST]", "<s> a<\\/s> </s>", "<<ROLE>>\ntool\nt\n<</ROLE>>\n"]
    learned = [s["text"] for r in df.orderBy("turn").collect() for s in r["segments"] if s["loss"]]
    assert learned == ["a<\\/s>"]
    assert read_back(df).first()["formatted_chars"] == sum(map(len, shown))


PIECES = st.lists(st.sampled_from([*INST.controls, "\\", "<", "[", "/", "s>", "INST]", " ", "\n", "SYS>>", "a"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), PIECES), max_size=6), st.integers(1, 9))
def test_escapes_are_reversible_at_any_cut(turns, size):
    """The reader gets the text in pieces cut anywhere; Python writes what Spark writes (checked below)."""
    back = unescape()
    tails = re.compile(rf"({INST.tails()})(\\*)")
    whole = ""
    for role, text in turns:
        held = tails.sub(lambda m: m[1] + m[2] + "\\", text)
        assert back(held) == text and not any(c in held for c in INST.controls)
        m = INST.roles.get(role, INST.other)
        whole += m.before + ("" if role in INST.roles else role + "\n") + held + m.after
    reader, found = Reader(INST), []
    for at in range(0, len(whole), size):
        found += reader.feed(whole[at : at + size])
    reader.end()
    assert found == turns


def test_spark_escapes_as_python_does(spark):
    tails = re.compile(rf"({INST.tails()})(\\*)")
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "<SYS>>", " "]) for _ in range(9)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    assert all(r["e"] == tails.sub(lambda m: m[1] + m[2] + "\\", r["t"]) for r in df.collect())


def in_order(roles):
    state, bad = INST.start, None
    for i, r in enumerate(roles):
        to = INST.next_state(state, r)
        if to == "bad" and state != "bad":
            bad = i
        state = to
    return state in INST.ends, bad, state


def test_the_automaton_over_many_partitions(spark):
    """Conversations of any length, cut into as many ranges as there are partitions."""
    rng = random.Random(3)
    chats = {0: ["user", "assistant"] * 400, 1: ["user", "assistant"] * 300 + ["assistant"] + ["user"] * 50, 2: ["system"] + ["user", "assistant"] * 200 + ["user"]}
    chats |= {c: [rng.choice(["system", "user", "assistant", "tool"]) for _ in range(rng.randrange(1, 6))] for c in range(3, 60)}
    rows = [(c, t, r, "x") for c, roles in chats.items() for t, r in enumerate(roles)]
    rng.shuffle(rows)
    got = check_order(format_turns(spark.createDataFrame(rows, SCHEMA).repartition(6)), partitions=9).collect()
    assert {r["conv_id"]: (r["valid"], r["bad_turn"], r["state"]) for r in got} == {c: in_order(roles) for c, roles in chats.items()}


def test_verdicts_of_awkward_rows(spark):
    rows = {r["conv_id"]: r for r in formatted_conversations(spark.createDataFrame(awkward(), SCHEMA)).collect()}
    assert set(rows) == {r[0] for r in awkward()}
    assert rows[None]["valid"] and rows[50]["valid"] and not rows[51]["valid"] and not rows[55]["valid"]
    assert (rows[53]["valid"], rows[53]["bad_turn"], rows[54]["bad_turn"]) == (False, 1, 0)


def test_empty_and_probe(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert formatted_conversations(empty).count() == 0 and format_turns(empty).count() == 0
    rows = formatted_conversations(with_probe(empty, -7, [("user", "</s>"), ("assistant", "</s>")])).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"], r["valid"]) for r in rows] == [(-7, 2, 4, True)]


@pytest.mark.parametrize(
    "change",
    [
        {"controls": ("<s>", "s>")},
        {"controls": ("<<SYS>>", "< s>")},
        {"other": Marks("<<ROLE>>", "\n<</ROLE>>\n")},
        {"roles": {**INST.roles, "user": Marks("<s> ", " [/INST]")}},
    ],
)
def test_templates_that_could_not_be_read_back_are_errors(change):
    args = {"roles": INST.roles, "other": INST.other, "controls": INST.controls, "moves": INST.moves, "start": INST.start, "ends": INST.ends} | change
    with pytest.raises(ValueError):
        ChatTemplate(**args)
