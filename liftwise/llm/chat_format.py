"""Chat formatting from a declarative template, with a role automaton and a loss mask.

The template names the marks around each role's text, whether the text is learned from,
and the moves of a finite-state machine over roles.  A turn becomes text segments, each
with its loss flag, by column expressions alone, so formatting needs no shuffle.

Control strings inside a text are escaped: a backslash goes in after the first character
of what would read as a control string, after any backslashes that stand there already.
Taking one backslash out of every such place gives the text back, whatever it held.

The automaton is run over conversations of any length: turns are range-partitioned by
conversation and turn, every partition turns its run of a conversation into a map from
states to states, and the maps of a conversation are composed in order.  Reading back and
hashing a whole conversation is sequential by nature: rows stream through in order and
nothing but the current turn is held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "bad"  # the state after a turn out of order; nothing leaves it


@dataclass(frozen=True)
class Marks:
    """What stands before and after the text of a role, and whether the text is learned from."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Marks by role, the marks of any other role (its name goes between ``other_role`` and a
    line end), the control strings that texts must not hold, and the automaton: a state
    after each allowed move, a start, and the states in which a conversation may end."""

    roles: Mapping[str, Marks]
    other: Marks
    controls: tuple[str, ...]
    moves: Mapping[str, Mapping[str, str]]
    start: str
    ends: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        if any(re.search(r"[\\\s]", c) or len(c) < 2 for c in self.controls):
            raise ValueError("a control string is two characters or more, without white space and backslashes")
        for a in self.controls:
            for b in self.controls:
                if any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1, len(a))):
                    raise ValueError(f"{b!r} may begin inside {a!r}")
        for m in [*self.roles.values(), self.other]:
            if not (any(m.before.startswith(c) for c in self.controls) and m.before[-1:].isspace() and m.after[:1].isspace()):
                raise ValueError("a mark opens with a control string, and white space keeps it apart from the text")
            if not any(m.after.strip().startswith(c) for c in self.controls):
                raise ValueError("a closing mark holds a control string")
        opens = [m.before for m in [*self.roles.values(), self.other]]
        if any(a != b and b.startswith(a) for a in opens for b in opens) or len(set(opens)) < len(opens):
            raise ValueError("opening marks must tell roles apart")

    @property
    def states(self) -> list[str]:
        reached = {s for m in self.moves.values() for s in m.values()}
        return sorted({self.start, *self.moves, *reached} - {BAD}) + [BAD]

    def tails(self) -> str:
        """A pattern for a control string's first character and, looking ahead, the rest."""
        by_first: dict[str, list[str]] = {}
        for c in self.controls:
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(f"{re.escape(f)}(?=\\\\*(?:{'|'.join(t)}))" for f, t in by_first.items())

    def next_state(self, state: str, role: str) -> str:
        return self.moves.get(state, {}).get(role, BAD)


# The marks of instruction-tuned chat models with [INST] turns.
INST = ChatTemplate(
    roles={
        "system": Marks("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Marks("[INST] ", " [/INST]"),
        "assistant": Marks("<s> ", " </s>", loss=True),
    },
    other=Marks("<<ROLE>>\n", "\n<</ROLE>>\n"),
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>"),
    moves={
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    start="start",
    ends=frozenset({"asked", "answered"}),
)


def escaped(text: Column, template: ChatTemplate = INST) -> Column:
    """``text`` with a backslash inside everything that reads as a control string."""
    return F.regexp_replace(text, rf"({template.tails()})(\\*)", r"$1$2\\")


def unescape(template: ChatTemplate = INST) -> Callable[[str], str]:
    """The way back from :func:`escaped`, for use in tasks."""
    pattern = re.compile(rf"({template.tails()})(\\*)\\")
    return lambda text: pattern.sub(r"\1\2", text)


def format_turns(turns: DataFrame, template: ChatTemplate = INST, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each row of ``turns``: ``conv_id``, ``turn``, ``role``, ``raw`` (the text, by
    which rows of one turn number are ordered) and ``segments``, an array of (text, loss).

    The formatted conversation is its rows' segments joined, rows in order of ``turn``, role
    and text, nulls first.  A null text is the empty text, a null role the empty role.  A
    role the template does not name gets the marks of other roles with its name in them.
    Repeated rows stay.  An empty table gives an empty result; other columns are ignored.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    name = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))

    def segment(c: Column, loss: bool) -> Column:
        return F.struct(c.alias("text"), F.lit(loss).alias("loss"))

    def parts(before: Column, m: Marks) -> Column:
        return F.array(segment(before, False), segment(escaped(text, template), m.loss), segment(F.lit(m.after), False))

    other = F.concat(F.lit(template.other.before), escaped(name, template), F.lit("\n"))
    segments = parts(other, template.other)
    for known, m in template.roles.items():
        segments = F.when(role == known, parts(F.lit(m.before), m)).otherwise(segments)
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("raw"), segments.alias("segments"))


def check_order(formatted: DataFrame, template: ChatTemplate = INST, partitions: int | None = None) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``valid``, ``bad_turn``, ``state``.

    ``valid``: every turn is an allowed move and the last state may end a conversation;
    ``bad_turn``: number of the first turn out of order (null if none, or if the turn has no
    number); ``state``: the last state.  Reads ids and roles only; a long conversation is
    spread over many tasks.  Conversations of null id are one conversation.
    """
    spark = formatted.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    states = template.states
    at = {s: i for i, s in enumerate(states)}
    moves = {role: [at[template.next_state(s, role)] for s in states] for m in template.moves.values() for role in m}
    bad = at[BAD]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        held: list | None = None  # conversation, next state and first bad turn by first state

        def rows(runs: list[list]) -> pa.RecordBatch:
            conv, after, first_bad = zip(*runs)
            ints = pa.array(after, pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict({"conv_id": pa.array(conv, pa.int64()), "piece": pa.array([piece] * len(conv), pa.int32()), "next": ints, "bad": pa.array(first_bad, pa.list_(pa.int64()))})

        for batch in batches:
            done = []
            for conv, turn, role in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role"))):
                if held is None or held[0] != conv:
                    if held is not None:
                        done.append(held)
                    held = [conv, list(range(len(states))), [None] * len(states)]
                step = moves.get(role)
                for i, s in enumerate(held[1]):
                    to = step[s] if step else bad
                    if to == bad and s != bad:
                        held[2][i] = turn
                    held[1][i] = to
            if done:
                yield rows(done)
        if held is not None:
            yield rows([held])

    keys = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.monotonically_increasing_id().alias("i"))
    laid = keys.repartitionByRange(n, "conv_id", "turn", "role", "i").sortWithinPartitions("conv_id", "turn", "role")
    maps = laid.select("conv_id", "turn", "role").mapInArrow(runs, "conv_id long, piece int, next array<int>, bad array<long>")
    grouped = maps.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "next", "bad"))).alias("maps"))
    none = F.struct(F.lit(at[template.start]).alias("state"), F.lit(None).cast("long").alias("bad_turn"))

    def compose(so_far: Column, m: Column) -> Column:
        return F.struct(
            F.get(m["next"], so_far["state"]).alias("state"),
            F.when(so_far["state"] == bad, so_far["bad_turn"]).otherwise(F.get(m["bad"], so_far["state"])).alias("bad_turn"),
        )

    ended = grouped.select("conv_id", F.aggregate("maps", none, compose).alias("end"))
    state = F.element_at(F.array(*[F.lit(s) for s in states]), F.col("end.state") + 1)
    return ended.select("conv_id", state.isin(*sorted(template.ends)).alias("valid"), F.col("end.bad_turn").alias("bad_turn"), state.alias("state"))


class Reader:
    """Takes a formatted conversation piece by piece and gives back its turns."""

    def __init__(self, template: ChatTemplate):
        marks = [*template.roles.items(), (None, template.other)]
        options = []
        for i, (role, m) in enumerate(marks):
            name = r"(?P<role>[^\n]*)\n" if role is None else ""
            options.append(rf"{re.escape(m.before)}{name}(?P<t{i}>.*?){re.escape(m.after)}")
        self.roles = [role for role, _ in marks]
        self.pattern = re.compile("|".join(options), re.S)
        self.unescape = unescape(template)
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn that ``piece`` completes."""
        self.rest += piece
        at = 0
        while found := self.pattern.match(self.rest, at):
            i = next(i for i in range(len(self.roles)) if found[f"t{i}"] is not None)
            role = self.roles[i]
            if role is None:
                role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(found["role"]))
            yield role, self.unescape(found[f"t{i}"])
            at = found.end()
        self.rest = self.rest[at:]

    def end(self) -> None:
        if self.rest:
            raise ValueError("a formatted conversation ends inside a turn")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, template: ChatTemplate = INST) -> DataFrame:
    """One row for each conversation, from the segments alone: ``n_turns``, ``turns_sha256`` (role,
    line end, text, line end of every turn), ``loss_chars``, ``loss_sha256`` (all text under the
    loss mask) and ``formatted_chars``; texts unescaped.

    Rows are shuffled by conversation, sorted (on disk if need be) and streamed, so a
    conversation of any length takes the memory of one turn.  A conversation without turns
    has no row.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(template), None

        def row(h: dict) -> dict:
            reader.end()
            return {"conv_id": h["conv"], "n_turns": h["n"], "turns_sha256": h["all"].hexdigest(), "loss_chars": h["chars"], "loss_sha256": h["loss"].hexdigest(), "formatted_chars": h["formatted"]}

        out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            done = []
            for conv, segments in zip(batch.column("conv_id").to_pylist(), batch.column("segments").to_pylist()):
                if held is None or held["conv"] != conv:
                    if held is not None:
                        done.append(row(held))
                    held = {"conv": conv, "n": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                for s in segments:
                    held["formatted"] += len(s["text"])
                    if s["loss"]:
                        learned = reader.unescape(s["text"])
                        held["chars"] += len(learned)
                        held["loss"].update(learned.encode())
                for role, text in reader.feed("".join(s["text"] for s in segments)):
                    held["n"] += 1
                    held["all"].update(f"{role}\n{text}\n".encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
        if held is not None:
            yield pa.RecordBatch.from_pylist([row(held)], schema=out)

    rows = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "raw", "segments")
    laid = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "raw")
    return laid.select("conv_id", "segments").mapInArrow(digests, READ)


def chat_text(segments: Column | str) -> Column:
    """The formatted text of one row's segments."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def formatted_conversations(turns: DataFrame, template: ChatTemplate = INST) -> DataFrame:
    """:func:`read_back` of the formatted turns beside the verdict of :func:`check_order`."""
    formatted = format_turns(turns, template)
    verdict = check_order(formatted, template)
    read = read_back(formatted, template)
    same = read["conv_id"].eqNullSafe(verdict["conv_id"])
    return read.join(verdict, same).select(read["*"], "valid", "bad_turn", "state")


def with_probe(turns: DataFrame, conv_id: int, texts: list[tuple[str, str]]) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) and one more conversation of (role, text) rows."""
    rows = [F.struct(F.lit(conv_id).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(t).alias("text")) for i, (r, t) in enumerate(texts)]
    more = turns.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return reduce(DataFrame.unionByName, [turns.select("conv_id", "turn", "role", "text"), more])
