"""SQL dumps of any size by byte ranges: where the value tuples of a table's INSERT statements are.

A dump may be one statement on one line, so neither lines nor statements divide it.  Spark
cuts the file into blocks of bytes, each of which ends behind a closing bracket (the
record separator it is read with).  Whether a block begins inside a string, a comment or
a tuple depends on everything before it, so the dump is read twice:

1. Every block is scanned once from each lexical state it might begin in, and yields a small
   table: state at the end, change of bracket depth, and the beginning of the statement
   that is open at the end.  Tables compose, so a prefix over the blocks (a few numbers
   each) gives every block its true start.
2. Every block, started right, cuts out its tuples.  A tuple that crosses blocks is put
   together from its fragments.

A task reads many blocks where they are small, and neighbours in a task are read as one
block.  Only tables and statement heads reach the driver, a few KB for each of those: as
many as the session's partition size needs, however small the blocks are.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

# Lexical states at a block's start.  No token of two characters can cross it: the byte before is a bracket.
CODE, SINGLE, DOUBLE, BACKTICK, LINE, BLOCK = range(6)
OPENERS = {b"'": SINGLE, b'"': DOUBLE, b"`": BACKTICK, b"#": LINE, b"-": LINE, b"/": BLOCK}
# From inside a token to its end.
REST = {
    SINGLE: rb"[^'\\]*+(?:\\.[^'\\]*+)*+'",
    DOUBLE: rb'[^"\\]*+(?:\\.[^"\\]*+)*+"',
    BACKTICK: rb"[^`]*+`",
    LINE: rb"[^\n]*+\n",
    BLOCK: rb"[^*]*+(?:\*(?!/)[^*]*+)*+\*/",
}
TOKENS = b"|".join([b"'" + REST[SINGLE], b'"' + REST[DOUBLE], b"`" + REST[BACKTICK], b"(?:#|--(?=\\s))" + REST[LINE], rb"/\*" + REST[BLOCK]])
ENDS = {s: re.compile(p, re.S) for s, p in REST.items()}
TOKEN = re.compile(TOKENS, re.S)
PLAIN = rb"-(?!-\s)|/(?!\*)"
RUN = re.compile(rb"(?:[^'\"`#/\-]++|" + TOKENS + rb"|" + PLAIN + rb")*+", re.S)
STATEMENT = re.compile(rb"(?:[^;'\"`#/\-]++|" + TOKENS + rb"|" + PLAIN + rb")*+;", re.S)
IGNORED = re.compile(rb"(?:\s++|(?:#|--(?=\s))" + REST[LINE] + rb"|/\*" + REST[BLOCK] + rb")*+", re.S)
# A tuple's inside: strings, and anything that is no bracket.
INSIDE = rb"(?:'" + REST[SINGLE] + rb'|"' + REST[DOUBLE] + rb"|[^'\"()])*+"
TUPLE = re.compile(rb"\((" + INSIDE + rb")\)", re.S)
LIST = re.compile(rb"(?:[\s,]*+\(" + INSIDE + rb"\))*+[\s,]*+", re.S)
# One value and the comma behind it (one is added behind the last); a doubled quote is two strings side by side.
VALUE = rb"\s*+((?:'" + REST[SINGLE] + rb')++|(?:"' + REST[DOUBLE] + rb")++|[^',\"]*?)\s*+,"
VALUES = re.compile(VALUE, re.S)
ALL_VALUES = re.compile(rb"(?:" + VALUE + rb")*+", re.S)
TUPLE_END = re.compile(INSIDE + rb"\)", re.S)
# The beginning of a statement, which must name the table and the columns of an INSERT within it.
HEAD_BYTES = 16 << 10


@dataclass
class Scan:
    """A block read from one lexical state on: where it stands now."""

    state: int
    depth: int = 0
    head: bytes | None = None  # beginning of the open statement, if it began in this block

    def feed(self, text: bytes) -> None:
        at = 0
        if self.state != CODE:
            end = ENDS[self.state].match(text)
            if not end:
                self._grow(text, 0)
                return
            at, self.state = end.end(), CODE
        start = at
        run = RUN.match(text, at).end()
        if run < len(text):
            self.state = OPENERS[text[run : run + 1]]
        code = TOKEN.sub(b"", text[start:run])
        self.depth += code.count(b"(") - code.count(b")")
        if b";" in code:
            while found := STATEMENT.match(text, at):
                at = found.end()
            self.head = b""
            self._grow(text, at)
        else:
            self._grow(text, 0)

    def _grow(self, text: bytes, at: int) -> None:
        if self.head is not None and len(self.head) < HEAD_BYTES:
            self.head += text[at : at + HEAD_BYTES - len(self.head)]


SCANNED = "file long, start long, size long, bytes long, first binary, next array<int>, depth array<long>, head array<binary>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], bytes]]:
    """((file, block start, file size), text) of every batch, a block at a time: its records stand behind each other in one buffer.

    A block that begins where the one before it in the task ends goes on under that one's start.
    """
    at = (0, -1, -1, -1)  # file, start of the first neighbour, start and end of the newest
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts, sizes, lengths = (batch.column(c).to_numpy() for c in ("file", "start", "size", "length"))
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
        text = batch.column("text")
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        data = memoryview(text.buffers()[2])
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            file, start = int(files[a]), int(starts[a])
            if at[0] != file or start not in at[2:]:
                at = file, start, start, start
            at = file, at[1], start, start + int(lengths[a])
            yield (file, at[1], int(sizes[a])), bytes(data[offsets[a] : offsets[b]])


def scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow``: one row for each block, its table by lexical state."""
    held: dict = {}

    def done() -> pa.RecordBatch:
        runs = held["runs"]
        return pa.RecordBatch.from_pydict(
            {
                **{name: pa.array([value]) for name, value in zip(("file", "start", "size"), held["at"])},
                "bytes": pa.array([held["bytes"]]),
                "first": pa.array([held["first"]], pa.binary()),
                "next": pa.array([[r.state for r in runs]], pa.list_(pa.int32())),
                "depth": pa.array([[r.depth for r in runs]], pa.list_(pa.int64())),
                "head": pa.array([[r.head for r in runs]], pa.list_(pa.binary())),
            }
        )

    for at, text in _blocks(batches):
        if held and held["at"] != at:
            yield done()
            held = {}
        if not held:
            held = {"at": at, "bytes": 0, "first": b"", "runs": [Scan(s) for s in range(6)]}
        held["bytes"] += len(text)
        held["first"] += text[: max(0, HEAD_BYTES - len(held["first"]))]
        for r in held["runs"]:
            r.feed(text)
    if held:
        yield done()


@dataclass(frozen=True)
class Start:
    """The true start of a block: lexical state, bracket depth, beginning of the open statement;
    whether it is the file's last, and whether its last bracket is not in the file."""

    state: int
    depth: int
    head: bytes
    last: bool
    added: bool


def block_starts(tables: list) -> dict[tuple[int, int], Start]:
    """Prefix of the blocks' tables, file by file (rows of ``scan_blocks``)."""
    starts = {}
    by_file: dict[int, list] = {}
    for r in sorted(tables, key=lambda r: (r["file"], r["start"])):
        by_file.setdefault(r["file"], []).append(r)
    for file, rows in by_file.items():
        state, depth, head = CODE, 0, b""
        added = sum(r["bytes"] for r in rows) > rows[0]["size"]
        for i, r in enumerate(rows):
            last = i == len(rows) - 1
            starts[file, r["start"]] = Start(state, depth, head, last, last and added)
            opened = r["head"][state]
            if opened is not None:
                head = bytes(opened)
            elif len(head) < HEAD_BYTES:  # a full one is shared by the blocks behind it
                head = (head + bytes(r["first"]))[:HEAD_BYTES]
            state, depth = r["next"][state], depth + r["depth"][state]
    return starts


class Tuples:
    """One block, started right: its complete tuples of the wanted table, and the fragments at its ends."""

    def __init__(self, table: str, start: Start):
        name = re.escape(table.encode())
        begin = rb"INSERT\s+(?:\w+\s+)*?INTO\s+(?:`?\w+`?\s*\.\s*)?(?:`" + name + rb"`|" + name + rb"(?![\w`]))"
        self.table, self.begin = table, re.compile(begin, re.I)
        columns = rb"\((?:`[^`]*`|[^()'`]|\([^()']*\))*\)"
        self.head = re.compile(begin + rb"\s*(?:(" + columns + rb")\s*)?VALUES?(?!\w)", re.I)
        self.start, self.rest, self.names, self.skipped = start, b"", None, None
        self.fragment: bytes | None = None  # the end of a tuple that an earlier block began
        self.crossing = False  # still inside that tuple
        opening = IGNORED.match(start.head).end()
        found = self.head.match(start.head, opening)
        if found:
            self.names = found[1] or b""
            self.crossing = start.depth > 0 or start.state != CODE
            self.fragment = b"" if self.crossing else None
        elif len(start.head) < HEAD_BYTES:
            self.rest = start.head  # the whole statement so far; it is read again
        else:
            self._not_wanted(start.head, opening)
            self.skipped = start.state
    def _not_wanted(self, text: bytes, at: int) -> None:
        if self.begin.match(text, at):
            raise ValueError(f"INSERT into {self.table} is not a list of value tuples: {text[at : at + 200]!r}")

    def _cross(self, text: bytes) -> bytes:
        """``text`` without what belongs to the tuple of an earlier block."""
        self.fragment += text
        at = 0
        if self.start.state != CODE:
            end = ENDS[self.start.state].match(self.fragment)
            if not end:
                return b""
            at = end.end()
        end = TUPLE_END.match(self.fragment, at)
        if not end:
            return b""
        self.crossing = False
        text, self.fragment = self.fragment[end.end() :], self.fragment[: end.end()]
        return text

    def _skip(self, text: bytes) -> bytes:
        """``text`` behind the end of a statement that is not wanted."""
        at = 0
        if self.skipped != CODE:
            end = ENDS[self.skipped].match(text)
            if not end:
                return b""
            at = end.end()
        end = STATEMENT.match(text, at)
        if end:
            self.skipped = None
            return text[end.end() :]
        run = RUN.match(text, at).end()
        self.skipped = CODE if run == len(text) else OPENERS[text[run : run + 1]]
        return b""

    def feed(self, text: bytes) -> Iterator[tuple[bytes, list[bytes]]]:
        """(column list, insides of tuples) that ``text`` completes."""
        if self.crossing:
            text = self._cross(text)
        if self.skipped is not None:
            text = self._skip(text)
        if not text or self.crossing or self.skipped is not None:
            return
        self.rest += text
        at = 0
        while True:
            if self.names is not None:
                end = LIST.match(self.rest, at).end()
                found = TUPLE.findall(self.rest, at, end)
                if found:
                    yield self.names, found
                at = end
                if at == len(self.rest) or self.rest[at : at + 1] == b"(":
                    break
                if self.rest[at : at + 1] != b";":
                    raise ValueError(f"INSERT into {self.table} is not a list of value tuples: {self.rest[at : at + 200]!r}")
                at, self.names = at + 1, None
                continue
            begin = IGNORED.match(self.rest, at).end()
            found = self.head.match(self.rest, begin)
            if found:
                self.names, at = found[1] or b"", found.end()
                continue
            ended = STATEMENT.match(self.rest, begin)
            if ended:
                self._not_wanted(self.rest[: ended.end()], begin)
                at = ended.end()
                continue
            if len(self.rest) - begin >= HEAD_BYTES:
                self._not_wanted(self.rest, begin)
                self.skipped = CODE
                self._skip(self.rest[begin:])
                at = len(self.rest)
            break
        self.rest = self.rest[at:]

    def end(self) -> bytes | None:
        """The beginning of a tuple that a later block ends, if any."""
        left = self.rest if self.names is not None and not self.crossing else b""
        if self.start.last and (left.strip() or self.crossing):
            raise ValueError(f"INSERT into {self.table} is not a list of value tuples: the dump ends inside one")
        if self.start.last and self.names is None and self.skipped is None:
            self._not_wanted(self.rest, IGNORED.match(self.rest).end())
        return left or None


VALUE_ROWS = "names string, v array<string>"
# kind: 1 a tuple's beginning, 2 a piece of one that began earlier.
FRAGMENTS = "file long, start long, kind int, names string, text string"


def value_rows(table: str, found: list[tuple[bytes, list[bytes]]]) -> pa.RecordBatch:
    """Insides of tuples (by column list) as their values; strings in single quotes, escapes still on."""
    flat, lengths, names = [], [0], []
    for columns, tuples in found:
        names += [columns.decode()] * len(tuples)
        for t in tuples:
            t += b","
            values = VALUES.findall(t)
            if sum(map(len, values)) + len(values) != len(t) and ALL_VALUES.match(t).end() != len(t):  # space around values, or none
                raise ValueError(f"not a tuple of values of {table}: {t[:200]!r}")
            if b'"' in t:  # strings in double quotes are written as the others
                values = [b"'" + v[1:-1].replace(b'""', b'"').replace(b"'", b"''") + b"'" if v[:1] == b'"' else v for v in values]
            flat += values
            lengths.append(len(flat))
    values = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_pydict({"names": pa.array(names, pa.string()), "v": values})


def cut_tuples(table: str, starts: dict[tuple[int, int], Start], fragments: bool) -> Callable:
    """A ``mapInArrow`` function: the tuples of ``table``, or else the fragments at the blocks' ends."""

    def fragment(at: tuple[int, int], kind: int, names: bytes, text: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "file": pa.array([at[0]]),
                "start": pa.array([at[1]]),
                "kind": pa.array([kind], pa.int32()),
                "names": pa.array([names.decode()]),
                "text": pa.array([text], pa.binary()).cast(pa.string()),
            }
        )

    def block(pieces: Iterator[bytes], at: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        reader = Tuples(table, starts[at])
        waiting = None
        for text in pieces:
            if waiting is not None:
                yield from (value_rows(table, [found]) for found in reader.feed(waiting) if not fragments)
            waiting = text
        yield from (value_rows(table, [found]) for found in reader.feed(waiting[:-1] if starts[at].added else waiting) if not fragments)
        names, left = reader.names or b"", reader.end()
        if fragments and reader.fragment:
            yield fragment(at, 2, b"", reader.fragment)
        if fragments and left:
            yield fragment(at, 1, names, left)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, _), pieces in groupby(_blocks(batches), key=lambda b: b[0]):
            if (file, start) not in starts:
                raise RuntimeError("the dump changed while it was read")
            yield from block((text for _, text in pieces), (file, start))

    return cut


def split_tuples(table: str) -> Callable:
    """A ``mapInArrow`` function over whole tuples (``names``, ``t``)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, t in zip(batch.column("names").to_pylist(), batch.column("t").to_pylist()):
                inside = TUPLE.fullmatch(t.encode())
                if not inside:
                    raise ValueError(f"not a tuple of values of {table}: {t[:200]!r}")
                yield value_rows(table, [(names.encode(), [inside[1]])])

    return split


def text_tuples(table: str) -> Callable:
    """A ``mapInArrow`` function over texts of whole statements (``text``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Tuples(table, Start(CODE, 0, b"", True, False)).head.pattern
        one_row = re.compile(rb"(?>" + head + rb")\s*+" + TUPLE.pattern + rb"\s*+;?+\s*+", re.I | re.S)
        for batch in batches:
            found = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                text = text or b""
                one = one_row.fullmatch(text)
                if one:  # one statement of one tuple needs no reader
                    found.append((one[1] or b"", [one[2]]))
                    continue
                reader = Tuples(table, Start(CODE, 0, b"", True, False))
                found += reader.feed(text)
                reader.end()
            yield value_rows(table, found)

    return cut


def _bytes(size: str) -> int:
    """A setting such as 128MB, 64k or 1000b as a number."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


def read_blocks(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """The dump at ``path`` (a file, folder or pattern) as ``file``, ``start``, ``size``, ``length``, ``text``: records up to each closing bracket.

    Blocks are ``block_bytes`` long (default: the session's ``spark.sql.files.maxPartitionBytes``),
    whatever the number of executors.  Small ones share a task up to that setting's bytes, but
    leave a few tasks for each core.  A sibling session holds the block length, so the
    caller's settings stay as they are.
    """
    sibling = spark.newSession()
    task_bytes = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if block_bytes:
        sibling.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    else:
        sibling.conf.set("spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    sibling.conf.set("spark.sql.files.minPartitionNum", "1")
    sibling.conf.set("spark.sql.files.openCostInBytes", "1")
    lines = sibling.read.option("lineSep", ")").text(path)
    where = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_block_start", "start"), ("file_size", "size"), ("file_block_length", "length"))]
    blocks = lines.select(F.xxhash64("_metadata.file_path").alias("file"), *where, F.concat("value", F.lit(")")).cast("binary").alias("text"))
    if not block_bytes or block_bytes >= task_bytes:
        return blocks
    parts = lines.rdd.getNumPartitions()
    tasks = max(4 * spark.sparkContext.defaultParallelism, math.ceil(parts * block_bytes / task_bytes))
    return blocks.coalesce(tasks) if tasks < parts else blocks


def dump_starts(blocks: DataFrame) -> dict[tuple[int, int], Start]:
    """The true start of every block of ``blocks`` (one pass over the text; a few KB a block come to the driver)."""
    return block_starts(blocks.mapInArrow(scan_blocks, SCANNED).collect())


def insert_tuples(blocks: DataFrame, table: str, starts: dict[tuple[int, int], Start] | None = None) -> DataFrame:
    """(``names``: column list or empty, ``v``: values as written) of every tuple inserted into ``table``."""
    starts = dump_starts(blocks) if starts is None else starts
    whole = blocks.mapInArrow(cut_tuples(table, starts, False), VALUE_ROWS)
    if all(s.state == CODE and s.depth == 0 for s in starts.values()):
        return whole
    pieces = blocks.mapInArrow(cut_tuples(table, starts, True), FRAGMENTS)  # two a block at most
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    numbered = pieces.withColumn("nth", F.count_if(F.col("kind") == 1).over(order))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))), lambda p: p["text"])
    joined = numbered.groupBy("file", "nth").agg(F.max("names").alias("names"), F.array_join(parts, "").alias("t"))
    return whole.unionByName(joined.select("names", "t").mapInArrow(split_tuples(table), VALUE_ROWS))
