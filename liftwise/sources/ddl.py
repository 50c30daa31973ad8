"""Table definitions from a dump's CREATE TABLE statements (S6), and how they differ from the declared schemas."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from liftwise.schemas import LEGACY_COLUMN_NAMES, PRIMARY_KEYS
from liftwise.sources.rejects import LENGTHS, SCHEMAS
from liftwise.sources.sqltext import Start, Tuples, _blocks, dump_starts, read_blocks

CREATE = re.compile(rb"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?", re.I)
NAME = r"(?:`((?:[^`]|``)*)`|(\w+))"
HEAD = re.compile(rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:(?:`[^`]*`|\w+)\s*\.\s*)?{NAME}\s*\(", re.I)
STRING = r"'(?:[^'\\]|\\.|'')*'|`[^`]*`"
PART = re.compile(rf"(?:{STRING}|\((?:{STRING}|\((?:{STRING}|[^()'`])*\)|[^()'`])*\)|[^,()'`])+", re.S)
COLUMN = re.compile(rf"\s*{NAME}\s+(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?(.*)", re.S)
KEY = re.compile(r"\s*PRIMARY\s+KEY\s*\(([^)]*)\)", re.I)
OTHER = re.compile(r"\s*(?:UNIQUE|KEY|INDEX|CONSTRAINT|FOREIGN|FULLTEXT|SPATIAL|CHECK)\b", re.I)
# SQL types and their counterparts.
TYPES = {
    **dict.fromkeys(["char", "varchar", "text", "tinytext", "mediumtext", "longtext", "enum"], T.StringType()),
    **dict.fromkeys(["tinyint", "smallint", "mediumint", "int", "integer"], T.IntegerType()),
    "bigint": T.LongType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
}


@dataclass(frozen=True)
class TableDefinition:
    """One CREATE TABLE: columns in order, lengths by column, primary key, collation if declared."""

    name: str
    schema: T.StructType
    lengths: dict[str, int] = field(default_factory=dict)
    primary_key: tuple[str, ...] = ()
    collation: str | None = None


def parse_create_table(text: str) -> TableDefinition:
    """The definition in one CREATE TABLE statement; bracketed quantity names get their underscore spelling."""
    head = HEAD.search(text)
    if not head:
        raise ValueError(f"not a CREATE TABLE statement: {text[:100]}")
    at, parts = head.end(), []
    while part := PART.match(text, at):
        parts.append(part[0])
        at = part.end()
        if text[at : at + 1] != ",":
            break
        at += 1
    if text[at : at + 1] != ")":
        raise ValueError(f"CREATE TABLE is not read to its end: {text[at : at + 100]}")
    fields, lengths, key = [], {}, ()
    for part in parts:
        if found := KEY.match(part):
            key = tuple(_spelled(n.strip().strip("`")) for n in found[1].split(","))
        elif not OTHER.match(part):
            c = COLUMN.match(part)
            name, kind = _spelled((c[1] or c[2]).replace("``", "`")), c[3].lower()
            if kind in ("decimal", "numeric"):
                data = T.DecimalType(int(c[4] or 10), int(c[5] or 0))
            elif kind in TYPES:
                data = TYPES[kind]
            else:
                raise ValueError(f"column {name} has an unknown type: {kind}")
            if c[4] and isinstance(data, T.StringType):
                lengths[name] = int(c[4])
            rest = re.sub(r"'(?:[^'\\]|\\.|'')*'", "", c[6])
            fields.append(T.StructField(name, data, not re.search(r"\bNOT\s+NULL\b|\bPRIMARY\s+KEY\b", rest, re.I)))
            if re.search(r"\bPRIMARY\s+KEY\b", rest, re.I):
                key = (name,)
    collation = re.search(r"\bCOLLATE\s*=?\s*(\w+)", text[at:], re.I)
    return TableDefinition((head[1] or head[2]).replace("``", "`"), T.StructType(fields), lengths, key, collation and collation[1])


def _spelled(name: str) -> str:
    return LEGACY_COLUMN_NAMES.get(name, name)


class _Definitions(Tuples):
    """Collects the CREATE TABLE statements that end in a block."""

    def __init__(self, start: Start):
        self.found: list[bytes] = []
        super().__init__("\0", start)

    def _not_wanted(self, text: bytes, at: int) -> None:
        if CREATE.match(text, at) and text.rstrip()[-1:] == b";":
            self.found.append(text[at:])


def read_definitions(spark: SparkSession, path: str, block_bytes: int | None = None) -> dict[str, TableDefinition]:
    """The definitions of all tables that the dump at ``path`` creates, by name.

    The dump is read by byte ranges; only its CREATE TABLE statements (of up to 16 KB) come
    to the driver.  The last definition of a name holds.
    """
    blocks = read_blocks(spark, path, block_bytes)
    starts = dump_starts(blocks)

    def definitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, _), pieces in groupby(_blocks(batches), key=lambda b: b[0]):
            reader = _Definitions(starts[file, start])
            for _, text in pieces:
                list(reader.feed(text))
            n = len(reader.found)
            yield pa.RecordBatch.from_pydict({"file": pa.array([file] * n, pa.int64()), "start": pa.array([start] * n, pa.int64()), "text": pa.array([t.decode() for t in reader.found], pa.string())})

    rows = blocks.mapInArrow(definitions, "file long, start long, text string").collect()
    found = [parse_create_table(r["text"]) for r in sorted(rows, key=lambda r: (r["file"], r["start"]))]
    return {d.name: d for d in found}


def drift(found: TableDefinition, table: str) -> list[str]:
    """How a definition differs from the declared schema of ``table``: names, order, types, NOT NULL, lengths, key."""
    out = []
    declared = SCHEMAS[table]
    if found.schema.names != declared.names:
        out.append(f"columns {found.schema.names}, declared {declared.names}")
    ours = {f.name: f for f in declared.fields}
    for f in found.schema.fields:
        if f.name not in ours:
            continue
        if f.dataType != ours[f.name].dataType:
            out.append(f"{f.name}: {f.dataType.simpleString()}, declared {ours[f.name].dataType.simpleString()}")
        if f.nullable != ours[f.name].nullable:
            out.append(f"{f.name}: {'NULL' if f.nullable else 'NOT NULL'}, declared otherwise")
        if found.lengths.get(f.name) != LENGTHS[table].get(f.name):
            out.append(f"{f.name}: length {found.lengths.get(f.name)}, declared {LENGTHS[table].get(f.name)}")
    key = (PRIMARY_KEYS[table],) if table in PRIMARY_KEYS else ()
    if found.primary_key != key:
        out.append(f"primary key {found.primary_key}, declared {key}")
    return out
