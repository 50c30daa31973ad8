"""Dumps by byte ranges: any block size gives what the plain parse gives, also from one huge statement."""

from __future__ import annotations

import random
import re

import pytest

from liftwise.schemas import FACT, PRODUCTS
from liftwise.sources.sqldump import parse_insert_lines, read_dump_tables, read_insert_rows
from liftwise.sources.sqltext import CODE, RUN, Scan, Start, Tuples, block_starts, dump_starts, read_blocks
from tests.conftest import DATA

NAMES = ["Widget", "a),(b", "it''s (x)", "back\\\\", "quote \\' ) here", "semi;\nINSERT INTO dim_products VALUES (''no'',''no'',''no'');", "-- not a comment", "/* nor this */", '"double" `tick`', "", "ünï 🙂)", "x" * 300 + ")" * 40, "\\\\\\')"]


def products(n, seed=1):
    rng = random.Random(seed)
    return [(f"P{i}", rng.choice(NAMES), rng.choice(NAMES)) for i in range(n)]


def statement(rows, end="\n", head="INSERT INTO `dim_products` VALUES "):
    return head + f",{end if end != ' ' else ''}".join(f"('{a}','{b}','{c}')" for a, b, c in rows) + ";" + end


HEADER = "-- Host: it's a dump; with (brackets\n/*!40101 SET NAMES 'utf8' */;\n# hash ' comment\nCREATE TABLE `dim_products` (`a` varchar(10) DEFAULT 'x)', KEY (`a`(4)));\nLOCK TABLES `dim_products` WRITE;\n"


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def plain(text):
    return re.sub(r"\\(.)|''", lambda m: m[1] or "'", text, flags=re.S)


def expected(rows):
    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("end", ["\n", "\r\n", " "])
@pytest.mark.parametrize("block", [None, 450])
def test_one_huge_statement(spark, tmp_path, end, block):
    rows = products(120)
    path = write(tmp_path / "d.sql", HEADER.replace("\n", end if end != " " else "\n") + statement(rows, end) + "UNLOCK TABLES;" + end)
    got = read_insert_rows(spark, path, "dim_products", PRODUCTS, block)
    assert rows_of(got) == expected(rows)


def test_it_is_read_by_many_tasks(spark, tmp_path):
    path = write(tmp_path / "d.sql", statement(products(400), " "))
    blocks = read_blocks(spark, path, 3000)
    assert blocks.rdd.getNumPartitions() > 10
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "3000"
    starts = dump_starts(blocks)
    assert len(starts) > 10 and any(s.state != CODE or s.depth for s in starts.values())


@pytest.mark.parametrize("block", [700, None])
def test_many_statements_tables_and_files(spark, tmp_path, block):
    rows = products(90, seed=3)
    other = "".join(f"INSERT INTO `other` VALUES ({i},'x;)''','INSERT INTO dim_products VALUES (1)');\n" for i in range(40))
    first = HEADER + other + statement(rows[:30]) + other + "insert ignore into shop.dim_products (category, `product_code`,\n product_name) values "
    first += ",\n  ".join(f"('{c}', '{a}' , '{b}')" for a, b, c in rows[30:60]) + " ;\n" + other
    write(tmp_path / "a.sql", first)
    write(tmp_path / "b.sql", statement(rows[60:]).rstrip("\n;"))  # ends with a bracket
    write(tmp_path / "c.sql", "")
    got = read_insert_rows(spark, str(tmp_path), "dim_products", PRODUCTS, block)
    assert rows_of(got) == expected(rows)


def test_a_value_longer_than_many_blocks(spark, tmp_path):
    rows = [("P1", "long " + "(x)'' " * 2000, "c"), ("P2", "b", "c"), ("P3", ")" * 5000, "c")]
    path = write(tmp_path / "d.sql", statement(rows, " "))
    assert rows_of(read_insert_rows(spark, path, "dim_products", PRODUCTS, 1500)) == expected(rows)


def test_a_large_unwanted_table_and_a_cut_head(spark, tmp_path):
    big = "INSERT INTO `fact` VALUES " + ",".join(f"({i},'it''s) ; fine')" for i in range(3000)) + ";\n"
    head = "INSERT INTO dim_products (product_code, product_name, category(x))\n" + "\n" * 50 + "VALUES ('P1','(b)','c');\n"
    path = write(tmp_path / "d.sql", big + statement(products(3)) + big)
    for block in (5000, 20_000, None):
        assert rows_of(read_insert_rows(spark, path, "dim_products", PRODUCTS, block)) == expected(products(3))
    path = write(tmp_path / "h.sql", head.replace("category(x)", "`category`"))
    assert rows_of(read_insert_rows(spark, path, "dim_products", PRODUCTS, 70)) == [("P1", "(b)", "c")]


@pytest.mark.parametrize(
    "text",
    [
        "INSERT INTO dim_products SELECT a, b, c FROM t;",
        "INSERT INTO dim_products VALUES ('a','b','c') ON DUPLICATE KEY UPDATE x = 1;",
        "INSERT INTO dim_products VALUES ('a','b','c'),('d','e",
        "INSERT INTO dim_products VALUES ('a','b','c'),('d','e','f'",
        "INSERT INTO dim_products VALUES ('a','b');",
        "INSERT INTO dim_products",
    ],
)
@pytest.mark.parametrize("block", [60, None])
def test_nothing_of_a_wanted_table_is_dropped(spark, tmp_path, text, block):
    path = write(tmp_path / "d.sql", statement(products(5)) + text)
    with pytest.raises(Exception, match="not a list of value tuples|wrong length"):
        read_insert_rows(spark, path, "dim_products", PRODUCTS, block).collect()


def test_strings_in_double_quotes(spark):
    lines = spark.createDataFrame([('INSERT INTO dim_products VALUES ("P""1","it\'s, (b)",\'say "c"\')',)], "value string")
    assert rows_of(parse_insert_lines(lines, "dim_products", PRODUCTS)) == [('P"1', "it's, (b)", 'say "c"')]


def test_dump_tables_share_one_scan(spark):
    small, plain = read_dump_tables(spark, f"{DATA}/mini_dump.sql", 50), read_dump_tables(spark, f"{DATA}/mini_dump.sql")
    for name in plain:
        assert rows_of(small[name]) == rows_of(plain[name])
    assert small["fact"].schema == plain["fact"].schema and small["fact"].columns == FACT.names


def test_tables_compose_at_any_cut():
    """Blocks cut behind any bracket: composed tables give the states of one scan, tuples the whole list."""
    rng = random.Random(9)
    text = (HEADER + statement(products(25, 5), " ") + "UPDATE t SET a = 'x)' WHERE (b = \"y')\");\n" + statement(products(25, 6))).encode()
    brackets = [i + 1 for i, c in enumerate(text) if c == ord(")")]
    whole = [t for _, ts in Tuples("dim_products", Start(CODE, 0, b"", True, False)).feed(text) for t in ts]
    assert len(whole) == 50 and RUN.match(text).end() == len(text)
    for _ in range(200):
        cuts = sorted(rng.sample(brackets, rng.randrange(1, 12)))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)]) if a < b]
        tables, at = [], 0
        for piece in pieces:
            runs = [Scan(s) for s in range(6)]
            for r in runs:
                r.feed(piece)
            tables.append({"file": 1, "start": at, "size": len(text), "bytes": len(piece), "first": piece[: 16 << 10], "next": [r.state for r in runs], "depth": [r.depth for r in runs], "head": [r.head for r in runs]})
            at += len(piece)
        starts, found, open_ = block_starts(tables), [], b""
        for t, piece in zip(tables, pieces):
            reader = Tuples("dim_products", starts[1, t["start"]])
            got = [x for _, xs in reader.feed(piece) for x in xs]
            left = reader.end()
            if reader.fragment:
                open_ += reader.fragment
                if not reader.crossing:
                    found.append(open_[1:-1])
                    open_ = b""
            found += got
            if left:
                open_ = left
        assert found == whole


def test_small_blocks_share_tasks_and_starts(spark, tmp_path):
    """Tasks, and what the driver holds, follow the dump's size and the cores, not the number of blocks."""
    rows = products(2000, seed=7)
    half = len(rows) // 2
    write(tmp_path / "a.sql", HEADER + statement(rows[:half], " "))
    write(tmp_path / "b.sql", statement(rows[half:]))
    most = 4 * spark.sparkContext.defaultParallelism
    blocks = read_blocks(spark, str(tmp_path), 500)
    assert blocks.rdd.getNumPartitions() <= most < (tmp_path / "b.sql").stat().st_size / 500
    assert len(dump_starts(blocks)) <= 3 * most
    for block in (100, 500):
        assert rows_of(read_insert_rows(spark, str(tmp_path), "dim_products", PRODUCTS, block)) == expected(rows)


def test_a_full_head_is_held_once():
    table = {"file": 1, "size": 10**9, "bytes": 10**5, "first": b"x" * (16 << 10), "next": [CODE] * 6, "depth": [0] * 6, "head": [None] * 6}
    starts = block_starts([table | {"start": n * 10**5} for n in range(50)])
    assert len({id(s.head) for s in starts.values()}) == 2


def test_text_functions_are_planned_once_for_all_columns(spark):
    lines = spark.createDataFrame([("INSERT INTO fact_events VALUES (1,2,3,4,5,6,7,8)",)], "value string")
    parsed = parse_insert_lines(lines, "fact_events", FACT)
    assert [tuple(r) for r in parsed.collect()] == [("1", "2", "3", "4", 5, "6", 7, 8)]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < len(FACT.fields)


def test_statements_of_one_tuple_in_odd_forms(spark):
    texts = [
        "INSERT INTO dim_products VALUES ('a','','it''s')",
        "insert into `dim_products` (category, product_code) values ( 'c\\n\\'' , 'b)(' ) ; ",
        "-- note\nINSERT INTO dim_products VALUES (NULL,'NULL',null);",
        "INSERT INTO dim_products VALUES ('d','\\\\','x'),('e','(',\"\")",
        "INSERT INTO other VALUES ('f','g','h')",
        None,
    ]
    got = parse_insert_lines(spark.createDataFrame([(t,) for t in texts], "value string"), "dim_products", PRODUCTS)
    want = [("a", "", "it's"), ("b)(", None, "c\n'"), (None, "NULL", None), ("d", "\\", "x"), ("e", "(", "")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    for wrong in ("INSERT INTO dim_products VALUES ('a' 'b','c','d')", "INSERT INTO dim_products VALUES ('a','b','c')) ;"):
        with pytest.raises(Exception, match="not a tuple of values|not a list of value tuples"):
            parse_insert_lines(spark.createDataFrame([(wrong,)], "value string"), "dim_products", PRODUCTS).collect()
