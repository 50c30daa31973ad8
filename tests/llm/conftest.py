"""Small document tables with the awkward cases: nulls, empty, long and odd texts, ties, repeats."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "river stone early light winter garden moon silver path under quiet morning house window bird song".split()


def prose(start: int, n: int) -> str:
    return " ".join(WORDS[(start * 7 + i * i + i // 3) % len(WORDS)] for i in range(n))


def doc_rows() -> list[tuple]:
    texts = {
        1: prose(1, 40),
        2: prose(1, 40),  # copy of 1
        3: prose(1, 40) + " added",
        4: prose(5, 60),
        5: "",
        6: None,
        7: " \t\n ",
        8: "word",
        9: "Word",
        10: prose(9, 5000),  # very long
        11: "ünï cödé " * 20 + "中文 ▁ mark",
        12: "12345 !!! ###",
        13: "",
        14: prose(5, 60),  # copy of 4
    }
    rows = [(i, t, "en" if i % 3 else None, None if i == 8 else f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    return rows + [rows[3], (None, prose(1, 40), None, None, 1), (4, "another text under a used id", "en", "s0", 28)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


CLASHES = "id digest row best size key sk range fp first component_id score kept taken target path word unit license sigs host".split()


def with_clashes(df):
    """``df`` with more columns, named like the operators' own."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})
