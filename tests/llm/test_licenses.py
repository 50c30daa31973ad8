from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pytest

from liftwise.llm import licenses as L
from tests.llm.conftest import with_clashes

FILES = [
    ("a/LICENSE", "Released under the MIT License."),
    ("a/x.py", "# code without a notice"),
    ("a/b/y.py", "import this"),
    ("a/b/z.py", "intro line of a source file\nLicensed under the Apache License, Version 2.0.\nmore code that goes on for a while, for it is no licence file"),
    ("a/b/c/COPYING", "Licensed under CC BY-NC 4.0."),
    ("a/b/c/d/e.txt", "deep file"),
    ("q/f.txt", "nothing to inherit"),
    ("q/g.txt", "This work is  LICENSED under the gnu general public license, version 3. And here the prose goes on for long, telling of rivers and of stones, of early light and of the winter garden."),
    ("top.txt", None),
    (None, ""),
    ("r/1", "the license of the version under the work"),
    ("r/2", "Released under the BSD terms of someone's garden"),
    ("a/x.py", "# code without a notice"),
]


def plain(files, least=0.75, least_file=0.6):
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    vocabulary = {w for ts in L.TEMPLATES.values() for t in ts for w in L.template_words(t)}
    df = Counter(w for _, t in files for w in set(words(t or "")) & vocabulary)
    idf = {w: math.log((1 + len(files)) / (1 + df[w])) + 1 for w in vocabulary}
    other = math.log(1 + len(files)) + 1

    def best(passage):
        vector = {w: n * idf.get(w, other) for w, n in Counter(words(passage)).items()}
        norm = math.sqrt(sum(x * x for x in vector.values())) or 1
        scores = [(-round(min(1, sum(vector.get(w, 0) * x for w, x in v.items()) / norm), 9), name) for name, v in L.template_vectors(L.TEMPLATES, idf)]
        return min(scores)

    own, held = {}, {}
    for path, text in files:
        path, text = path or "", text or ""
        for p in [*re.split("\n", text), *re.split(r"(?<=[.!?;])\s+|\n", text), *re.split(r"\n\s*\n", text), text]:
            s = best(p)
            if -s[0] >= least:
                own[path] = min(own.get(path, (0, "")), s)
        s = best(text)
        if -s[0] >= least_file:
            d = path.rpartition("/")[0]
            held[d] = min(held.get(d, (0, "")), s)
    rows = []
    for path, _ in files:
        path = path or ""
        if path in own:
            rows.append((path, own[path][1], "own"))
            continue
        d = path.rpartition("/")[0]
        while d not in held and d:
            d = d.rpartition("/")[0]
        rows.append((path, held[d][1], "inherited") if d in held else (path, None, "none"))
    return sorted(rows, key=str)


def test_own_and_inherited_against_brute_force(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    rows = L.scan_licenses(with_clashes(files)).collect()
    assert sorted(((r["path"], r["license"], r["origin"]) for r in rows), key=str) == plain(FILES)
    found = {r["path"]: (r["license"], r["origin"], r["license_dir"]) for r in rows}
    assert found["a/b/c/d/e.txt"] == ("CC-BY-NC-4.0", "inherited", "a/b/c")
    assert found["a/b/y.py"] == ("MIT", "inherited", "a")
    assert found["a/b/z.py"][:2] == ("Apache-2.0", "own")
    assert found["q/f.txt"] == (None, "none", None)


def test_every_template_finds_itself(spark):
    rows = [(f"{name}/{i}", f"some words before\n{t}\nand after") for name, ts in L.TEMPLATES.items() for i, t in enumerate(ts)]
    got = L.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()
    assert all(r["license"] == r["path"].split("/")[0] and r["score"] == pytest.approx(1) for r in got)


def test_key_words_lose_no_passage():
    vocabulary = {w for ts in L.TEMPLATES.values() for t in ts for w in L.template_words(t)}
    idf = {w: 1 + len(w) / 5 for w in vocabulary}
    vectors = L.template_vectors(L.TEMPLATES, idf)
    keys = set(L.key_words(vectors, idf, 0.6))
    for _, v in vectors:  # the best passage of other words is the template's own part of them
        assert math.sqrt(sum(x * x for w, x in v.items() if w not in keys)) < 0.6


def test_documents_and_empty(docs, no_docs):
    rows = L.scan_licenses(L.document_paths(docs)).collect()
    assert len(rows) == docs.count() and {r["origin"] for r in rows} == {"none"}
    assert L.scan_licenses(L.document_paths(no_docs)).count() == 0
    plan = L.scan_licenses(L.document_paths(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_whole_licence_texts_are_licence_files(spark):
    texts = {p.stem: p.read_text() for p in (Path(__file__).parent / "data").glob("*.txt")}
    texts["MIT-long"] = texts["MIT"].replace("Andrew Gallant", "The Authors of a Project with a Long Name and All Others Who Have Taken Part")
    texts["CC-BY-SA-4.0"] = f"Attribution-ShareAlike 4.0 International\n\n{L.OPENINGS['CC-BY-SA-4.0'][0]}\n\nSection 1 -- Definitions."
    header = "".join(f"// {line}\n" for line in texts["MIT"].splitlines()) + "".join(f"fn part{i}(river: Stone{i}) -> Light{i} {{ garden{i}(moon{i}) }}\n" for i in range(40))
    files = [(f"{name}/LICENSE", t) for name, t in texts.items()] + [(f"{name}/src/x.py", "import this") for name in texts]
    files += [("src/a.rs", header), ("src/b.rs", "fn b() {}"), ("doc/README", "A garden.\n\nLicense\n\nApache License, Version 2.0\n\nThanks"), ("doc/x", "more")]
    got = {r["path"]: r for r in L.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    for name in texts:
        license = name.removesuffix("-long")
        assert (got[f"{name}/LICENSE"]["license"], got[f"{name}/LICENSE"]["origin"]) == (license, "own")
        assert (got[f"{name}/src/x.py"]["license"], got[f"{name}/src/x.py"]["license_dir"]) == (license, name)
    assert got["src/b.rs"]["origin"] == "none" and got["doc/x"]["origin"] == "none"


def test_licence_texts_in_any_layout_decide_over_notices_inside_them(spark):
    texts = {p.stem: p.read_text() for p in (Path(__file__).parent / "data").glob("*.txt")}
    texts["AGPL-3.0"] = texts["GPL-3.0"].replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1).replace("29 June 2007", "19 November 2007", 1)
    first = "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."
    texts["AGPL-3.0"], n = re.subn(r"The GNU General Public License is a free, copyleft license for\s+software and other kinds of works\.", first, texts["AGPL-3.0"], count=1)
    assert n == 1
    note = "\n\nThis distribution bundles the garden library. It was written by the people of the river, and its stones are their own.\n"
    forms = {
        "plain": lambda t: t,
        "no-blank-lines": lambda t: re.sub(r"\n\s*\n", "\n", t),
        "one-line": lambda t: " ".join(t.split()),
        "note": lambda t: t + note,
        "one-line-note": lambda t: " ".join((t + note).split()),
        "titled": lambda t: "The Garden Project " + " ".join(t.split()),
    }
    files = [(f"{form}/{name}/LICENSE", change(t)) for form, change in forms.items() for name, t in texts.items()]
    files += [(f"{form}/{name}/src/x.py", "import this") for form in forms for name in texts]
    files += [("prose/a", "A long tale. " * 200 + "Permission is hereby granted, free of charge, to all who come to the river."), ("prose/b", "b")]
    got = {r["path"]: r for r in L.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    wrong = [(path, r["license"], r["origin"]) for path, r in got.items() if path.count("/") > 1 and (r["license"], r["origin"]) != (path.split("/")[1], "own" if path.endswith("LICENSE") else "inherited")]
    assert not wrong
    assert got["prose/a"]["origin"] == got["prose/b"]["origin"] == "none"


def test_a_header_is_judged_alike_in_a_repeated_table(spark):
    header = "All that is here was released under the MIT License."
    files = [("a/x.py", header), ("b/y.py", "This project is released under the MIT License.")]
    files += [(f"c/{i}", f"All that is here was this project is for {w} and the river{i} is cold") for i, w in enumerate("stone light moon bird".split() * 10)]
    table = spark.createDataFrame(files, "path string, text string")
    from pyspark.sql import functions as F

    repeated = table.crossJoin(spark.range(100)).select(F.concat_ws("/", F.col("id").cast("string"), "path").alias("path"), "text")
    once = {r["path"]: (r["license"], r["score"]) for r in L.scan_licenses(table).collect()}
    assert once["a/x.py"][0] == once["b/y.py"][0] == "MIT" and once["c/1"][0] is None
    for r in L.scan_licenses(repeated).collect():
        assert (r["license"], r["score"]) == once[r["path"].partition("/")[2]]
