"""License scans, in DataFrame functions only.

Passages of every file (lines, sentences, paragraphs, the whole text) are compared with
licence templates by the cosine of sparse TF-IDF vectors.  A file takes the best licence its
own passages state; a file without one inherits from the nearest ancestor directory that
holds a licence file (a file whose whole text is a licence), found by path joins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.llm.common import saved

# How files state well-known licences.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}

DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce "
    "the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution. "
)
# Short licences as a whole: what a licence file holds.
FULL_TEXTS: Mapping[str, Sequence[str]] = {
    "MIT": (
        "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall "
        "be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-2-Clause": ("Copyright (c) All rights reserved. " + CONDITIONS + DISCLAIMER,),
    "BSD-3-Clause": (
        "Copyright (c) All rights reserved. " + CONDITIONS + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. " + DISCLAIMER,
    ),
}
FSF = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. "
# How the texts of long licences begin: four paragraphs, or the sentence of acceptance.
OPENINGS: Mapping[str, Sequence[str]] = {
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the "
        "terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ),
    "GPL-2.0": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + FSF + "Preamble The licenses for most software are designed to take "
        "away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software to make sure the "
        "software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to "
        "using it. You can apply it to your programs, too.",
    ),
    "GPL-3.0": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ " + FSF + "Preamble The GNU General Public License is a "
        "free, copyleft license for software and other kinds of works.",
    ),
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ " + FSF + "Preamble The GNU Affero General "
        "Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. " + FSF + "This is the first released version of the Lesser "
        "GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1. Preamble",
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ " + FSF + "This version of the GNU Lesser General "
        "Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below. 0. Additional Definitions.",
    ),
    "MPL-1.1": (
        "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions. 1.0.1. Commercial Use means distribution or otherwise making the Covered Code available to a third party.",
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. "
        "1.2. Contributor Version means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.",
    ),
} | {
    f"CC-{short}-4.0": (
        f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {long} 4.0 International Public License (Public License).",
    )
    for short, long in {
        "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
        "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    }.items()
}
NOTICE, FULL, OPENING = "notice", "full", "opening"
OPENING_PARAGRAPHS = 4
TITLE_WORDS = 8
# How the bodies of short licences begin, behind the names of their holders.
GRANTS = ("permission is hereby granted free of charge to", "redistribution and use in source and binary forms")


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def template_vectors(templates: Mapping[str, Sequence[str]], idf: Mapping[str, float]) -> list[tuple[str, dict[str, float]]]:
    """(licence, unit vector) of every template text."""
    vectors = []
    for name, texts in templates.items():
        for text in texts:
            weight = {w: n * idf[w] for w, n in Counter(template_words(text)).items()}
            norm = math.sqrt(sum(x * x for x in weight.values()))
            vectors.append((name, {w: x / norm for w, x in weight.items()}))
    return vectors


def idf_of(total: int, n: int) -> float:
    """Of a word in ``n`` of ``total`` files; by shares alone, so that a repeated table weighs the same."""
    return math.log(total / n) + 1 if total else 1.0


def key_words(vectors: Sequence[tuple[str, dict[str, float]]], idf: Mapping[str, float], least: float) -> list[str]:
    """Words of which every passage with a cosine of ``least`` or more holds one.

    The commonest words are left out as long as, in no template, what is left out weighs
    ``least`` or more: with those words alone a cosine cannot get there (Cauchy-Schwarz).
    """
    left = [0.0] * len(vectors)
    words = sorted(idf, key=lambda w: (idf[w], w))
    for i, w in enumerate(words):
        grown = [x + v.get(w, 0.0) ** 2 for x, (_, v) in zip(left, vectors)]
        if max(grown) >= least * least - 1e-9:
            return words[i:]
        left = grown
    return []


def few_key_words(vectors: Sequence[tuple[str, dict[str, float]]], idf: Mapping[str, float], least: float) -> list[str]:
    """Like ``key_words``, but as few words as can be, for long templates: words are taken by
    their weight in the templates that are still open and their rareness, until what is left
    of every template weighs less than ``least``."""
    need = [1 - least * least + 1e-9] * len(vectors)
    taken: list[str] = []
    while any(n > 0 for n in need):
        gain = Counter()
        for n, (_, v) in zip(need, vectors):
            for w, x in v.items() if n > 0 else ():
                if w not in taken:
                    gain[w] += min(n, x * x)
        best = min(gain, key=lambda w: (-gain[w] / (math.exp(1 - idf[w]) + 0.001), w))
        taken.append(best)
        need = [n - v.get(best, 0.0) ** 2 for n, (_, v) in zip(need, vectors)]
    return taken


def word_pattern(words: Sequence[str]) -> str:
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(words)) + r")(?![\p{L}\p{N}])"


def passages(text: Column) -> Column:
    """Distinct passages of a text: lines, sentences, paragraphs and the whole."""
    lines = F.split(text, "\n")
    sentences = F.split(text, r"(?<=[.!?;])\s+|\n")
    paragraphs = F.split(text, r"\n\s*\n")
    return F.array_distinct(F.concat(lines, sentences, paragraphs, F.array(text)))


def openings(text: Column) -> Column:
    """Runs of paragraphs that may open a licence text: the first one names a license."""
    paragraphs = F.split(text, r"\n\s*\n")
    runs = F.transform(paragraphs, lambda p, i: F.when(F.lower(p).contains("license"), F.array_join(F.slice(paragraphs, i + 1, OPENING_PARAGRAPHS), "\n\n")))
    return F.filter(runs, lambda r: r.isNotNull())


def titled(text: Column, titles: Mapping[str, Sequence[int]], share: float = 0.0) -> Column:
    """Runs of words that begin with one of ``titles``, in each of the lengths given for it.

    Lines and paragraphs play no part, so a text is found flattened, indented and with more
    behind it.  Runs that hold less than ``share`` of the words of the text are left out.
    """
    if not titles:
        return F.array().cast("array<string>")
    gap = r"[^\p{L}\p{N}]+"
    pattern = {title: gap.join(title.split()) + r"(?![\p{L}\p{N}])" for title in titles}
    places = F.split(text, r"(?i)(?<![\p{L}\p{N}])(?=" + "|".join(pattern.values()) + ")")
    size = F.size(words_of(text))
    found = []
    for title, lengths in titles.items():
        begun = F.filter(places, lambda p: p.rlike(f"(?i)^(?:{pattern[title]})"))  # noqa: B023
        for n in lengths:
            runs = F.transform(begun, lambda p: F.array_join(F.slice(words_of(p), 1, n), " "))  # noqa: B023
            found.append(F.when(F.lit(n) >= share * size, runs).otherwise(F.array().cast("array<string>")))
    return F.concat(*found)


def opening_titles(openings: Mapping[str, Sequence[str]]) -> dict[str, list[int]]:
    """The first words of each opening, and the lengths in words of the openings that begin so."""
    lengths: dict[str, set[int]] = {}
    for texts in openings.values():
        for words in map(template_words, texts):
            lengths.setdefault(" ".join(words[:TITLE_WORDS]), set()).add(len(words))
    return {title: sorted(n) for title, n in lengths.items()}


def grant_titles(texts: Mapping[str, Sequence[str]]) -> dict[str, list[int]]:
    """The grants that short licences hold, and the lengths in words of the bodies from there on."""
    lengths: dict[str, set[int]] = {}
    for named in texts.values():
        for words in (" ".join(template_words(t)) for t in named):
            for grant in GRANTS:
                if grant in words:
                    lengths.setdefault(grant, set()).add(len(words[words.index(grant) :].split()))
    return {title: sorted(n) for title, n in lengths.items()}


def passage_scores(units: DataFrame, vectors: Sequence[tuple[str, str, dict[str, float]]], counts: DataFrame, total: int) -> DataFrame:
    """Best licence per ``unit`` hash of ``units`` (``unit``, ``passage``) and kind of template:
    (``unit``, ``kind``, ``score``, ``license``); ``vectors`` are (kind, licence, unit vector).

    Cosine of the TF-IDF vectors; ``counts`` has the files (of ``total``) that hold each word.
    Of equal scores the first licence by name wins.
    """
    spark = units.sparkSession
    entries = [(w, i, kind, name, x) for i, (kind, name, v) in enumerate(vectors) for w, x in v.items()]
    parts = F.broadcast(spark.createDataFrame(entries, "word string, template int, kind string, license string, part double"))
    tf = units.select("unit", F.explode(words_of(F.col("passage"))).alias("word")).filter("word <> ''").groupBy("unit", "word").agg(F.count("*").alias("tf"))
    weighed = tf.join(counts, "word", "left").withColumn("x", F.col("tf") * (F.log(F.lit(float(total)) / F.coalesce("n", F.lit(1))) + 1))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(parts, "word").groupBy("unit", "template", "kind", "license").agg(F.sum(F.col("x") * F.col("part")).alias("dot"))
    scored = dots.join(norms, "unit").select("unit", "kind", "license", F.least(F.round(F.col("dot") / F.col("norm"), 9), F.lit(1.0)).alias("score"))
    # Best score first, then the first name: the minimum of (-score, name).
    best = scored.groupBy("unit", "kind").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("x"))
    return best.select("unit", "kind", (-F.col("x.s")).alias("score"), "x.license")


def parent(path: Column) -> Column:
    """The directory of a path; the topmost directory is the empty text."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def nearest_licenses(dirs: DataFrame, held: DataFrame) -> DataFrame:
    """For every ``dir`` of ``dirs`` the ``license`` and place (``license_dir``) of the nearest
    directory among itself and its ancestors that ``held`` (``license_dir``, ``license``) lists."""
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    chain = dirs.distinct().select("dir", F.explode(F.array_distinct(up)).alias("license_dir"))
    met = chain.join(held, "license_dir")
    near = met.groupBy("dir").agg(F.max(F.struct(F.length("license_dir").alias("n"), "license_dir", "license")).alias("x"))
    return near.select("dir", "x.license_dir", "x.license")


def scan_licenses(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    least: float = 0.75,
    least_file: float = 0.6,
) -> DataFrame:
    """One row per row of ``files``: ``path``, ``license``, ``origin``, ``score``, ``license_dir``.

    ``origin`` is ``own`` (a passage reaches ``least``), ``inherited`` (from ``license_dir``,
    the nearest directory with a licence file) or ``none``.  A licence file is one whose whole
    text is a notice (at ``least_file`` or more), a short licence's text (or whose body is at
    least half of it) or the opening of a long one's (a run of its paragraphs, or of its words
    from the title on; all at ``least``): what such a file is comes before what its passages state,
    so a licence that names another in its text is not taken for that one.  Of several files in one directory the best score, then the first name, decides.  Inverse document frequencies
    of all words are counted over all files, and depend on shares of files only.  Rows that share a path count as one file; a null path is the
    empty path, null and empty texts state nothing; an empty table gives an empty result.
    """
    rows = files.select(F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = {NOTICE: templates, FULL: FULL_TEXTS, OPENING: OPENINGS}
    words = {kind: {w for texts in named.values() for t in texts for w in template_words(t)} for kind, named in kinds.items()}
    vocabulary = sorted(set.union(*words.values()))
    # In how many files each word of the table stands; the empty word counts the files.
    each = F.array_distinct(F.concat(words_of(F.col("text")), F.array(F.lit(""))))
    counts = saved(rows.select(F.explode(each).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "license-words")
    df = {r["word"]: r["n"] for r in counts.filter(F.col("word").isin(["", *vocabulary])).collect()}  # a row per template word at most
    total = df.pop("", 0)
    rarest = min(df.values(), default=1)  # a template word that no file has weighs like the rarest that one has
    idf = {w: idf_of(total, df.get(w, rarest)) for w in vocabulary}
    vectors = [(kind, name, v) for kind, named in kinds.items() for name, v in template_vectors(named, idf)]
    of = {kind: [(name, v) for k, name, v in vectors if k == kind] for kind in kinds}
    keys = {NOTICE: key_words(of[NOTICE], {w: idf[w] for w in words[NOTICE]}, min(least, least_file)), FULL: few_key_words(of[FULL], idf, least), OPENING: few_key_words(of[OPENING], idf, least)}
    pattern = {kind: word_pattern(words) for kind, words in keys.items()}
    likely = rows.filter(F.lower("text").rlike(word_pattern(set.union(*map(set, keys.values())))))
    # Each kind of passage by the key words of the templates it can be like.
    begun = F.concat(openings(F.col("text")), titled(F.col("text"), opening_titles(OPENINGS)))
    some = {NOTICE: passages(F.col("text")), FULL: F.array("text"), OPENING: begun}
    some = [F.filter(found, lambda p: F.lower(p).rlike(pattern[kind])) for kind, found in some.items()]  # noqa: B023
    bodies = F.filter(titled(F.col("text"), grant_titles(FULL_TEXTS), 0.5), lambda p: p.rlike(pattern[FULL]))
    units = [F.transform(found, lambda p: F.struct(p.alias("passage"), F.lit(is_body).alias("body"))) for is_body, found in ((False, F.array_distinct(F.concat(*some))), (True, bodies))]  # noqa: B023
    units = likely.select("path", F.sha2("text", 256).alias("whole"), F.explode(F.concat(*units)).alias("u")).select("path", "whole", "u.*")
    units = units.withColumn("unit", F.sha2("passage", 256)).groupBy("path", "whole", "unit").agg(F.first("passage").alias("passage"), F.max("body").alias("body"))
    units = saved(units, "license-passages")
    scores = passage_scores(units.groupBy("unit").agg(F.first("passage").alias("passage")), vectors, counts, total)
    found = saved(units.select("path", "whole", "unit", "body").join(scores, "unit"), "license-scores")
    # What the whole file is, then the best score, then the first name.
    is_whole = F.col("unit") == F.col("whole")
    is_text = ((F.col("kind") == FULL) & (is_whole | F.col("body")) | (F.col("kind") == OPENING)) & (F.col("score") >= least)
    order = F.struct((~is_text).cast("int").alias("rank"), (-F.col("score")).alias("s"), "license")
    own = found.filter(is_text | (F.col("kind") == NOTICE) & (F.col("score") >= least)).groupBy("path").agg(F.min(order).alias("own"))
    texts = found.filter(is_text | (F.col("kind") == NOTICE) & is_whole & (F.col("score") >= least_file)).groupBy("path").agg(F.min(order).alias("x"))
    dirs = texts.groupBy(parent(F.col("path")).alias("license_dir")).agg(F.min(F.struct("x.s", "x.license")).alias("x")).select("license_dir", "x.license")
    placed = rows.select("path", parent(F.col("path")).alias("dir")).join(own, "path", "left")
    near = nearest_licenses(placed.select("dir"), dirs).withColumnRenamed("license", "inherited")
    joined = placed.join(near, "dir", "left")
    has = F.col("own").isNotNull()
    return joined.select(
        "path",
        F.coalesce("own.license", "inherited").alias("license"),
        F.when(has, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        (-F.col("own.s")).alias("score"),
        F.when(~has, F.col("license_dir")).alias("license_dir"),
    )


def document_paths(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents as files: ``source/lang/doc_id`` (nulls as ``_``) with their text."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in ("source", "lang", id_col)]
    return docs.select(F.col(id_col).alias("doc_id"), F.concat_ws("/", *part).alias("path"), "text")
