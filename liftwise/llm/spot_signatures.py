"""Document fingerprints by spot signatures, in DataFrame functions only.

A text's words are split into anchors (common words) and content words.  Every run of
anchors opens a chain of the next content words; anchors and chain are one signature.  Where
no anchor has stood for some words (other languages, tables, lists), every other word, chosen
by its hash, opens a chain of its own.  A
document's fingerprint is its set of signatures.  Two documents are compared by the Jaccard
similarity of their sets, and only where their sizes allow the threshold: documents are
partitioned by set length, and meet through rare signatures of a prefix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftwise.llm.common import saved

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die das und in zu den von mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des et un une du en que est pour dans qui par sur au avec il ne se pas plus son ce "
    "el los las y por con no para su al lo como más pero sus o este sí porque"
).split()
MARK = "\u0001"  # precedes an anchor that has been attached to the content word before it
CHAIN = 2  # content words in a signature
GAP = 12  # words without an anchor from which on hash-chosen words open chains
CHOSEN = 2  # one word in so many is chosen


def anchor_pattern(anchors: Sequence[str]) -> str:
    """The anchors as one alternation, by first letter (each is tried only where its letter fits)."""
    by_letter: dict[str, list[str]] = {}
    for a in sorted(set(anchors), key=lambda a: (-len(a), a)):
        by_letter.setdefault(a[0], []).append(a[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items()))


def with_signatures(docs: DataFrame, text_col: str, out: str, anchors: Sequence[str] = tuple(ANCHORS), chain: int = CHAIN) -> DataFrame:
    """``docs`` with the sorted array ``out`` of the text's distinct signature hashes.

    Words are runs of letters and digits, lower-cased.  A word whose last ``GAP`` words, itself
    included, are no anchors and have none behind them opens a chain if its hash says so.  A text without
    a complete chain (of one or two words) has one signature, its word sequence; a text without
    words, null and empty ones included, has none.  Equal texts have equal signatures.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    # "of the cat sat" becomes "\1of\1the cat sat": anchors hang on the content word before them.
    hung = F.regexp_replace(F.col("__words"), rf"(?:^| )({anchor_pattern(anchors)})(?= |$)", MARK + "$1")
    # Words and tokens are columns of their own, so that nothing is computed again for each element.
    tokens = docs.withColumn("__words", words).withColumn("__tokens", F.split(hung, " "))

    def signature(token: Column, i: Column) -> Column:
        follow = [F.substring_index(F.get(F.col("__tokens"), i + n), MARK, 1) for n in range(1, chain + 1)]
        anchor = F.substring_index(token, MARK, -1)
        before = F.slice(F.col("__tokens"), F.greatest(i - GAP + 2, F.lit(1)), F.least(i + 1, F.lit(GAP)))
        free = (F.xxhash64(token) % CHOSEN == 0) & ~F.exists(before, lambda t: t.contains(MARK))
        whole = i + chain < F.size("__tokens")
        return F.when(whole & token.contains(MARK), F.xxhash64(anchor, *follow)).when(whole & free, F.xxhash64(F.lit(""), token, *follow))

    found = F.filter(F.transform("__tokens", signature), lambda h: h.isNotNull())
    lone = F.when(F.col("__words") == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64("__words")))
    sigs = tokens.withColumn("__found", F.array_sort(F.array_distinct(found)))
    return sigs.withColumn(out, F.when(F.size("__found") > 0, F.col("__found")).otherwise(lone)).drop("__words", "__tokens", "__found")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike (1)."""
    common = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - common
    return F.when(whole == 0, F.lit(1.0)).otherwise(common / F.greatest(whole, F.lit(1)))


def fingerprint(sigs: Column) -> Column:
    """The set as one short string: its size and the SHA-256 of its sorted hashes."""
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.sha2(F.array_join(sigs.cast("array<string>"), ","), 256))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Each row of ``docs`` (``doc_id``, ``text``) with its signatures ``sigs``, and the next
    document's ``next_text`` and ``next_sigs`` in the order of descending ids.

    Ids are cut into ``parts`` ranges of about equal count; a window runs inside a range, and
    its last row is joined with the first of the next range that has rows.  After the last
    document comes the first.  Null ids come last; rows that repeat an id go by their text.
    The whole texts are shuffled once.
    """
    spark = docs.sparkSession
    place = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    keyed = docs.withColumn("__at", place)
    steps = [i / parts for i in range(1, parts)]
    cuts = keyed.agg(F.percentile_approx("__at", steps, 10000).alias("c")).first()["c"] if steps else []
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    part = F.size(F.filter(bounds, lambda c: c <= F.col("__at")))
    # The first id of every range: at most ``parts`` rows.
    firsts = dict(keyed.groupBy(part.alias("p")).agg(F.max("__at").alias("a")).collect())
    filled = sorted(firsts)
    after = [(p, firsts[filled[i - 1]]) for i, p in enumerate(filled)]  # index -1: the topmost range
    heads = F.broadcast(spark.createDataFrame(after, "__part int, __head long"))
    order = F.struct(F.col("text").isNotNull(), F.col("text"))
    head_rows = keyed.join(heads, F.col("__at") == F.col("__head")).groupBy("__part").agg(F.min(order).alias("h"))
    head_rows = with_signatures(head_rows.select(F.col("__part").alias("__p"), F.col("h.text").alias("text")), "text", "sigs")
    head_rows = head_rows.select("__p", F.struct("text", "sigs").alias("__first"))

    rows = with_signatures(keyed, "text", "sigs").withColumn("__part", part)
    inside = Window.partitionBy("__part").orderBy(F.desc("__at"), F.asc_nulls_first("text"))
    rows = rows.withColumn("__next", F.lead(F.struct("text", "sigs")).over(inside))
    rows = rows.join(head_rows, F.col("__part") == F.col("__p"))
    following = F.when(F.col("__next").isNotNull(), F.col("__next")).otherwise(F.col("__first"))
    rows = rows.withColumn("__n", following)
    return rows.select("doc_id", "text", "sigs", F.col("__n.text").alias("next_text"), F.col("__n.sigs").alias("next_sigs"))


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, one row per row of ``docs``.

    In the edited text the last floor(n/2) code points give way to as many of the next
    document's first (or all it has).  Returns ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next`` (Jaccard
    similarities of the signature sets) and ``n_signatures``.  Null counts as empty; a lone
    document is its own next one; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = parts or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), parts)
    size = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    rows = rows.withColumn("edited", edited).drop("next_text").withColumn("n_chars", size.cast("long"))
    rows = with_signatures(rows.drop("text"), "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").alias("n_signatures"),
    )


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate search: (members, links).

    Members are (``doc_id``, ``fingerprint``), one row per row of ``docs``; links are
    (``a``, ``b``, ``likeness``) between different fingerprints (a < b) of Jaccard similarity
    ``threshold`` or more, so copies are never expanded.  Sets are partitioned by length
    (bounds grow by 1/threshold): only neighbouring partitions can hold similar sets.  With
    every set ordered from rare to common, two similar sets share a signature of their
    prefixes, by which they meet; a candidate pair is counted once, at its least shared
    prefix signature, and verified on the whole sets.  Empty sets link to nothing.
    """
    t = float(threshold)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_signatures(rows, "text", "sigs").select("doc_id", "sigs", fingerprint(F.col("sigs")).alias("fingerprint"))
    sets = saved(rows.groupBy("fingerprint").agg(F.first("sigs").alias("sigs")).filter(F.size("sigs") > 0), "spot-sets")
    one = sets.select("fingerprint", F.explode("sigs").alias("sig"))
    counted = one.groupBy("sig").agg(F.count("*").alias("n"))
    ranked = one.join(counted.filter("n > 1"), "sig").groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("shared"))
    # A signature that no other set has cannot join anything: it only takes places of the prefix.
    ranked = ranked.join(sets, "fingerprint").withColumn("size", F.size("sigs"))
    prefix = F.col("size") - F.ceil(F.col("size") * t - 1e-9) + 1 - (F.col("size") - F.size("shared"))
    ranked = ranked.withColumn("prefix", F.slice(F.transform("shared", lambda x: x["sig"]), F.lit(1), F.greatest(prefix, F.lit(0)).cast("int")))
    part = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(t)) + 1e-9).cast("int")
    ranked = saved(ranked.select("fingerprint", "sigs", "size", "prefix", part.alias("part")), "spot-prefixes")
    cells = ranked.select("fingerprint", "size", "prefix", "part", F.explode("prefix").alias("sig"))
    left = cells.select("sig", "part", *[F.col(c).alias(c + "_l") for c in ("fingerprint", "size", "prefix")])
    right = cells.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") - 1)))
    right = right.select("sig", "part", *[F.col(c).alias(c + "_r") for c in ("fingerprint", "size", "prefix")])
    met = left.join(right, ["sig", "part"]).filter("size_l < size_r or (size_l = size_r and fingerprint_l < fingerprint_r)")
    met = met.filter(F.col("size_l") >= F.col("size_r") * t - 1e-9).filter(F.array_min(F.array_intersect("prefix_l", "prefix_r")) == F.col("sig"))
    sigs = ranked.select("fingerprint", "sigs")
    met = met.select("fingerprint_l", "fingerprint_r").join(sigs.toDF("fingerprint_l", "sigs_l"), "fingerprint_l").join(sigs.toDF("fingerprint_r", "sigs_r"), "fingerprint_r")
    near = met.withColumn("likeness", likeness(F.col("sigs_l"), F.col("sigs_r"))).filter(F.col("likeness") >= t)
    links = near.select(F.least("fingerprint_l", "fingerprint_r").alias("a"), F.greatest("fingerprint_l", "fingerprint_r").alias("b"), "likeness")
    return rows.select("doc_id", "fingerprint"), links
