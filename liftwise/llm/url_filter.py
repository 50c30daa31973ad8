"""URL filters: path rules first, then link-graph propagation per host.

Trust spreads from hosts with allowed pages along links (personalised PageRank); distrust
spreads from hosts with blocked pages against them (who links to a blocked host is suspect).
The graph is a table of host edges and every step a Spark join and aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.llm.common import lower_ascii, saved

# Absolute links in href attributes; group 1 is the host with port and user.
HREF = r"(?i)\bhref\s*=\s*[\x22\x27]?\s*(?:https?:)?//([^/?#\x22\x27\s>]+)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting (verdict, host, path) rule; null where none fits.

    The rules are a parameter, a list the caller wrote, so they are one CASE expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def bare_host(host: Column) -> Column:
    """A host without user and port: the form in which the link graph knows it."""
    return F.regexp_replace(host, r"^[^@]*@|:[0-9]*$", "")


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (``src``, ``dst``) between different bare hosts, from the absolute links of each page.

    Null urls and null html have no links; an empty table gives none.
    """
    linked = pages.select(bare_host(host_of(F.col(url_col))).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1))).alias("to"))
    return linked.select("src", bare_host(lower_ascii(F.col("to"))).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, most_steps: int = 400) -> DataFrame:
    """Per host ``trust`` and ``distrust``: the fixed point of seed + damping x inflow.

    ``seeds`` holds (``host``, ``trust``, ``distrust``), one row a host; hosts that are only
    linked to start at zero.  A host's trust goes out in equal parts over its links, its
    distrust in equal parts over the hosts that link to it.  A step shrinks what all scores
    together move by at least ``damping``, and steps end when that is ``tolerance`` or less:
    the error then left is below tolerance x damping/(1-damping), summed over all hosts.
    ``most_steps`` is enough for 10^24 hosts at the defaults; not reaching the tolerance is
    an error.  Without links the scores are the seeds; a null host is no host.
    """
    forward = links.join(links.groupBy("src").count(), "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (damping / F.col("count")).alias("trust_part"), F.lit(0.0).alias("distrust_part"))
    back = links.join(links.groupBy("dst").count(), "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("trust_part"), (damping / F.col("count")).alias("distrust_part"))
    arcs = saved(forward.unionByName(back), "host-arcs")
    known = seeds.unionByName(links.select(F.col("dst").alias("host"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust")))
    start = saved(known.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "host-seeds")
    if arcs.isEmpty():
        return start
    now = start
    for _ in range(most_steps):
        flow = arcs.join(now, "host").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.col("trust") * F.col("trust_part")).alias("in_trust"), F.sum(F.col("distrust") * F.col("distrust_part")).alias("in_distrust")
        )
        new = start.join(flow, "host", "left").join(now.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0")), "host")
        new = new.select("host", *[(F.col(c) + F.coalesce(F.col(f"in_{c}"), F.lit(0.0))).alias(c) for c in ("trust", "distrust")], "t0", "d0")
        new = saved(new, "host-scores")
        moved = new.agg(F.sum(F.abs(F.col("trust") - F.col("t0"))), F.sum(F.abs(F.col("distrust") - F.col("d0")))).first()
        now = new.select("host", "trust", "distrust")
        if max(m or 0.0 for m in moved) <= tolerance:
            return now
    raise RuntimeError(f"scores still move by {max(moved)} after {most_steps} steps")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = 0.5,
    **walk,
) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``.

    ``rules`` are (allow|block, host, path).  A page that a rule fits gets the rule's verdict.
    The shares of a host's pages that rules allow and block are its seeds; a page without a
    rule is blocked where its host's distrust exceeds its trust by ``threshold`` or more, and
    allowed elsewhere, also without any evidence.  Null or odd urls have an empty host, which
    takes part in no link and is always allowed; null html has no links; repeated rows count
    each; an empty table gives an empty result; other columns are ignored.  ``host`` is as the
    url has it; ports and users are no part of a host in the link graph and its seeds.
    """
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("node", bare_host(F.col("host")))
    share = [F.avg((F.col("ruled").eqNullSafe(v)).cast("double")).alias(c) for v, c in (("allow", "trust"), ("block", "distrust"))]
    seeds = seen.filter("node <> ''").groupBy(F.col("node").alias("host")).agg(*share)
    links = saved(host_links(pages, url_col, html_col), "host-links")
    scores = propagate(seeds, links, **walk)
    judged = seen.join(scores.withColumnRenamed("host", "node"), "node", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    method = F.when(distrust - trust >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
