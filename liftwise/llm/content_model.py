"""Main text of web pages by a tree-structured graphical model.

Every block-level DOM node is content or not.  A node's own potential comes from its tag,
the words of its class, id and role, its length and its links; a potential on every
parent-child edge couples the two.  Sum-product messages up and then down the tree give each node's exact marginal.
The weights are fitted by gradient ascent on the likelihood of labelled pages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.llm.dom import Node, Page, read

TAGS = (
    "#document html head body div section article main p h1 h2 h3 ul ol li nav aside header footer form table tr td "
    "blockquote pre figure figcaption dl dd"
).split()
# Words of class, id and role attributes, by what they tell.
HINTS = {
    "content": "article post entry content body story main text blog prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs tags links skip",
    "advert": "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner dfp doubleclick",
    "side": "sidebar side aside related recommended rail widget trending popular complementary",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe paywall disclaimer warning toast dialog",
    "comments": "comment comments reply replies discussion disqus respond feedback review reviews thread",
    "form": "form search login signup register contact input",
    "header": "header masthead logo topbar top brand site branding",
    "footer": "footer foot copyright legal bottom colophon contentinfo imprint",
    "share": "share social sharing follow twitter facebook meta byline author",
}
HINT_OF = {word: i for i, words in enumerate(HINTS.values()) for word in words.split()}
TAG_OF = {tag: i for i, tag in enumerate(TAGS)}
LENGTHS = (0, 3, 10, 30)
OWN = 1 + len(TAGS) + 1 + len(HINTS) + len(LENGTHS) + 1 + 5  # node features
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption".split())


def node_features(node: Node) -> list[int]:
    """Indices of the binary features that hold."""
    found = [0, 1 + TAG_OF.get(node.tag, len(TAGS))]
    at = 2 + len(TAGS)
    named = " ".join(node.attributes.get(k, "") for k in ("class", "id", "role"))
    if not named.isspace():
        words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower())
        found += sorted({at + HINT_OF[w] for w in words if w in HINT_OF})
    at += len(HINTS)
    found.append(at + sum(node.words > n for n in LENGTHS))
    at += len(LENGTHS) + 1
    if node.words and node.link_words * 2 > node.words:
        found.append(at)
    if node.words and node.link_words * 5 < node.words:
        found.append(at + 1)
    if node.stops * 30 > node.words:
        found.append(at + 2)
    if node.own_words:
        found.append(at + 3 + (node.own_words > 10))
    return found


ROOTS = frozenset(["#document", "html", "body"])
EDGE_KINDS = 4


def edge_kind(i: int, page: Page) -> int:
    """Edges into text-bearing elements and into containers have potentials of their own, and
    so have edges from the page's outermost elements, which hold all kinds of parts."""
    node = page.nodes[i]
    return (0 if node.tag in TEXT_TAGS else 1) + (2 if page.nodes[node.parent].tag in ROOTS else 0)


class Model:
    """``own``: weight of a feature for being content; ``edges[kind][parent][child]``: log-potentials."""

    def __init__(self, own: Sequence[float], edges: Sequence[Sequence[Sequence[float]]]) -> None:
        self.own = [float(x) for x in own]
        self.edges = [[[float(x) for x in row] for row in kind] for kind in edges]


def log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def messages(page: Page, features: list[list[int]], model: Model) -> tuple[list[float], list[float], list[float]]:
    """Sum-product on the tree, as log-odds: (up to the parent, down from it, belief of being content).

    A message is the log-ratio of content to other; constants cancel.
    """
    n = len(page.nodes)
    inside = [sum(model.own[f] for f in fs) for fs in features]  # own potential and all messages from below
    up, down = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        e = model.edges[edge_kind(i, page)]
        x = inside[i]
        up[i] = log_add(e[1][0], e[1][1] + x) - log_add(e[0][0], e[0][1] + x)
        inside[page.nodes[i].parent] += up[i]
    belief = inside[:]
    for i in range(1, n):
        p = page.nodes[i].parent
        e = model.edges[edge_kind(i, page)]
        without = belief[p] - up[i]  # what the parent knows from everyone else
        down[i] = log_add(e[0][1], e[1][1] + without) - log_add(e[0][0], e[1][0] + without)
        belief[i] = inside[i] + down[i]
    return up, down, belief


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def edge_marginals(i: int, page: Page, up: list[float], belief: list[float], down: list[float], model: Model) -> list[list[float]]:
    """Joint probability of (parent, child) states on the edge into node ``i``."""
    e = model.edges[edge_kind(i, page)]
    above, below = belief[page.nodes[i].parent] - up[i], belief[i] - down[i]
    logs = [[e[a][b] + a * above + b * below for b in (0, 1)] for a in (0, 1)]
    top = max(max(row) for row in logs)
    p = [[math.exp(x - top) for x in row] for row in logs]
    total = sum(map(sum, p))
    return [[x / total for x in row] for row in p]


def fit(labelled: Sequence[tuple[str, Sequence[int] | None]], steps: int = 150, rate: float = 0.1, ridge: float = 0.00002) -> Model:
    """Weights with the greatest likelihood of the labels, by exact gradients (observed minus
    expected counts under the tree's marginals), with a ridge penalty.

    A labelled page is (html, labels per node); without labels they are read from ``data-y``
    attributes, which a node inherits from its parent and which are no feature.
    """
    pages = []
    for source, labels in labelled:
        page = read(source)
        if labels is None:
            labels = []
            for node in page.nodes:
                above = labels[node.parent] if node.parent >= 0 else 0
                labels.append(int(node.attributes.get("data-y", above)))
        pages.append((page, [node_features(node) for node in page.nodes], list(labels)))
    own, edges = np.zeros(OWN), np.zeros((EDGE_KINDS, 2, 2))
    own_past, edge_past = (np.zeros_like(own), np.zeros_like(own)), (np.zeros_like(edges), np.zeros_like(edges))
    total = sum(len(p.nodes) for p, _, _ in pages)
    for step in range(1, steps + 1):
        model = Model(own, edges)
        own_slope, edge_slope = np.zeros(OWN), np.zeros((EDGE_KINDS, 2, 2))
        for page, features, labels in pages:
            up, down, belief = messages(page, features, model)
            for i, (fs, y) in enumerate(zip(features, labels)):
                gap = y - logistic(belief[i])
                for f in fs:
                    own_slope[f] += gap
                if i:
                    kind = edge_kind(i, page)
                    edge_slope[kind] -= edge_marginals(i, page, up, belief, down, model)
                    edge_slope[kind][labels[page.nodes[i].parent]][y] += 1
        own_slope, edge_slope = own_slope / total - ridge * own, edge_slope / total - ridge * edges
        for w, slope, mean, square in ((own, own_slope, *own_past), (edges, edge_slope, *edge_past)):  # Adam steps
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(own, edges)


def main_text(source: str | None, model: Model, cut: float = 0.5) -> str:
    """Blocks of nodes whose marginal of being content is over ``cut``, joined by blank lines.

    What a control, a drawing, noscript or template itself says is left out; block-level
    elements inside are judged like all others.  Formulas and objects are part of their block.
    """
    page = read(source)
    _, _, belief = messages(page, [node_features(node) for node in page.nodes], model)
    return "\n\n".join(text for node, text in page.blocks if not page.nodes[node].silent and logistic(belief[node]) > cut)


def main_text_column(source: Column, model: Model) -> Column:
    own, edges = model.own, model.edges

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(own, edges)
        for pages in batches:
            yield pd.Series([main_text(p, model) for p in pages], dtype="object")

    return of(source)


def extract_pages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text`` (empty if none), ``n_chars`` (code points).

    Null and empty html have no text; broken, cut and very long pages give what they hold;
    repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text_column(F.col(html_col), model).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
