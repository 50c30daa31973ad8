"""Labelled pages for the content model: layouts with their parts marked.

``data-y`` marks a part as content (1) or not (0); what lies inside inherits it.  The words
do not matter to the model, only structure, names, lengths and links do.
"""

from __future__ import annotations

import itertools
import re

LONG = "We walked along the river until the evening came, and then the others told us what they had seen there."
SHORT = "A quiet place to rest."


def words(n: int) -> str:
    return " ".join(itertools.islice(itertools.cycle(LONG.split()), n))


def links(n: int) -> str:
    return "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(n))


def paragraphs(*sizes: int) -> str:
    return "".join(f"<p>{words(n)}.</p>" for n in sizes)


def bare(body: str) -> str:
    """An article without an element of its own; a list of links would be no different from a menu there."""
    if "<li><a" in body:
        return f'<div class="text" data-y="1">{body}</div>'
    return re.sub("<(p|ul|ol|div|table|pre|blockquote|h2|figure)>", r'<\1 data-y="1">', body)


# Ways to write each part.  Everything but the article is not content.
ARTICLES = (
    lambda body: f'<article data-y="1"><h1>{words(8)}</h1>{body}</article>',
    lambda body: f'<div id="content" data-y="1"><h1>{words(5)}</h1>{body}</div>',
    lambda body: f'<main><div class="post-body" data-y="1"><h2>{words(4)}</h2>{body}</div></main>',
    lambda body: f'<div class="wrapper"><div class="entry-content" data-y="1">{body}</div></div>',
    lambda body: f'<section class="story" data-y="1"><h1>{words(6)}</h1>{body}</section>',
    lambda body: f'<main data-y="1"><h1>{words(7)}</h1>{body}</main>',
    lambda body: f'<div class="container"><div data-y="1"><h1>{words(9)}</h1>{body}</div></div>',
    lambda body: f'<article class="post" data-y="1"><section>{body}</section></article>',
    lambda body: f'<div data-y="1">{body}</div>',
    lambda body: bare(body),
    lambda body: f'<article data-y="1"><h1>{words(10)}</h1>{body}</article>',
)
BODIES = (
    paragraphs(60, 80, 40),
    paragraphs(5) + paragraphs(120),
    paragraphs(30) + f"<ul><li>{words(12)}</li><li>{words(7)}</li><li>{SHORT}</li></ul>" + paragraphs(25),
    f"<p><b>{words(40)}<br><p>{words(90)}.</p><p>{SHORT}</p>",
    paragraphs(20) + f"<blockquote><p>{words(30)}.</p></blockquote><h2>{words(4)}</h2>" + paragraphs(55, 3),
    f"<p>{words(9)}.</p>",
    f"<p>{words(4)}.</p>",
    f"<p>{words(7)}</p>",
    paragraphs(12, 2, 5, 30, 8),
    f"<p>{words(35)}</p><p>{words(16)}</p>",
    f"<p>{words(150)}</p>",
    f"<p>{words(2)}</p><p>{words(12)}</p>",
    paragraphs(15) + f"<ul><li>{words(14)}.</li></ul>",
    paragraphs(9) + f"<ol><li>{words(20)}.</li><li>{words(5)}</li></ol>" + paragraphs(11),
    paragraphs(14) + f"<pre>{words(20)}</pre><table><tr><td>{words(3)}</td><td>{words(2)}</td></tr></table>" + paragraphs(70),
    f'<p>{words(30)} <a href="/x">{words(3)}</a> {words(20)}.</p><figure><figcaption>{words(8)}.</figcaption></figure>' + paragraphs(45),
    f"<div>{words(50)}.</div><div>{words(6)}.</div>",
    f'<p>{words(25)}.</p><div class="ad" data-y="0">{words(9)}.</div><p>{words(35)}.</p>',
    f"<table><tr><td>{words(14)}.</td><td>{words(9)}.</td></tr><tr><td>{words(6)}</td><td>{words(2)}</td></tr></table>",
    paragraphs(11) + f"<table><tr><th>{words(2)}</th><th>{words(1)}</th></tr><tr><td>{words(3)}</td><td>{words(5)}.</td></tr></table>",
    paragraphs(16) + f"<h2>{words(3)}</h2><ul>{links(4)}</ul>" + paragraphs(21),
    paragraphs(40) + f"<h2>{words(2)}</h2><ul>{links(3)}</ul><h2>{words(3)}</h2><ol><li>{words(11)}.</li></ol>" + paragraphs(8),
    f'<p>{words(18)}.</p><aside data-y="0"><p>{words(15)}.</p></aside><p>{words(22)}.</p><div class="share" data-y="0"><a href="/s">Share</a></div>',
)
BEFORE = (
    "",
    f"<nav><ul>{links(6)}</ul></nav>",
    f'<header><div class="logo"><a href="/">Home</a></div><nav><ul>{links(4)}</ul></nav></header>',
    f'<header class="site-header"><h1>{words(2)}</h1><p>{words(6)}.</p></header>',
    f'<div id="header"><a href="/">{words(2)}</a></div><div class="menu"><ul>{links(8)}</ul></div>',
    f'<div class="cookie-notice"><p>{words(20)}.</p><a href="/ok">Accept</a></div><nav>{links(3)}</nav>',
    f'<nav><ul>{links(5)}</ul></nav><!-- ad --><div class="ad">{words(6)}. {words(3)}.</div>',
    f'<form class="search"><label>Search</label><input></form><ul class="breadcrumbs">{links(3)}</ul>',
    f'<div class="banner" role="alert"><p>{words(12)}.</p></div><div role="navigation">{links(4)}</div>',
    f'<div class="advertisement"><p>{words(25)}.</p><p>{words(18)}.</p></div>',
)
AFTER = (
    "",
    f"<footer>&copy; {words(4)} &middot; {words(14)}.</footer>",
    f'<aside class="sidebar"><h3>Related</h3><ul>{links(5)}</ul><p>{words(18)}.</p></aside><footer><p>{words(10)}.</p></footer>',
    f'<section class="comments"><h3>3 comments</h3><div class="comment"><p>{words(24)}.</p></div><div class="comment"><p>{words(9)}.</p></div></section>',
    f'<div id="comments"><ol><li><p>{words(40)}.</p></li><li><p>{words(16)}.</p></li></ol></div><footer>{words(6)}.</footer>',
    f'<form><p>{words(10)}.</p><label>Name</label><input></form><div class="footer"><a href="/t">Terms</a> {words(5)}.</div>',
    f'<div class="widget"><p>{words(12)}.</p></div><div class="newsletter"><p>{words(15)}.</p></div><div id="footer">{words(20)}.</div>',
    f'<aside><p>{words(30)}.</p><p>{words(12)}.</p></aside><div class="related-links"><ul>{links(4)}</ul></div>',
    f'<div class="notice"><p>{words(22)}.</p></div><footer><ul>{links(3)}</ul><small>{words(8)}</small></footer>',
)


def labelled_pages() -> list[tuple[str, list[int] | None]]:
    """Pages that pair every way to write a part with several of the others (labels in ``data-y``)."""
    pages = []
    for n in range(len(BODIES) * len(ARTICLES)):
        article = ARTICLES[n % len(ARTICLES)](BODIES[(n * 5 + n // len(ARTICLES)) % len(BODIES)])
        before = BEFORE[(n * 7 + n // len(ARTICLES)) % len(BEFORE)]
        after = AFTER[(n * 5 + n // len(BEFORE)) % len(AFTER)]
        head = f"<head><title>{words(5)}</title><style>p{{margin:0}}</style></head>"
        inside = before + article + after
        if n % 3 == 1:
            inside = f'<div class="page">{inside}</div>'
        tail = "" if n % 7 == 0 else "</body></html>"
        pages.append((f'<!DOCTYPE html><html>{head}<body data-y="0">{inside}{tail}', None))
    # Bare texts: no page around them, all of it content.
    pages += [(words(n), [1]) for n in (4, 30, 200)] + [(f"<p>{words(n)}.</p>", [0, 1]) for n in (5, 40)]
    return pages
