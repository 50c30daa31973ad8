"""A small tolerant HTML reader: block-level elements as a tree, and the text blocks they own."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark meter object output progress q "
    "ruby rp rt s samp small span strike strong sub sup time tt u var "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
# An opening tag ends open elements of these kinds, but looks no further up than the barrier.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
    "button": ({"button"}, ()),
    "select": ({"select"}, ()),
    "body": ({"head"}, {"html"}),
}
# Block-level elements end an open select or drawing, which cannot hold them; a button may hold a div.
BREAKS_OUT = CLOSES_P | {"body"}
HOLDS_NO_BLOCK = frozenset("select svg".split())
HOLDS_DIV = frozenset("button".split())
SILENT = frozenset("svg button select option optgroup noscript template".split())  # own text is no text of the page
EMPTY = re.compile(r"(?:^|[\s\"'])/\Z")  # the end of a self-closed tag, not of an unquoted value
# A quote opens a string only behind an equals sign; elsewhere it is a character of a name or an unquoted value.
VALUE = r"=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|" + VALUE + r")*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Node:
    """A block-level element; text counts are of its whole subtree once ``read`` is done."""

    tag: str
    parent: int
    attributes: dict[str, str] = field(default_factory=dict)
    own_words: int = 0  # outside of child nodes
    words: int = 0
    link_words: int = 0
    stops: int = 0  # sentence ends
    silent: bool = False  # its own text is a control's or a drawing's


@dataclass
class Page:
    nodes: list[Node]  # parents before children; the first is the document itself
    blocks: list[tuple[int, str]]  # (node, text with white space made one space) in page order


def attributes_of(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if raw and not raw.isspace():
        for name, a, b, c in ATTRIBUTE.findall(raw):
            found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def read(source: str | None) -> Page:
    """The page of ``source``; null, empty and broken markup give what text there is."""
    source = source or ""
    nodes, blocks = [Node("#document", -1)], []
    stack: list[tuple[str, int]] = [("#document", 0)]  # open elements; inline ones keep their block's node
    depths: dict[str, list[int]] = {}  # where in the stack the open elements of each kind are
    text: list[str] = []
    links: list[str] = []
    in_link = 0

    def flush() -> None:
        if not text:
            return
        words = html.unescape("".join(text)).split()
        if words:
            node = nodes[stack[-1][1]]
            node.words += len(words)
            node.own_words += len(words)
            node.link_words += min(len(words), len(html.unescape(" ".join(links)).split()))
            node.stops += sum(w[-1] in ".!?:;…" for w in words)
            blocks.append((stack[-1][1], " ".join(words)))
        text.clear()
        links.clear()

    def close_to(depth: int) -> None:
        """Close the open elements from ``depth`` up; the text so far is theirs."""
        nonlocal in_link
        if any(tag not in INLINE for tag, _ in stack[depth:]):
            flush()
        in_link -= sum(tag == "a" for tag, _ in stack[depth:])
        for tag, _ in stack[depth:]:
            depths[tag].pop()
        del stack[depth:]

    def open_element(tag: str, node: int) -> None:
        depths.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def innermost(kinds, barrier=()) -> int | None:
        """Place of the innermost open element of ``kinds``, if none of ``barrier`` is further in."""
        found, stop = (max((depths[k][-1] for k in tags if depths.get(k)), default=0) for tags in (kinds, barrier))
        return found if found and found >= stop else None

    at = 0
    while at < len(source):
        token = TOKEN.search(source, at)
        piece = source[at : token.start()] if token else source[at:]
        if piece:
            text.append(piece)
            if in_link:
                links.append(piece)
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            depth = innermost({tag})
            if depth is not None:
                close_to(depth)
            elif tag == "p" or tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            if EMPTY.search(token[3]):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            text.append(" ")
            continue
        if tag in BREAKS_OUT:
            left_open = HOLDS_NO_BLOCK if tag == "div" else HOLDS_NO_BLOCK | HOLDS_DIV
            while (depth := innermost(left_open, {"foreignobject", "template"})) is not None:
                close_to(depth)
        if tag in CLOSES_P and (depth := innermost({"p"}, {"button", "td", "th", "table"})) is not None:
            close_to(depth)
        if tag in IMPLIED_END and (depth := innermost(*IMPLIED_END[tag])) is not None:
            close_to(depth)
        if tag in INLINE:
            in_link += tag == "a"
            open_element(tag, stack[-1][1])
        else:
            flush()
            silent = tag in SILENT or (tag not in CLOSES_P and nodes[stack[-1][1]].silent)
            nodes.append(Node(tag, stack[-1][1], attributes_of(token[3]), silent=silent))
            if not token[3].endswith("/"):
                open_element(tag, len(nodes) - 1)
    close_to(1)
    flush()
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.words, up.link_words, up.stops = up.words + node.words, up.link_words + node.link_words, up.stops + node.stops
    return Page(nodes, blocks)
