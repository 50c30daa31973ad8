from __future__ import annotations

import html
import itertools
import math
import random
import re
import time

import pytest

from liftwise.llm import content_model as C
from liftwise.llm.common import table
from liftwise.llm.dom import read
from liftwise.llm.labelled_pages import labelled_pages
from tests.llm.conftest import with_clashes


@pytest.fixture(scope="module")
def model():
    return C.fit(labelled_pages())


def weight(page, features, model, states):
    total = 0.0
    for i, (fs, y) in enumerate(zip(features, states)):
        total += y * sum(model.own[f] for f in fs)
        if i:
            total += model.edges[C.edge_kind(i, page)][states[page.nodes[i].parent]][y]
    return math.exp(total)


def test_marginals_against_all_states():
    rng = random.Random(6)
    page = read("<body><div class=ad><p>One two.</p></div><article><h1>A b c</h1><p>Some words here.<ul><li><a href=x>link</a></li></ul></article><footer>x")
    model = C.Model([rng.uniform(-2, 2) for _ in range(C.OWN)], [[[rng.uniform(-2, 2) for _ in "01"] for _ in "01"] for _ in range(C.EDGE_KINDS)])
    features = [C.node_features(n) for n in page.nodes]
    up, down, belief = C.messages(page, features, model)
    every = {s: weight(page, features, model, s) for s in itertools.product((0, 1), repeat=len(page.nodes))}
    total = sum(every.values())
    for i in range(len(page.nodes)):
        assert C.logistic(belief[i]) == pytest.approx(sum(w for s, w in every.items() if s[i]) / total)
        if i:
            joint = C.edge_marginals(i, page, up, belief, down, model)
            for a, b in itertools.product((0, 1), repeat=2):
                assert joint[a][b] == pytest.approx(sum(w for s, w in every.items() if s[page.nodes[i].parent] == a and s[i] == b) / total)


def test_reader():
    page = read("<p>a&amp;b &lt;c <br>d<p>e <b>f<script>x</p></script> g</b></div><ul><li>h<li>i</ul><!-- no --><textarea>j</textarea> k &copy &am")
    assert [t for _, t in page.blocks] == ["a&b <c d", "e f g", "h", "i", "k © &am"]
    assert read(None).blocks == [] and read("").blocks == [] and [t for _, t in read("just  text").blocks] == ["just text"]
    assert [t for _, t in read("a <b c > d <").blocks] == ["a d <"]
    deep = read("<div>" * 3000 + "x")
    assert deep.nodes[0].words == 1 and len(deep.nodes) == 3001


def test_labelled_pages_are_learned(model):
    wrong = blocks = 0
    for source, labels in labelled_pages():
        page = read(source)
        belief = C.messages(page, [C.node_features(n) for n in page.nodes], model)[2]
        y = list(labels or [])
        for node in page.nodes if labels is None else []:
            y.append(int(node.attributes.get("data-y", y[node.parent] if node.parent >= 0 else 0)))
        wrong += sum((belief[i] > 0) != y[i] for i, _ in page.blocks)
        blocks += len(page.blocks)
    assert wrong / blocks < 0.01


def test_layouts_not_learned_from(model):
    good, bad = "Here the story of the old mill begins, and it is told once more.", "Something else stands here, of no use to the reader."
    page = f"""<html><body><div id="site-navigation"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div>
    <section class="gdpr-consent"><p>{bad}</p></section><div class="article-body"><h2>Mill</h2><p>{good}</p><p>{good}</p>
    <div class="sponsored"><p>{bad}</p></div><ul><li>{good}</li></ul></div><aside id="sidebar-right"><p>{bad}</p></aside>
    <div class="user-comments"><div class="reply"><p>{bad}</p></div></div><form><p>{bad}</p></form><footer><p>{bad}</p></footer></body></html>"""
    assert C.main_text(page, model) == "\n\n".join(["Mill", good, good, good])


def test_pages_of_the_table(spark, model):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r for r in C.extract_pages(with_clashes(pages), model).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r["page_id"]]["text"] == "\n\n".join(x for x in parts if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_odd_pages(spark, model):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<<<>>> &#x41; <p"), (3, "u", "<article><p>" + "word " * 200_000), (None, "u", "<p>")]
    got = C.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert len(got) == 5 and all(r["text"] is not None for r in got)
    assert max(r["n_chars"] for r in got) == 200_000 * 5 - 1
    assert C.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_no_tag_swallows_the_article(model):
    good = "Here the story of the old mill begins, and it is told once more."
    article = f"<article><h1>Mill</h1><p>{good}</p><p>{good}</p></article><footer>Imprint</footer>"
    whole = "\n\n".join(["Mill", good, good])
    ahead = ["<svg class=logo viewBox='0 0 1 1'/>", "<math display=block />", "<svg><path d='M0'>", "<select><option>One<option>Two", "<button>Menu", "<noscript>", "<template>"]
    ahead += ["<object data=a.swf>", "<script src='a.js' />", "<svg><svg><path/></svg><text>x</text></svg>", "<nav><select><option>One</nav>", "<button><div>Menu</div>"]
    for x in ahead:
        assert C.main_text(f"<html><body>{x}{article}</body></html>", model).endswith(whole), x
    assert C.main_text(f"<html><body><script src=/a/>var a = 1</script>{article}</body></html>", model) == whole


def test_text_of_formulas_and_objects_is_kept(model):
    good = "Here the story of the old mill begins, and it is told once more."
    p = f"<p>{good} <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> {good}</p><p>{good} <object data=a>outer <object data=b>inner</object> rest</object> {good}</p>"
    got = C.main_text(f"<html><body><article><h1>Mill</h1>{p}<p>{good}</p><button>Share</button></article></body></html>", model)
    assert got == "\n\n".join(["Mill", f"{good} x=2 {good}", f"{good} outer inner rest {good}", good])


def test_quotes_inside_unquoted_values(model):
    first, second = "It's the first of the old mill's stories, told at length.", "And it's followed by the second one, as long as that."
    page = f"<html><body><article><h1>Mill</h1><p title=don't>{first}</p><p class=x\">{second}</p><p title=\"a > b\" data-x='c > \"d'>{first}</p></article></body></html>"
    assert C.main_text(page, model) == "\n\n".join(["Mill", first, second, first])


def test_very_deep_nesting_is_read_in_linear_time():
    began = time.process_time()
    page = read("<div>" * 50_000 + "<p>x" + "<b>" * 50_000 + "y</p>" + "</div>" * 50_000 + "z")
    assert [t for _, t in page.blocks] == ["xy", "z"] and len(page.nodes) == 50_002
    assert time.process_time() - began < 10


def test_the_stack_search_finds_what_a_walk_finds():
    """Implied ends and barriers, against trees written out."""
    page = read("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>e<p>f<td>g<tr><td><table><tr><td>h</table>i</table><dl><dt>j<dd>k<dt>l</dl>")
    assert [t for _, t in page.blocks] == list("abcdefghijkl")
    parents = {t: page.nodes[page.nodes[n].parent].tag for n, t in page.blocks}
    assert parents["b"] == "ul" and parents["f"] == "td" and parents["h"] == "tr" and parents["l"] == "dl"


def test_tables_and_link_lists_of_an_article_are_kept(model):
    good = "Here the story of the old mill begins, and it is told once more."
    ahead = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
    table = "<table><tr><td>One cell of the table tells a story.<td>Another cell goes on with it.</table>"
    assert C.main_text(f"<html><body>{ahead}<article>{table}</article><footer>x</footer></body></html>", model) == "One cell of the table tells a story.\n\nAnother cell goes on with it."
    figures = "<table><tr><th>Year<th>Grain</tr><tr><td>1900<td>12 tons</tr></table>"
    assert C.main_text(f"<html><body>{ahead}<article><h1>Mill</h1>{figures}</article></body></html>", model) == "Mill\n\nYear\n\nGrain\n\n1900\n\n12 tons"
    linked = f"<article><h1>Mill</h1><p>{good}</p><h2>Links</h2><ul><li><a href=/a>First thing</a><li><a href=/b>Second thing</a></ul><p>{good}</p></article>"
    assert C.main_text(f"<html><body>{ahead}{linked}</body></html>", model) == "\n\n".join(["Mill", good, "Links", "First thing", "Second thing", good])
