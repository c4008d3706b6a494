import random
import time

import numpy as np
import pytest

from setweave.llm import html

RNG = random.Random(17)


def cost(net, edges, keep):
    return sum(-min(c, 0) if k else max(c, 0) for c, k in zip(net, keep)) + sum(c for u, v, c in edges if keep[u] != keep[v])


def test_cut_of_any_graph_is_minimal():
    for _ in range(120):
        n = RNG.randrange(1, 9)
        net = [RNG.choice([0, RNG.uniform(-4, 4)]) for _ in range(n)]
        edges = [(u, v, RNG.uniform(0, 3)) for u in range(n) for v in range(u) if RNG.random() < 0.5]
        best = min(cost(net, edges, [m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(net, edges, html.minimum_cut(net, edges)) == pytest.approx(best)


def random_page():
    tags = ["div", "p", "article", "nav", "section", "ul", "li", "aside", "form"]
    some = lambda: RNG.choice([f"<{RNG.choice(tags)}>", f"</{RNG.choice(tags)}>", "word, word. " * RNG.randrange(1, 5), "<a>link text</a>"])
    return "".join(some() for _ in range(RNG.randrange(5, 40)))


def test_reductions_leave_the_cut_as_it_is():
    for _ in range(300):
        page = html.Page(random_page())
        if page.text:
            z = np.array([RNG.uniform(-html.LIMIT, html.LIMIT) for _ in page.text])
            net, edges = html.graph(page, z)
            assert html.reduced(page, net, edges) == html.minimum_cut(net, edges)[len(page.parent) :]


def test_classifier_learns_from_blocks_whose_role_is_stated(spark):
    def page(k):
        nav = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(5))
        return f"<nav><ul>{nav}</ul></nav><article>{'<p>' + 'Some words of the text, and more of them. ' * 4 + '</p>'}<p>Short.</p></article><footer>rights 2020</footer>"

    pages = spark.createDataFrame([(k, "u", page(k)) for k in range(20)], "page_id long, url string, html string")
    weights = html.learn(pages)
    assert (weights == html.learn(pages.repartition(3))).all() and (weights != html.PRIOR).any()
    bare = "<div><a>one item</a></div><div><a>item two</a></div><div><p>" + "Some words of the text, and more. " * 5 + "</p></div>"
    assert html.main_text(bare, weights) == ("Some words of the text, and more. " * 5).strip()
    assert (html.learn(pages.limit(0)) == html.PRIOR).all()
    assert html.extracted(pages.limit(0), weights).collect() == []


def test_broken_markup():
    assert html.main_text("<article><svg><p>a</p><select>b</article>") == "a\nb"
    assert html.main_text("<article><p>x <math><mi>y</mi><mo>=</mo></math> z</p></article>") == "x y= z"
    assert html.main_text("<form id=all><nav>n</nav><main><p>text</p><form>no</form></main></form>") == "text"
    assert html.main_text("<div id=comments><article>theirs</article></div><article>ours</article>") == "ours"
    assert html.main_text("<script>unclosed <p>a") == ""


@pytest.mark.parametrize("page", ["<div>x" * 170_000, "<div>x</div>" * 87_000, "<div class=ad>x" * 60_000, "<article>" + "<div>x" * 160_000, "<table><tr><td>x, y. <a>k</a>" * 30_000, "<select>" * 120_000, "<!--" * 200_000])
def test_pages_of_a_megabyte(page):
    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 10  # about 1 s
