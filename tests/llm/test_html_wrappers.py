"""Wrappers: what they accept, how large they grow, and what pages take from them."""

import random
import re

import pytest
from test_html_whole import texts

from sparkloom.llm import wrappers


def serial(node):
    """A page's tree, as it is, as a string."""
    if node.token == "#":
        return "#"
    inner = "".join(serial(k) for k in node.kids)
    return f"<{node.token}>{inner}</>" if node.token else inner


def plain(page):
    """The tree without folding."""
    root = wrappers.Node("")
    path = [root]
    for kind, x, attrs in wrappers.events(page):
        if kind == "text" and not x.isspace():
            path[-1].kids.append(wrappers.Node("#"))
        elif kind == "open":
            marks = wrappers._marks(attrs)
            path[-1].kids.append(wrappers.Node(f"{x} {marks}" if marks else x))
            path.append(path[-1].kids[-1])
        elif kind == "close":
            path.pop()
    return root


def pattern(node):
    """The wrapper as a regular expression over serial()."""
    flag = {"": "", "?": "?", "+": "+", "*": "*"}[node.flag]
    if node.token == "#":
        return f"(?:#){flag}"
    inner = "".join(pattern(k) for k in node.kids)
    if node.token == "()":
        return f"(?:{inner}){flag}"
    if not node.token:
        return inner
    name, _, marks = node.token.partition(" ")
    head = f"<{re.escape(name)}[^>]*>" if "*" in marks.split(" ") else f"<{re.escape(node.token)}>"
    return f"(?:{head}{inner}</>){flag}"


def random_page(rng):
    def block(depth):
        kind = rng.random()
        if kind < 0.4 or depth > 3:
            return rng.choice(["<p>{}</p>", "<p><b>{}</b>x</p>", "<h2>{}</h2>"]).format(rng.randint(0, 3))
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{rng.randint(0, 5)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        mark = rng.choice(["", " class=box", " class='box wide'", f" id=post-{rng.choice('abcdefgh')}"])
        return f"<div{mark}>" + "".join(block(depth + 1) for _ in range(rng.randint(1, 4))) + "</div>"

    return "<body>" + "".join(block(0) for _ in range(rng.randint(1, 5))) + "</body>"


def test_a_wrapper_accepts_all_its_pages():
    rng = random.Random(2)
    for _ in range(150):
        pages = [random_page(rng) for _ in range(rng.randint(1, 6))]
        wrapper = None
        for page in pages:
            new = wrappers.tree(page)
            wrapper = new if wrapper is None else wrappers._both(wrapper, new, False)
        accepts = re.compile(pattern(wrapper))
        again = wrappers.Node.unpacked(wrapper.packed())
        assert wrappers.expression(again) == wrappers.expression(wrapper)
        for page in pages:
            assert accepts.fullmatch(serial(plain(page))), (page, wrappers.expression(wrapper))


def test_ids_of_single_pages_become_a_slot(spark):
    names = "alpha beta gamma delta epsilon zeta".split()
    page = "<html><body><div class='menu'><a href='/'>home</a></div><div class='tag'>all about {n}</div><div id='post-{n}'><h1>Title {n}</h1><p>text of {n}</p></div><div class='foot'>same on all</div></body></html>"
    assert texts(spark, [page.replace("{n}", n) for n in names], "http://one.com/{}") == [f"all about {n}\n\nTitle {n}\n\ntext of {n}" for n in names]
    trees = [wrappers.tree(page.replace("{n}", n)) for n in names]
    wrapper = trees[0]
    for t in trees[1:]:
        wrapper = wrappers._both(wrapper, t, False)
    assert "<div *><h1>#</><p>#</></>" in wrappers.expression(wrapper)


def test_wrappers_stay_small():
    wrapper = None
    for i in range(600):
        name = "".join(chr(97 + int(c)) for c in str(i))
        new = wrappers.tree(f"<body><section class='{name}'><p>{i}</p></section><span class='x{name}'>{i}</span><{'em' if i % 2 else 'code'} class='{name}'>{i}</{'em' if i % 2 else 'code'}></body>")
        wrapper = new if wrapper is None else wrappers._both(wrapper, new, False)
    assert len(wrappers.expression(wrapper)) < 3000


@pytest.mark.parametrize("copies", [1, 5])
def test_constant_blocks_inside_the_root_are_the_templates(spark, copies):
    page = "<html><body><article><h1>Title {n}</h1><p>" + "words of {n} " * 30 + "</p><p class='x'>Subscribe to get more stories.</p><p>the end of {n}, by <b>us</b></p></article></body></html>"
    made = [page.replace("{n}", str(n)) for n in range(5) for _ in range(copies)]
    want = [f"Title {n}\n\n{('words of %d ' % n * 30).strip()}\n\nthe end of {n}, by us" for n in range(5) for _ in range(copies)]
    assert texts(spark, made, "http://one.com/{}") == want
    # two pages are too few to tell, and pages that are copies of each other keep their text
    assert all("Subscribe" in t for t in texts(spark, made[: 2 * copies : copies], "http://two.com/{}"))
    assert all("Subscribe" in t and "words" in t for t in texts(spark, [made[0]] * 6, "http://same.com/{}"))


@pytest.mark.parametrize("mark", ["class='banner-story'", "id='notice-period'", "id='discussion'", "class='menu-items'"])
@pytest.mark.parametrize("pages", [1, 4])
def test_content_elements_named_like_boilerplate(spark, mark, pages):
    page = f"<html><body><nav><a href='/'>home</a></nav><div class='tag'>Site {{n}}</div><div {mark}><h1>Title {{n}}</h1><p>{'words of {n} ' * 20}</p></div><footer>f</footer></body></html>"
    got = texts(spark, [page.replace("{n}", str(n)) for n in range(pages)], "http://one.com/{}")
    assert all(f"Title {n}\n\n{('words of %d ' % n * 20).strip()}" in t for n, t in enumerate(got))


def test_quotes_that_are_not_closed(spark):
    pages = ['<article><p class="a>Hello</p><p>two</p></article>', '<article><p class="a>Hello</p><p class="b">two</p></article>', "<article><p title=\"1 > 0\" data-x='<b>no</b>'>Hello</p><p don't>two</p></article>", '<article><p class="a>Hello</p><a href="/x" id="y">two</a></article>']
    assert [t.split() for t in texts(spark, pages)] == [["Hello", "two"]] * 4


def test_hot_hosts_are_aligned_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "MANY_PAGES", 2)
    monkeypatch.setattr(wrappers, "LEVELS", 2)
    page = "<html><body><div class='top'>same</div><div id='c'><h1>x{n}</h1><p>{n}</p>" + "<ul><li>{n}</li></ul>" + "</div><div class='foot'>same words</div></body></html>"
    df = spark.createDataFrame([(i, "http://w.com/", page.replace("{n}", str(i))) for i in range(40)], "page_id long, url string, html string").repartition(8)
    rows = wrappers.wrappers(df).collect()
    assert len(rows) == 1 and rows[0].pages == 40 and rows[0].wrapper == "<html><body><div top>=</><div c><h1>#</><p>#</><ul><li>#</></></><div foot>=</></></>"
