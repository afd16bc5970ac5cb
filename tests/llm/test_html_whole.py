"""Pages whose text was cut: nothing of an article may be lost."""

import random
import re

import pytest

from sparkloom.llm import wrappers


def texts(spark, pages, url="http://h{}.com/"):
    """Main texts by the position of a page; every page has its own host unless url says otherwise."""
    df = spark.createDataFrame([(i, url.format(i), p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    return [found[i] for i in range(len(pages))]


RAW_NAMES = ['<svg-icon name="x"></svg-icon>', "<title-bar></title-bar>", "<select-menu></select-menu>", "<template-card></template-card>", '<svg width="1"/>', '<svg viewBox="0 0 1 1" d="a>b" />', "<svg/>", "<SVG-icon></SVG-icon>", "<svg><path d='x'/><text>no</text></svg>", "<script-x></script-x>", "<svg\n/>"]


@pytest.mark.parametrize("tail", ["", "<svg><path/></svg><p>three</p>"])
def test_names_that_begin_like_raw_elements(spark, tail):
    pages = [f"<html><body><article><p>one</p>{x}<p>two</p>{tail}</article></body></html>" for x in RAW_NAMES]
    assert texts(spark, pages) == ["one\n\ntwo" + ("\n\nthree" if tail else "")] * len(pages)


def test_text_after_deep_nesting(spark):
    deep = "".join(f"<div>{i}" for i in range(300)) + "</div>" * 300
    flat = "\n\n".join(map(str, range(300)))
    fonts = "<font>" * 250
    pages = [f"<html><body><div><article>{deep}<p>tail</p></article><p>out</p></div></body></html>", f"<html><body>{fonts}<p>one</p><nav>menu</nav><p>two</p><footer>f</footer></body></html>", f"<html><body><article>{fonts}<p>one</p><div class='ad'>buy</div><p>two</p></article></body></html>"]
    assert texts(spark, pages) == [f"{flat}\n\ntail", "one\n\ntwo", "one\n\ntwo"]


def test_events_balance_as_with_a_plain_stack():
    rng = random.Random(5)
    names = "div p b li ul td tr table br article span a tbody th dt dd section".split()
    for _ in range(300):
        page = "".join(rng.choice(["<%s>", "<%s>", "</%s>", "x"]).replace("%s", rng.choice(names)) for _ in range(60))
        stack, got = [], []
        for kind, x, _ in wrappers.events(page):
            got.append((kind, x))
            if kind == "open":
                stack.append(x)
            elif kind == "close":
                assert stack.pop() == x
        assert not stack and got == plain_events(page)


def plain_events(page):
    """The same ends, each found by a walk down the stack."""
    stack, out = [], []

    def pop():
        out.append(("close", stack.pop()))

    for end, name, text in re.findall(r"<(/?)(\w+)>|([^<]+)", page):
        if text:
            out.append(("text", text))
        elif end:
            if name in stack:
                while stack[-1] != name:
                    pop()
                pop()
            elif name in ("p", "br"):
                out.append(("void", "br"))
        else:
            closes = wrappers.CLOSES.get(name, frozenset()) | ({"p"} if name in wrappers.ENDS_P else set())
            while closes:
                at = next((i for i in reversed(range(len(stack))) if stack[i] in closes or stack[i] in wrappers.HOLDS), -1)
                if at < 0 or stack[at] not in closes:
                    break
                while len(stack) > at:
                    pop()
                if not stack or stack[-1] not in closes:
                    break
            if name in wrappers.VOID:
                out.append(("void", name))
            else:
                stack.append(name)
                out.append(("open", name))
    while stack:
        pop()
    return out


SLUGS = ['<h2 id="search-algorithms">t</h2><p>x{n}</p>', '<h2 id="search">t</h2><p>x{n}</p>', '<section id="discussion"><h2>t</h2><p>x{n}</p></section>', '<div id="related-work"><h3>t</h3><p>x{n}</p></div>', '<section id="alert-rules"><p>t</p><p>x{n}</p></section>', '<div class="notice"><p>t</p><p>x{n}</p></div>']


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("pages", [1, 4])
def test_title_words_are_no_boilerplate(spark, tag, pages):
    for url in ("http://h{}.com/", "http://one.com/{}"):
        made = [f"<html><body><div class='menu'><a href='/'>home</a></div><{tag} class='body'><p>one{n}{i}</p>{x.replace('{n}', str(n))}<p>two{n}</p></{tag}></body></html>" for n in range(pages) for i, x in enumerate(SLUGS)]
        assert texts(spark, made, url) == [f"one{n}{i}\n\nt\n\nx{n}\n\ntwo{n}" for n in range(pages) for i in range(len(SLUGS))]


def test_wrappers_confirm_boilerplate(spark):
    page = "<html><body><article><p>one{n}</p><div class='share-buttons'>Tell your friends</div><div id='related'><a href='/{n}'>more {n}</a></div><div class='ad-slot'>buy {n}</div><p>two{n}</p></article></body></html>"
    assert texts(spark, [page.replace("{n}", str(n)) for n in range(4)], "http://one.com/{}") == [f"one{n}\n\ntwo{n}" for n in range(4)]
