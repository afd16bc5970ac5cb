"""Main text of pages by wrappers inferred from pages of the same host.

A wrapper is a union-free regular expression over a page's tokens: tags, text
slots, optional groups and repeated groups, nested as elements are. Pages of
a host are aligned with the host's wrapper one by one: like tokens are matched in
order (heaviest common subsequence), a token that one side lacks becomes
optional, neighbours that repeat become one repeated group (periods of one to
three tokens), texts that differ become a slot, and elements of one tag whose ids
or classes differ from page to page become one element with a slot (``*``) for those.
More than ``MOST_KIDS`` neighbours are folded by tag, so a wrapper stays small however
many pages it was made from. Tasks align their own pages first; a host's partial
wrappers are then aligned with each other, those of hosts with many pages in
two levels, so a host with a third of all pages sends one wrapper from each task.

From the wrapper the host's content root is chosen, a node of it: an article or main
element if one holds text, else the lowest element that holds all text which
isn't boilerplate (by tag, by class, id or role, by being mostly links, or by being
the same text on every page). Names are evidence only: where they would leave less
than ``NAMED_LEAST`` of the text, tags and the wrapper decide. Each page is then
aligned with the wrapper from the top down to the root, and its main text is
what stands there, without boilerplate elements (below the root a class or id
has to be a layout name as a whole, and one of everyday words counts only if the
wrapper shows a constant text or mostly links) and without blocks that are the
template's: the same text at the same place on all of ``CONSTANT_PAGES`` or more pages,
as long as those are no more than ``CONSTANT_MOST`` of the root's text (pages that are
copies of each other keep theirs).

Results for odd input: null or empty html gives an empty text; a null url, or
one without ``://``, has the empty host, which is a host like any other; a page
in which the root is missing is read from its body; unclosed and stray tags
are tolerated, comments and raw elements without an end run to the end of the
page (a self-closed svg is empty, ``<svg-icon>`` an element like any other), a quote
that isn't closed in its tag ends with the tag;
the wrapper, which is packed recursively, ends at depth ``DEEPEST``, while pages
are read at any depth; repeated rows give repeated
results; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed
from .words import slices

DEEPEST = 200
#: A task's wrappers are sent on when it holds this many hosts.
HELD_HOSTS = 5000
#: A text that is the same on at least so many pages of a host, and on all of them, is the template's.
CONSTANT_PAGES = 3
LINK_SHARE = 0.7
#: The share of text that names of boilerplate have to leave, and the most of a root's text that the template may hold.
NAMED_LEAST, CONSTANT_MOST = 0.3, 0.3
#: Neighbours in a wrapper beyond which those of one tag are folded.
MOST_KIDS = 48
#: What pages need of the wrappers (some hundred bytes a host) is broadcast up to so many hosts and bytes; beyond, pages meet it by host and salt.
FEW_HOSTS, FEW_BYTES, SALTS = 20_000, 16 << 20, 16
#: A task's wrapper of at least so many pages is aligned with others of its salt first.
MANY_PAGES, LEVELS = 16, 64

#: Element names and marks of HTML pages.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}), "tfoot": frozenset({"tbody", "thead", "tr", "td", "th"})}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "caption", "legend", "summary"}
HOLDS = frozenset("table ul ol dl select article section main aside nav footer header form div body html td th blockquote".split())
NOISE_TAGS = frozenset("head nav footer aside form button input dialog menu object embed canvas audio video script style noscript template textarea iframe svg title select".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login register social share sharing sidebar sidebars rail menu menus navbar nav navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond discussion related recommended recommendations widget widgets toolbar pagination pager search hidden disclaimer".split())
ROOT_NOISE = frozenset("comment comments reply replies ad ads advert advertisement related promo sponsored teaser".split())
#: Inside content a mark counts only if it is a layout name as a whole: these words, and one of noise. Words that aren't SURE may be a title's: the wrapper has to confirm them.
LAYOUT_WORDS = frozenset("area bar block body bottom box btn button buttons col column container content desktop dropdown entry fixed form global group head header heading icon icons inline inner item items left link links list local main mobile outer page panel post posts primary right row secondary section site slot sticky text thread title toggle top unit wrap wrapper".split())
#: Elements whose ids and classes may be slots.
SLOTTED = frozenset("div section article main table tbody tr td ul ol li p h1 h2 h3 blockquote dl figure".split())
SURE = frozenset("ad ads adv advert adverts advertisement adsense breadcrumb breadcrumbs comment comments disqus gdpr masthead navbar sidebar sidebars".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<svg(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>|<(?P<raw>%s)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^'\">])*|[^>]*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)" % "|".join(RAW), re.S | re.I)
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marks(attrs: str) -> str:
    """Class, id and role of a tag, in a fixed form without digits; ``!`` if it is hidden."""
    if "=" not in attrs and "hidden" not in attrs.lower():
        return ""
    found = []
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        value, name = (a or b or c).strip(), name.lower()
        if name == "style":
            if re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                found.append("!")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            found.append("!")
        elif name == "role":
            found.append("role:" + value.lower())
        elif name in ("class", "id", "itemprop"):
            found += [re.sub(r"\d+", "", v) for v in value.split()]
    return " ".join(sorted(set(found)))


def is_noise(token: str, inside_content: bool, confirmed: frozenset[str] | None = None) -> bool:
    """Whether an element of this token is boilerplate; inside_content: below an article or main element; confirmed: inside content, the host's tokens for which doubtful marks hold."""
    name, _, marks = token.partition(" ")
    if name in NOISE_TAGS or (name == "header" and not inside_content):
        return True
    if not marks or name in ("html", "body"):
        return False
    for mark in marks.split(" "):
        if mark == "!":
            return True
        if mark.startswith("role:"):
            if mark[5:] in NOISE_ROLES:
                return True
            continue
        parts = {x.lower() for x in WORD.findall(mark)}
        if parts & {"no", "has", "with", "without"}:
            continue
        own = name in ("article", "main")
        noise = parts & (ROOT_NOISE if own else NOISE_WORDS)
        if not noise:
            continue
        if confirmed is None and not own:
            return True
        if name in HEADINGS or parts - noise - NOISE_WORDS - LAYOUT_WORDS:
            continue
        if confirmed is None or token in confirmed or noise & (SURE | ROOT_NOISE - {"related", "promo"} if own else SURE):
            return True
    return False


class Node:
    __slots__ = ("token", "flag", "kids", "text", "size", "links")

    def __init__(self, token: str, flag: str = "", kids: list | None = None, text: object = None, size: int = 0, links: int = 0):
        # flag: "" once, "?" optional, "+" repeated, "*" both; text of "#": the constant's digest, None for a slot
        self.token, self.flag, self.kids, self.text, self.size, self.links = token, flag, kids if kids is not None else [], text, size, links

    def packed(self) -> list:
        return [self.token, self.flag, self.text, self.size, self.links, [k.packed() for k in self.kids]]

    @classmethod
    def unpacked(cls, x: list) -> Node:
        return cls(x[0], x[1], [cls.unpacked(k) for k in x[5]], x[2], x[3], x[4])


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with implied ends: kind is open, close, void or text. Opens and closes balance at any depth."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where the stack has each name

    def last(names: frozenset[str]) -> int:
        at = -1
        for n in names:
            if (found := places.get(n)) and found[-1] > at:
                at = found[-1]
        return at

    def pop() -> tuple[str, str, str]:
        top = stack.pop()
        places[top].pop()
        return "close", top, ""

    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            yield "text", text, ""
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if places.get(name):
                at = places[name][-1]
                while len(stack) > at:
                    yield pop()
            elif name in ("p", "br"):
                yield "void", "br", ""
            continue
        closes = CLOSES.get(name, frozenset())
        if name in ENDS_P:
            closes = closes | {"p"}
        if closes:
            at = last(closes)
            if at >= 0 and at < last(HOLDS - closes):
                at = -1
            while at >= 0:
                while len(stack) > at:
                    yield pop()
                at = len(stack) - 1 if stack and stack[-1] in closes else -1
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCK:
            yield "void", name, m["attrs"]
        else:
            places.setdefault(name, []).append(len(stack))
            stack.append(name)
            yield "open", name, m["attrs"]
    while stack:
        yield pop()


def digest(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def tree(page: str) -> Node:
    """The page as nested tokens down to DEEPEST, each repeated run of siblings folded; what is below counts as text of the deepest."""
    root, path = Node(""), []
    path.append(root)
    in_link = surplus = 0
    for kind, x, attrs in events(page):
        if kind == "text":
            if x.isspace():
                continue
            text = " ".join(references.unescape(x).split())
            path[-1].kids.append(Node("#", text=digest(text), size=len(text), links=len(text) if in_link else 0))
        elif kind == "open":
            in_link += x == "a"
            if len(path) > DEEPEST:
                surplus += 1
                continue
            marks = _marks(attrs)
            node = Node(f"{x} {marks}" if marks else x)
            path[-1].kids.append(node)
            path.append(node)
        elif kind == "close":
            in_link -= x == "a"
            if surplus:
                surplus -= 1
                continue
            node = path.pop()
            node.kids = fold(node.kids)
        elif x != "br":
            path[-1].kids.append(Node(x))
    root.kids = fold(root.kids)
    return root


def _both(a: Node, b: Node, repeated: bool) -> Node:
    optional = a.flag in "?*" and a.flag or b.flag in "?*" and b.flag
    again = repeated or a.flag in ("+", "*") or b.flag in ("+", "*")
    flag = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[bool(optional), again]
    text = a.text if a.text == b.text else None
    return Node(a.token if a.token == b.token else common(a.token, b.token), flag, align(a.kids, b.kids), text, a.size + b.size, a.links + b.links)


def fold(kids: list[Node]) -> list[Node]:
    """Fold neighbours that repeat: runs of one token, then of two or three."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].token == k.token:
            out[-1] = _both(out[-1], k, True)
        else:
            out.append(k)
    for w in (2, 3):
        i = 0
        while i + 2 * w <= len(out):
            if [k.token for k in out[i : i + w]] == [k.token for k in out[i + w : i + 2 * w]] and not any(k.token == "()" for k in out[i : i + w]):
                group = out[i : i + w]
                while [k.token for k in out[i + w : i + 2 * w]] == [k.token for k in group]:
                    group = [_both(a, b, False) for a, b in zip(group, out[i + w : i + 2 * w], strict=True)]
                    del out[i + w : i + 2 * w]
                out[i : i + w] = [Node("()", "+", group)]
            i += 1
    return out


def _optional(node: Node) -> Node:
    return Node(node.token, {"": "?", "+": "*"}.get(node.flag, node.flag), node.kids, node.text, node.size, node.links)


def common(a: str, b: str) -> str:
    """The token that two of one tag have in common: what they share, and a slot for the rest."""
    name, _, one = a.partition(" ")
    both = {*one.split(" ")} & {*b.partition(" ")[2].split(" ")}
    return " ".join([name, *sorted((both | {"*"}) - {""})])


def weight(a: str, b: str) -> int:
    """How well two tokens fit each other: 0 not at all."""
    if a == b:
        return 8
    name, _, one = a.partition(" ")
    other, _, two = b.partition(" ")
    if name != other or name not in SLOTTED or not one or not two or is_noise(a, False) or is_noise(b, False):
        return 0
    return 1 + 2 * min(3, len({*one.split(" ")} & {*two.split(" ")} - {"*"}))


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The expression that both lists fit: the heaviest common subsequence is matched, the rest optional."""
    if [k.token for k in a] == [k.token for k in b]:
        return [_both(x, y, False) for x, y in zip(a, b, strict=True)]
    start = 0
    while start < len(a) and start < len(b) and a[start].token == b[start].token:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[-1 - end].token == b[-1 - end].token:
        end += 1
    head = [_both(x, y, False) for x, y in zip(a[:start], b[:start], strict=True)]
    tail = [_both(x, y, False) for x, y in zip(a[len(a) - end :], b[len(b) - end :], strict=True)]
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(a), len(b)
    fits = {(x, y): weight(x, y) for x in {k.token for k in a} for y in {k.token for k in b}}
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            w = fits[a[i].token, b[j].token]
            row[j] = max(below[j], row[j + 1], below[j + 1] + w if w else 0)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and (w := fits[a[i].token, b[j].token]) and best[i][j] == best[i + 1][j + 1] + w:
            out.append(_both(a[i], b[j], False))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return narrowed(fold([*head, *out, *tail]))


def narrowed(kids: list[Node]) -> list[Node]:
    """At most about MOST_KIDS neighbours: beyond, those that are optional or repeated become one repeated element for each tag and kind of mark."""
    if len(kids) <= MOST_KIDS:
        return kids
    out: list[Node] = []
    at: dict[tuple, int] = {}
    for k in kids:
        name = k.token.partition(" ")[0]
        key = (name, is_noise(k.token, False)) if k.token not in ("#", "()") else (k.token, False)
        if k.flag and key in at:
            out[at[key]] = _both(out[at[key]], k, True)
        else:
            if k.flag:
                at[key] = len(out)
            out.append(k)
    return out


def expression(node: Node) -> str:
    """The wrapper as text: tags, # for a slot, = for a constant text, and groups."""
    if node.token == "#":
        return ("=" if node.text is not None else "#") + node.flag
    inner = "".join(map(expression, node.kids))
    if node.token == "()":
        return f"({inner}){node.flag}"
    body = f"<{node.token}>{inner}</>" if node.token else inner
    return f"({body}){node.flag}" if node.flag else body


def confirmed_noise(wrapper: Node, pages: int) -> frozenset[str]:
    """Tokens with marks of noise whose text is mostly links, or the same on every page of a host."""
    found: dict[str, list[int]] = {}

    def visit(node: Node, always: bool) -> tuple[int, int, int]:
        """Characters below node, those within links, and those of constant texts."""
        always = always and node.flag in ("", "+")
        if node.token == "#":
            return node.size, node.links, node.size if always and node.text is not None and pages >= CONSTANT_PAGES else 0
        below = [visit(k, always) for k in node.kids]
        sums = [sum(x[i] for x in below) for i in range(3)]
        if " " in node.token and is_noise(node.token, True):
            found[node.token] = [a + b for a, b in zip(found.get(node.token, (0, 0, 0)), sums, strict=True)]
        return tuple(sums)

    visit(wrapper, True)
    return frozenset(t for t, (size, links, constant) in found.items() if constant == size or links >= LINK_SHARE * size)


def content_root(wrapper: Node, pages: int, confirmed: frozenset[str] = frozenset()) -> list[Node] | None:
    """Nodes from the top to the content root of a host; None if it has no text of its own."""

    def live(node: Node, inside: bool, tags_only: bool) -> tuple[int, int]:
        """Characters of text below node that count, and those within links."""
        if node.token == "#":
            constant = node.text is not None and pages >= CONSTANT_PAGES
            return (0, 0) if constant else (node.size, node.links)
        name = node.token.partition(" ")[0]
        if name in NOISE_TAGS if tags_only else is_noise(node.token, inside, confirmed if inside else None):
            return 0, 0
        below = [live(k, inside or name in ("article", "main"), tags_only) for k in node.kids]
        size, links = sum(x[0] for x in below), sum(x[1] for x in below)
        if name in ("ul", "ol", "div", "section", "table", "p") and size and links >= LINK_SHARE * size and not inside:
            return 0, 0
        return size, links

    named, plain = live(wrapper, False, False)[0], live(wrapper, False, True)[0]
    for tags_only in (True, False) if named < NAMED_LEAST * plain else (False, True):
        found: list[tuple[int, list[str], list[Node]]] = []

        def articles(node: Node, path: list[Node], inside: bool) -> None:
            name = node.token.partition(" ")[0]
            size = live(node, inside, tags_only)[0]
            if not size:
                return
            here = path if node.token in ("", "()") else [*path, node]
            if name in ("article", "main"):
                found.append((size, [n.token for n in here], here))
                return
            for k in node.kids:
                articles(k, here, inside)

        articles(wrapper, [], False)
        if found:
            return max(found, key=lambda x: x[:2])[2]
        node, path = wrapper, []
        while True:
            size = live(node, False, tags_only)[0]
            if not size:
                break
            whole = [k for k in node.kids if live(k, False, tags_only)[0] == size]
            if len(whole) != 1 or whole[0].token == "#" or whole[0].flag in ("+", "*") or whole[0].token.partition(" ")[0] in ("p", "h1", "h2", "h3", "li", "td", "span", "a", "b", "i", "em", "strong"):
                return path
            node = whole[0]
            if node.token != "()":
                path.append(node)
    return None


def guide(wrapper: Node, pages: int, path: list[Node]) -> list:
    """What pages need of the wrapper: nested [token, on the path to the root, digests of the template's texts, nodes below].

    Beside the path stand its neighbours, without what is below them; below the
    root only what leads to texts of the template.
    """
    on_path = {id(n) for n in path}
    root = path[-1] if path else wrapper
    total, constant = 0, 0

    def sums(node: Node, always: bool) -> None:
        nonlocal total, constant
        always = always and node.flag in ("", "+")
        if node.token == "#":
            total += node.size
            constant += node.size if always and node.text is not None else 0
        for k in node.kids:
            if k.token in ("#", "()") or not is_noise(k.token, True):
                sums(k, always)

    sums(root, True)
    drop = pages >= CONSTANT_PAGES and constant <= CONSTANT_MOST * total

    def flat(node: Node) -> list[Node]:
        return [x for k in node.kids for x in (flat(k) if k.token == "()" else [k])]

    def constants(node: Node) -> list[int]:
        """The text of a block that holds one text and nothing else, the same on every page."""
        name = node.token.partition(" ")[0]
        kids = node.kids
        return [kids[0].text] if name in BLOCK and len(kids) == 1 and kids[0].token == "#" and kids[0].flag == "" and kids[0].text is not None else []

    def below(node: Node, always: bool) -> list | None:
        always = always and node.flag in ("", "+")
        if node.token == "#" or not always:
            return None
        own = constants(node)
        kids = [x for k in flat(node) if (x := below(k, always))]
        return [node.token, False, own, kids] if own or kids else None

    def along(node: Node, at: int) -> list:
        if at == len(path):
            if not drop:
                return []
            marked = {id(k): below(k, True) for k in flat(node)}
            return [marked[id(k)] or [k.token, False, [], []] for k in flat(node) if k.token != "#"] if any(marked.values()) else []
        return [[k.token, id(k) in on_path, [], along(k, at + 1) if id(k) in on_path else []] for k in flat(node) if k.token != "#"]

    return along(wrapper, 0)


class Step:
    """An open element of a page and where it stands in the wrapper."""

    __slots__ = ("kids", "next", "constants")

    def __init__(self, kids: list | None, constants: list[int] | tuple = ()):
        self.kids, self.next, self.constants = kids, 0, constants

    def match(self, token: str) -> list | None:
        """The wrapper's node for the next element below: in order, from the last match on, else from the start (groups repeat)."""
        if not self.kids:
            return None
        name, _, marks = token.partition(" ")
        own = None
        for i in (*range(self.next, len(self.kids)), *range(self.next)):
            if self.kids[i][0] == token:
                self.next = i
                return self.kids[i]
        for i in (*range(self.next, len(self.kids)), *range(self.next)):
            other, _, wanted = self.kids[i][0].partition(" ")
            if other == name and "*" in wanted.split(" "):
                own = {*marks.split(" ")} if own is None else own
                if {*wanted.split(" ")} - {"*"} <= own and not is_noise(token, False):
                    self.next = i
                    return self.kids[i]
        return None


def main_text(page: str, root: list | None, confirmed: frozenset[str] = frozenset(), depth: int = 0) -> str:
    """Blocks below the content root, in page order, joined by an empty line; root: the guide, whose root lies ``depth`` elements deep."""
    blocks: list[str] = []
    held: list[str] = []
    owners: list[Step | None] = []  # of the held texts
    stack = [Step(root)]
    skipped = -1  # depth of the boilerplate element that is open
    content = 0  # open article and main elements
    on_path = 0  # open elements that are on the path to the root
    found = False
    inside = depth == 0
    open_ = 0

    def end() -> None:
        if held:
            block = " ".join("".join(held).split())
            if block and not (len(owners) == 1 and owners[0] and owners[0].constants and digest(block) in owners[0].constants):
                blocks.append(block)
            held.clear()
            owners.clear()

    for kind, x, attrs in events(page):
        if kind == "text":
            if inside and skipped < 0:
                held.append(references.unescape(x))
                if not x.isspace():
                    owners.append(stack[-1])
        elif kind == "void":
            if inside and skipped < 0:
                if x in BLOCK:
                    end()
                elif x == "br":
                    held.append(" ")
        elif kind == "open":
            marks = _marks(attrs)
            token = f"{x} {marks}" if marks else x
            open_ += 1
            node = stack[-1].match(token) if skipped < 0 else None
            stack.append(Step(node[3], node[2]) if node else Step(None))
            if inside and x in BLOCK:
                end()
            ahead = bool(node and node[1]) and on_path == open_ - 1  # on the path to the root
            if skipped < 0 and not (ahead and x not in NOISE_TAGS) and is_noise(token, content > 0, confirmed if content or depth and inside else None):
                skipped = open_
            content += x in ("article", "main")
            if ahead and skipped < 0:
                on_path += 1
                if not inside and on_path == depth:
                    inside = found = True
                    end()
        else:
            if inside and x in BLOCK and (skipped < 0 or skipped == open_):
                end()
            if skipped == open_:
                skipped = -1
            stack.pop()
            content -= x in ("article", "main")
            open_ -= 1
            if on_path > open_:
                on_path = open_
                if depth and inside and on_path < depth:
                    end()
                    inside = False
    end()
    if depth and not found:
        return main_text(page, None, confirmed)
    return "\n\n".join(blocks)


HOST = "translate(regexp_extract({url}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Per host: host, pages, wrapper (as an expression), root (JSON of the content root's path, or null), noise (JSON of confirmed tokens)."""
    rows = pages.select(F.coalesce(F.expr(HOST.format(url=f"`{url}`")), F.lit("")).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % LEVELS
        held: dict[str, tuple[int, Node]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([salt if x[0] >= MANY_PAGES else -1 for x in held.values()], pa.int32()), pa.array([json.dumps(x[1].packed()) for x in held.values()], pa.string())], names=["host", "pages", "salt", "wrapper"])
            held.clear()
            return batch

        for whole in batches:
            for batch in slices(whole, "html"):
                for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    new = tree(page)
                    n, old = held.get(host, (0, None))
                    held[host] = n + 1, new if old is None else _both(old, new, False)
                if len(held) >= HELD_HOSTS:
                    yield out()
        yield out()

    def aligned(table: pa.Table) -> tuple[int, Node]:
        n, wrapper = 0, None
        for pages_, text in sorted(zip(table["pages"].to_pylist(), table["wrapper"].to_pylist(), strict=True)):
            node = Node.unpacked(json.loads(text))
            n, wrapper = n + pages_, node if wrapper is None else _both(wrapper, node, False)
        return n, wrapper

    def merged(table: pa.Table) -> pa.Table:
        n, wrapper = aligned(table)
        return pa.table({"host": table["host"][:1].cast(pa.string()), "pages": pa.array([n], pa.int64()), "wrapper": pa.array([json.dumps(wrapper.packed())], pa.string())})

    def joined(table: pa.Table) -> pa.Table:
        n, wrapper = aligned(table)
        noise = confirmed_noise(wrapper, n)
        path = content_root(wrapper, n, noise)
        known = {"host": table["host"][:1].cast(pa.string()), "pages": pa.array([n], pa.int64()), "wrapper": pa.array([expression(wrapper)], pa.string())}
        return pa.table(known | {"root": pa.array([json.dumps([len(path or ()), guide(wrapper, n, path) if path is not None else []])], pa.string()), "noise": pa.array([json.dumps(sorted(noise))], pa.string())})

    found = rows.mapInArrow(partial, "host string, pages long, salt int, wrapper string")
    found = found.groupBy("host", "salt").applyInArrow(merged, "host string, pages long, wrapper string")
    return found.groupBy("host").applyInArrow(joined, "host string, pages long, wrapper string, root string, noise string")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text, n_chars."""
    roots = checkpointed(wrappers(pages, url, html).select(F.col("host").alias("_host"), "root", "noise"))
    kinds = {c: pages.schema[c].dataType for c in (key, url)}
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"), F.coalesce(F.expr(HOST.format(url=f"`{url}`")), F.lit("")).alias("_host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for whole in batches:
            for batch in slices(whole, "_html"):
                texts = []
                for page, *of in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    if (of := tuple(of)) not in known:
                        if len(known) >= HELD_HOSTS:
                            known.clear()
                        depth, root = json.loads(of[0] or "[0, []]")
                        known[of] = root, frozenset(json.loads(of[1] or "[]")), depth
                    texts.append(main_text(page or "", *known[of]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["a", "b", "text", "n_chars"])

    size = roots.agg(F.count("*").alias("n"), F.sum(F.octet_length("root") + F.octet_length("noise") + F.octet_length("_host")).alias("b")).first()
    if size["n"] <= FEW_HOSTS and (size["b"] or 0) <= FEW_BYTES:
        joined = rows.join(F.broadcast(roots), "_host", "left")
    else:  # a host may hold a third of the pages
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_key", "_html"), F.lit(SALTS)))
        joined = salted.join(roots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_host", "_salt"], "left")
    found = joined.select("_key", "_url", "_html", "root", "noise").mapInArrow(run, f"a {kinds[key].simpleString()}, b {kinds[url].simpleString()}, text string, n_chars long")
    return found.toDF(key, url, "text", "n_chars")
