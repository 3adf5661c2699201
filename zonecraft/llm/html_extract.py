"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text.  A linear classifier gives every block a cost of being called
boilerplate and one of being called content: the capacities of its edges from the source and to
the sink.  Names, roles and tags of the elements around a block are features among others, and an element
that holds the page's main part, or most of its text, is no furniture whatever it is called.  Blocks that follow each other, more so the nearer they are in the document tree, and
blocks of one parent are joined by smoothness edges.  The minimum cut, found by maximum flow,
is the labelling of least cost."""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

# Kinds of elements.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "nav", "aside", "footer", "header", "form", "blockquote", "menu", "select", "figure"}
CONTENT_TAGS, CHROME_TAGS = {"article", "main"}, set("nav footer aside form dialog menu button select fieldset search".split())
CONTENT_ROLES, CHROME_ROLES = {"main", "article"}, set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
CHROME_WORDS = set("nav navbar navigation menu menus sidebar footer header masthead banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
                   "subscribe subscription signup login promo promotion advert adverts advertisement advertising ad ads adsense sponsor sponsored sponsors related "
                   "recommended recommendations share sharing social cookiebar toast topnav sidenav topbar rail adsbygoogle breadcrumb breadcrumbs pagination pager "
                   "widget toolbar copyright skip".split())
COMMENT_WORDS = set("comment comments commentlist discussion disqus respond replies reply".split())
TITLE_WORDS, PART_WORDS = {"header", "masthead", "banner"}, {"entry", "post", "article", "story"}
CONTENT_NAMES = set("article article-body article-content articlebody post post-body post-content entry entry-content story story-body content main main-content page-content".split())
NOT_A_PART = {"has", "with", "no", "without", "is", "show", "hide"}

CHROME, OUTSIDE, INSIDE = -9.0, -3.0, 4.0
MAIN_SHARE, MOST = 0.3, 0.6  # of a page's text: what its main part has at least, and what is too much for furniture


class Element:
    """A block-level element: what its own tag and attributes say, and the text below it."""

    __slots__ = ("parent", "furniture", "comments", "content", "size")

    def __init__(self, parent, furniture, comments, content):
        self.parent, self.furniture, self.comments, self.content, self.size = parent, furniture, comments, content, 0


class Block:
    __slots__ = ("chrome", "common", "content", "depth", "element", "linked", "parent", "tag", "text")

    def __init__(self, text, tag, parent, depth, common, linked, element):
        self.text, self.tag, self.parent, self.depth, self.common, self.linked, self.element = text, tag, parent, depth, common, linked, element
        self.content = self.chrome = False


def _says(tag: str, raw: str, in_content: bool) -> tuple[bool, bool, bool]:
    """Whether an element's tag and attributes speak of page furniture, of readers' comments, of content."""
    furniture, comments, content = tag in CHROME_TAGS or tag == "header" and not in_content, False, tag in CONTENT_TAGS
    if not raw.strip() or tag in ("html", "body"):
        return furniture, comments, content
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            furniture = True
        elif name == "role":
            furniture, content = furniture or value in CHROME_ROLES, content or value in CONTENT_ROLES
        elif name == "itemprop" and value == "articlebody":
            content = True
        elif name in ("class", "id") and tag not in HEADINGS | {"main"}:
            for token in value.split():
                content = content or tag in ("div", "section") and token in CONTENT_NAMES
                words = re.split(r"[-_:]+", token)
                said = {w for i, w in enumerate(words) if i == 0 or words[i - 1] not in NOT_A_PART}
                if said & PART_WORDS and said & TITLE_WORDS and not said & (CHROME_WORDS - TITLE_WORDS):
                    # the head of an entry, not of the page
                    furniture, content = furniture and tag != "header", True
                else:
                    furniture = furniture or bool(said & CHROME_WORDS)
                comments = comments or bool(said & COMMENT_WORDS)
    return furniture, comments, content


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; white space in a block is one space."""
    found: list[Block] = []
    elements = [Element(-1, False, False, False)]  # the first stands for the page
    # open elements: tag, number, block-level element around, whether in content
    stack, number, parts, linked, links = [("", 0, 0, False)], 0, [], 0, 0
    open_tags: dict[str, int] = {}
    same = 1  # how many open elements have been open since the last block

    def flush():
        nonlocal parts, linked, same
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK or not i)
                outer = stack[at - 1][1] if at else 0
                found.append(Block(text, stack[at][0], outer, at + 1, min(same, at + 1, found[-1].depth) if found else 0, linked, stack[at][2]))
                same = len(stack)
            parts, linked = [], 0

    def add(raw: str):
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text)

    def pop_to(at: int):
        nonlocal links, same
        for e in stack[at:]:
            links -= e[0] == "a"
            open_tags[e[0]] -= 1
        del stack[at:]
        same = min(same, at)

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(re.sub(r"</?\Z", "", page[at:]))
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        closing, name, raw = m[1] or m[4], name.lower(), m[3] or m[6] or ""
        if closing:
            if name in BLOCK:
                flush()
            if open_tags.get(name):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        pop_to(i)
                        break
                    if name not in BLOCK and stack[i][0] in BLOCK:
                        break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCK:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] in CLOSES.get(name, ()):
                    pop_to(i)
                    if stack[-1][0] not in CLOSES.get(name, ()):
                        break
                elif stack[i][0] in SCOPE:
                    break
        if name in VOID or raw.endswith("/") and name not in BLOCK and name != "a":
            continue
        _, _, element, content = stack[-1]
        if name in BLOCK:
            furniture, comments, own = _says(name, raw, content)
            elements.append(Element(element, furniture, comments, own))
            element, content = len(elements) - 1, content or own
        number += 1
        stack.append((name, number, element, content))
        open_tags[name] = open_tags.get(name, 0) + 1
        links += name == "a"
    flush()
    _judge(found, elements)
    return found


def _judge(found: list[Block], elements: list[Element]) -> None:
    """Set content and chrome of the blocks from the elements around them, each element looked at twice.

    The main part is the largest element that speaks of content and is no comment.  Furniture that holds
    it, or that has most of the text while no content element stands outside of it, is a name of the page's
    layout (a form around a page, a wrapper called after its sidebar) and counts for nothing."""
    for b in found:
        elements[b.element].size += max(len(b.text) - b.linked, 0)
    for e in reversed(elements[1:]):  # children come after their parents
        elements[e.parent].size += e.size
    total = elements[0].size or 1
    commented = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        commented[i] = commented[e.parent] or e.comments
    candidates = [i for i, e in enumerate(elements) if e.content and not commented[i]]
    main = max(candidates, key=lambda i: (elements[i].size, -i), default=None)
    holds_main, inside = [False] * len(elements), [0] * len(elements)
    if main is not None and elements[main].size >= MAIN_SHARE * total:
        i = main
        while i > 0:
            holds_main[i] = True
            i = elements[i].parent
    for i in candidates:
        inside[i] += 1
    for i in range(len(elements) - 1, 0, -1):
        inside[elements[i].parent] += inside[i]
    chrome, content = [False] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        layout = holds_main[i] or e.size >= MOST * total and inside[i] == len(candidates)
        own = e.comments and not holds_main[i] or e.furniture and not layout
        chrome[i], content[i] = chrome[e.parent] or own, content[e.parent] or e.content
    for b in found:
        b.chrome, b.content = chrome[b.element], content[b.element]


def score(block: Block, article_known: bool) -> float:
    """The classifier's log odds of content."""
    words = block.text.count(" ") + 1
    s = min(words, 40) / 10 - 1.0
    s += CHROME if block.chrome else INSIDE if block.content else OUTSIDE if article_known else 0.0
    # a list of links is furniture outside of an article, and part of it inside
    s -= min(1.0, block.linked / len(block.text)) * (1.5 if block.content else 6.0)
    s += 2.0 if block.tag == "h1" else 1.0 if block.tag in HEADINGS else 0.5 if block.tag in ("p", "blockquote", "pre", "figcaption") else -0.5 if block.tag in ("li", "option") else 0.0
    s += 0.5 if block.text[-1] in ".!?…:;\"”" else 0.0
    return s - (2.0 if block.text.startswith(("©", "(c)", "Copyright")) else 0.0)


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, weaker with their distance in the tree, and between blocks of a parent."""
    edges, latest = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, 2.0 / (blocks[i - 1].depth + b.depth - 2 * b.common + 1)))
        if latest.get(b.parent, i - 1) < i - 1:
            edges.append((latest[b.parent], i, 0.5))
        latest[b.parent] = i
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side (content) of a minimum cut; ties are not.

    A node whose own edge outweighs all its smoothness edges is on that side in every minimum cut; it
    is decided first and its edges become its neighbours' own.  The rest is solved by maximum flow along
    shortest paths in layers."""
    n = len(scores)
    own, near = list(scores), [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(own[i]) > sum(near[i].values()):
            side[i] = own[i] > 0
            for j, w in near[i].items():
                own[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        source, sink = n, n + 1
        room = {i: dict(near[i]) for i in rest}
        room[source], room[sink] = {}, {}
        for i in rest:
            a, b = (source, i) if own[i] > 0 else (i, sink)
            room[a][b], room[b][a] = abs(own[i]), room[b].get(a, 0.0)
        tiny = 1e-9
        while True:
            layer, queue = {source: 0}, deque([source])
            while queue:
                i = queue.popleft()
                for j, c in room[i].items():
                    if c > tiny and j not in layer:
                        layer[j] = layer[i] + 1
                        queue.append(j)
            if sink not in layer:
                break
            left = {i: iter(list(room[i])) for i in layer}
            path = [source]
            while path:
                i = path[-1]
                if i == sink:
                    flow = min(room[a][b] for a, b in zip(path, path[1:]))
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= flow
                        room[b][a] += flow
                    path = path[:1 + next(k for k, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= tiny)]
                    continue
                step = next((j for j in left[i] if room[i][j] > tiny and layer.get(j) == layer[i] + 1), None)
                if step is None:
                    path.pop()
                else:
                    path.append(step)
        for i in rest:
            side[i] = i in layer
    return [bool(s) for s in side]


def main_blocks(page: str) -> list[str]:
    """The texts of a page's content blocks, in order."""
    found = blocks_of(page)
    known = any(b.content and not b.chrome for b in found)
    keep = minimum_cut([score(b, known) for b in found], smoothness(found))
    return [b.text for b, k in zip(found, keep) if k]


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, blocks, text, n_chars) for every row; n_chars counts code points.

    Pages are worked one by one in Arrow batches; a page takes time and memory in proportion to its
    length, however deep it is nested; the maximum flow is solved for the undecided blocks alone.  A null or empty page, and one without content, has no blocks and an empty text.  Broken
    markup is read as far as it goes: a tag cut off at the end is markup, an unclosed script or
    comment reaches to the end.  Repeated rows, null ids and addresses pass through; other columns are
    ignored.  An empty table gives no rows."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [main_blocks(page) if page else [] for page in part.column(2).to_pylist()]
                texts = [" ".join(b) for b in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 ["page_id", "url", "blocks", "text", "n_chars"])

    x = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind, name = (x.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return x.mapInArrow(work, f"page_id {kind}, url {name}, blocks array<string>, text string, n_chars bigint")
