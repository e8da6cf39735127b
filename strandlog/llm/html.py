"""HTML extraction by tag-path ratios.

Each text of a page belongs to the path of tags, with their classes, from the root to it. Per path, the length of text
outside links and the punctuation are summed up and divided by the number of its texts; both ratios are smoothed among
neighbours in one container with a Gaussian window, fused by their geometric mean and held against a part of their
spread over the page. Paths whose texts differ in length count for more. Texts above it select content nodes; the smallest element around these holds the article, whose
headings, captions and short paragraphs among the content come along. Tags, roles and classes that mark boilerplate, and
the article's own tag, only weight a text's fused ratio.

Nulls and edges: null or empty html has the empty text; a page without content too; rows that repeat are each
extracted; broken markup (tags or quotes left open, a page or an entity cut off) is read as far as it goes; an empty
table gives no rows. A page is one row's work, in time linear in its length: its text is never cut.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's own classes of elements, and words that mark boilerplate in class names and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text for readers.
RAW = frozenset("script style textarea title noscript template iframe svg select object audio video canvas annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded semantics".split()
)
CONTAINERS = frozenset("article main section div td body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | {"p"}
ITEMS = frozenset("li tr td dt dd option".split())
AWAY = frozenset("head nav header footer aside form button dialog menu".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer "
    "masthead cookie cookies consent gdpr notice notices banner popup modal overlay subscribe newsletter signup login share sharing social related recommended "
    "comment comments commentlist disqus respond replies widget pagination pager toolbar skip header topbar form search copyright disclaimer".split()
)
#: Parts of class names that tell how a page is laid out or what an article is made of: such a name marks no boilerplate.
LAYOUT_WORDS = frozenset("has have with without no non not is layout grid col row content article entry post story main page body text wrapper wrap container free".split())
#: Elements that an article may fill with links alone.
LINKED = HEADINGS | frozenset("p ul ol li dl dt dd table tr td th blockquote figure figcaption".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>])*+(?:>|\Z)|[^>]*+(?:>|\Z))|([^<]++|<)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
#: Part of the fused ratio's spread over the page that a content node must reach; the width of the smoothing; the least fused ratio of content.
SPREAD, SIGMA, FLOOR = 0.7, 1.0, 1.0
#: Weights of texts in marked elements and in an article's or main element.
MARKED, ARTICLE = 0.01, 4.0


class Element:
    """Pointers are set as the element opens, so that no later step walks from each text to the root."""

    __slots__ = ("article", "branch", "container", "depth", "in_link", "item", "marks", "name", "paragraph", "parent", "path", "scope", "serial")

    def __init__(self, name: str, parent: Element | None, serial: int, path: int, marked: bool):
        self.name, self.parent, self.serial, self.path, self.branch = name, parent, serial, path, None
        self.depth = parent.depth + 1 if parent else 0
        self.marks = (parent.marks if parent else 0) + marked
        self.article = name in ("article", "main") or bool(parent and parent.article)
        self.in_link = name == "a" or bool(parent and parent.in_link)
        boundary = parent is None or name in CONTAINERS or name in AWAY
        self.container = self if boundary else parent.container
        self.scope = self if parent is None or name not in INLINE else parent.scope
        inside = not boundary and name not in ("ul", "ol", "table", "dl")
        self.paragraph = self if name in PARAGRAPHS else parent.paragraph if inside else None
        self.item = self if name in ITEMS else parent.item if inside else None


def _attributes(text: str) -> dict[str, str]:
    """Values by name, in lower case; of a name that repeats the first counts."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), value.strip("\"'").lower())
    return found


def _is_word(name: str) -> bool:
    """Whether a class name or id is a word for boilerplate, or made of such a word and none of layout."""
    parts = set(re.split(r"[^a-z]+", name))
    return name in AWAY_WORDS or bool(parts & AWAY_WORDS) and not parts & LAYOUT_WORDS


def _marked(name: str, a: dict[str, str], in_article: bool) -> bool:
    if name in AWAY and not (name == "header" and in_article) or AWAY_ROLES.intersection(a.get("role", "").split()):
        return True
    return name not in HEADINGS and name not in ("article", "main", "body", "html") and any(_is_word(x) for key in ("class", "id") for x in a.get(key, "").split())


def texts(page: str) -> Iterator[tuple[Element, int, str]]:
    """(element, number of the block, text) of each text that is not hidden, in page order; the text as in the source."""
    paths: dict[tuple[int, str], int] = {}
    root = here = Element("", None, 0, 0, False)
    opened: Counter = Counter()  # open elements by name, inline ones by the block that holds them as well
    block, at, serial, hidden = 0, 0, 0, None
    ends: dict[str, int] = {}  # of raw elements without an end tag: from here on there is none

    def pop(upto: Element) -> None:
        """Closes all elements below ``upto``."""
        nonlocal here, hidden
        while here is not upto:
            opened[here.name] -= 1
            opened[here.parent.scope.serial, here.name] -= 1
            hidden = None if here is hidden else hidden
            here = here.parent

    while m := TOKEN.match(page, at):
        at = m.end()
        close, tag, attributes, text = m.groups()
        if text is not None:
            if hidden is None:
                yield here, block, text
            continue
        if tag is None:
            continue
        name = tag.lower()
        if name == "br" and hidden is None:  # white space of its block
            yield here, block, " "
        block += name not in INLINE
        if close:
            if opened[name] > 0 and (name not in INLINE or opened[here.scope.serial, name] > 0):
                up = here
                while up.name != name:
                    up = up.parent
                pop(up.parent)
            continue
        if name not in INLINE:  # a block ends an open paragraph and what is open inside it; an item ends an item
            if name in ITEMS and here.item and here.item.name == name:
                pop(here.item.parent)
            elif here.paragraph:
                pop(here.paragraph.parent)
        attributes = attributes.removesuffix(">")
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            if ends.get(name, len(page)) > at:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at, ends[name] = (end.end(), len(page)) if end else (len(page), at)
            else:
                at = len(page)
            continue
        a = _attributes(attributes) if attributes.strip() else {}
        serial += 1
        label = f"{name}.{a['class']}" if "class" in a else name
        path = paths.setdefault((here.path, label), len(paths) + 1)
        opened[here.scope.serial, name] += 1
        opened[name] += 1
        here = Element(name, here, serial, path, _marked(name, a, here.article))
        if hidden is None and name not in ("body", "html") and (name == "head" or a.get("hidden", "until-found") != "until-found" or a.get("aria-hidden") == "true"):
            hidden = here


def ratios(paths: list[int], containers: list[int], lengths: list[int], marks: list[int]) -> list[float]:
    """The fused ratio of each text of a page: by path, smoothed among neighbours. Lengths and marks count what is outside links."""
    n, size, punctuation, squares = Counter(paths), Counter(), Counter(), Counter()
    for p, k, m in zip(paths, lengths, marks, strict=True):
        size[p] += k
        punctuation[p] += m
        squares[p] += k * k
    spread = {p: math.sqrt(max(0.0, squares[p] / n[p] - (size[p] / n[p]) ** 2)) for p in n}  # boilerplate's texts are of a length
    reach = math.ceil(3 * SIGMA)
    weights = [math.exp(-d * d / (2 * SIGMA * SIGMA)) for d in range(reach + 1)]

    def smooth(v: list[float]) -> list[float]:
        out = []
        for i in range(len(v)):
            near = [j for j in range(max(0, i - reach), min(len(v), i + reach + 1)) if containers[j] == containers[i]]
            out.append(sum(v[j] * weights[abs(i - j)] for j in near) / sum(weights[abs(i - j)] for j in near))
        return out

    plain, extended = smooth([size[p] / n[p] for p in paths]), smooth([size[p] * (1 + punctuation[p]) * (1 + spread[p]) / n[p] ** 2 for p in paths])
    return [math.sqrt(a * b) if k else 0.0 for a, b, k in zip(plain, extended, lengths, strict=True)]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    nodes = [(e, block, entities.unescape(t)) for e, block, t in texts(page or "")]
    solid = [i for i, (*_, t) in enumerate(nodes) if t.strip()]
    if not solid:
        return ""
    some = [nodes[i] for i in solid]
    lengths = [0 if e.in_link else len(t.strip()) for e, _, t in some]
    fused = ratios([e.path for e, *_ in some], [e.container.serial for e, *_ in some], lengths, [0 if e.in_link else len(PUNCTUATION.findall(t)) for e, _, t in some])
    fused = [x * (MARKED if e.marks else 1) * (ARTICLE if e.article else 1) for x, (e, *_) in zip(fused, some, strict=True)]
    mean = sum(fused) / len(fused)
    least = max(FLOOR, min(SPREAD * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)), max(fused)))
    content = [e for (e, *_), x in zip(some, fused, strict=True) if x >= least]
    if not content:
        return ""
    # the smallest element around: that of the content nodes that open first and last
    top, other = min(content, key=lambda e: e.serial), max(content, key=lambda e: e.serial)
    while top is not other:
        if top.depth >= other.depth:
            top = top.parent
        else:
            other = other.parent
    while top.parent and top.name not in CONTAINERS:
        top = top.parent

    chain: list[Element] = []

    def branch(e: Element) -> Element | None:
        """The child of ``top`` that holds e, or ``top`` itself; None outside. Each element is asked once."""
        while e.branch is None and e is not top and e.parent:
            chain.append(e)
            e = e.parent
        found = e.branch if e.branch is not None else top if e is top else None
        while chain:
            x = chain.pop()
            x.branch = found = (x if found is top else found) if found is not None else False
        return found or None

    # branches that hold links for the most part and no content go, but not headings and lists among the content
    chosen, links, whole, order = {branch(e) for e in content}, Counter(), Counter(), {}
    for e, _, t in some:
        b = branch(e)
        order.setdefault(b, len(order))
        whole[b] += len(t.strip())
        links[b] += len(t.strip()) * e.in_link
    first, last = min(order[b] for b in chosen), max(order[b] for b in chosen)
    selected = set(content)

    def kept(e: Element) -> bool:
        b = branch(e)
        if b is None:
            return False
        if e in selected:
            return True
        if e.marks > top.marks:
            return False
        if b in chosen or b is top:
            return True
        linked = 2 * links[b] > whole[b]
        inside = first < order.get(b, -1) < last
        if b.name in HEADINGS or b.name == "header":
            return top.article or order.get(b, last) < last
        return (inside or top.article) and (not linked or b.name in LINKED)

    blocks: dict[int, list[str]] = {}
    for e, block, t in nodes:
        if kept(e):
            blocks.setdefault(block, []).append(t)
    return "\n\n".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def _extract(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        found = [main_text(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])


def op8(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row; no shuffle."""
    kinds = dict(pages.dtypes)
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_extract, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
