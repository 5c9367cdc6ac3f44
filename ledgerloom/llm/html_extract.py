"""Operator 7: main-text extraction by tree scoring.

A page's markup becomes a small tree of elements. Every paragraph passes points to its ancestors, for
being there, for its length and for its commas; the parent gets them whole, each further ancestor a
smaller part. A container's points are discounted by its link density. The best container is kept with
those of its siblings that score or read like it; blocks of text come out in page order.

Never text: scripts, styles, markup, comments, menus, headers and footers of the page, sidebars, forms,
notices, adverts and reader comments (by element name, role, or words in class and id). A form that wraps more
than half of the page's paragraph text is a container like any other; its controls go.

Points go to five ancestors at most: the shares beyond are too small to choose a container by.

Defined cases: null, empty and broken markup give the empty text where there is none; a page without any
scoring paragraph gives its blocks outside the dropped parts; unclosed elements end with their parent; a quote
inside an unquoted attribute is part of it; of containers with equal points the one that was scored first, in
page order, is best; very long pages and any number of stray end tags take linear time; repeated rows give a row
each; null ids and urls stay null; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.text import bounded_batches

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math noembed xmp".split())
DROPPED = frozenset(
    "script style noscript template iframe svg math head title nav header footer aside form button select option textarea input label fieldset dialog menu object embed canvas audio video map noembed xmp".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br caption".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd h2 h3 h4".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of the first kind ends an open one of the second.
CLOSES = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), frozenset({"p"})),
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}), "body": frozenset({"head"}),
}
#: An implied end does not reach beyond these.
FENCES = {"li": frozenset({"ul", "ol", "menu", "dir"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table", "tr"}), "th": frozenset({"table", "tr"})}
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-hidden|hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|banner|breadcrumbs?|combx|comments?|commentlist|community|consent|cookies?|disqus|extra|footer|foot|gdpr|header|legends|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|outbrain|pager|pagination|popup|promo\w*|related|remark|replies|reply|respond|rss|share|sharing|shoutbox|sidebar|signup|skyscraper|social|sponsor\w*|subscribe|taboola|tags|toolbar|widget)(?:$|[\s_-]|\d)",
    re.I,
)
_LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_COMMAS = re.compile("[,،、，;；]")
#: HTML's white space; other spaces become one too.
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "attributes", "parent", "children", "points", "dropped")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.dropped = False


def parse(markup: str) -> Node:
    """The element tree: end tags that open nothing are passed over, void elements hold nothing."""
    root = here = Node("#root", "", None)
    at, raw = 0, ""
    opened: Counter = Counter()  # open elements by name, so that a stray end tag climbs nowhere

    def leave(to: Node) -> Node:
        """Close open elements up to and with this one."""
        node = here
        while True:
            opened[node.name] -= 1
            if node is to:
                return node.parent
            node = node.parent

    last_section = markup.rfind("]]>")  # a section that nothing closes is a comment that ends at the next >
    while m := _TOKEN.search(markup, at):
        if m.start() > at:
            here.children.append(entities.unescape(markup[at : m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA[") and m.start() + 9 <= last_section:
                at = markup.index("]]>", m.start() + 9) + 3
                here.children.append(markup[m.start() + 9 : at - 3])
            continue
        name = name.lower()
        if m[1]:
            if opened[name]:
                node = here
                while node.name != name:
                    node = node.parent
                here = leave(node)
            continue
        closes = CLOSES.get(name)
        if closes and any(opened[c] for c in closes):
            fence, node, end = FENCES.get(name, frozenset()), here, None
            while node is not root and node.name not in fence and (node.name in closes or node.name in INLINE or name in FENCES):
                if node.name in closes:
                    end = node
                node = node.parent
            if end is not None:
                here = leave(end)
        child = Node(name, m[3], here)
        here.children.append(child)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS and name not in INLINE:
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(markup, at)
            raw = markup[at : close.start()] if close else markup[at:]
            child.children.append(raw)
            at = close.end() if close else len(markup)
            continue
        here = child
        opened[name] += 1
    if at < len(markup):
        here.children.append(entities.unescape(markup[at:]))
    return root


def _traits(attributes: str) -> dict[str, str]:
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return {}
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}


def _wrapping_forms(root: Node) -> set[int]:
    """The forms that hold more than half of the page's paragraph text: pages may lie in a form as a whole."""
    whole, of, stack = 0, Counter(), [(root, ())]
    while stack:
        node, forms = stack.pop()
        if node.name == "form":
            forms = (*forms, id(node))
        if node.name in PARAGRAPHS:
            own = sum(len(_clean(c)) for c in node.children if isinstance(c, str))
            whole += own
            for f in forms:
                of[f] += own
        stack.extend((c, forms) for c in node.children if isinstance(c, Node) and (c.name == "form" or c.name not in DROPPED))
    return {f for f, n in of.items() if 2 * n > whole}


def _is_dropped(node: Node, inside_article: bool, wrapping: set[int]) -> bool:
    if node.name == "form" and id(node) in wrapping:
        return False
    if node.name in DROPPED:
        return not (node.name == "header" and inside_article)
    traits = _traits(node.attributes)
    if not traits:
        return False
    if traits.get("role", "").lower() in _ROLES or "hidden" in traits or traits.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", traits.get("style", ""), re.I):
        return True
    named = f"{traits.get('class', '')} {traits.get('id', '')}"
    if node.name in ("body", "html", "article", "main", "p", *HEADINGS) and node.name != "p":
        return False
    return bool(_UNLIKELY.search(named)) and not _LIKELY.search(named)


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def _mark(root: Node) -> list[Node]:
    """Mark dropped parts and return the other elements in page order."""
    kept, stack, wrapping = [], [(root, False)], _wrapping_forms(root)
    while stack:
        node, inside = stack.pop()
        kept.append(node)
        inside = inside or node.name in ("article", "main")
        below = []
        for c in node.children:
            if isinstance(c, Node):
                c.dropped = _is_dropped(c, inside, wrapping)
                if not c.dropped:
                    below.append((c, inside))
        stack.extend(reversed(below))
    return kept


def _measures(kept: list[Node]) -> tuple[dict[int, int], dict[int, int]]:
    """Characters of text, and of text in links, of every kept element; children come after their parents."""
    length: dict[int, int] = {}
    links: dict[int, int] = {}
    for node in reversed(kept):
        own = sum(len(_clean(c)) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        length[id(node)] = own + sum(length[id(c)] for c in below)
        links[id(node)] = length[id(node)] if node.name == "a" else sum(links[id(c)] for c in below)
    return length, links


def _own_text(node: Node) -> str:
    """Text of an element without that of block elements in it."""
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is node or x.name not in BLOCKS and not x.dropped:
            stack.extend(reversed(x.children))
    return _clean(" ".join(parts))


def _score(kept: list[Node]) -> list[Node]:
    """Points of paragraphs passed to their ancestors; the elements that got any."""
    scored: dict[int, Node] = {}
    for node in kept:
        if node.name not in PARAGRAPHS and not (node.name in ("div", "section", "article", "main", "body", "#root") and any(isinstance(c, str) and len(_clean(c)) >= 25 for c in node.children)):
            continue
        text = _own_text(node)
        if len(text) < 25:
            continue
        points = 1 + len(_COMMAS.findall(text)) + min(len(text) // 100, 3)
        share, up = 1.0, node.parent if node.name in PARAGRAPHS else node
        depth = 0
        while up is not None and depth < 5:
            if up.name not in INLINE and up.name not in PARAGRAPHS - {"td", "blockquote"}:
                up.points += points * share
                scored[id(up)] = up
                depth += 1
                share = 0.5 if depth == 1 else 1 / (3 * (depth - 1))
            up = up.parent
    return list(scored.values())


def _blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks under these elements, in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _clean("".join(line))
        if text:
            out.append(text)
        line.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif not x.dropped:
                if x.name in BLOCKS:
                    end()
                    stack.append(None)
                stack.extend(reversed(x.children))
        end()
    return out


def extract(markup: str) -> str:
    """The main text of one page."""
    if not markup:
        return ""
    root = parse(markup)
    kept = _mark(root)
    length, links = _measures(kept)
    scored = _score(kept)
    density = lambda n: links[id(n)] / max(1, length[id(n)])
    for node in scored:
        named = " ".join(_traits(node.attributes).get(k, "") for k in ("class", "id"))
        node.points += 25 * bool(_LIKELY.search(named)) + {"article": 25, "main": 15, "div": 5, "td": 3, "blockquote": 3, "pre": 3}.get(node.name, 0)
        node.points *= 1 - density(node)
    if not scored:
        return "\n".join(_blocks([root]))
    best = max(scored, key=lambda n: n.points)
    # a lone child holds all that its parent does; an article is never left for one part of it
    up = best.parent
    while up is not None and best.name not in ("article", "main", "body"):
        if up.name == "article" or up.name == "main":
            best = up
            break
        up = up.parent
    least = max(10.0, 0.2 * best.points)
    chosen = []
    for sibling in best.parent.children if best.parent is not None else [best]:
        if isinstance(sibling, str):
            continue
        if sibling is best:
            chosen.append(sibling)
        elif not sibling.dropped:
            alike = sibling.name == best.name or sibling.points >= least
            prose = sibling.name == "p" and (length[id(sibling)] > 80 and density(sibling) < 0.25 or 0 < length[id(sibling)] <= 80 and density(sibling) == 0 and "." in _own_text(sibling))
            title = sibling.name == "h1" and best.name in ("article", "main", "div", "section")
            if alike and sibling.points >= least or prose or title:
                chosen.append(sibling)
    return "\n".join(_blocks(chosen))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text and n_chars (code points)."""
    bounded_batches(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
