"""Main text of web pages: paragraphs pass points to their ancestors, the best container and its like stay."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: elements as HTML names them
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search "
                   "section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never part of an article.
_OUT = frozenset("head script style noscript template svg math iframe object embed canvas audio video nav header footer "
                 "aside button select option textarea input label dialog menu search map".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                       "toolbar tooltip status".split())
#: Words of class and id names that mark what is not the article.
_OUT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|"
    r"newsletter|subscri\w+|signup|login|shar(?:e|ing)\w*|social\w*|sidebar\w*|widgets?|menus?|nav|navbar|navigation|"
    r"breadcrumbs?|pagination|pager|footer\w*|header|masthead|comments?|commentlist|disqus\w*|replies|respond|related\w*|"
    r"recommend\w*|toolbar|hidden|alerts?|forms?)(?=$|[\s_-])", re.I)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_UNTIL = re.compile(r"[\"'>]")
#: Attributes one after the other, so that names inside values are none.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: A sibling of the best container stays with this share of its points.
SIBLING = 0.2
#: A list, table or division with more of its text in links than this, and three links or more, is a menu.
MENU = 0.5


class _Node:
    __slots__ = ("tag", "parent", "soft", "hard", "points", "size", "linked", "links", "blocks")

    def __init__(self, tag, parent, soft, hard):
        self.tag, self.parent, self.soft, self.hard = tag, parent, soft, hard
        self.points = 0.0
        self.size = self.linked = self.links = self.blocks = 0


def _marks(attributes: str) -> tuple[bool, bool]:
    """(marked as no article by a class or id name, out for certain)."""
    soft = hard = False
    seen = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in seen:        # the first one counts
            continue
        seen.add(name)
        if name in ("class", "id"):
            soft = soft or bool(_OUT_WORDS.search(re.sub(r"([a-z])([A-Z])", r"\1-\2", value)))
        elif name == "role":
            hard = hard or value.lower() in _OUT_ROLES
        elif name == "hidden":
            hard = True
        elif name == "aria-hidden":
            hard = hard or value.lower() == "true"
        elif name == "style":
            hard = hard or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return soft, hard


def _tokens(page: str):
    """(text before, closing slash, element name, attributes, end) of each tag, comments being tags without a name.

    Every search goes on where the last one ended; what no later character can close (an open comment, section or
    quote) is looked for once, so broken pages are read in one go, too.
    """
    at, n, begin, quoted, sections = 0, len(page), 0, True, True
    while True:
        start = page.find("<", at)
        if start < 0 or start + 1 >= n:
            yield page[begin:], "", "", "", n
            return
        name = _NAME.match(page, start + 1)
        if name:
            stop = name.end()
            while quoted:
                mark = _UNTIL.search(page, stop)
                if mark is None:
                    quoted = False      # no tag from here on ends outside a quote
                    break
                stop = mark.end()
                if mark[0] == ">":
                    break
                stop = page.find(mark[0], stop) + 1
                if not stop:
                    quoted = False
                    break
            if not quoted:
                stop = page.find(">", name.end()) + 1
            if not stop:                # nothing closes it: text
                at = start + 1
                if page.find(">", at) < 0:
                    yield page[begin:], "", "", "", n
                    return
                continue
            begin, at = yield page[begin:start], name[1], name[2], page[name.end(): stop - 1], stop
            continue
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            stop = n if stop < 0 else stop + 3
        elif page[start + 1] in "!?":
            stop = 0
            if sections and page.startswith("<![CDATA[", start):
                stop = page.find("]]>", start) + 3
                if stop == 2:
                    sections, stop = False, 0
            stop = stop or page.find(">", start) + 1
            if not stop:
                yield page[begin:], "", "", "", n
                return
        else:
            at = start + 1
            continue
        begin, at = yield page[begin:start], "", "", "", stop


def _parse(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements in page order, and the text blocks: (innermost block element, text, characters in links)."""
    root = _Node("body", None, False, False)
    nodes, stack, blocks = [root], [root], []
    held: list[str] = []
    linked = anchors = 0

    def container():
        for node in reversed(stack):
            if node.tag in _BLOCK:
                return node
        return root

    def flush():
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append((container(), text, min(linked, len(text))))
            held.clear()
            linked = 0

    def words(text):
        nonlocal linked
        if text and not stack[-1].hard:
            text = entities.unescape(text) if "&" in text else text
            held.append(text)
            if anchors:
                linked += len(" ".join(text.split()))

    def close(upto):
        nonlocal anchors
        if any(n.tag in _BLOCK for n in stack[upto:]):
            flush()
        anchors -= sum(n.tag == "a" for n in stack[upto:])
        del stack[upto:]

    def find(names, until):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                return i
            if stack[i].tag in until:
                return 0
        return 0

    n, tokens, at = len(page), _tokens(page), None
    while True:
        try:
            before, end, name, attributes, at = tokens.send(None if at is None else (at, at))
        except StopIteration:
            break
        words(before)
        if not name:
            continue
        tag = name.lower()
        if end:
            until = () if tag in _BLOCK else _BLOCK
            if i := find((tag,), until):
                close(i)
            elif tag in ("br", "p"):
                held.append(" ")
            continue
        if tag in ("br", "wbr"):
            held.append(" " if tag == "br" else "")
            continue
        if tag in ("html", "body"):
            continue
        if tag in _BLOCK:
            if i := find(("p",), _BLOCK - {"p"}):
                close(i)
            if tag == "li" and (i := find(("li",), ("ul", "ol", "menu"))):
                close(i)
            elif tag in ("dt", "dd") and (i := find(("dt", "dd"), ("dl",))):
                close(i)
            elif tag in ("td", "th") and (i := find(("td", "th"), ("tr", "table"))):
                close(i)
            elif tag == "tr" and (i := find(("tr",), ("table",))):
                close(i)
            flush()
        elif tag == "a" and (i := find(("a",), _BLOCK)):
            close(i)
        soft, hard = _marks(attributes) if attributes and not attributes.isspace() else (False, False)
        parent = stack[-1]
        node = _Node(tag, parent, (soft or tag == "form") and tag not in ("article", "main"),
                     hard or parent.hard or tag in _OUT)
        nodes.append(node)
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        stack.append(node)
        if tag == "a":
            anchors += 1
            for up in stack:
                up.links += 1
        if tag in _RAW:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            at = stop.start() if stop else n
    flush()
    return nodes, blocks


def main_text(page: str | None) -> str:
    """The article's blocks in page order, one line each; empty if there is none."""
    if not page:
        return ""
    nodes, blocks = _parse(page)

    def up(node):
        while node is not None:
            yield node
            node = node.parent

    for node, text, linked in blocks:
        for a in up(node):
            a.size += len(text)
            a.linked += linked
            a.blocks += 1
    whole = max(1, nodes[0].size)
    articles = [n for n in nodes if n.tag in ("article", "main") and n.size and not n.hard]
    wrappers = {a for n in articles for a in up(n)} if articles else {n for n in nodes if n.blocks >= 3}
    dropped = set()
    for node in nodes:      # parents come first
        if node.parent is None:
            continue
        # a marked element, or a form, that holds most of the page and the article is only a wrapper
        menu = node.tag in ("ul", "ol", "div", "table", "section", "p", "dl") and node.links >= 3 and node.linked > MENU * node.size
        if node.parent in dropped or node.hard or menu or node.soft and not (
                2 * node.size > whole and node in wrappers):
            dropped.add(node)
    kept = [(node, text, linked) for node, text, linked in blocks if node not in dropped]
    if not kept:
        return ""
    for node, text, _ in kept:
        if node.tag in _HEADINGS:
            continue
        worth = 1 + text.count(",") + text.count("،") + min(len(text) / 100, 3)
        for level, a in enumerate(up(node if node.tag not in ("p", "pre", "td", "li", "blockquote") else node.parent)):
            a.points += worth if level == 0 else worth / 2 if level == 1 else worth / (3 * level)

    def score(node):
        bonus = 1.5 if node.tag in ("article", "main") else 1.0
        return node.points * bonus * (1 - node.linked / max(1, node.size))

    held = {a for node, _, _ in kept for a in up(node)}
    best = max((n for n in nodes if n in held and n.tag in _BLOCK), key=score, default=nodes[0])
    # an article around the best container is the article; without one, a main element is
    for name in ("article", "main"):
        if outer := [a for a in up(best) if a.tag == name]:
            best = outer[-1]
            break
    least, chosen = max(1.0, SIBLING * score(best)), {best}
    for node in nodes:
        if node.parent is best.parent and best.parent is not None and node not in dropped and node is not best:
            thin = node.linked < 0.25 * node.size
            if node.tag in _HEADINGS and thin or score(node) >= least or (
                    node.tag == "p" and thin and (node.size > 80 or node.size and best.tag in ("p", "pre"))):
                chosen.add(node)
    loose = best.parent if best.parent is not None and best.tag in ("p", "pre") else None
    return "\n".join(text for node, text, _ in kept if node is loose or any(a in chosen for a in up(node)))


RESULT = "page_id long, url string, text string, n_chars long"


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole HTML.

    Null or empty html, and pages without an article, give an empty text. Null ids and urls are passed
    on; repeated rows are each read; an empty table gives no rows.
    """
    def read(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                        pages["html"].cast("string").alias("html")).mapInArrow(read, RESULT)
