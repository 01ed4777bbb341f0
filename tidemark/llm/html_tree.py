"""A small tolerant HTML reader: elements with their text blocks and subtree hashes.

It reads tags, comments, raw-text elements and character references; closes paragraphs, list items,
cells and options where the next one starts; and never fails: what is open at the end ends there.
One pass over the page, no recursion, so depth and length are bounded by memory for one page only.
"""

from __future__ import annotations

import html
import re

import xxhash

# fixed values: element names of HTML
RAW_TEXT = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img del input".split())
#: an element of this kind ends, when it starts, an open one of these kinds
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",),
}
#: such a search does not leave the nearest of these
BARRIER = frozenset("ul ol dl table select article section div main body html aside nav header footer form blockquote".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTE_OR_END = re.compile(r"[\"'>]")


class Node:
    __slots__ = ("tag", "parent", "words", "parts", "digest", "n_text", "n_link", "place")

    def __init__(self, tag: str, parent: Node | None, words: frozenset[str]):
        self.tag, self.parent, self.words = tag, parent, words
        self.parts: list[Node | str] = []
        self.digest = 0
        self.n_text = 0  # characters of text, and those of them in links
        self.n_link = 0
        #: names the path of tags and class words from the root
        self.place = xxhash.xxh3_64_intdigest(f"{parent.place if parent else 0} {tag} {' '.join(sorted(words))}")


def _tag_end(page: str, at: int) -> int:
    """The place after the ``>`` that ends the tag (quotes may hold one); the page's end if none."""
    i = at
    while m := _QUOTE_OR_END.search(page, i):
        if m[0] == ">":
            return m.end()
        close = page.find(m[0], m.end())
        if close < 0:  # a quote that nothing closes
            end = page.find(">", m.end())
            return end + 1 if end >= 0 else len(page)
        i = close + 1
    return len(page)


def _words(attributes: str) -> frozenset[str]:
    out: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        out.update(re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower()))
    out.discard("")
    return frozenset(out)


def parse(page: str) -> Node:
    """The page's tree; nodes are finished (``digest``, ``n_text``) when closed."""
    root = Node("#root", None, frozenset())
    stack = [root]

    def text(s: str) -> None:
        if s:
            stack[-1].parts.append(html.unescape(s) if "&" in s else s)

    def close(node: Node) -> None:
        while stack[-1] is not node:
            _finish(stack.pop())
        _finish(stack.pop())

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                # "<!-->" and "<!--->" are whole comments
                end = page.find("-->", lt + 2)
                at = end + 3 if end >= 0 else n
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
        elif nxt == "/":
            m = _NAME.match(page, lt + 2)
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
            if m:
                _end_tag(m[0].lower(), stack, close)
        elif m := _NAME.match(page, lt + 1):
            end = _tag_end(page, m.end())
            tag = m[0].lower()
            inside = page[m.end() : end - 1]
            _start_tag(tag, stack, close)
            node = Node(tag, stack[-1], _words(inside) if inside else frozenset())
            stack[-1].parts.append(node)
            at = end
            if tag in RAW_TEXT:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, end)
                at = n if stop is None else _tag_end(page, stop.end())
                _finish(node)
            elif tag in VOID:
                _finish(node)
            else:
                stack.append(node)
        else:  # a "<" that starts no tag
            text("<")
            at = lt + 1
    while stack:
        _finish(stack.pop())
    return root


def _start_tag(tag: str, stack: list[Node], close) -> None:
    if tag not in INLINE and tag not in VOID or tag == "hr":
        for node in reversed(stack):  # a block ends an open paragraph
            if node.tag == "p":
                close(node)
                break
            if node.tag not in INLINE:
                break
    ends = CLOSES.get(tag)
    if ends:
        found = None
        for node in reversed(stack):
            if node.tag in ends:
                found = node
            elif node.tag in BARRIER or node.tag == "#root":
                break
        if found is not None:
            close(found)


def _end_tag(tag: str, stack: list[Node], close) -> None:
    for node in reversed(stack):
        if node.tag == tag:
            close(node)
            return
        if tag in INLINE and node.tag not in INLINE or node.tag == "#root":
            return
        if tag == "p" and node.tag in BARRIER:
            return


def _finish(node: Node) -> None:
    h = xxhash.xxh3_64(node.tag + " " + " ".join(sorted(node.words)))
    total = links = 0
    for p in node.parts:
        if isinstance(p, str):
            s = " ".join(p.split())
            if s:
                h.update(b"t")
                h.update(s.encode("utf-8", "surrogatepass"))
                total += len(s)
        else:
            h.update(b"e")
            h.update(p.digest.to_bytes(8, "little"))
            total += p.n_text
            links += p.n_link
    node.digest, node.n_text, node.n_link = h.intdigest(), total, total if node.tag == "a" else links


def blocks(root: Node, gone) -> list[str]:
    """Text blocks in page order, without the subtrees for which ``gone(node)`` holds: white space
    inside a block is one space; blocks without text are left out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        s = " ".join("".join(held).split())
        held.clear()
        if s:
            out.append(s)

    todo: list[Node | str | None] = [root]  # None ends a block
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        elif x.tag in RAW_TEXT or gone(x):
            # text on both sides of something removed stays apart, unless it was inline
            flush() if x.tag not in INLINE else None
        elif x.tag in INLINE:
            todo.extend(reversed(x.parts))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return out


def walk(root: Node):
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(p for p in reversed(x.parts) if not isinstance(p, str))
