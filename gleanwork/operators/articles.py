"""The main text of HTML pages: elements that are no article removed, then the part of the page with most text outside links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.values import DROPPED_CLASSES, DROPPED_IDS, DROPPED_LABEL, DROPPED_ROLES, DROPPED_TAGS

# Elements without an end, elements that start a line, and those that a next one of their kind ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article blockquote body dd div dl dt figcaption figure form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section table td th tr ul br".split())
NO_NEST = frozenset("p li td th tr dt dd option".split())

#: A part of the page stays beside the best one if it holds this share of its text.
BESIDE = 0.2


def dropped(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element is no article, by its tag, class, id, role or label."""
    classes, name = attributes.get("class", ""), attributes.get("id", "")
    return (
        tag in DROPPED_TAGS or any(x in classes for x in DROPPED_CLASSES) or any(x in name for x in DROPPED_IDS) or attributes.get("role", "") in DROPPED_ROLES or DROPPED_LABEL in attributes.get("aria-label", "").lower()
    )


class _Node:
    __slots__ = ("tag", "children", "chars", "linked")

    def __init__(self, tag: str):
        self.tag, self.children, self.chars, self.linked = tag, [], 0, 0


class _Page(HTMLParser):
    """The tree of a page without dropped elements; a text that is never closed ends with the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]
        self.gone: list[str] = []  # open elements from the dropped one on
        self.title, self.in_title = "", False

    def handle_starttag(self, tag, attrs):
        if self.gone:
            if tag not in VOID:
                self.gone.append(tag)
            return
        if dropped(tag, {k: v or "" for k, v in attrs}):
            if tag not in VOID:
                self.gone.append(tag)
            return
        if tag == "title":
            self.in_title = True
            return
        if tag in NO_NEST and self.open[-1].tag == tag:
            self.open.pop()
        node = _Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if self.gone:
            if tag in self.gone:
                while self.gone.pop() != tag:
                    pass
        elif tag == "title":
            self.in_title = False
        elif any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.gone:
            self.open[-1].children.append(data)


def _measure(node: _Node, linked: bool) -> None:
    """Sums the characters of text and of linked text of each element, without recursion."""
    order = [(node, linked)]
    for n, inside in order:
        order += [(c, inside or n.tag == "a") for c in n.children if isinstance(c, _Node)]
    for n, inside in reversed(order):
        own = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        n.chars = own + sum(c.chars for c in n.children if isinstance(c, _Node))
        n.linked = (own if inside or n.tag == "a" else 0) + sum(c.linked for c in n.children if isinstance(c, _Node))


def _text(node: _Node) -> str:
    """The text of an element, in lines by block."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n.tag in BLOCKS:
            out.append("\n")
            stack.append("\n")
        stack += reversed(n.children)
    return "".join(out)


def main_text(html: str) -> tuple[str, str]:
    """(text, title) of a page: from the root down into the part with nearly all text outside links, its text by lines."""
    page = _Page()
    page.feed(html)
    page.close()
    _measure(page.root, False)
    node = page.root
    own = lambda n: n.chars - n.linked
    while True:
        parts = [c for c in node.children if isinstance(c, _Node)]
        loose = any(isinstance(c, str) and c.strip() for c in node.children)
        best = max(parts, key=own, default=None)
        if loose or best is None or best.tag in ("p", "pre", "li", "tr", "td") or own(best) <= (1 - BESIDE) * own(node):
            break
        node = best
    kept = _Node(node.tag)
    # a part that is all links is no text; inline ones stay
    kept.children = [c for c in node.children if isinstance(c, str) or c.tag not in BLOCKS or c.chars == 0 or own(c) > 0]
    lines = [" ".join(x.split()) for x in _text(kept).split("\n")]
    heading = next((_text(n).strip() for n in _walk(page.root) if n.tag == "h1" and n.chars), "")
    return "\n".join(x for x in lines if x), " ".join(page.title.split()) or heading


def _walk(node: _Node) -> Iterator[_Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in reversed(n.children) if isinstance(c, _Node)]


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("title", T.StringType())]))
def article(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Struct (text, title) of each page of HTML; null stays empty."""
    for batch in pages:
        yield pd.DataFrame([main_text(x) if isinstance(x, str) else ("", "") for x in batch], columns=["text", "title"])
