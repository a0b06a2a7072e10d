"""Pages to text: structural noise goes, one container is chosen, headings become section marks.

Inline code is unwrapped, code blocks go. Containers: an explicit selector (tag, .class, #id, [attribute=value], and
tag with either), else article, main, [role=main], div.content, div.body, else the div with most text, else the page.
Pages are parsed with the standard library in Arrow batches; regular expressions cannot follow nested containers.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..config import DEFAULT, Config

VOID = set("area base br col embed hr img input link meta source track wbr".split())
HEADINGS, TAKEN = ("h1", "h2", "h3", "h4"), ("h1", "h2", "h3", "h4", "p", "li")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def text(self) -> str:
        """Texts within, each trimmed, joined by spaces."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                if s := n.strip():
                    out.append(s)
            else:
                todo.extend(reversed(n.kids))
        return " ".join(out)

    def walk(self):  # noqa: ANN201
        todo = [self]
        while todo:
            n = todo.pop()
            if not isinstance(n, str):
                yield n
                todo.extend(reversed(n.kids))


class Tree(HTMLParser):
    def __init__(self, drop_code: bool):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", {})
        self.stack = [self.root]
        self.drop = set(fixed.NOISE_TAGS) | ({"pre"} if drop_code else set())
        self.unwrap = set(fixed.INLINE_CODE) if drop_code else set()
        self.silent: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.drop:
            self.silent.append(tag)
        if self.silent or tag in self.unwrap:
            return
        node = Node(tag, dict(attrs))
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            kids = self.stack[-1].kids
            if kids and isinstance(kids[-1], str):
                kids[-1] += data
            else:
                kids.append(data)


SELECTOR = re.compile(r"^([a-zA-Z][\w-]*)?(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)=[\"']?([^\]\"']+)[\"']?\])?$")


def select(root: Node, selector: str) -> Node | None:
    m = SELECTOR.match(selector.strip())
    if not m:
        return None
    tag, cls, ident, attr, value = m.groups()
    for n in root.walk():
        if n is root or tag and n.tag != tag:
            continue
        a = n.attrs
        if cls and cls not in (a.get("class") or "").split() or ident and a.get("id") != ident or attr and a.get(attr) != value:
            continue
        return n
    return None


def text_lengths(root: Node) -> dict[int, int]:
    """Length of text() by node identity, summed from the leaves up."""
    order, parts = list(root.walk()), {}
    for n in reversed(order):
        # characters of the trimmed texts, and how many there are
        chars = count = 0
        for k in n.kids:
            if isinstance(k, str):
                s = k.strip()
                chars, count = chars + len(s), count + bool(s)
            else:
                chars, count = chars + parts[id(k)][0], count + parts[id(k)][1]
        parts[id(n)] = chars, count
    return {k: chars + max(count - 1, 0) for k, (chars, count) in parts.items()}


def page_text(source: str, selector: str = "", drop_code: bool = True) -> str:
    tree = Tree(drop_code)
    tree.feed(source or "")
    tree.close()
    found = None
    for s in ([selector] if selector else []) + ["article", "main", "[role=main]", "div.content", "div.body"]:
        found = found or select(tree.root, s)
    if found is None:
        size = text_lengths(tree.root)
        found = max((n for n in tree.root.walk() if n.tag == "div"), key=lambda n: size[id(n)], default=tree.root)
    parts = []
    for n in found.walk():
        if n.tag in TAKEN and n is not found and (t := n.text()):
            parts.append(f"\n== {t} ==\n" if n.tag in HEADINGS else t)
    return "\n".join(parts).strip()


def extract(page: Column, selector: Column | None = None, cfg: Config = DEFAULT) -> Column:
    drop = cfg.corpus.drop_code_blocks

    def run(pages: pa.Array, selectors: pa.Array) -> pa.Array:
        return pa.array([page_text(p or "", s or "", drop) for p, s in zip(pages.to_pylist(), selectors.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(page, F.lit("") if selector is None else F.coalesce(selector, F.lit("")))
