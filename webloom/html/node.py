"""The tree that selectors and value reads run over."""

from __future__ import annotations

DOCUMENT, ELEMENT, TEXT, COMMENT = range(4)
HTML, SVG, MATHML = "html", "svg", "math"
#: Elements without an end tag, and those whose text isn't escaped when written.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("style script xmp iframe noembed noframes plaintext".split())


class Node:
    __slots__ = ("kind", "tag", "attrs", "parent", "children", "text", "ns", "index", "count", "type_index", "type_count")

    def __init__(self, kind: int, tag: str = "", attrs: dict[str, str] | None = None, text: str = "", ns: str = HTML):
        self.kind, self.tag, self.attrs, self.text, self.ns = kind, tag, attrs if attrs is not None else {}, text, ns
        self.parent: Node | None = None
        self.children: list[Node] = []
        #: Places among the parent's elements and among those of the same tag, from 1; set by ``number``.
        self.index = self.count = self.type_index = self.type_count = 0

    def append(self, node: Node) -> None:
        node.parent = self
        self.children.append(node)

    def insert_before(self, node: Node, before: Node) -> None:
        node.parent = self
        self.children.insert(next(i for i, c in enumerate(self.children) if c is before), node)

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def text_content(self) -> str:
        """The text below, in order: nothing is trimmed, comments don't count."""
        if self.kind == TEXT:
            return self.text
        out, stack = [], self.children[::-1]
        while stack:
            n = stack.pop()
            if n.kind == TEXT:
                out.append(n.text)
            elif n.kind == ELEMENT:
                stack += n.children[::-1]
        return "".join(out)

    def inner_html(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(self.children[::-1])
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.kind == TEXT:
                raw = n.parent is not None and n.parent.ns == HTML and n.parent.tag in RAW
                out.append(n.text if raw else escape(n.text))
            elif n.kind == COMMENT:
                out.append(f"<!--{n.text}-->")
            else:
                attrs = "".join(f' {k}="{escape(v, True)}"' for k, v in sorted(n.attrs.items()))
                out.append(f"<{n.tag}{attrs}>")
                if not (n.ns == HTML and n.tag in VOID):
                    stack.append(f"</{n.tag}>")
                    stack += n.children[::-1]
        return "".join(out)

    def is_empty(self) -> bool:
        """No element below and no text; comments don't count."""
        return not any(c.kind == ELEMENT or c.kind == TEXT and c.text for c in self.children)


def escape(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("\xa0", "&nbsp;")
    return text.replace('"', "&quot;") if attribute else text.replace("<", "&lt;").replace(">", "&gt;")


def number(root: Node) -> None:
    """Set the places of all elements, once the tree is built."""
    stack = [root]
    while stack:
        n = stack.pop()
        elements = [c for c in n.children if c.kind == ELEMENT]
        if not elements:
            continue
        per: dict[str, int] = {}
        for i, e in enumerate(elements, 1):
            e.index, e.count = i, len(elements)
            e.type_index = per[e.tag] = per.get(e.tag, 0) + 1
        for e in elements:
            e.type_count = per[e.tag]
        stack += elements
