"""The portable CSS selectors: parsed once, matched right to left over a tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from webloom.html.node import ELEMENT, Node

_IDENT = re.compile(r"-?[A-Za-z_][A-Za-z0-9_-]*|--[A-Za-z0-9_-]*")
_NAME = re.compile(r"[A-Za-z0-9_-]+")
_NTH = re.compile(r"(?:([+-]?[0-9]*)n([+-][0-9]+)?|([+-]?[0-9]+))\Z")
SIMPLE = ("first-child", "last-child", "only-child", "empty", "first-of-type", "last-of-type", "only-of-type")
COUNTED = ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")
_WHITE = " \t\n\r\f"


class SelectorError(ValueError):
    """``unsupported``: valid CSS outside the portable profile."""

    def __init__(self, message: str, unsupported: bool = False):
        self.unsupported = unsupported
        super().__init__(message)


@dataclass
class Compound:
    tag: str | None = None
    id: str | None = None
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str, str]] = field(default_factory=list)
    pseudos: list[tuple[str, object]] = field(default_factory=list)

    def matches(self, n: Node) -> bool:
        if self.tag is not None and n.tag.lower() != self.tag:
            return False
        if self.id is not None and n.attrs.get("id") != self.id:
            return False
        if self.classes:
            has = n.attrs.get("class")
            if has is None:
                return False
            words = has.split()
            if not all(c in words for c in self.classes):
                return False
        return all(_attr(n, *a) for a in self.attrs) and all(_pseudo(n, *p) for p in self.pseudos)


def _attr(n: Node, name: str, op: str, value: str) -> bool:
    v = n.attrs.get(name)
    if v is None:
        return False
    if op == "":
        return True
    if op == "=":
        return v == value
    if op == "~=":
        return value in v.split()
    if op == "|=":
        return v == value or v.startswith(value + "-")
    # An empty value is in every attribute that is there.
    return v.startswith(value) if op == "^=" else v.endswith(value) if op == "$=" else value in v


def _pseudo(n: Node, name: str, arg) -> bool:
    if name == "not":
        return not arg.matches(n)
    if name == "empty":
        return n.is_empty()
    if name == "first-child":
        return n.index == 1
    if name == "last-child":
        return n.index == n.count
    if name == "only-child":
        return n.count == 1
    if name == "first-of-type":
        return n.type_index == 1
    if name == "last-of-type":
        return n.type_index == n.type_count
    if name == "only-of-type":
        return n.type_count == 1
    place = {"nth-child": n.index, "nth-last-child": n.count - n.index + 1, "nth-of-type": n.type_index, "nth-last-of-type": n.type_count - n.type_index + 1}[name]
    a, b = arg
    return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0


def _before(n: Node) -> list[Node]:
    """The element siblings before a node, nearest first."""
    if n.parent is None:
        return []
    out = []
    for c in n.parent.children:
        if c is n:
            break
        if c.kind == ELEMENT:
            out.append(c)
    return out[::-1]


@dataclass
class Selector:
    """``chains``: each a list of (combinator to the left, compound), left to right."""

    text: str
    chains: list[list[tuple[str, Compound]]]

    def matches(self, n: Node) -> bool:
        return any(self._match(c, len(c) - 1, n) for c in self.chains)

    def _match(self, chain, i: int, n: Node) -> bool:
        comb, compound = chain[i]
        if not compound.matches(n):
            return False
        if i == 0:
            return True
        if comb == ">":
            p = n.parent
            return p is not None and p.kind == ELEMENT and self._match(chain, i - 1, p)
        if comb == " ":
            p = n.parent
            while p is not None and p.kind == ELEMENT:
                if self._match(chain, i - 1, p):
                    return True
                p = p.parent
            return False
        earlier = _before(n)
        return any(self._match(chain, i - 1, e) for e in (earlier[:1] if comb == "+" else earlier))

    def query(self, scope: Node, limit: int = 0) -> list[Node]:
        """Elements below ``scope`` that match, in document order; at most ``limit`` if it isn't 0."""
        out, stack = [], scope.children[::-1]
        while stack:
            n = stack.pop()
            if n.kind != ELEMENT:
                continue
            if self.matches(n):
                out.append(n)
                if len(out) == limit:
                    break
            if n.children:
                stack += n.children[::-1]
        return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, message: str, unsupported: bool = False):
        raise SelectorError(f"{message} at offset {self.at}", unsupported)

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def white(self) -> bool:
        start = self.at
        while self.peek() and self.peek() in _WHITE:
            self.at += 1
        return self.at > start

    def parse(self) -> Selector:
        chains = []
        while True:
            self.white()
            chains.append(self.chain())
            if not self.peek():
                return Selector(self.text, chains)
            self.at += 1  # the comma

    def chain(self):
        chain = [("", self.compound())]
        while True:
            spaced = self.white()
            c = self.peek()
            if not c or c == ",":
                return chain
            if c in ">+~":
                self.at += 1
                self.white()
                chain.append((c, self.compound()))
            elif spaced:
                chain.append((" ", self.compound()))
            else:
                self.fail(f"unexpected character {c!r}")

    def ident(self) -> str:
        m = _IDENT.match(self.text, self.at)
        if not m:
            self.fail("expected an identifier")
        self.at = m.end()
        return m[0]

    def compound(self) -> Compound:
        out, start = Compound(), self.at
        if self.peek() == "*":
            self.at += 1
        elif _IDENT.match(self.text, self.at):
            out.tag = self.ident().lower()
        if self.peek() == "|":
            self.fail("namespaces are unsupported", True)
        while True:
            c = self.peek()
            if c == "#":
                self.at += 1
                if out.id is not None:
                    self.fail("a second id")
                m = _NAME.match(self.text, self.at)
                if not m:
                    self.fail("expected an id")
                out.id, self.at = m[0], m.end()
            elif c == ".":
                self.at += 1
                out.classes.append(self.ident())
            elif c == "[":
                out.attrs.append(self.attribute())
            elif c == ":":
                out.pseudos.append(self.pseudo())
            else:
                break
        if self.at == start:
            self.fail("expected a selector")
        return out

    def attribute(self) -> tuple[str, str, str]:
        self.at += 1
        self.white()
        name = self.ident().lower()
        self.white()
        if self.peek() == "]":
            self.at += 1
            return name, "", ""
        m = re.compile(r"[~|^$*]?=").match(self.text, self.at)
        if not m:
            self.fail("expected an attribute operator")
        self.at = m.end()
        self.white()
        q = self.peek()
        if q and q in "\"'":
            self.at += 1
            value = []
            while self.peek() != q:
                if not self.peek():
                    self.fail("unterminated attribute value")
                if self.peek() == "\\":
                    self.at += 1
                value.append(self.peek())
                self.at += 1
            self.at += 1
            value = "".join(value)
        else:
            start = self.at
            while self.peek() and self.peek() not in _WHITE + "]":
                self.at += 1
            value = self.text[start : self.at]
            if not value:
                self.fail("expected an attribute value")
        spaced = self.white()
        if self.peek() != "]":
            if spaced and re.compile(r"[A-Za-z]\s*\]").match(self.text, self.at):
                self.fail("attribute case flags are unsupported", True)
            self.fail("expected ]")
        self.at += 1
        return name, m[0], value

    def pseudo(self) -> tuple[str, object]:
        self.at += 1
        if self.peek() == ":":
            self.fail("pseudo-elements are unsupported", True)
        name = self.ident().lower()
        if name in SIMPLE:
            return name, None
        if name in COUNTED:
            if self.peek() != "(":
                self.fail(f":{name} needs an argument")
            end = self.text.find(")", self.at)
            if end < 0:
                self.fail("expected )")
            arg = re.sub(r"\s+", "", self.text[self.at + 1 : end]).lower()
            self.at = end + 1
            return name, self.nth(arg)
        if name == "not":
            if self.peek() != "(":
                self.fail(":not needs an argument")
            self.at += 1
            self.white()
            inner = self.compound()
            self.white()
            if self.peek() != ")":
                self.fail(":not takes one compound selector; others are unsupported", self.peek() != "")
            self.at += 1
            return name, inner
        return self.fail(f":{name} is unsupported", True)

    def nth(self, arg: str) -> tuple[int, int]:
        if arg in ("odd", "even"):
            return 2, int(arg == "odd")
        m = _NTH.match(arg)
        if not m:
            self.fail("invalid An+B")
        if m[3] is not None:
            return 0, int(m[3])
        a = m[1]
        return (int(a + "1") if a in ("", "+", "-") else int(a)), int(m[2] or 0)


def parse_selector(text: str) -> Selector:
    return _Parser(text).parse()
