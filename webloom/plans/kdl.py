"""The KDL subset that programs are written in: text to nodes with spans."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from webloom.plans.diagnostics import Diagnostic, Span, ordered

_IDENT = re.compile(r"[A-Za-z_-][A-Za-z0-9_./-]*")
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9A-Za-z_]*|0[oO][0-9A-Za-z_]*|0[bB][0-9A-Za-z_]*|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]*)?)")
_KEYWORDS = {"true": True, "false": False, "null": None}
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\\": "\\", '"': '"', "/": "/"}
_BASES = {"x": 16, "o": 8, "b": 2}


@dataclass
class Value:
    """A string, boolean, integer, float or null; ``span`` is where it stands."""

    value: object
    span: Span

    @property
    def kind(self) -> str:
        v = self.value
        return "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string"


@dataclass
class KdlNode:
    name: str
    span: Span
    args: list[Value] = field(default_factory=list)
    props: list[tuple[str, Value, Span]] = field(default_factory=list)
    children: list[KdlNode] = field(default_factory=list)

    def prop(self, name: str) -> Value | None:
        return next((v for k, v, _ in self.props if k == name), None)


@dataclass
class Token:
    kind: str  # ident, value, {, }, (, ), =, /-, end (newline or ;), eof, bad
    text: str
    value: object
    start: int
    end: int


class Lexer:
    def __init__(self, file: str, text: str):
        self.file, self.text, self.found = file, text, []
        self._bytes, self._lines = [0], [(0, 1)]
        at = 0
        for i, c in enumerate(text):
            at += len(c.encode())
            self._bytes.append(at)
            if c == "\n":
                self._lines.append((i + 1, len(self._lines) + 1))

    def point(self, i: int) -> tuple[int, int, int]:
        low, high = 0, len(self._lines)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._lines[mid][0] <= i else (low, mid)
        start, line = self._lines[low]
        return self._bytes[i], line, i - start + 1

    def span(self, a: int, b: int) -> Span:
        return Span(self.file, self.point(a), self.point(b))

    def error(self, message: str, a: int, b: int) -> None:
        self.found.append(Diagnostic("E_KDL_SYNTAX", message, self.span(a, b)))

    def tokens(self) -> list[Token]:
        text, at, out = self.text, 0, []
        while at < len(text):
            c = text[at]
            if c in " \t\r﻿":
                at += 1
            elif c == "\n" or c == ";":
                out.append(Token("end", c, None, at, at + 1))
                at += 1
            elif c == "\\" and re.match(r"\\[ \t\r]*(?://[^\n]*)?(?:\n|\Z)", text[at:]):
                at = text.find("\n", at) + 1 or len(text)
            elif text.startswith("//", at):
                end = text.find("\n", at)
                at = end if end >= 0 else len(text)
            elif text.startswith("/*", at):
                at = self._comment(at)
            elif text.startswith("/-", at):
                out.append(Token("/-", "/-", None, at, at + 2))
                at += 2
            elif c in "{}()=":
                out.append(Token(c, c, None, at, at + 1))
                at += 1
            else:
                token = self._quoted(at) if c == '"' else self._hash(at) if c == "#" else self._word(at)
                out.append(token)
                at = token.end
        out.append(Token("eof", "", None, len(text), len(text)))
        return out

    def _comment(self, start: int) -> int:
        depth, at = 1, start + 2
        while depth:
            m = re.compile(r"/\*|\*/").search(self.text, at)
            if not m:
                self.error("unterminated block comment", start, len(self.text))
                return len(self.text)
            depth += 1 if m[0] == "/*" else -1
            at = m.end()
        return at

    def _quoted(self, start: int) -> Token:
        text, at, out = self.text, start + 1, []
        while at < len(text):
            c = text[at]
            if c == '"':
                return Token("value", text[start : at + 1], "".join(out), start, at + 1)
            if c == "\n":
                self.error("newline in quoted string", start, at)
                return Token("value", text[start:at], "".join(out), start, at)
            if c == "\\":
                e = text[at + 1 : at + 2]
                m = re.compile(r"u\{([0-9A-Fa-f]{1,6})\}").match(text, at + 1)
                if m and int(m[1], 16) <= 0x10FFFF and not 0xD800 <= int(m[1], 16) <= 0xDFFF:
                    out.append(chr(int(m[1], 16)))
                    at = m.end()
                    continue
                if e in _ESCAPES and e:
                    out.append(_ESCAPES[e])
                else:
                    self.error("invalid string escape", at, min(len(text), at + 2))
                at += 2
                continue
            out.append(c)
            at += 1
        self.error("unterminated quoted string", start, len(text))
        return Token("value", text[start:], "".join(out), start, len(text))

    def _hash(self, start: int) -> Token:
        text = self.text
        m = re.compile(r'(#+)("""|")').match(text, start)
        if m:
            close = m[2] + m[1]
            end = text.find(close, m.end())
            if end < 0:
                self.error("unterminated raw string", start, len(text))
                return Token("value", text[start:], text[m.end() :], start, len(text))
            body = text[m.end() : end]
            if m[2] == '"""':
                body = body.removeprefix("\r\n").removeprefix("\n").removesuffix("\n").removesuffix("\r")
            elif "\n" in body:
                self.error("newline in raw string", start, end + len(close))
            return Token("value", text[start : end + len(close)], body, start, end + len(close))
        m = re.compile(r"#([A-Za-z-]+)").match(text, start)
        if m and m[1] in _KEYWORDS:
            return Token("value", m[0], _KEYWORDS[m[1]], start, m.end())
        end = m.end() if m else start + 1
        self.error("invalid keyword", start, end)
        return Token("bad", text[start:end], None, start, end)

    def _word(self, start: int) -> Token:
        text = self.text
        if re.compile(r"[+-]?[0-9]").match(text, start):
            m = _NUMBER.match(text, start)
            return self._number(m[0], start, m.end())
        m = _IDENT.match(text, start)
        if m:
            return Token("ident", m[0], m[0], start, m.end())
        self.error(f"unexpected character '{text[start]}'", start, start + 1)
        return Token("bad", text[start], None, start, start + 1)

    def _number(self, word: str, start: int, end: int) -> Token:
        digits, sign = word.lstrip("+-"), -1 if word[0] == "-" else 1
        bad = lambda message: (self.error(message, start, end), Token("bad", word, None, start, end))[1]
        base = _BASES.get(digits[1:2].lower()) if digits[0] == "0" else None
        if base:
            rest = digits[2:]
            if not rest or rest[0] == "_":
                return bad("integer base prefix must be followed by a digit")
            try:
                n = sign * int(rest.replace("_", ""), base)
            except ValueError:
                return bad("invalid digit for the integer's base")
        elif re.fullmatch(r"[0-9_]+", digits):
            n = sign * int(digits.replace("_", ""))
        else:
            try:
                f = float(word.replace("_", ""))
            except ValueError:
                return bad("invalid number")
            return Token("value", word, f, start, end) if math.isfinite(f) else bad("number out of range")
        return Token("value", word, n, start, end) if -(2**63) <= n < 2**63 else bad("integer out of range")


class Parser:
    def __init__(self, file: str, text: str):
        self.lexer = Lexer(file, text)
        self.tokens = self.lexer.tokens()
        self.at = 0
        self.found: list[Diagnostic] = []

    @property
    def here(self) -> Token:
        return self.tokens[self.at]

    def span(self, t: Token) -> Span:
        return self.lexer.span(t.start, t.end)

    def error(self, message: str, t: Token, code: str = "E_KDL_SYNTAX") -> None:
        self.found.append(Diagnostic(code, message, self.span(t)))

    def document(self) -> tuple[list[KdlNode], list[Diagnostic]]:
        nodes = []
        while self.here.kind != "eof":
            nodes += self._nodes(top=True)
        return nodes, ordered(self.found + self.lexer.found)

    def _skip(self) -> None:
        """To the end of the line or block, after an error."""
        while self.here.kind not in ("end", "}", "eof"):
            self.at += 1

    def _nodes(self, top: bool = False) -> list[KdlNode]:
        out = []
        while True:
            t = self.here
            if t.kind == "end":
                self.at += 1
            elif t.kind == "eof":
                return out
            elif t.kind == "}":
                if not top:
                    return out
                self.error("unexpected closing brace", t)
                self.at += 1
            elif t.kind == "/-":
                self.at += 1
                if self.here.kind in ("/-", "end", "eof", "}"):
                    self.error("slashdash must be followed by a node", t)
                    self._skip()
                    continue
                self._node()
            else:
                node = self._node()
                if node is not None:
                    out.append(node)

    def _annotated(self) -> bool:
        """A type annotation is recognised in order to be rejected."""
        if self.here.kind != "(":
            return False
        self.error("KDL type annotations are not supported", self.here, "E_TYPE_ANNOTATION_UNSUPPORTED")
        while self.here.kind not in (")", "end", "eof"):
            self.at += 1
        if self.here.kind == ")":
            self.at += 1
        return True

    def _node(self) -> KdlNode | None:
        """A node; its span ends with its last argument or its block."""
        first = self.here
        node = self._plain_node()
        if node is not None:
            last = self.tokens[self.at - 1]
            ends = [v.span.end for v in node.args] + [self.lexer.point(last.end)] * (last.kind == "}" and last.start > first.start)
            node.span = Span(node.span.file, node.span.start, max([node.span.end, *ends]))
        return node

    def _plain_node(self) -> KdlNode | None:
        self._annotated()
        t = self.here
        if t.kind == "ident" or t.kind == "value" and isinstance(t.value, str):
            node = KdlNode(t.value, self.span(t))
            self.at += 1
        else:
            if t.kind not in ("end", "eof", "}"):
                self.error(f'expected node name, found "{t.text}"', t)
            self._skip()
            return None
        while True:
            t = self.here
            if t.kind in ("end", "eof", "}"):
                return node
            hidden = t.kind == "/-"
            if hidden:
                self.at += 1
                t = self.here
                if t.kind == "/-":
                    self.error("slashdash must be followed by an argument, a property or a block", t)
                    self._skip()
                    return node
            if t.kind == "{":
                self.at += 1
                children = self._nodes()
                if self.here.kind == "}":
                    self.at += 1
                else:
                    self.error("unterminated child block", t)
                if not hidden:
                    node.children = children
                if not hidden and self.here.kind not in ("end", "eof", "}"):
                    self.error(f'unexpected token "{self.here.text}" after child block', self.here)
                    self._skip()
                if not hidden:
                    return node
                continue
            self._annotated()
            t = self.here
            following = self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else t
            named = t.kind == "ident" or t.kind == "value" and isinstance(t.value, str)
            if named and following.kind == "=" and following.start == t.end:
                self.at += 2
                self._annotated()
                v = self.here
                if v.kind != "value":
                    self.error(f'expected a value for property "{t.value}"', v)
                    self._skip()
                    return node
                self.at += 1
                if not hidden:
                    node.props.append((t.value, Value(v.value, self.span(v)), self.lexer.span(t.start, v.end)))
            elif t.kind == "value":
                self.at += 1
                if not hidden:
                    node.args.append(Value(t.value, self.span(t)))
            else:
                self.error(f'unexpected token "{t.text}" in node', t)
                self._skip()
                return node


def parse_kdl(file: str, data: bytes | str) -> tuple[list[KdlNode], list[Diagnostic]]:
    if isinstance(data, bytes):
        try:
            data = data.decode("utf-8")
        except UnicodeDecodeError:
            start = (0, 1, 1)
            return [], [Diagnostic("E_KDL_SYNTAX", "source is not valid UTF-8", Span(file, start, start))]
    return Parser(file, data).document()
