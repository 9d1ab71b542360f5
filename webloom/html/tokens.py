"""HTML tokens: start and end tags, text, comments, doctypes; raw text is asked for by the tree builder."""

from __future__ import annotations

import re
from html.entities import html5

_SPACE = "\t\n\f "
_TAG = re.compile(r"[a-zA-Z][^\t\n\f />\0]*")
_ATTR = re.compile(r"[\t\n\f /]*(?:(=?[^\t\n\f />=]*)(?:[\t\n\f ]*=[\t\n\f ]*(?:\"([^\"]*)(\"|\Z)|'([^']*)('|\Z)|([^\t\n\f >]*)))?)")
_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([a-zA-Z][a-zA-Z0-9]*;?))")
_LONGEST = max(map(len, html5))
#: Numbers of C1 controls that stand for characters of Windows-1252 (fixed by the HTML standard).
_WINDOWS = {0x80 + i: c for i, c in enumerate(bytes(range(0x80, 0xA0)).decode("cp1252", "replace")) if c != "�"}
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _character(n: int) -> str:
    if n in _WINDOWS:
        return _WINDOWS[n]
    return "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)


def unescape(text: str, attribute: bool = False) -> str:
    """Character references resolved; the longest name wins, with or without its semicolon."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1]:
            return _character(int(m[1], 16) if len(m[1]) < 12 else 0x110000)
        if m[2]:
            return _character(int(m[2]) if len(m[2]) < 12 else 0x110000)
        name = m[3]
        for n in range(min(len(name), _LONGEST), 1, -1):
            got = html5.get(name[:n])
            if got is None:
                continue
            if attribute and name[n - 1] != ";":
                after = name[n : n + 1] or text[m.end() : m.end() + 1]
                if after == "=" or after.isascii() and after.isalnum():
                    return m[0]
            return got + name[n:]
        return m[0]

    return _REFERENCE.sub(one, text)


class Tokens:
    """``next()`` gives ("start", tag, attrs, self-closing), ("end", tag), ("text", text), ("comment", text),
    ("doctype",) or None at the end. ``raw`` names the element whose text follows unparsed."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.at = 0
        self.raw: str | None = None
        self.references = False
        self.cdata = False

    def next(self):
        text, at = self.text, self.at
        if at >= len(text):
            return None
        if self.raw is not None:
            return self._raw()
        less = text.find("<", at)
        if less != at:
            end = less if less >= 0 else len(text)
            self.at = end
            return ("text", unescape(text[at:end]))
        two = text[at + 1 : at + 2]
        if two == "!":
            return self._declaration()
        if two == "/":
            if at + 2 >= len(text):
                self.at = len(text)
                return ("text", "</")
            m = _TAG.match(text, at + 2)
            if m:
                tag, _, _, ok = self._tag(m)
                return ("end", tag) if ok else None
            if text[at + 2] == ">":
                self.at = at + 3
                return self.next()
            return self._bogus(at + 2)
        if two == "?":
            return self._bogus(at + 1)
        m = _TAG.match(text, at + 1)
        if not m:
            self.at = at + 1
            return ("text", "<")
        tag, attrs, closing, ok = self._tag(m)
        return ("start", tag, attrs, closing) if ok else None

    def _tag(self, m: re.Match) -> tuple[str, dict[str, str], bool, bool]:
        """A tag cut off by the end of the text is dropped."""
        text, at, attrs = self.text, m.end(), {}
        while True:
            while at < len(text) and text[at] in _SPACE:
                at += 1
            if at >= len(text):
                self.at = len(text)
                return "", attrs, False, False
            if text[at] == ">":
                self.at = at + 1
                return m[0].translate(LOWER).replace("\0", "�"), attrs, False, True
            if text.startswith("/>", at):
                self.at = at + 2
                return m[0].translate(LOWER), attrs, True, True
            if text[at] == "/":
                at += 1
                continue
            a = _ATTR.match(text, at)
            if a[3] == "" or a[5] == "":
                if a.end() >= len(text) and (a[2] is not None or a[4] is not None):
                    self.at = len(text)
                    return "", attrs, False, False
            name = a[1].translate(LOWER).replace("\0", "�")
            value = next((v for v in (a[2], a[4], a[6]) if v is not None), "")
            if name and name not in attrs:
                attrs[name] = unescape(value, True).replace("\0", "�")
            at = a.end()

    def _bogus(self, start: int):
        end = self.text.find(">", start)
        end = end if end >= 0 else len(self.text)
        self.at = end + 1
        return ("comment", self.text[start:end])

    def _declaration(self):
        text, at = self.text, self.at
        if text.startswith("<!--", at):
            for short in ("<!-->", "<!--->"):
                if text.startswith(short, at):
                    self.at = at + len(short)
                    return ("comment", "")
            m = re.compile(r"--!?>").search(text, at + 4)
            end = m.start() if m else len(text)
            self.at = m.end() if m else len(text)
            body = text[at + 4 : end]
            if not m:
                body = re.sub(r"--?!?\Z", "", body)
            return ("comment", body.replace("\0", "�"))
        if text[at + 2 : at + 9].lower() == "doctype":
            self._bogus(at + 2)
            return ("doctype",)
        if self.cdata and text.startswith("<![CDATA[", at):
            end = text.find("]]>", at + 9)
            self.at = end + 3 if end >= 0 else len(text)
            return ("text", text[at + 9 : end if end >= 0 else len(text)]) if end != at + 9 else self.next()
        return self._bogus(at + 2)

    def _raw(self):
        """The text up to the end tag of ``raw``; then that tag."""
        text, at, tag = self.text, self.at, self.raw
        if tag == "plaintext":
            self.at = len(text)
            return ("text", text[at:].replace("\0", "�"))
        end_tag = re.compile(rf"</{tag}(?=[\t\n\f />])", re.I)
        m = end_tag.search(text, at)
        if tag == "script" and m:
            # Within "<!-- <script" the next end tag belongs to the inner script.
            start = at
            while m:
                opened = text.find("<!--", start, m.start())
                if opened < 0:
                    break
                closed = text.find("-->", opened + 2)
                inner = re.compile(r"<script[\t\n\f />]", re.I).search(text, opened, m.start())
                if 0 <= closed < m.start():
                    start = closed + 3
                elif inner and not (0 <= closed < inner.start()):
                    m = end_tag.search(text, m.end())
                    start = m.start() if m and False else opened
                    if m and (closed < 0 or closed > m.start()):
                        break
                else:
                    break
        end = m.start() if m else len(text)
        references, self.raw = self.references, None
        if end == at and m:
            return self.next()
        self.at = end
        body = text[at:end].replace("\0", "�")
        return ("text", unescape(body) if references else body)
