"""The portable regular expressions (RE2's syntax): checked, then written for Python's ``regex`` or for Java."""

from __future__ import annotations

import re as _re
from dataclasses import dataclass
from functools import lru_cache

_CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": "\\t\\n\\f\\r "}
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F", "blank": "\\t ", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0B\\f\\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_WORD = "0-9A-Za-z_"
_BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_NOT_BOUNDARY = f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
_PUNCTUATION = set("\\.+*?()|[]{}^$-/\"'`~!@#%&=:;<>, ")


class RegexError(ValueError):
    pass


@dataclass(frozen=True)
class Pattern:
    """``python`` and ``java`` are complete patterns, flags included."""

    python: str
    java: str
    groups: int


class _Writer:
    def __init__(self, text: str, flags: str):
        self.text, self.at, self.groups = text, 0, 0
        self.out: list[str] = []
        self.flags = {"i": False, "m": False, "s": False, "U": False}
        for f in flags:
            self.flags[f] = True

    def fail(self, what: str):
        raise RegexError(f"error parsing regexp: {what}")

    def write(self) -> None:
        self.alternatives(False)
        if self.at < len(self.text):
            self.fail("unexpected ): `" + self.text + "`")

    def alternatives(self, inside: bool) -> None:
        saved = dict(self.flags)
        repeatable = False
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == ")":
                break
            if c == "|":
                self.out.append("|")
                self.at += 1
                repeatable = False
                continue
            if c in "*+?" or c == "{" and _re.compile(r"\{[0-9]+(,[0-9]*)?\}").match(self.text, self.at):
                if not repeatable:
                    self.fail(f"missing argument to repetition operator: `{c}`")
                self.repeat()
                repeatable = False
                continue
            repeatable = self.atom()
        self.flags = saved

    def repeat(self) -> None:
        m = _re.compile(r"([*+?]|\{([0-9]+)(?:,([0-9]*))?\})(\??)").match(self.text, self.at)
        if m[2] and (int(m[2]) > 1000 or m[3] and (int(m[3]) > 1000 or int(m[3]) < int(m[2]))):
            self.fail(f"invalid repeat count: `{m[1]}`")
        self.at = m.end()
        if self.at < len(self.text) and (self.text[self.at] in "*+?" or _re.compile(r"\{[0-9]+(,[0-9]*)?\}").match(self.text, self.at)):
            self.fail(f"invalid nested repetition operator: `{m[0]}{self.text[self.at]}`")
        lazy = bool(m[4]) != self.flags["U"]
        self.out.append(m[1] + "?" * lazy)

    def atom(self) -> bool:
        c = self.text[self.at]
        if c == "(":
            return self.group()
        if c == "[":
            self.out.append(self.char_class())
            return True
        if c == "\\":
            return self.escape()
        self.at += 1
        if c == ".":
            self.out.append("[\\x{0}-\\x{10FFFF}]" if self.flags["s"] else "[^\\n]")
        elif c == "^":
            self.out.append("(?<![^\\n])" if self.flags["m"] else "\\A")
        elif c == "$":
            self.out.append("(?![^\\n])" if self.flags["m"] else "\\z")
        else:
            self.out.append(self.literal(c))
        return True

    def literal(self, c: str) -> str:
        return "\\" + c if c in "\\.+*?()|[]{}^$-&~#/ " else c

    def group(self) -> bool:
        m = _re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])").match(self.text, self.at)
        if m:
            saved = dict(self.flags)
            for f in m[1]:
                self.flags[f] = True
            for f in m[2] or "":
                self.flags[f] = False
            self.at = m.end()
            case = "i" if self.flags["i"] else "-i"
            if m[3] == ")":
                # To the end of the enclosing group.
                self.out.append(f"(?{case}:")
                self.alternatives_rest()
                self.out.append(")")
                self.flags = saved
                return False
            self.out.append(f"(?{case}:")
            self.alternatives(True)
            self.close()
            self.flags = saved
            return True
        if self.text.startswith("(?", self.at):
            bad = self.text[self.at : self.at + 3]
            self.fail(f"invalid or unsupported Perl syntax: `{bad}`")
        self.groups += 1
        self.at += 1
        self.out.append("(")
        self.alternatives(True)
        self.close()
        return True

    def alternatives_rest(self) -> None:
        saved = dict(self.flags)
        inner_repeatable = False
        while self.at < len(self.text) and self.text[self.at] != ")":
            c = self.text[self.at]
            if c == "|":
                self.out.append("|")
                self.at += 1
                inner_repeatable = False
            elif c in "*+?" or c == "{" and _re.compile(r"\{[0-9]+(,[0-9]*)?\}").match(self.text, self.at):
                if not inner_repeatable:
                    self.fail(f"missing argument to repetition operator: `{c}`")
                self.repeat()
                inner_repeatable = False
            else:
                inner_repeatable = self.atom()
        self.flags = saved

    def close(self) -> None:
        if self.text[self.at : self.at + 1] != ")":
            self.fail(f"missing closing ): `{self.text}`")
        self.at += 1
        self.out.append(")")

    def escape(self) -> bool:
        text = self.text
        e = text[self.at + 1 : self.at + 2]
        if not e:
            self.fail("trailing backslash at end of expression")
        if e == "Q":
            end = text.find("\\E", self.at + 2)
            body = text[self.at + 2 : end if end >= 0 else len(text)]
            self.at = end + 2 if end >= 0 else len(text)
            self.out.append("".join(map(self.literal, body)))
            return bool(body)
        simple = {"A": "\\A", "z": "\\z", "b": _BOUNDARY, "B": _NOT_BOUNDARY}
        if e in simple:
            self.at += 2
            self.out.append(simple[e])
            return True
        self.out.append(self.class_escape(False))
        return True

    def class_escape(self, inside: bool) -> str:
        """One escape that stands for a character or a class of them."""
        text, e = self.text, self.text[self.at + 1 : self.at + 2]
        if e.lower() in _CLASSES:
            self.at += 2
            body = _CLASSES[e.lower()]
            if e.islower():
                return body if inside else f"[{body}]"
            return f"[^{body}]"
        if e in "pP":
            m = _re.compile(r"[pP](?:([A-Za-z])|\{(\^?)([A-Za-z_]+)\})").match(text, self.at + 1)
            if not m:
                self.fail(f"invalid character class range: `{text[self.at : self.at + 2]}`")
            self.at = m.end()
            negative = (e == "P") != bool(m[2])
            name = m[1] or m[3]
            prefix = "Is" if len(name) > 2 else ""
            return f"\\{'P' if negative else 'p'}{{{prefix}{name}}}"
        m = _re.compile(r"x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))").match(text, self.at + 1)
        if m:
            n = int(m[1] or m[2], 16)
            if n > 0x10FFFF:
                self.fail("invalid escape sequence")
            self.at = m.end()
            return self.literal(chr(n)) if n > 32 else f"\\x{n:02X}"
        m = _re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}").match(text, self.at + 1)
        if m and (m[0][0] == "0" or len(m[0]) > 1):
            self.at = m.end()
            n = int(m[0], 8)
            return self.literal(chr(n)) if n > 32 else f"\\x{n:02X}"
        controls = {"n": "\\n", "t": "\\t", "r": "\\r", "f": "\\f", "a": "\\x07", "v": "\\x0B"}
        if e in controls:
            self.at += 2
            return controls[e]
        if e in _PUNCTUATION or not e.isalnum():
            self.at += 2
            return self.literal(e)
        return self.fail(f"invalid escape sequence: `\\{e}`")

    def char_class(self) -> str:
        text, start = self.text, self.at
        self.at += 1
        negative = text[self.at : self.at + 1] == "^"
        self.at += negative
        parts, first = [], True
        while True:
            c = text[self.at : self.at + 1]
            if not c:
                self.fail(f"missing closing ]: `{text[start:]}`")
            if c == "]" and not first:
                self.at += 1
                break
            first = False
            m = _re.compile(r"\[:(\^?)([a-z]+):\]").match(text, self.at)
            if m:
                if m[2] not in _POSIX:
                    self.fail(f"invalid character class range: `{m[0]}`")
                self.at = m.end()
                parts.append(f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]])
                continue
            low, single = self.class_item()
            if single and text[self.at : self.at + 1] == "-" and text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high, also = self.class_item()
                if not also or _value(high) < _value(low):
                    self.fail(f"invalid character class range: `{text[start : self.at]}`")
                parts.append(f"{low}-{high}")
            else:
                parts.append(low)
        return f"[{'^' if negative else ''}{''.join(parts)}]"

    def class_item(self) -> tuple[str, bool]:
        c = self.text[self.at]
        if c != "\\":
            self.at += 1
            return self.literal(c), True
        e = self.text[self.at + 1 : self.at + 2]
        item = self.class_escape(True)
        return item, not (e and (e.lower() in _CLASSES or e in "pP"))


def _value(item: str) -> int:
    if len(item) == 1:
        return ord(item)
    if item.startswith("\\x"):
        return int(item[2:], 16)
    return ord({"n": "\n", "t": "\t", "r": "\r", "f": "\f"}.get(item[1], item[1]))


@lru_cache(4096)
def translate(pattern: str, flags: str = "") -> Pattern:
    """Checks a pattern; ``flags`` are among i, m and s, each once."""
    if any(f not in "ims" for f in flags) or len(set(flags)) != len(flags):
        raise RegexError(f"invalid flags {flags!r}")
    w = _Writer(pattern, flags)
    w.write()
    body = "".join(w.out)
    python = body.replace("\\z", "\\Z").replace("[\\x{0}-\\x{10FFFF}]", "(?s:.)").replace("{Is", "{")
    case = "(?i)" if "i" in flags else ""
    out = Pattern("(?V1)" + case + python, ("(?iu)" if case else "") + body.replace("(?i:", "(?iu:"), w.groups)
    compiled(out.python)
    return out


@lru_cache(4096)
def compiled(python: str):
    import regex

    try:
        return regex.compile(python)
    except regex.error as e:
        raise RegexError(f"error parsing regexp: {e}") from None


_REPLACEMENT = _re.compile(r"\$(\$|[0-9]{1,2})")


def expand(replacement: str, m) -> str:
    """A replacement with $0 to $99 and $$; groups that aren't there or took no part are empty."""
    groups = m.re.groups
    return _REPLACEMENT.sub(lambda r: "$" if r[1] == "$" else (m[int(r[1])] or "" if int(r[1]) <= groups else ""), replacement)


def java_replacement(replacement: str, groups: int) -> str:
    """The same for Java: other dollars and backslashes are escaped."""
    out, at = [], 0
    plain = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    for m in _REPLACEMENT.finditer(replacement):
        out.append(plain(replacement[at : m.start()]))
        at = m.end()
        if m[1] == "$":
            out.append("\\$")
        elif int(m[1]) <= groups:
            # A digit that follows must not be read as part of the number.
            after = replacement[at : at + 1]
            out.append(f"${int(m[1])}" + ("\\" + after if after.isascii() and after.isdigit() else ""))
            at += bool(after.isascii() and after.isdigit())
    return "".join(out) + plain(replacement[at:])
