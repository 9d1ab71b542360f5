"""One split of URL references for both forms of the URL built-ins, as regular expressions that Java and Python read alike.

A reference is refused if it has a control character, begins with a colon, has a colon in the first segment of a path
without scheme, a percent sign without two hexadecimal digits in its path or fragment, or an authority whose characters
or port aren't allowed. White space and characters beyond ASCII are let through in paths and queries.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_to_bytes

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
CONTROL = r"[\x00-\x1F\x7F]"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
FRAGMENT = r"(?s)\A[^#]*#(.*)"
QUERY = r"(?s)\A[^?#]*\?([^#]*)"
#: What stands between scheme and query: authority and path.
HIERARCHY = rf"(?s)\A(?:{SCHEME})?([^?#]*)"
AUTHORITY = r"(?s)\A//([^/]*)"
AFTER_AUTHORITY = r"(?s)\A//[^/]*(.*)"
COLON_FIRST = r"\A[^/?#]*:"
_USER = r"(?:[A-Za-z0-9\-._:~!$&'()*+,;=@]|%[0-9A-Fa-f]{2})*@"
_HOST = r"""(?:[A-Za-z0-9\-._~!$&'()*+,;=:\[\]<>"]|[^\x00-\x7F]|%25|%[89A-Fa-f][0-9A-Fa-f])*"""
_END = "(?![\\s\\S])"
#: The characters of an authority, and its form: an address in brackets or a name, then a port of digits.
ALLOWED = rf"\A(?:{_USER})?{_HOST}{_END}"
FORM = rf"(?s)\A(?:.*@)?(?:\[.*\](?::[0-9]*)?|(?!\[)(?:[^:@]*|[^@]*:[0-9]*)){_END}"


def split(text: str) -> tuple[str, str] | None:
    """(path, query) as they are written, or None if the reference is refused."""
    if re.search(CONTROL, text) or text.startswith(":"):
        return None
    scheme = re.match(SCHEME, text) is not None
    rest = re.search(HIERARCHY, text)[1]
    fragment, query = re.search(FRAGMENT, text), re.search(QUERY, text)
    if not scheme and not rest.startswith("/") and re.search(COLON_FIRST, rest):
        return None
    path = rest
    if rest.startswith("//") and (scheme or not rest.startswith("///")):
        authority, path = re.search(AUTHORITY, rest)[1], re.search(AFTER_AUTHORITY, rest)[1]
        if not (re.search(ALLOWED, authority) and re.search(FORM, authority)):
            return None
    elif scheme and not rest.startswith("/"):
        path = ""
    if re.search(BAD_ESCAPE, path) or fragment and re.search(BAD_ESCAPE, fragment[1]):
        return None
    return path, query[1] if query else ""


_WRITTEN = re.compile(r"(?:[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/]|%[0-9A-Fa-f]{2})*\Z")
_WRITTEN_FRAGMENT = re.compile(r"(?:[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/?]|%[0-9A-Fa-f]{2})*\Z")


def _escaped(text: str, written: re.Pattern, safe: str) -> str:
    """As it stands if every character may, else with all others escaped."""
    return text if written.match(text) else quote(unquote_to_bytes(text), safe=safe)


def _without_dots(path: str) -> str:
    """An absolute path without its segments ``.`` and ``..``."""
    kept: list[str] = []
    parts = path.removeprefix("/").split("/")
    for p in parts:
        if p == "..":
            del kept[-1:]
        elif p != ".":
            kept.append(p)
    return "/" + "/".join([*kept, ""] if parts[-1] in (".", "..") and kept else kept)


def resolve(base: str, reference: str) -> str | None:
    """A reference against an absolute URL, escaped where it has to be; None if the reference is refused."""
    if split(reference) is None:
        return None

    def parts(text: str) -> tuple[str, str | None, str, str | None, str]:
        scheme = re.match(SCHEME, text)
        rest = re.search(HIERARCHY, text)[1]
        query, fragment = re.search(QUERY, text), re.search(FRAGMENT, text)
        authority = re.search(AUTHORITY, rest) if rest.startswith("//") and (scheme or not rest.startswith("///")) else None
        path = re.search(AFTER_AUTHORITY, rest)[1] if authority else rest
        return scheme[0].lower() if scheme else "", authority[1] if authority else None, path, query[1] if query else None, fragment[1] if fragment else ""

    scheme, authority, path, query, fragment = parts(reference)
    old_scheme, old_authority, old_path, old_query, old_fragment = parts(base)
    if scheme and authority is None and not path.startswith("/"):
        return scheme + path + ("" if query is None else "?" + query) + ("#" + _escaped(fragment, _WRITTEN_FRAGMENT, "$&+,/:;=?@!()*") if fragment else "")
    if scheme or authority:
        path = _without_dots(path) if path else ""
    else:
        authority = old_authority
        if not path and not query and query != "":
            query, fragment = old_query, fragment or old_fragment
        full = old_path if not path else path if path.startswith("/") else old_path[: old_path.rfind("/") + 1] + path
        path = _without_dots(full) if full else ""
    out = scheme or old_scheme
    if authority is not None:
        out += "//" + "".join(c if c.isascii() else quote(c) for c in authority)
    out += _escaped(path, _WRITTEN, "$&+,/:;=@")
    return out + ("" if query is None else "?" + query) + ("#" + _escaped(fragment, _WRITTEN_FRAGMENT, "$&+,/:;=?@!()*") if fragment else "")
