"""Runtime inputs, URL templates and URL policies, as Python functions and as Columns."""

from __future__ import annotations

import ipaddress
import math
from collections.abc import Mapping
from urllib.parse import quote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.builtins import float_text
from webloom.plans.diagnostics import ExecutionError
from webloom.plans.program import Program


def resolve_inputs(program: Program, given: Mapping[str, object]) -> dict[str, object]:
    """Given inputs and defaults, checked; the first unknown name in order is reported."""
    known = {i.name: i for i in program.inputs}
    for name in sorted(given):
        if name not in known:
            raise ExecutionError("E_INPUT_UNKNOWN", f'unknown input "{name}"', f"input.{name}")
    out = {}
    for name, i in known.items():
        if name not in given:
            if i.required:
                raise ExecutionError("E_INPUT_REQUIRED", f'input "{name}" is required', f"input.{name}")
            if i.has_default:
                out[name] = i.default
            continue
        v, t = given[name], str(i.type)
        whole = isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer()
        ok = {"string": isinstance(v, str), "bool": isinstance(v, bool), "int": whole, "float": isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)}[t]
        if not ok:
            raise ExecutionError("E_INPUT_TYPE", f'input "{name}" is not of type {t}', f"input.{name}")
        out[name] = int(v) if t == "int" else float(v) if t == "float" else v
    return out


def _text(v: object) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else float_text(v) if isinstance(v, float) else str(v)


def expand_url(program: Program, given: Mapping[str, object]) -> str:
    values = resolve_inputs(program, given)
    url = ""
    for kind, text in program.url:
        if kind == "input" and text not in values:
            raise ExecutionError("E_INPUT_REQUIRED", f'input "{text}" has no value', f"input.{text}")
        url += text if kind == "literal" else quote(_text(values[text]), safe="-._~")
    parts = urlsplit(url)
    if parts.scheme.lower() not in ("http", "https") or not parts.netloc:
        raise ExecutionError("E_URL_INVALID", "expanded URL is not absolute", "source.fetch.url")
    return url


def percent_encoded(x: Column) -> Column:
    """All but RFC 3986's unreserved characters."""
    form = F.url_encode(x)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_column(program: Program, columns: Mapping[str, Column]) -> Column:
    """The URL of each row from columns of inputs; defaults stand in for columns not given."""
    parts = []
    for kind, text in program.url:
        i = next((i for i in program.inputs if kind == "input" and i.name == text), None)
        if i is None:
            parts.append(F.lit(text))
        else:
            v = columns.get(text, F.lit(_text(i.default)) if i.has_default else F.lit(None))
            parts.append(percent_encoded(F.coalesce(v.cast("string"), F.lit(_text(i.default))) if i.has_default else v.cast("string")))
    return F.concat(*parts)


# IANA's special-purpose blocks that aren't global, and those within them that are (fixed values).
_PRIVATE = [
    ipaddress.ip_network(n)
    for n in (
        "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15",
        "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8",
    )
]
_GLOBAL = [ipaddress.ip_network(n) for n in ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28", "64:ff9b::/96")]


def public_address(text: str) -> str | None:
    """Why an address may not be connected to, or None: it isn't one, or isn't global."""
    try:
        address = ipaddress.ip_address(text.split("%")[0])
    except ValueError:
        return "not an address"
    address = getattr(address, "ipv4_mapped", None) or address
    inside = lambda nets: any(address in n for n in nets if n.version == address.version)
    return "address is not global" if inside(_PRIVATE) and not inside(_GLOBAL) else None


def public_internet(url: str) -> str | None:
    """Why a URL may not be fetched, or None: http or https, no user, and no address that isn't global.
    The addresses that a name has are checked by the fetcher when it connects (``public_address``)."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
        _ = parts.port
    except ValueError:
        return "malformed URL"
    if parts.scheme.lower() not in ("http", "https"):
        return "scheme is not http or https"
    if parts.username is not None or parts.password is not None:
        return "URL carries a user"
    if not host:
        return "URL has no host"
    if host == "localhost" or host.endswith(".localhost"):
        return "host is local"
    why = public_address(host)
    return None if why == "not an address" else why


def public_internet_column(url: Column) -> Column:
    """Why each URL may not be fetched, or null."""
    return F.udf(public_internet, "string", useArrow=True)(url)
