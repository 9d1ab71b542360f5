"""The 26 built-in transforms as Python functions: the semantics that the Column forms are tested against."""

from __future__ import annotations

import math
import re
import struct
import urllib.parse
from dataclasses import dataclass, field

from webloom.functions import regex2, urls
from webloom.plans.types import BOOL, FLOATS, INTEGERS, STRING, Type, assignable, literal_fits, parse_type, primitive

#: Unicode's White_Space characters (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space that aren't a single space.
_RUNS = re.compile(f"[{WHITE.replace(' ', '')}][{WHITE}]*+| [{WHITE}]++")


class BuiltinError(ValueError):
    """A value that a transform refuses."""


@dataclass(frozen=True)
class Arg:
    name: str
    kind: str  # string, int, count (not negative), bool, scalar, number
    required: bool = False
    default: object = None


@dataclass(frozen=True)
class Builtin:
    name: str
    takes: str
    gives: str
    args: tuple[Arg, ...] = ()
    positional: bool = False
    group: str = field(default="string")


_S, _Q = "string", "string?"
_PATTERN, _FLAGS = Arg("pattern", "string", True), Arg("flags", "string", False, "")
BUILTINS = {
    b.name: b
    for b in (
        Builtin("trim", _S, _S),
        Builtin("normalize-whitespace", _S, _S),
        Builtin("lowercase", _S, _S),
        Builtin("uppercase", _S, _S),
        Builtin("replace", _S, _S, (Arg("old", "string", True), Arg("new", "string", True), Arg("count", "count"))),
        Builtin("regex-replace", _S, _S, (_PATTERN, Arg("replacement", "string", True), _FLAGS, Arg("count", "count"))),
        Builtin("regex-capture", _S, _Q, (_PATTERN, Arg("group", "count", False, 0), _FLAGS)),
        Builtin("substring", _S, _S, (Arg("start", "int", True), Arg("end", "int"))),
        Builtin("split", _S, "string[]", (Arg("separator", "string", True), Arg("limit", "count"))),
        Builtin("join", "string[]", _S, (Arg("separator", "string", True),)),
        Builtin("prepend", _S, _S, (Arg("value", "string", True),)),
        Builtin("append", _S, _S, (Arg("value", "string", True),)),
        Builtin("parse-int", _S, "as", (Arg("as", "string", True), Arg("radix", "int", False, 10)), group="conversion"),
        Builtin("parse-float", _S, "as", (Arg("as", "string", True),), group="conversion"),
        Builtin("parse-bool", _S, "bool", (Arg("case-sensitive", "bool", False, False), Arg("true", "string", False, "true"), Arg("false", "string", False, "false")), group="conversion"),
        Builtin("to-string", "scalar", _S, group="conversion"),
        Builtin("empty-to-null", _S, _Q, group="conversion"),
        Builtin("coalesce", "nullable", "bare", (Arg("value", "scalar", True),), group="conversion"),
        Builtin("url-resolve", _S, _S, (Arg("base", "string", True),), group="url"),
        Builtin("url-query", _S, _Q, (Arg("name", "string", True), Arg("index", "count", False, 0)), group="url"),
        Builtin("url-path", _S, _S, group="url"),
        Builtin("path-segment", _S, _Q, (Arg("index", "int", True),), group="url"),
        Builtin("assert-matches", _S, _S, (_PATTERN, _FLAGS), group="validation"),
        Builtin("assert-enum", "any", "same", (), True, group="validation"),
        Builtin("assert-min", "number", "same", (Arg("value", "number", True),), group="validation"),
        Builtin("assert-max", "number", "same", (Arg("value", "number", True),), group="validation"),
    )
}


def result_type(name: str, given: Type, args: dict) -> Type | None:
    """What a call gives for an input of a type; None if it doesn't take it."""
    b = BUILTINS[name]
    if b.takes in ("string", "string[]"):
        if not assignable(given, parse_type(b.takes)):
            return None
        if b.gives == "as":
            names = INTEGERS if name == "parse-int" else FLOATS
            return primitive(args["as"]) if args.get("as") in names else None
        return parse_type(b.gives)
    if b.takes == "scalar":
        ok = given.kind == "primitive" and (given in (STRING, BOOL) or given.is_numeric)
        return STRING if ok else None
    if b.takes == "nullable":
        return given.of if given.nullable else None
    if b.takes == "number":
        return given if given.is_numeric else None
    return given


def check_arguments(name: str, given: Type, named: dict, positional: list) -> list[tuple[str, str]]:
    """(code, message) of what is wrong with a call's arguments."""
    b = BUILTINS[name]
    out = []
    bad = lambda message, code="E_TRANSFORM_ARGUMENT": out.append((code, message))
    known = {a.name: a for a in b.args}
    for k in named:
        if k not in known:
            bad(f'unknown property "{k}" of {name}', "E_UNKNOWN_PROPERTY")
    if b.positional != bool(positional):
        bad(f"{name} needs at least one argument" if b.positional else f"{name} takes no positional arguments")
    for a in b.args:
        v = named.get(a.name)
        if a.name not in named:
            if a.required:
                bad(f'{name} needs property "{a.name}"')
            continue
        whole = isinstance(v, int) and not isinstance(v, bool)
        ok = {"string": isinstance(v, str), "int": whole, "count": whole and v >= 0, "bool": isinstance(v, bool), "scalar": v is not None, "number": whole or isinstance(v, float)}[a.kind]
        if ok and a.kind in ("int", "count") and not -(2**31) <= v < 2**31:
            ok = False
        if not ok:
            bad(f'property "{a.name}" of {name} must be a {a.kind}')
    if out:
        return out
    if "pattern" in known:
        flags = named.get("flags", "")
        if any(f not in "ims" for f in flags) or len(set(flags)) != len(flags):
            bad("flags must be unique and among i, m and s")
        else:
            try:
                p = regex2.translate(named["pattern"], flags)
                if named.get("group", 0) > p.groups:
                    bad("group exceeds the pattern's captures")
            except regex2.RegexError as e:
                bad(str(e), "E_REGEX_INVALID")
    if name == "parse-int":
        if named["as"] not in INTEGERS:
            bad("as must be an integer type")
        if not 2 <= named.get("radix", 10) <= 36:
            bad("radix must be from 2 to 36")
    if name == "parse-float" and named["as"] not in FLOATS:
        bad("as must be a float type")
    if name == "parse-bool" and named.get("true", "true") == named.get("false", "false"):
        bad("true and false must differ")
    if name == "coalesce" and given.nullable and not literal_fits(named["value"], given.of):
        bad("value is not assignable")
    if name == "assert-enum" and not all(literal_fits(v, given) or given.is_numeric and isinstance(v, (int, float)) and not isinstance(v, bool) and given.name not in FLOATS for v in positional):
        bad("arguments are not assignable to the input")
    if name == "url-resolve":
        base = urllib.parse.urlsplit(named["base"])
        if not base.scheme:
            bad("base must be absolute")
    return out


def float_text(value: float, narrow: bool = False) -> str:
    """The shortest digits that give the value back, with an exponent of two digits or more where the decimal
    exponent is under -4 or over 5."""
    if value == 0:
        return "-0" if math.copysign(1, value) < 0 else "0"
    digits = _shortest32(value) if narrow else repr(abs(value))
    mantissa, _, exp = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    number = (whole + part).lstrip("0")
    point = len(whole) + int(exp or 0) - (len(whole + part) - len(number))
    number = number.rstrip("0") or "0"
    sign = "-" if value < 0 else ""
    e = point - 1
    if e < -4 or e >= 6:
        frac = "." + number[1:] if len(number) > 1 else ""
        return f"{sign}{number[0]}{frac}e{'-' if e < 0 else '+'}{abs(e):02d}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{number}"
    if point >= len(number):
        return sign + number + "0" * (point - len(number))
    return f"{sign}{number[:point]}.{number[point:]}"


def _shortest32(value: float) -> str:
    for n in range(1, 10):
        text = f"{abs(value):.{n - 1}e}"
        if struct.unpack("f", struct.pack("f", float(text)))[0] == struct.unpack("f", struct.pack("f", abs(value)))[0]:
            return text
    return repr(abs(value))


def _url(text: str) -> tuple[str, str]:
    """(path, query)."""
    parts = urls.split(text)
    if parts is None:
        raise BuiltinError("invalid URL")
    return parts


def _decoded(text: str, plus: bool = False) -> str:
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        raise BuiltinError("invalid percent escape")
    return urllib.parse.unquote(text.replace("+", " ") if plus else text, errors="replace")


_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")


def _parse_int(x: str, target: str, radix: int) -> int:
    low, high = INTEGERS[target]
    m = re.fullmatch(r"([+-]?)([0-9A-Za-z]+)", x)
    if not m or low == 0 and m[1] == "-" or not x.isascii():
        raise BuiltinError(f'parse {target}: parsing "{x}": invalid syntax')
    try:
        n = int(m[2], radix) * (-1 if m[1] == "-" else 1)
    except ValueError:
        raise BuiltinError(f'parse {target}: parsing "{x}": invalid syntax') from None
    if not low <= n <= high:
        raise BuiltinError(f'parse {target}: parsing "{x}": value out of range')
    return n


def _parse_float(x: str, target: str) -> float:
    if not _DECIMAL.match(x):
        raise BuiltinError(f'parse {target}: parsing "{x}": invalid syntax')
    f = float(x)
    if target == "f32":
        try:
            f = struct.unpack("f", struct.pack("f", f))[0]
        except OverflowError:
            f = math.inf
    if not math.isfinite(f):
        raise BuiltinError(f'parse {target}: parsing "{x}": value out of range')
    return f


def apply_builtin(name: str, x, named: dict, positional: list = (), given: str = "string"):
    """The result of one call; raises ``BuiltinError``."""
    arg = lambda k: named.get(k, next(a.default for a in BUILTINS[name].args if a.name == k))
    if name == "trim":
        return x.strip(WHITE)
    if name == "normalize-whitespace":
        return _RUNS.sub(" ", x).strip(" ")
    if name == "lowercase":
        return x.lower()
    if name == "uppercase":
        return x.upper()
    if name == "replace":
        count = arg("count")
        return x.replace(arg("old"), arg("new"), -1 if count is None else count)
    if name in ("regex-replace", "regex-capture", "assert-matches"):
        p = regex2.compiled(regex2.translate(arg("pattern"), arg("flags")).python)
        if name == "assert-matches":
            if not p.search(x):
                raise BuiltinError("value does not match required pattern")
            return x
        if name == "regex-capture":
            m = p.search(x)
            return m[arg("group")] if m else None
        count = arg("count")
        return x if count == 0 else p.sub(lambda m: regex2.expand(arg("replacement"), m), x, count=count or 0)
    if name == "substring":
        n, start, end = len(x), arg("start"), arg("end")
        clamp = lambda i: min(max(i + n if i < 0 else i, 0), n)
        return x[clamp(start) : clamp(n if end is None else end)]
    if name == "split":
        sep, limit = arg("separator"), arg("limit")
        parts = x.split(sep) if sep else list(x)
        return parts if limit is None else parts[:limit]
    if name == "join":
        if any(v is None for v in x):
            raise BuiltinError("array holds a null")
        return arg("separator").join(x)
    if name == "prepend":
        return arg("value") + x
    if name == "append":
        return x + arg("value")
    if name == "parse-int":
        return _parse_int(x, arg("as"), arg("radix"))
    if name == "parse-float":
        return _parse_float(x, arg("as"))
    if name == "parse-bool":
        fold = (lambda s: s) if arg("case-sensitive") else str.lower
        if fold(x) == fold(arg("true")):
            return True
        if fold(x) == fold(arg("false")):
            return False
        raise BuiltinError("value is not a configured boolean")
    if name == "to-string":
        if isinstance(x, bool):
            return "true" if x else "false"
        return float_text(x, given == "f32") if isinstance(x, float) else str(x)
    if name == "empty-to-null":
        return x or None
    if name == "coalesce":
        return arg("value") if x is None else x
    if name == "url-resolve":
        out = urls.resolve(arg("base"), x)
        if out is None:
            raise BuiltinError("invalid URL reference")
        return out
    if name == "url-query":
        query = _url(x)[1]
        if ";" in query:
            raise BuiltinError("invalid semicolon in the query")
        pairs = [[_decoded(v, True) for v in pair.partition("=")[::2]] for pair in query.split("&") if pair]
        found = [v for k, v in pairs if k == arg("name")]
        return found[arg("index")] if arg("index") < len(found) else None
    if name == "url-path":
        return _decoded(_url(x)[0])
    if name == "path-segment":
        # Without a path, what is given is one.
        parts = [_decoded(p) for p in (_url(x)[0] or x).split("/") if p]
        i = arg("index")
        return parts[i] if -len(parts) <= i < len(parts) else None
    if name == "assert-enum":
        if not any(x == v and isinstance(x, bool) == isinstance(v, bool) for v in positional):
            raise BuiltinError("value is not one of the required values")
        return x
    if name in ("assert-min", "assert-max"):
        if x < arg("value") if name == "assert-min" else x > arg("value"):
            raise BuiltinError(f"value is {'less' if name == 'assert-min' else 'greater'} than {arg('value')}")
        return x
    raise KeyError(name)
