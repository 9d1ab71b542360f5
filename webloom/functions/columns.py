"""The built-in transforms as Column expressions.

Each gives a pair (value, failed): a value is null where the result is null, and ``failed`` says that the
input was refused. Nothing here runs Python on the executors, except for ``url-resolve``, counted
``regex-replace``, float ``to-string`` and ``parse-int`` of radixes other than ten, which Spark's functions can't
express and which are Arrow functions. Null input gives null and doesn't fail, but for ``coalesce``.
"""

from __future__ import annotations

import functools
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webloom.functions import regex2, urls
from webloom.functions.builtins import BUILTINS, WHITE, BuiltinError, apply_builtin
from webloom.plans.types import INTEGERS, Type, parse_type

#: Runs of Unicode's white space that aren't a single space; the property has the characters of ``WHITE``.
_RUNS = "[\\p{IsWhite_Space}&&[^ ]]\\p{IsWhite_Space}*+| \\p{IsWhite_Space}++"


def _arrow(name: str, named: dict, positional: tuple, given: str, gives: Type):
    """(value, failed) by the Python form of a built-in, in Arrow batches."""
    schema = T.StructType([T.StructField("v", gives.spark()), T.StructField("failed", T.BooleanType())])
    kind = to_arrow_type(schema)

    def run(x: pa.Array) -> pa.Array:
        out = []
        for v in x.to_pylist():
            try:
                out.append({"v": None if v is None else apply_builtin(name, v, named, positional, given), "failed": False})
            except BuiltinError:
                out.append({"v": None, "failed": True})
        return pa.array(out, kind)

    return F.arrow_udf(run, schema)


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _percent_decoded(x: Column, plus: bool) -> Column:
    return F.try_url_decode(x if plus else F.replace(x, F.lit("+"), F.lit("%2B")))


def builtin(name: str, x: Column, /, *positional, _given: str = "string", **properties) -> tuple[Column, Column]:
    """(value, failed). Properties are written with underscores: ``case_sensitive``, ``as_``."""
    named = {k.rstrip("_").replace("_", "-"): v for k, v in properties.items()}
    args = {a.name: a.default for a in BUILTINS[name].args} | named
    never = F.lit(False)
    fails = lambda bad: F.coalesce(bad, never)
    kept = lambda value, bad: (F.when(~fails(bad), value), fails(bad))
    if name == "trim":
        return F.btrim(x, F.lit("".join(WHITE))), never
    if name == "normalize-whitespace":
        return F.btrim(F.regexp_replace(x, F.lit(_RUNS), F.lit(" ")), F.lit(" ")), never
    if name == "lowercase":
        return F.lower(x), never
    if name == "uppercase":
        return F.upper(x), never
    if name == "replace":
        old, new, count = args["old"], F.lit(args["new"]), args["count"]
        if count == 0:
            return x, never
        if old and count is None:
            return F.replace(x, F.lit(old), new), never
        if not old:
            chars = F.filter(F.split(x, ""), lambda c: c != "")
            if count is None:
                return F.concat(new, F.array_join(F.transform(chars, lambda c: F.concat(c, new)), "")), never
            put = F.transform(chars, lambda c, i: F.concat(F.when(i < count, new).otherwise(""), c))
            return F.concat(F.array_join(put, ""), F.when(F.size(chars) < count, new).otherwise("")), never
        parts = F.split(x, _quoted(old), -1)
        head, tail = F.slice(parts, 1, count + 1), F.slice(parts, count + 2, F.greatest(F.size(parts) - count - 1, F.lit(0)))
        joined = F.array_join(head, args["new"])
        return F.when(F.size(parts) > count + 1, F.concat(joined, F.lit(old), F.array_join(tail, old))).otherwise(joined), never
    if name in ("regex-replace", "regex-capture", "assert-matches"):
        p = regex2.translate(args["pattern"], args["flags"])
        if name == "assert-matches":
            return kept(x, ~x.rlike(p.java))
        if name == "regex-capture":
            found = F.regexp_extract(x, p.java, args["group"])
            if args["group"] == 0:
                return F.when(x.rlike(p.java), found), never
            # An empty group that took part and one that didn't look alike to regexp_extract, but only the former can be
            # referred to: the first match is taken without going back, then its group is asked for.
            took_part = f"\\A(?>(?s:.*?)(?={p.java}))(?>{p.java})\\{p.groups + args['group']}"
            return F.when(x.rlike(p.java), F.when(found != "", found).when(x.rlike(took_part), "")), never
        if args["count"] is None:
            return F.regexp_replace(x, F.lit(p.java), F.lit(regex2.java_replacement(args["replacement"], p.groups))), never
        got = _arrow(name, named, (), _given, parse_type("string"))(x)
        return got["v"], got["failed"]
    if name == "substring":
        n = F.length(x)
        clamp = lambda i: F.least(F.greatest((n + i) if i < 0 else F.lit(i), F.lit(0)), n)
        start = clamp(args["start"])
        end = n if args["end"] is None else clamp(args["end"])
        return F.substring(x, start + 1, F.greatest(end - start, F.lit(0))), never
    if name == "split":
        if args["separator"]:
            parts = F.split(x, _quoted(args["separator"]), -1)
        else:
            parts = F.filter(F.split(x, ""), lambda c: c != "")
        return (parts if args["limit"] is None else F.slice(parts, 1, args["limit"]) if args["limit"] else F.when(x.isNotNull(), F.array().cast("array<string>"))), never
    if name == "join":
        return kept(F.array_join(x, args["separator"]), F.exists(x, lambda v: v.isNull()))
    if name == "prepend":
        return F.concat(F.lit(args["value"]), x), never
    if name == "append":
        return F.concat(x, F.lit(args["value"])), never
    if name == "parse-int":
        low, high = INTEGERS[args["as"]]
        if args["radix"] != 10:
            got = _arrow(name, named, (), _given, parse_type(args["as"]))(x)
            return got["v"], got["failed"]
        n = F.when(x.rlike("\\A[+-]?[0-9]+\\z" if low else "\\A\\+?[0-9]+\\z"), x.try_cast("decimal(38,0)"))
        inside = n.between(F.lit(Decimal(low)), F.lit(Decimal(high)))
        return F.when(inside, n).cast(parse_type(args["as"]).spark()), x.isNotNull() & ~F.coalesce(inside, never)
    if name == "parse-float":
        f = F.when(x.rlike("\\A[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z"), x.try_cast("double"))
        f = f.cast("float") if args["as"] == "f32" else f
        return kept(f, x.isNotNull() & (f.isNull() | F.isnan(f) | (F.abs(f) == float("inf"))))
    if name == "parse-bool":
        fold = (lambda c: c) if args["case-sensitive"] else F.lower
        yes, no = fold(x) == fold(F.lit(args["true"])), fold(x) == fold(F.lit(args["false"]))
        return F.when(yes, True).when(no, False), fails(~(yes | no))
    if name == "to-string":
        if _given in ("float", "f32", "f64"):
            got = _arrow(name, named, (), _given, parse_type("string"))(x)
            return got["v"], got["failed"]
        return x.cast("string"), never
    if name == "empty-to-null":
        return F.nullif(x, F.lit("")), never
    if name == "coalesce":
        return F.coalesce(x, F.lit(args["value"])), never
    if name in ("url-query", "url-path", "path-segment"):
        path, query, refused = _url(x)
        if name == "url-path":
            return kept(_percent_decoded(path, False), refused)
        if name == "path-segment":
            # Without a path, what is given is one.
            parts = F.filter(F.split(F.when(path == "", x).otherwise(path), "/"), lambda p: p != "")
            i = args["index"]
            part = F.try_element_at(parts, F.lit(i + 1 if i >= 0 else i))
            return kept(_percent_decoded(part, False), refused | F.exists(parts, lambda p: p.rlike(urls.BAD_ESCAPE)))
        pairs = F.filter(F.split(query, "&"), lambda p: p != "")
        value = F.get(F.filter(pairs, lambda p: _percent_decoded(F.substring_index(p, "=", 1), True) == args["name"]), F.lit(args["index"]))
        raw = F.when(value.contains("="), F.substring(value, F.instr(value, "=") + 1, F.length(value))).when(value.isNotNull(), "")
        return kept(_percent_decoded(raw, True), refused | query.contains(";") | query.rlike(urls.BAD_ESCAPE))
    if name == "assert-enum":
        return kept(x, ~x.isin(*positional))
    if name == "assert-min":
        return kept(x, x < F.lit(args["value"]))
    if name == "assert-max":
        return kept(x, x > F.lit(args["value"]))
    got = _arrow(name, named, tuple(positional), _given, parse_type("string"))(x)
    return got["v"], got["failed"]


def _url(x: Column) -> tuple[Column, Column, Column]:
    """(path, query, refused) of URL references, as ``urls.split`` has them."""
    part = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    scheme = x.rlike(rf"\A{urls.SCHEME}")
    rest = part(x, urls.HIERARCHY)
    has_authority = rest.startswith("//") & (scheme | ~rest.startswith("///"))
    authority = part(rest, urls.AUTHORITY)
    path = F.when(has_authority, part(rest, urls.AFTER_AUTHORITY)).when(rest.startswith("/") | ~scheme, rest).when(x.isNotNull(), "")
    refused = x.rlike(urls.CONTROL) | x.startswith(":") | (~scheme & ~rest.startswith("/") & rest.rlike(urls.COLON_FIRST))
    refused = refused | (has_authority & ~(authority.rlike(urls.ALLOWED) & authority.rlike(urls.FORM)))
    return path, part(x, urls.QUERY), refused | path.rlike(urls.BAD_ESCAPE) | part(x, urls.FRAGMENT).rlike(urls.BAD_ESCAPE)


@functools.lru_cache(1)
def names() -> tuple[str, ...]:
    return tuple(BUILTINS)
