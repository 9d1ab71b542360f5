"""Each built-in's Column form gives what its Python form gives, on the same odd texts."""

import random
import re

import pytest

from webloom.functions.builtins import BUILTINS, BuiltinError, apply_builtin
from webloom.functions.columns import builtin
from webloom.functions.urls import resolve, split

URLS = [
    "", "a b", "http://h/a b?x=1", "?x=1", "mailto:a@b", "http://h:99999/p", "#f%zz", "http://h/%zz", "http://h/a%20b/%2F", "//h/p", "///h/p", "http:///p", "http://h", "http://h?x=1", "a:b/c", "a/b:c", "1a:b", ":x",
    "/a/b?x=1;y=2", "/a?x=%zz", "/a?x=%20&x=+", "/a?=1&&x", "http://u:p@h/x", "http://u p@h/x", "http://h h/x", "http://[::1]:80/x", "http://[::1/x", "http://[::1]x/y", "http://h:8a/x", "http://h:/x", "http://h:1:2/x",
    "http://%41/x", "http://%C3%A9/x", "http://é.example/ü?q=ö#ä", "/a\x01b", "/a\x7f", "\n", "/a//b/", "/a%2Fb/c", "*", "http:a/b", "x?y?z#a#b", "?x=a%3Db", "?x", "?x=", "?x=1&x=2&x=3", "http://h/%", "/%4", "http://h^/x", "http://h\"/x", "?%78=7",
]
TEXTS = ["", " ", "\t a  b\u00a0\u3000c \n", "\u2003x\u2003", "a\x1cb", "aXbXc", "abc", "ABC ß É", "1", "+7", "-7", "255", "256", "-128", "18446744073709551615", "18446744073709551616", "9223372036854775807", "1e3", "1.25", ".5", "nan", "1e999", "yes", "NO", "ff", "zz", "12ab34", "ab", "aab", "😀 x 😀", "a.b.c", "..", "\\E$1"]


def calls():
    yield "trim", (), {}
    yield "normalize-whitespace", (), {}
    yield "lowercase", (), {}
    yield "uppercase", (), {}
    for old, count in (("X", None), ("X", 1), ("", None), ("", 2), ("b", 0)):
        yield "replace", (), {"old": old, "new": "<$>"} | ({} if count is None else {"count": count})
    for count in (None, 1):
        yield "regex-replace", (), {"pattern": "([a-c])(x?)", "replacement": "[$1$2]"} | ({} if count is None else {"count": count})
    for pattern, group in (("(a)|(b)", 1), ("(a)|(b)", 2), ("a(x?)b", 1), ("(x)?b", 1), ("(x*)b", 1), ("[0-9]+", 0), ("(?:(b)|a)(c?)", 2), ("((a)|x?)b", 1)):
        yield "regex-capture", (), {"pattern": pattern, "group": group}
    for start, end in ((0, None), (1, 3), (-2, None), (-3, -1), (2, 1), (5, 99)):
        yield "substring", (), {"start": start} | ({} if end is None else {"end": end})
    for sep, limit in ((".", None), (".", 2), ("", None), ("", 1), (".", 0)):
        yield "split", (), {"separator": sep} | ({} if limit is None else {"limit": limit})
    yield "prepend", (), {"value": "<"}
    yield "append", (), {"value": ">"}
    for kind in ("u8", "i8", "i64", "u64", "int"):
        yield "parse-int", (), {"as": kind}
    yield "parse-int", (), {"as": "u16", "radix": 16}
    for kind in ("f32", "f64"):
        yield "parse-float", (), {"as": kind}
    yield "parse-bool", (), {"true": "yes", "false": "no"}
    yield "to-string", (), {}
    yield "empty-to-null", (), {}
    yield "coalesce", (), {"value": "none"}
    yield "url-resolve", (), {"base": "https://e.example/a/b"}
    for index in (0, 1):
        yield "url-query", (), {"name": "x", "index": index}
    yield "url-path", (), {}
    for index in (0, 1, -1, -5):
        yield "path-segment", (), {"index": index}
    yield "assert-matches", (), {"pattern": "^[a-z]+$"}
    yield "assert-enum", ("abc", "1"), {}


def test_all_built_ins_agree(spark):
    rng = random.Random(1)
    bits = ["http:", "//", "/", "h", ":", "8", "?", "x", "=", "&", "#", "%2", "%41", "%C3%BC", "é", " ", "@", "[", "]", ";", "+", ".", "a"]
    texts = [*URLS, *TEXTS, *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").cache()
    x, columns, kinds = df["x"], [df["i"]], []
    for n, (name, positional, named) in enumerate(calls()):
        value, failed = builtin(name, x, *positional, **{("as_" if k == "as" else k): v for k, v in named.items()})
        columns += [value.alias(f"v{n}"), failed.alias(f"f{n}")]
        kinds.append((name, positional, named))
    assert {k for k, _, _ in kinds} == set(BUILTINS) - {"join", "assert-min", "assert-max"}
    wrong = []
    for row in df.select(*columns).collect():
        for n, (name, positional, named) in enumerate(kinds):
            try:
                want = (apply_builtin(name, texts[row["i"]], named, list(positional)), False)
            except BuiltinError:
                want = (None, True)
            got = (row[f"v{n}"], row[f"f{n}"])
            same = got == want or got[1] == want[1] and want[0] is not None and got[0] is not None and not isinstance(want[0], (str, list)) and float(got[0]) == float(want[0])
            if not same:
                wrong.append((name, named, texts[row["i"]], got, want))
    assert not wrong, (len(wrong), wrong[:8])


def test_white_space_of_every_character(spark):
    """The property that the Column form names has the characters that the Python form lists."""
    texts = [f"{chr(c)}a{chr(c)}{chr(c)}b c{chr(c)}" for c in (*range(0xD800), *range(0xE000, 0x11000))]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    value, trimmed = builtin("normalize-whitespace", df["x"])[0], builtin("trim", df["x"])[0]
    for row in df.select("x", value.alias("v"), trimmed.alias("t")).collect():
        assert (row["v"], row["t"]) == (apply_builtin("normalize-whitespace", row["x"], {}), apply_builtin("trim", row["x"], {})), row["x"].encode()


def test_built_ins_of_arrays_and_numbers(spark):
    df = spark.createDataFrame([(["a", "b"], 5.0), ([], -1.0), (["a", None], 4.0), (None, None)], "a array<string>, n double")
    joined, min_, max_ = builtin("join", df["a"], separator="-"), builtin("assert-min", df["n"], _given="f64", value=4), builtin("assert-max", df["n"], _given="f64", value=4)
    got = df.select(*joined, *min_, *max_).collect()
    assert [tuple(r) for r in got] == [("a-b", False, 5.0, False, None, True), ("", False, None, True, -1.0, False), (None, True, 4.0, False, 4.0, False), (None, False, None, False, None, False)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a b", ("a b", "")), ("http://h/a b?x=1", ("/a b", "x=1")), ("", ("", "")), ("?x=1", ("", "x=1")), ("mailto:a@b", ("", "")), ("http://h:99999/p", ("/p", "")), ("#f%zz", None), (":x", None), ("a:b/c", ("", "")), ("1a:b", None), ("///h:x/p", ("///h:x/p", "")), ("http://[::1]:80/x", ("/x", "")), ("http://[::1/x", None), ("http://u p@h/", None), ("http://h:8a/", None)],
)
def test_split(text, want):
    assert split(text) == want


@pytest.mark.parametrize(
    ("reference", "want"),
    [("../x", "https://e.example/x"), ("../item?q=1#part", "https://e.example/item?q=1#part"), ("./y/../z/", "https://e.example/a/z/"), ("", "https://e.example/a/b?k=v#f"), ("?q", "https://e.example/a/b?q"), ("#g", "https://e.example/a/b?k=v#g"), ("//o/p", "https://o/p"), ("/é b", "https://e.example/%C3%A9%20b"), ("a%20b", "https://e.example/a/a%20b"), ("mailto:a@b", "mailto:a@b"), ("HTTP://h/../q", "http://h/q"), ("..", "https://e.example/"), ("../../..", "https://e.example/"), ("%zz", None), (".", "https://e.example/a/")],
)
def test_resolve(reference, want):
    assert resolve("https://e.example/a/b?k=v#f", reference) == want


def test_no_python_in_columns(spark):
    """Only the built-ins that the module names run Python on the executors."""
    df = spark.createDataFrame([("x",)], "x string")
    slow = set()
    for name, positional, named in calls():
        value, failed = builtin(name, df["x"], *positional, **{("as_" if k == "as" else k): v for k, v in named.items()})
        plan = df.select(value, failed)._jdf.queryExecution().toString()
        if re.search("ArrowEvalPython|BatchEvalPython|PythonUDF", plan):
            slow.add((name, "count" in named or "radix" in named))
    assert slow == {("url-resolve", False), ("regex-replace", True), ("parse-int", True)}
