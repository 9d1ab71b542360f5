"""Records, recovery, Spark plans, relational selectors, sources, streams."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import regex2
from webloom.functions.builtins import BuiltinError, apply_builtin, float_text
from webloom.functions.columns import builtin
from webloom.operators import dom
from webloom.operators.browser import extract_page
from webloom.operators.extract import decode, extract, fields, rows, sink_json
from webloom.operators.runtime import extract_html
from webloom.plans.compiler import compile_text
from webloom.plans.diagnostics import ExecutionError
from webloom.plans.portfolio import program
from webloom.plans.selector import parse_selector
from webloom.sources.charset import decode_column, decode_page
from webloom.sources.fetch import Options, fetch, session_for
from webloom.sources.urls import expand_url, percent_encoded, public_internet, resolve_inputs, url_column
from webloom.streaming.pages import extract_stream, read_pages, write_batches

# -- built-ins ---------------------------------------------------------------------------------------------

CASES = [
    ("trim", "  a b　\n", {}, "a b"), ("normalize-whitespace", "\t a  \n b ", {}, "a b"), ("lowercase", "ÉA", {}, "éa"), ("uppercase", "éa", {}, "ÉA"), ("replace", "aXbXc", {"old": "X", "new": "-"}, "a-b-c"),
    ("replace", "aXbXc", {"old": "X", "new": "-", "count": 1}, "a-bXc"), ("replace", "abc", {"old": "", "new": "."}, ".a.b.c."), ("replace", "abc", {"old": "", "new": ".", "count": 2}, ".a.bc"), ("replace", "abc", {"old": "b", "new": "x", "count": 0}, "abc"),
    ("regex-replace", "a1b22", {"pattern": "([a-z])([0-9]+)", "replacement": "$2$1$$"}, "1a$22b$"), ("regex-replace", "aaa", {"pattern": "a", "replacement": "b", "count": 2}, "bba"), ("regex-replace", "a\nb", {"pattern": "^b$", "replacement": "x", "flags": "m"}, "a\nx"),
    ("regex-replace", "x1", {"pattern": "(x)", "replacement": "$10"}, "1"), ("regex-capture", "id=42", {"pattern": "id=([0-9]+)", "group": 1}, "42"), ("regex-capture", "x", {"pattern": "y"}, None), ("regex-capture", "b", {"pattern": "(a)?b", "group": 1}, None),
    ("regex-capture", "b", {"pattern": "(a*)b", "group": 1}, ""), ("regex-capture", "a\n", {"pattern": "^a$"}, None), ("substring", "héllo", {"start": 1, "end": 3}, "él"), ("substring", "hello", {"start": -3}, "llo"), ("substring", "hello", {"start": 4, "end": 2}, ""), ("substring", "abc", {"start": -9, "end": 99}, "abc"),
    ("split", "a,b,,", {"separator": ","}, ["a", "b", "", ""]), ("split", "a,b,c", {"separator": ",", "limit": 2}, ["a", "b"]), ("split", "añ", {"separator": ""}, ["a", "ñ"]), ("split", "", {"separator": ""}, []), ("split", "", {"separator": ","}, [""]), ("split", "a.b", {"separator": ".", "limit": 0}, []),
    ("prepend", "b", {"value": "a"}, "ab"), ("append", "a", {"value": "b"}, "ab"), ("parse-int", "+7", {"as": "i8"}, 7), ("parse-int", "-129", {"as": "i8"}, BuiltinError), ("parse-int", "-1", {"as": "u8"}, BuiltinError), ("parse-int", " 1", {"as": "int"}, BuiltinError), ("parse-int", "1_0", {"as": "int"}, BuiltinError),
    ("parse-int", "ff", {"as": "u8", "radix": 16}, 255), ("parse-int", "9223372036854775808", {"as": "int"}, BuiltinError), ("parse-float", "1.5e3", {"as": "f64"}, 1500.0), ("parse-float", ".5", {"as": "f64"}, 0.5), ("parse-float", "1d", {"as": "f64"}, BuiltinError), ("parse-float", "NaN", {"as": "f64"}, BuiltinError),
    ("parse-float", "1e400", {"as": "f64"}, BuiltinError), ("parse-bool", "TRUE", {}, True), ("parse-bool", "no", {"true": "yes", "false": "NO"}, False), ("parse-bool", "No", {"true": "yes", "false": "no", "case-sensitive": True}, BuiltinError), ("empty-to-null", "", {}, None), ("empty-to-null", " ", {}, " "),
    ("url-resolve", "../x?q#f", {"base": "https://h/a/b/c"}, "https://h/a/x?q#f"), ("url-query", "http://h/?a=1&b=x%20y+z&a=2", {"name": "b"}, "x y z"), ("url-query", "http://h/?a=1&a=2", {"name": "a", "index": 1}, "2"), ("url-query", "http://h/?a", {"name": "a"}, ""), ("url-query", "http://h/", {"name": "a"}, None),
    ("url-query", "http://h/?a=%zz", {"name": "a"}, BuiltinError), ("url-path", "http://h/a%20b/c+d", {}, "/a b/c+d"), ("url-path", "/x%2Fy", {}, "/x/y"), ("path-segment", "http://h/a/b%2Fc/", {"index": -1}, "b/c"), ("path-segment", "/a", {"index": 3}, None), ("assert-matches", "ready", {"pattern": "^read"}, "ready"), ("assert-matches", "x", {"pattern": "y"}, BuiltinError),
]


@pytest.mark.parametrize(("name", "x", "named", "want"), CASES)
def test_builtin_python(name, x, named, want):
    if want is BuiltinError:
        with pytest.raises(BuiltinError):
            apply_builtin(name, x, named)
    else:
        assert apply_builtin(name, x, named) == want


def test_builtin_columns(spark):
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "i int, x string").repartition(1)
    chosen = []
    for i, (name, _, named, want) in enumerate(CASES):
        v, bad = builtin(name, F.col("x"), **{k.replace("-", "_") + ("_" if k == "as" else ""): a for k, a in named.items()})
        chosen.append(df.where(f"i = {i}").select("i", F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}).alias("v"), bad.alias("bad")))
    import functools
    import json

    got = {r["i"]: r for r in functools.reduce(lambda a, b: a.unionAll(b), chosen).collect()}
    for i, (name, x, named, want) in enumerate(CASES):
        assert got[i]["bad"] == (want is BuiltinError), (name, x, named)
        if want is not BuiltinError:
            assert json.loads(got[i]["v"])["v"] == want, (name, x, named)


def test_other_builtins():
    assert apply_builtin("join", ["a", "b"], {"separator": "-"}) == "a-b" and apply_builtin("coalesce", None, {"value": 1}) == 1
    assert apply_builtin("assert-enum", "a", {}, ("a", "b")) == "a" and apply_builtin("assert-min", 3, {"value": 3}) == 3 and apply_builtin("to-string", True, {}) == "true"
    for bad in (lambda: apply_builtin("join", ["a", None], {"separator": ""}), lambda: apply_builtin("assert-enum", 1, {}, (True,)), lambda: apply_builtin("assert-max", 4, {"value": 3})):
        with pytest.raises(BuiltinError):
            bad()
    assert [float_text(v) for v in (1.0, 1e6, 1e-5, 0.1, -2.5)] == ["1", "1e+06", "1e-05", "0.1", "-2.5"] and float_text(1.100000023841858, True) == "1.1"


@settings(max_examples=200)
@given(st.text(alphabet="ab1 \n\r\v.é", max_size=8), st.sampled_from(["a.b", "^a$", "\\s+", "\\bab\\b", "(?i)É", "[^a-b]+", "a*?b", "(a|b){2}", "\\w\\d", "(?s).+", "[[:alpha:]]1"]))
def test_regex_python(text, pattern):
    import duckdb

    p = regex2.compiled(regex2.translate(pattern).python)
    want = duckdb.execute("select regexp_matches(?, ?)", [text, pattern]).fetchone()[0]
    assert bool(p.search(text)) == want


@pytest.mark.parametrize("pattern", ["(?=a)", "(a)\\1", "a**", "(?P<n>a)", "(?<n>a)", "a++", "(?>a)", "[b-a]", "a{2,1}", "(", ")", "\\", "a{1001}"])
def test_regex_refused(pattern):
    with pytest.raises(regex2.RegexError):
        regex2.translate(pattern)


# -- records -----------------------------------------------------------------------------------------------


def run(body, html, declarations="", **options):
    got = extract_html(program(body, declarations), html, **options)
    return got["value"], [(w["code"], w["path"], w["row"]) for w in got["warnings"]], got["partial"]


NUMBER = 'field "n" type="u8" required=#true { select ".n"; value "text"; apply "parse-int" as="u8" }'
ROWS = "<ul><li><b class=n>1</b><li><b class=n>x</b><li><b class=n>300</b><li><i>none</i><li><b class=n>4</b></ul>"


def test_skip_keeps_warnings_of_dropped_rows():
    body = 'collection "c" on-row-error="skip" { select "li"; field "w" type="string?" { select "b"; value "text"; apply "assert-matches" pattern="^[0-9]"; on-error "warn" }\n' + NUMBER + " }"
    value, warnings, partial = run(body, ROWS)
    assert [r["n"] for r in value["c"]] == [1, 4] and partial
    assert warnings == [("W_ERROR_RECOVERED", "output.c[1].w", None), ("W_ROW_SKIPPED", "output.c", 1), ("W_ROW_SKIPPED", "output.c", 2), ("W_ROW_SKIPPED", "output.c", 3), ("W_PARTIAL_EXTRACTION", None, None)]


@pytest.mark.parametrize(
    ("body", "code", "path"),
    [
        ('collection "c" { select "li"; ' + NUMBER + " }", "E_TRANSFORM", "output.c[1].n"), ('collection "c" min-items=3 on-row-error="skip" { select "li"; ' + NUMBER + " }", "E_COLLECTION_CARDINALITY", "output.c"),
        ('collection "c" max-items=1 on-row-error="skip" { select "li"; ' + NUMBER + " }", "E_COLLECTION_CARDINALITY", "output.c"), ('collection "c" required=#true { select "ol"; ' + NUMBER + " }", "E_COLLECTION_CARDINALITY", "output.c"),
        ('field "a" type="string" required=#true { select "li"; value "text" }', "E_SELECTOR_CARDINALITY", "output.a"), ('field "a" type="string" required=#true { select "ol"; value "text" }', "E_REQUIRED_VALUE_MISSING", "output.a"),
        ('field "a" type="string" required=#true { select "ul"; value "attr" name="id" }', "E_REQUIRED_VALUE_MISSING", "output.a"), ('collection "c" { select "ul"; collection "d" min-items=9 { select "li"; field "x" type="string" { select "b"; value "text" } } }', "E_COLLECTION_CARDINALITY", "output.c[0].d"),
    ],
)
def test_errors(body, code, path):
    with pytest.raises(ExecutionError) as e:
        run(body, ROWS)
    assert (e.value.code, e.value.path) == (code, path)


def test_missing_and_recovery():
    body = """field "a" type="string" { select "ol"; value "text" }
field "b" type="string" default="d" { select "ol"; value "text" }
field "c" type="u8?" { select "li" match="first"; value "text"; apply "parse-int" as="u8"; on-error "null" }
field "d" type="string" default="z" { select "i"; value "text"; apply "assert-enum" "q"; on-error "default" }"""
    value, warnings, partial = run(body, ROWS.replace("<b class=n>1", "<b>x"))
    assert value == {"a": None, "b": "d", "c": None, "d": "z"} and partial and warnings == [("W_PARTIAL_EXTRACTION", None, None)]


def test_transforms():
    decl = 'transform "x" input="string" output="string" { external symbol="ext" }\ntransform "p" input="string" output="string" { pipeline { apply "trim"; apply "x" } }\ntransform "m" input="string" output="float?" { match { case "A!" 1.5; default #null } }'
    body = 'field "a" type="float?" required=#true { select "p"; value "text"; apply "p"; apply "m" }'
    assert run(body, "<p> A </p>", decl, externals={"ext": lambda s: s + "!"})[0] == {"a": 1.5}
    for ext, code in ((lambda s: 1, "E_EXTERNAL_TRANSFORM_RESULT_TYPE"), (lambda s: 1 / 0, "E_EXTERNAL_TRANSFORM")):
        with pytest.raises(ExecutionError) as e:
            run(body, "<p> A </p>", decl, externals={"ext": ext})
        assert e.value.code == code
    with pytest.raises(ExecutionError) as e:
        run(body, "<p>", decl)
    assert e.value.code == "E_EXTERNAL_TRANSFORM_MISSING"
    with pytest.raises(ExecutionError) as e:
        run('field "a" type="string" required=#true { select "p"; value "text"; apply "r" }', "<p>x", 'transform "r" input="string" output="string" { pipeline { apply "r" } }')
    assert e.value.code == "E_TRANSFORM_RECURSION"


# -- Spark -------------------------------------------------------------------------------------------------

LINKS = 'field "title" type="string" required=#true { select "title"; value "text" }\ncollection "links" { select "nav li"; field "href" type="string" { select "a"; value "attr" name="href" } }'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_parse_and_pruning(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = extract(program(LINKS), pages, keep=("page_id",), where="page_id < 20").where("partial = false and size(value.links) > 4")
    text = plan(got)
    assert text.count("ArrowEvalPython") == 1 and "url" not in text.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(page_id), LessThan(page_id,20)]" in text
    assert got.count() > 0


def test_columns_rows_and_sinks(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").union(spark.createDataFrame([(9999, "u", None)], "page_id long, url string, html string"))
    p = program(LINKS)
    assert fields(p, pages, keep=("page_id",)).columns == ["page_id", "title", "links"]
    assert rows(p, pages, "links", keep=("page_id",)).columns == ["page_id", "pos", "href"]
    got = extract(p, pages, keep=("page_id",))
    assert got.where("page_id = 9999").first()["value"] is None
    assert decode(got, p.schema).schema.simpleString() == p.schema.simpleString()
    assert '"title":' in sink_json(got).first()["json"]
    with pytest.raises(Exception, match="E_SELECTOR_CARDINALITY"):
        extract(program('field "a" type="string" required=#true { select "li"; value "text" }'), pages, errors="raise").collect()


@pytest.mark.parametrize("selector", ["nav ul > li:nth-child(2) a", "article > p", "li + li", "h1 ~ p", "h1, div.ad, *[href^='/t']", "p:last-of-type", "li:not(:first-child)", "html body :empty", "b:only-child"])
def test_relational_selectors_agree(spark, sf, selector):
    from webloom.html.tree import parse

    pages = spark.read.parquet(f"{sf}/pages.parquet").where("page_id < 8")
    nodes = dom.dom_nodes(pages, text=False)
    got = {r["page_id"]: r["n"] for r in dom.select_nodes(nodes, selector).groupBy("page_id").agg(F.count("*").alias("n")).collect()}
    want = {r["page_id"]: len(parse_selector(selector).query(parse(r["html"]))) for r in pages.collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_many_relational_selectors(spark, sf):
    from webloom.html.tree import parse

    pages = spark.read.parquet(f"{sf}/pages.parquet").where("page_id < 8")
    selectors = {"a": "nav ul > li:nth-child(2) a", "b": "h1 ~ p, div.ad", "c": "li + li", "d": "article > p, p", "e": "li ~ li ~ li", "f": "table"}
    got = {(r["page_id"], r["selector"]): r["n"] for r in dom.select_many(dom.dom_nodes(pages, text=False), selectors).groupBy("page_id", "selector").agg(F.count("*").alias("n")).collect()}
    want = {(r["page_id"], k): len(parse_selector(s).query(parse(r["html"]))) for r in pages.collect() for k, s in selectors.items()}
    assert got == {k: v for k, v in want.items() if v}


def test_stream(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/pages.parquet").write.parquet(f"{tmp_path}/in")
    stream = extract_stream(program(LINKS), read_pages(spark, f"{tmp_path}/in", "page_id long, url string, html string"), keep=("page_id",))
    counts = []
    q = write_batches(stream, f"{tmp_path}/cp", lambda df, n: counts.append(df.where("error is null").count()))
    q.awaitTermination(120)
    assert sum(counts) == spark.read.parquet(f"{sf}/pages.parquet").count()


# -- sources -----------------------------------------------------------------------------------------------


def test_charsets(spark):
    assert decode_page("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é" and decode_page(b"\xef\xbb\xbf\xc3\xa9", "text/html; charset=latin1") == "é"
    assert decode_page(b'<meta charset="euc-jp">' + "日本".encode("euc-jp")).endswith("日本") and decode_page("x".encode("utf-16-le"), "text/html;charset=utf-16le") == "x"
    assert decode_page(b"x", "text/html; charset=mine", {"mine": lambda b: "own"}) == "own"
    for data, kind, code in ((b"\xff", None, "E_HTML_DECODE"), (b"x", "a; charset=nope", "E_HTML_CHARSET_UNSUPPORTED")):
        with pytest.raises(ExecutionError) as e:
            decode_page(data, kind)
        assert e.value.code == code
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xff"),), (None,), (bytearray(b"x" * 20),)], "b binary")
    got = [r[0] for r in df.select(decode_column(F.col("b"), max_bytes=10)).collect()]
    assert [(r["html"], r["code"]) for r in got] == [("é", None), (None, "E_HTML_DECODE"), (None, None), (None, "E_HTTP_BODY_TOO_LARGE")]


URLS = compile_text('extractor "u" version="2026-01-01" language-version="2026-07-15" {\n source "html" { fetch mode="http" url="https://e.invalid/{a}/{n}?l={l}"; session policy="required" }\n input "a" type="string"\n input "n" type="int"\n input "l" type="string" required=#false default="ja"\n field "t" type="string" { select "p"; value "text" }\n}')


def test_urls(spark):
    assert expand_url(URLS, {"a": "x y/~é*", "n": 3}) == "https://e.invalid/x%20y%2F~%C3%A9%2A/3?l=ja"
    df = spark.createDataFrame([("x y/~é*", 3)], "a string, n long")
    assert df.select(url_column(URLS, {"a": F.col("a"), "n": F.col("n")})).first()[0] == expand_url(URLS, {"a": "x y/~é*", "n": 3})
    assert df.select(percent_encoded(F.lit("a+b c"))).first()[0] == "a%2Bb%20c"
    for given_, code in (({"a": "x"}, "E_INPUT_REQUIRED"), ({"a": "x", "n": 1, "z": 1}, "E_INPUT_UNKNOWN"), ({"a": "x", "n": "1"}, "E_INPUT_TYPE")):
        with pytest.raises(ExecutionError) as e:
            resolve_inputs(URLS, given_)
        assert e.value.code == code
    with pytest.raises(ExecutionError) as e:
        session_for(URLS, None)
    assert e.value.code == "E_SESSION_REQUIRED"


@pytest.mark.parametrize(("url", "ok"), [("https://example.com/", True), ("http://8.8.8.8/", True), ("ftp://x/", False), ("http://127.0.0.1/", False), ("http://[::1]/", False), ("http://u:p@x/", False), ("http://10.1.2.3/", False), ("http://localhost/", False), ("http://192.0.0.9/", True), ("http://[::ffff:10.0.0.1]/", False), ("http://169.254.169.254/", False)])
def test_policy(url, ok):
    assert (public_internet(url) is None) == ok


def test_fetch_stage(spark):
    def fetcher(url, session, options):
        if "bad" in url:
            raise ExecutionError("E_HTTP_STATUS", "status 500")
        return {"status": 200, "content_type": "text/html", "body": b"<p>x"}

    got = fetch(spark.createDataFrame([("http://good/",), ("http://bad/",), (None,)], "url string"), options=Options(policy=None), fetcher=fetcher).collect()
    assert sorted((r["url"], r["status"], r["code"]) for r in got) == [("http://bad/", None, "E_HTTP_STATUS"), ("http://good/", 200, None)]


def test_fetch_stage_of_equal_urls(spark, tmp_path):
    """A row for each page, whether or not others have its address; kept columns come along as they are."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from webloom.plans import portfolio

    urls = ["http://a/", "http://b/", "http://c/", "http://a/", "http://b/", "http://a/", "http://é/", "http://é/"]
    pq.write_table(pa.table({"page_id": pa.array(range(len(urls)), pa.int64()), "url": urls, "html": [""] * len(urls)}), tmp_path / "pages.parquet")
    want = duckdb.connect().sql(portfolio.SQL["fetch_stage"].replace("from pages", f"from '{tmp_path}/pages.parquet'")).fetchall()
    got = portfolio.QUERIES["fetch_stage"](spark, f"file://{tmp_path}").select("page_id", "status", "code", "n").collect()
    assert len(got) == len(urls) and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    rows = spark.sql("select id % 2 as `odd name`, timestamp'2026-01-01 00:00:00' as at, array(id) as ids, 'u' as url, id as status from range(5)")
    fetched = fetch(rows, keep=("odd name", "at", "ids"), options=Options(policy=None), fetcher=lambda *_: {"status": 200})
    assert fetched.columns[:4] == ["odd name", "at", "ids", "url"]
    assert sorted((r["ids"], r["odd name"], r["at"].year, r["status"]) for r in fetched.collect()) == [([i], i % 2, 2026, 200) for i in range(5)]
    with pytest.raises(ValueError, match="status"):
        fetch(rows, keep=("status",))


def test_small_tables_are_dealt_out(spark, sf, tmp_path):
    from webloom.operators.spread import _bytes, spread

    cores = spark.sparkContext.defaultParallelism
    one = spark.read.parquet(f"{sf}/pages.parquet")
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == one.count()
    one.repartition(cores).write.parquet(f"file://{tmp_path}/many")
    many = spark.read.parquet(f"file://{tmp_path}/many")
    assert spread(many) is many and spread(one.limit(0).select("page_id")).count() == 0
    rows = spark.createDataFrame([(1,)], "a int")
    assert spread(rows) is rows
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert spread(one) is one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [_bytes(x) for x in ("134217728b", "128m", "1g", "64KB", "7")] == [1 << 27, 1 << 27, 1 << 30, 1 << 16, 7]


def test_names_that_resolve_to_private_addresses(monkeypatch):
    """Every address of a name is checked before the connection, and the checked address is the one connected to."""
    import socket

    from webloom.sources import fetch as module

    tried = []

    def resolve(addresses):
        return lambda host, port, *_: [(socket.AF_INET, socket.SOCK_STREAM, 6, "", (a, port)) for a in addresses]

    class Socket:
        def __init__(self, *_):
            pass

        def settimeout(self, _):
            pass

        def connect(self, target):
            tried.append(target)
            raise OSError("no network")

        def close(self):
            pass

    monkeypatch.setattr(module.socket, "socket", Socket)
    for addresses, code in ((["169.254.169.254"], "E_URL_POLICY"), (["93.184.216.34", "10.0.0.1"], "E_URL_POLICY"), (["93.184.216.34", "93.184.216.35"], "E_HTTP_FETCH")):
        monkeypatch.setattr(module.socket, "getaddrinfo", resolve(addresses))
        for scheme in ("http", "https"):
            with pytest.raises(ExecutionError) as e:
                module.fetch_one(f"{scheme}://metadata.example/", options=Options(timeout=1.0))
            assert e.value.code == code
    assert tried == [("93.184.216.34", 80), ("93.184.216.35", 80), ("93.184.216.34", 443), ("93.184.216.35", 443)]


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "<title>t</title>", "v", "e", "p", "x"), (2, None, "v", "e", "p", "x")], "id int, html string, value string, error string, partial string, title string")
    p = program('field "title" type="string" required=#true { select "title"; value "text" }\ncollection "c" { select "title"; field "pos2" type="string" { select "b"; value "text" } }')
    got = fields(p, pages, keep=("id", "value", "error", "partial")).collect()
    assert [(r["id"], r["value"], r["error"], r["partial"], r["title"]) for r in got] == [(1, "v", "e", "p", "t")]
    assert rows(p, pages, "c", keep=("value", "title")).columns == ["value", "title", "pos", "pos2"]
    for call in (lambda: extract(p, pages, keep=("value",)), lambda: fields(p, pages, keep=("title",)), lambda: dom.dom_nodes(pages.withColumnRenamed("id", "tag"), key="tag"), lambda: dom.page_matches(pages.withColumnRenamed("id", "n"), {}, key="n")):
        with pytest.raises(ValueError, match="rename"):
            call()


def test_pages_without_key_and_with_one_key(spark):
    html = "<ul><li>a<li>b</ul>"
    pages = spark.createDataFrame([(None, html), (None, html), (5, html), (5, html), (6, None)], "page_id long, html string").repartition(3)
    nodes = dom.dom_nodes(pages)
    for s, n in (("ul > li", 8), ("li + li", 4), ("li ~ li", 4), ("body li", 8), ("li, ul", 12)):
        assert dom.select_nodes(nodes, s).count() == n
    got = sorted((str(r["page_id"]), r["n"]) for r in dom.page_matches(pages, {"x": "ul > li"}).collect())
    assert got == [("5", 2), ("5", 2), ("6", 0), ("None", 2), ("None", 2)]


def test_documents_of_a_folder(spark, tmp_path):
    from webloom.plans.compiler import CompileError
    from webloom.sources import programs

    module = 'module "m" version="2026-01-01" language-version="2026-07-15" { transform "loud" input="string" output="string" { pipeline { apply "uppercase" } } }'
    main = 'import "./lib/m.kdl" as="m"\nextractor "t" version="2026-01-01" language-version="2026-07-15" { source "html" { fetch mode="http" url="https://e.invalid/" }; field "a" type="string" required=#true { select "p"; value "text"; apply "m.loud" } }'
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/m.kdl").write_text(module)
    (tmp_path / "main.kdl").write_text(main)
    (tmp_path / "note.txt").write_text("x")
    path = f"file://{tmp_path}"
    assert set(programs.read_directory(spark, path)) == {"main.kdl", "lib/m.kdl"}
    assert extract_html(programs.compile_directory(spark, path, "main.kdl"), "<p>hi")["value"] == {"a": "HI"}
    with pytest.raises(ValueError, match="more than"):
        programs.read_directory(spark, path, max_bytes=10)
    with pytest.raises(CompileError):
        programs.compile_directory(spark, path, "lib/m.kdl")
    df = spark.createDataFrame([(1, main), (2, "extractor"), (3, None)], "path int, source string")
    got = {r["path"]: r for r in programs.compile_documents(df, modules={"lib/m.kdl": module}).collect()}
    assert got[1]["ok"] and got[1]["ir"] and not got[1]["diagnostics"] and not got[2]["ok"] and got[3]["diagnostics"][0]["code"] == "E_DOCUMENT_ROOT"


class FakeBrowser:
    def __init__(self, html):
        from webloom.html.tree import parse

        self.root, self.log = parse(html), []

    def __getattr__(self, name):
        return lambda *a: self.log.append((name, *a))

    def query_all(self, scope, selector, limit):
        return parse_selector(selector).query(scope or self.root, limit)

    def text(self, n):
        return n.text_content()

    def attribute(self, n, name):
        return n.attrs.get(name)

    def evaluate(self, script, element, timeout):
        return {"k": [1, None]} if element is None else element.tag


def test_browser():
    p = compile_text('extractor "b" version="2026-01-01" language-version="2026-07-15" {\n source "html" { fetch mode="browser" url="https://e.example/"; workflow { click ".go" timeout-ms=5; scroll 0 10 } }\n field "o" type="object" required=#true { evaluate-js "() => 1" scope="document" returns="object" }\n collection "c" { select "li"; field "t" type="string" required=#true { evaluate-js "e => e" scope="current" returns="string" }\n field "x" type="string" { select "a"; value "text" } }\n}')
    b = FakeBrowser("<ul><li><a>1</a><li>2</ul>")
    got = extract_page(p, b, {}, allow_javascript=True)
    assert got["value"] == {"o": {"k": [1, None]}, "c": [{"t": "li", "x": "1"}, {"t": "li", "x": None}]} and [x[0] for x in b.log] == ["navigate", "click", "scroll"]
    for args, code in (((p, b, {}), "E_JAVASCRIPT_DISABLED"), ((p, None, {}), "E_BROWSER_RUNTIME_MISSING"), ((URLS, b, {}), "E_BROWSER_MODE_REQUIRED")):
        with pytest.raises(ExecutionError) as e:
            extract_page(*args)
        assert e.value.code == code
    with pytest.raises(ExecutionError) as e:
        extract_html(p, "<p>")
    assert e.value.code == "E_SNAPSHOT_UNSUPPORTED"


def test_command_line(tmp_path, capsys):
    from webloom.__main__ import main

    good, bad, page = tmp_path / "p.kdl", tmp_path / "bad.kdl", tmp_path / "x.html"
    good.write_text('extractor "u" version="2026-01-01" language-version="2026-07-15" { source "html" { fetch mode="http" url="https://e.invalid/" }; field "t" type="string" { select "p"; value "text" } }')
    bad.write_text("extractor")
    page.write_text("<p>hi")
    assert main(["validate", str(good)]) == 0 and main(["validate", str(bad)]) == 1 and main(["nope"]) == 2 and main(["compile", str(good)]) == 0
    capsys.readouterr()
    assert main(["extract", str(good), "--html", str(page)]) == 0 and '"t": "hi"' in capsys.readouterr().out


def test_queries_against_sql(spark, sf):
    """Every query over pages and nations, and some built-ins, against its SQL."""
    import duckdb

    from webloom.plans import portfolio

    c = duckdb.connect()
    for t in ("pages", "documents", "events", "part", "orders", "lineitem", "customer", "nation"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    text = lambda x: "null" if x is None or x != x else str(x)
    # One of the queries of a defect each is enough here: compile_diagnostics has all of them.
    names = [n for n in portfolio.SQL if not n.startswith(("builtin_", "compile_"))]
    names += ["builtin_url_path", "builtin_url_path_odd", "builtin_url_query_odd", "builtin_trim", "builtin_parse_int_u64", "builtin_catalog", "compile_diagnostics", "compile_utf8", "compile_capabilities", "compile_order"]
    assert len(names) > 85
    for name in names:
        df = portfolio.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted(tuple(text(r[k]) for k in cols) for r in df.collect())
        quoted = ", ".join(f'"{k}"' for k in cols)
        assert got == sorted(tuple(map(text, r)) for r in c.sql(f"select {quoted} from ({portfolio.SQL[name]})").fetchall()), name


def test_pipeline_transform_of_all_pages(spark):
    """Every page has its row, upper-cased beyond ASCII too."""
    import html
    import re

    from webloom.plans import portfolio

    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html").collect()
    want = [(r["page_id"], html.unescape(re.search('<a href="([^"]*)">', r["html"])[1]).replace("/", "").upper() + "!") for r in pages]
    got = [(r["page_id"], r["site"]) for r in portfolio.QUERIES["pipeline_transform"](spark, d).collect()]
    assert sorted(got) == sorted(want) and len(got) == 250
    assert sum(not v.isascii() for _, v in got) > 20
