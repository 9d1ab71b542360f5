"""Further queries over the test tables: the language's forms, selectors, recovery, sources and live pages."""

from __future__ import annotations

from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from webloom.html.tree import parse
from webloom.operators import browser
from webloom.operators.extract import decode, extract, fields, sink_json
from webloom.plans import portfolio as base
from webloom.plans.authoring import ExtractorBuilder, Members
from webloom.plans.compiler import compile_text
from webloom.plans.diagnostics import ExecutionError
from webloom.plans.selector import parse_selector
from webloom.sources import charset, fetch, urls
from webloom.sources.programs import compile_documents

pages_query, query, table, program = base.pages_query, base.query, base.table, base.program
TITLE, HEADING, LANG, HREFS, PARAGRAPHS, TEXT, TRIMMED = base._TITLE, base._HEADING, base._LANG, base._HREFS, base._PARAGRAPHS, base._TEXT, base._TRIMMED
_LINKS = f"len({HREFS})"
_TITLE_FIELD = 'field "title" type="string" required=#true { select "title"; value "text"; apply "normalize-whitespace" }'
_TITLE_SQL = f"select page_id, {TITLE} as title from pages"

# -- selectors: how many elements of each page match -------------------------------------------------------

_NAV = '<nav id="main" class="top menu" data-k="en-US">'


def selector_query(name: str, selector: str, sql: str) -> None:
    """Over pages whose ``nav`` has an id, classes and an attribute with a dash."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<nav>"), F.lit(_NAV)).alias("html"))
        quoted = selector.replace('"', '\\"')
        return fields(program(f'collection "c" {{ select "{quoted}"; field "t" type="string" {{ select "missing"; value "text" }} }}'), df, keep=("page_id",)).select("page_id", F.size("c").cast("long").alias("n"))

    query(f"selector_{name}", f"select page_id, ({sql})::bigint as n from pages")(run)


_HREF_TEXT = f"list_transform({HREFS}, lambda h: {TEXT.format('h')})"
for _name, _selector, _sql in (
    ("universal", "article > *", f"{PARAGRAPHS} + 1"),
    ("id", "#main > ul", "1"),
    ("class_of_several", "nav.menu.top li", _LINKS),
    ("attribute", "[data-k]", "1"),
    ("attribute_equals", "html[lang=de]", f"{LANG} = 'de'"),
    ("attribute_word", "[class~=menu] li", _LINKS),
    ("attribute_dash", "nav[data-k|=en] a", _LINKS),
    ("attribute_prefix", "a[href^='/th']", f"len(list_filter({_HREF_TEXT}, lambda h: starts_with(h, '/th')))"),
    ("attribute_suffix", "a[href$='n']", f"len(list_filter({_HREF_TEXT}, lambda h: ends_with(h, 'n')))"),
    ("attribute_part", "a[href*='an']", f"len(list_filter({_HREF_TEXT}, lambda h: contains(h, 'an')))"),
    ("only_child", "li > a:only-child", _LINKS),
    ("not_only_child", "nav > ul > li:only-child", f"{_LINKS} = 1"),
    ("empty", "meta:empty, br:empty", "1 + len(regexp_extract_all(html, '<br>'))"),
    ("last_child", "ul > li:last-child", "1"),
    ("last_of_type", "article > p:last-of-type", f"{PARAGRAPHS} > 0"),
    ("only_of_type", "article > h1:only-of-type, article > p:only-of-type", f"1 + ({PARAGRAPHS} = 1)::int"),
    ("first_of_type", "article > p:first-of-type", f"{PARAGRAPHS} > 0"),
    ("nth_child", "nav li:nth-child(5)", f"{_LINKS} >= 5"),
    ("nth_last_child", "nav li:nth-last-child(5)", f"{_LINKS} >= 5"),
    ("nth_of_type", "article > p:nth-of-type(3)", f"{PARAGRAPHS} >= 3"),
    ("nth_last_of_type", "article > p:nth-last-of-type(4)", f"{PARAGRAPHS} >= 4"),
    ("an_plus_b_odd", "nav li:nth-child(2n+1)", f"(len({HREFS}) + 1) // 2"),
    ("an_plus_b_even", "nav li:nth-child(even)", f"len({HREFS}) // 2"),
    ("an_plus_b_least", "nav li:nth-child(-n+3)", f"least({_LINKS}, 3)"),
    ("an_plus_b_third", "article > p:nth-of-type(3n+2)", f"({PARAGRAPHS} + 1) // 3"),
    ("an_plus_b_from_end", "article > p:nth-last-of-type(n+3)", f"greatest({PARAGRAPHS} - 2, 0)"),
    ("not_compound", "nav li:not(:last-child):not(:first-child)", f"greatest({_LINKS} - 2, 0)"),
    ("list", "h1, div.ad, nav li, #main", f"3 + {_LINKS}"),
    ("descendant", "body li a", _LINKS),
    ("adjacent", "nav + div.ad, div.ad + article", "2"),
    ("general_sibling", "nav ~ article, nav ~ footer", "2"),
):
    selector_query(_name, _selector, _sql)

# -- forms of the language ---------------------------------------------------------------------------------

for _name, _body in (
    ("comments", "// one line\n" + _TITLE_FIELD.replace("{ select", "{ /* a /* nested */ comment */ select") + " // end"),
    ("slashdash", '/-field "gone" type="string" { select "p"; value "text" }\n' + _TITLE_FIELD.replace("value", '/- value "html"\n value').replace('type="string"', 'type="string" /- default="x"')),
    ("raw_string", _TITLE_FIELD.replace('select "title"', 'select #"head > title:not([x="y"])"#')),
    ("escapes", _TITLE_FIELD.replace('"title" }', '"\\u{74}itle" }').replace('select "title"', 'select "\\u{74}itle"')),
    ("terminators", _TITLE_FIELD.replace("; ", "\n").replace("{ ", "{\n")),
    ("default_policy", _TITLE_FIELD.replace(" required=#true", "")),
):
    pages_query(f"language_{_name}", _body, _TITLE_SQL)
pages_query("language_numbers", 'collection "links" max-items=0x3e8 min-items=1 { select "nav li"; field "t" type="string" { select "a"; value "text"; apply "substring" start=0b0 end=0o3 } }', f"select page_id, {_LINKS}::bigint as n from pages", lambda df: df.select("page_id", F.size("links").cast("long").alias("n")))
pages_query("language_keywords", 'field "x" type="string?" required=#false { select "table"; value "text" }', "select page_id, null::varchar as x from pages")
pages_query(
    "nested_collections", 'collection "lists" { select "nav > ul"; collection "items" { select "li"; field "href" type="string" { select "a"; value "attr" name="href" } } }',
    f"select page_id, 0 as i, (i - 1)::integer as j, {TEXT.format('hs[i]')} as href from (select page_id, hs, unnest(range(1, len(hs) + 1)) as i from (select page_id, {HREFS} as hs from pages))",
    lambda df: df.select("page_id", F.posexplode("lists").alias("i", "l")).select("page_id", "i", F.posexplode("l.items").alias("j", "x")).select("page_id", "i", "j", "x.href"),
)
_MODULE = 'module "m" version="2026-01-01" language-version="2026-07-15" { transform "loud" input="string" output="string" { pipeline { apply "normalize-whitespace"; apply "append" value="!" } } }'


@query("language_imports", f"select page_id, {TITLE} || '!' as title from pages")
def _imports(spark, sf_dir):
    text = 'import "./lib/m.kdl" as="m"\nextractor "page" version="2026-01-01" language-version="2026-07-15" { source "html" { fetch mode="http" url="https://example.invalid/" }; field "title" type="string" required=#true { select "title"; value "text"; apply "m.loud" } }'
    return fields(compile_text(text, "dir/main.kdl", {"dir/lib/m.kdl": _MODULE}), table(spark, sf_dir, "pages"), keep=("page_id",))


@query("external_transform", f"select page_id, case when {LANG} = 'fr' then null else upper({LANG}) end as lang, case when {LANG} = 'fr' then 'E_EXTERNAL_TRANSFORM' end as code from pages")
def _external(spark, sf_dir):
    def shout(lang: str) -> str:
        if lang == "fr":
            raise ValueError("refused")
        return lang.upper()

    p = program('field "lang" type="string" required=#true { select "html"; value "attr" name="lang"; apply "shout" }', 'transform "shout" input="string" output="string" { external symbol="shout" }')
    return extract(p, table(spark, sf_dir, "pages"), keep=("page_id",), externals={"shout": shout}).select("page_id", "value.lang", "error.code")


@query("external_result_type", "select page_id, 'E_EXTERNAL_TRANSFORM_RESULT_TYPE' as code, 'output.lang' as path from pages")
def _external_type(spark, sf_dir):
    p = program('field "lang" type="string" required=#true { select "html"; value "attr" name="lang"; apply "number" }', 'transform "number" input="string" output="string" { external symbol="number" }')
    return extract(p, table(spark, sf_dir, "pages"), keep=("page_id",), externals={"number": len}).select("page_id", "error.code", "error.path")


pages_query(
    "recursion_guard", 'field "lang" type="string" required=#true { select "html"; value "attr" name="lang"; apply "again" }', f"select page_id, 'E_TRANSFORM_RECURSION' as code, 'output.lang' as path from pages where {LANG} <> ''",
    lambda df: df.select("page_id", "error.code", "error.path"), whole=True, declarations='transform "again" input="string" output="string" { pipeline { apply "again" } }',
)
pages_query("missing_required", 'field "x" type="string" required=#true { select "table"; value "text" }', "select page_id, 'E_REQUIRED_VALUE_MISSING' as code, 'output.x' as path from pages", lambda df: df.select("page_id", "error.code", "error.path"), whole=True)
pages_query("select_first", 'field "x" type="string" required=#true { select "nav a" match="first"; value "attr" name="href" }', f"select page_id, {TEXT.format(HREFS + '[1]')} as x from pages")
pages_query(
    "collection_required", 'collection "c" required=#true { select "nav li:nth-child(6)"; field "t" type="string" { select "a"; value "text" } }', f"select page_id, case when {_LINKS} < 6 then 'E_COLLECTION_CARDINALITY' end as code from pages",
    lambda df: df.select("page_id", "error.code"), whole=True,
)
pages_query(
    "row_error_fail", 'collection "c" { select "nav li"; field "href" type="string" required=#true { select "a"; value "attr" name="href"; apply "assert-matches" pattern="^/t" } }',
    f"select page_id, case when i is not null then 'output.c[' || (i - 1) || '].href' end as path from (select page_id, list_position(list_transform({HREFS}, lambda h: starts_with(h, '/t')), false) as i from pages)",
    lambda df: df.select("page_id", "error.path"), whole=True,
)
_DROPPED = 'collection "c" on-row-error="skip" { select "nav li"; field "w" type="string?" { select "a"; value "attr" name="href"; apply "assert-matches" pattern="^/[ei]"; on-error "warn" }\nfield "href" type="string" required=#true { select "a"; value "attr" name="href"; apply "assert-matches" pattern="^/t" } }'
pages_query(
    "warning_order", _DROPPED,
    f"""select page_id, string_agg(s, ' ' order by o, k) as warnings from (
        select page_id, i as o, 0 as k, 'W_ERROR_RECOVERED@output.c[' || (i - 1) || '].w' as s from (select page_id, hs, unnest(range(1, len(hs) + 1)) as i from (select page_id, {HREFS} as hs from pages)) where not regexp_matches(hs[i], '^/[ei]')
        union all select page_id, i, 1, 'W_ROW_SKIPPED@output.c#' || (i - 1) from (select page_id, hs, unnest(range(1, len(hs) + 1)) as i from (select page_id, {HREFS} as hs from pages)) where not starts_with(hs[i], '/t')
        union all select page_id, 1000, 2, 'W_PARTIAL_EXTRACTION@' from pages where len(list_filter({HREFS}, lambda h: not (regexp_matches(h, '^/[ei]') and starts_with(h, '/t')))) > 0) group by page_id""",
    lambda df: df.select("page_id", F.array_join(F.transform("warnings", lambda w: F.concat(w["code"], F.lit("@"), F.coalesce(w["path"], F.lit("")), F.coalesce(F.concat(F.lit("#"), w["row"].cast("string")), F.lit("")))), " ").alias("warnings")).where("warnings <> ''"),
    whole=True,
)
pages_query("partial_summary", _DROPPED, f"select page_id, len(list_filter({HREFS}, lambda h: not (regexp_matches(h, '^/[ei]') and starts_with(h, '/t')))) > 0 as partial from pages", lambda df: df.select("page_id", "partial"), whole=True)
pages_query("value_html_links", 'field "x" type="string" required=#true { select "nav ul"; value "html" }', "select page_id, regexp_extract(html, '<ul>(.*?)</ul>', 1, 's') as x from pages")
pages_query("inner_html_head", 'field "x" type="string" required=#true { select "head"; value "html" }', "select page_id, replace(replace(replace(regexp_extract(html, '<head>(.*?)</head>', 1, 's'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·') as x from pages")
pages_query("text_of_article", 'field "n" type="string" required=#true { select "footer"; value "text" }', f"select page_id, {TEXT.format(chr(39).join(['regexp_extract(html, ', '<footer>(.*?)</footer>', ', 1, ', 's', ')']))} as n from pages")


# -- compiling: a program with one defect for each nation --------------------------------------------------

_FIELD = 'field "a" type="string" required=#true { select "p"; value "text" }'
#: (what is written instead of the program's text, codes in order); the program has the form of ``_HEAD`` and a body.
_HEAD = 'extractor "t" version="2026-01-01" language-version="2026-07-15" {\n source "html" { fetch mode="http" url="https://example.invalid/" }\n'
DEFECTS: list[tuple[str, str, str]] = [
    ("none", _HEAD + _FIELD + "\n}", ""),
    ("type_annotations", _HEAD.replace("extractor", "(x)extractor") + _FIELD + "\n}", "E_TYPE_ANNOTATION_UNSUPPORTED"),
    ("error_recovery", _HEAD + "one 0x\n" + _FIELD + "\ntwo 0b\n}", "E_KDL_SYNTAX,E_KDL_SYNTAX,E_KDL_SYNTAX,E_KDL_SYNTAX"),
    ("unclosed", _HEAD + _FIELD, "E_KDL_SYNTAX"),
    ("duplicate", _HEAD + _FIELD + "\n" + _FIELD + "\n}", "E_DUPLICATE_SYMBOL"),
    ("identifier", _HEAD + _FIELD.replace('"a"', '"A b"') + "\n}", "E_IDENTIFIER_INVALID"),
    ("unknown_node", _HEAD + _FIELD + "\nbogus\n}", "E_UNKNOWN_NODE"),
    ("unknown_property", _HEAD + _FIELD.replace(" required", " x=1 required") + "\n}", "E_UNKNOWN_PROPERTY"),
    ("argument", _HEAD + _FIELD.replace(' value "text"', ' value "text"; apply "replace" old="x"') + "\n}", "E_TRANSFORM_ARGUMENT"),
    ("regex", _HEAD + _FIELD.replace(' value "text"', ' value "text"; apply "assert-matches" pattern="(?=a)"') + "\n}", "E_REGEX_INVALID"),
    ("type", _HEAD + _FIELD.replace('type="string"', 'type="strin"') + "\n}", "E_TYPE_UNKNOWN"),
    ("mismatch", _HEAD + _FIELD.replace('type="string"', 'type="u8"') + "\n}", "E_TYPE_MISMATCH"),
    ("selector", _HEAD + _FIELD.replace('"p"', '"p["') + "\n}", "E_SELECTOR_INVALID"),
    ("selector_unsupported", _HEAD + _FIELD.replace('"p"', '"p:has(b)"') + "\n}", "E_SELECTOR_UNSUPPORTED"),
    ("version_required", _HEAD.replace(' version="2026-01-01"', "") + _FIELD + "\n}", "E_DOCUMENT_VERSION_REQUIRED"),
    ("version_invalid", _HEAD.replace("2026-01-01", "2026-02-30") + _FIELD + "\n}", "E_DOCUMENT_VERSION_INVALID"),
    ("language_version", _HEAD.replace("2026-07-15", "2031-01-01") + _FIELD + "\n}", "E_LANGUAGE_VERSION_UNSUPPORTED"),
    ("input_undeclared", _HEAD.replace("invalid/", "invalid/{x}") + _FIELD + "\n}", "E_INPUT_UNDECLARED"),
    ("template", _HEAD.replace("https://example.invalid/", "/relative") + _FIELD + "\n}", "E_TEMPLATE_INVALID"),
    ("import_cycle", 'import "program.kdl" as="m"\n' + _HEAD + _FIELD + "\n}", "E_IMPORT_CYCLE"),
    ("import_remote", 'import "https://x/m.kdl" as="m"\n' + _HEAD + _FIELD + "\n}", "E_REMOTE_IMPORT_UNSUPPORTED"),
    ("capability", _HEAD + _FIELD + '\nfield "b" type="string" { evaluate-js "() => 1" scope="document" returns="string" }\n}', "E_BROWSER_CAPABILITY_REQUIRED"),
    ("shadows", _HEAD + 'transform "trim" input="string" output="string" { pipeline { apply "uppercase" } }\n' + _FIELD + "\n}", "E_TRANSFORM_SHADOWS_BUILTIN"),
    ("match", _HEAD + 'transform "m" input="string" output="string" { match { case "a" "b" } }\n' + _FIELD + "\n}", "E_MATCH_DEFAULT"),
    ("order", _HEAD + _FIELD.replace("required", "x=1 required") + "\nbogus\n" + _FIELD.replace('"a"', '"A"') + "\n}", "E_UNKNOWN_PROPERTY,E_UNKNOWN_NODE,E_IDENTIFIER_INVALID"),
]


def _documents(spark, sf_dir):
    """A program for each nation, by its key."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % len(DEFECTS)).alias("k"))
    return nations.select("n_nationkey", F.element_at(F.array(*[F.lit(text) for _, text, _ in DEFECTS]), F.col("k") + 1).alias("source"))


_CASES = "case n_nationkey % {} {} end".format(len(DEFECTS), " ".join(f"when {i} then '{codes}'" for i, (_, _, codes) in enumerate(DEFECTS)))


@query("compile_diagnostics", f"select n_nationkey, {_CASES} as codes, {_CASES} = '' as ok from nation")
def _diagnostics(spark, sf_dir):
    found = compile_documents(_documents(spark, sf_dir), "n_nationkey")
    codes = F.array_join(F.transform(F.filter("diagnostics", lambda d: d["severity"] == "error"), lambda d: d["code"]), ",")
    return found.select("n_nationkey", codes.alias("codes"), "ok")


for _k, (_name, _, _codes) in enumerate(DEFECTS):

    @query(f"compile_{_name}", f"select n_nationkey, '{_codes}' as codes from nation where n_nationkey % {len(DEFECTS)} = {_k}")
    def _defect(spark, sf_dir, k=_k):
        return _diagnostics(spark, sf_dir).where(F.col("n_nationkey") % len(DEFECTS) == k).select("n_nationkey", "codes")


@query("compile_utf8", "select n_nationkey, case when n_nationkey % 2 = 0 then 'E_KDL_SYNTAX' else '' end as codes from nation")
def _utf8(spark, sf_dir):
    text = F.lit(_HEAD + _FIELD + "\n}").cast("binary")
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(text, F.unhex(F.lit("FF")))).otherwise(text).alias("source"))
    return compile_documents(df, "n_nationkey").select("n_nationkey", F.array_join("diagnostics.code", ",").alias("codes"))


@query("compile_capabilities", "select n_nationkey, case when n_nationkey % 2 = 0 then 'http.fetch' else 'browser.navigate,browser.query,browser.read-text' end as capabilities from nation")
def _capabilities(spark, sf_dir):
    text = _HEAD + _FIELD + "\n}"
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, text).otherwise(text.replace('"http"', '"browser"')).alias("source"))
    found = compile_documents(df, "n_nationkey")
    return found.select("n_nationkey", F.array_join(F.from_json(F.get_json_object("ir", "$.capabilities"), "array<string>"), ",").alias("capabilities"))


# -- sources and sinks -------------------------------------------------------------------------------------


@query("charset_decode", f"select page_id, case page_id % 4 when 2 then null else {TITLE} end as title, case page_id % 4 when 2 then 'E_HTML_DECODE' when 3 then null end as code from pages")
def _charsets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    # As UTF-8, as UTF-16 by the content type, with a byte that UTF-8 doesn't have, and with a byte-order mark.
    body = F.when(k == 1, F.encode("html", "UTF-16LE")).when(k == 2, F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("FF")))).when(k == 3, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    kind = F.when(k == 1, "text/html; charset=utf-16le").when(k == 3, "text/html; charset=latin1")
    got = pages.select("page_id", charset.decode_column(body, kind).alias("d")).select("page_id", "d.html", "d.code")
    title = extract(program(_TITLE_FIELD), got, keep=("page_id", "code"))
    return title.select("page_id", "value.title", "code")


@query("charset_custom", _TITLE_SQL)
def _charset_custom(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode(F.concat(F.lit("<title>"), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("</title>")), "UTF-8").alias("b"))
    got = pages.select("page_id", charset.decode_column(F.col("b"), F.lit("text/html; charset=x-loud"), {"x-loud": lambda b: b.decode()}).alias("d")).select("page_id", F.col("d.html").alias("html"))
    return fields(program(_TITLE_FIELD), got, keep=("page_id",))


@query("body_limit", "select page_id, case when octet_length(encode(html)) > 4096 then 'E_HTTP_BODY_TOO_LARGE' end as code from pages")
def _limit(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", charset.decode_column(F.encode("html", "UTF-8"), max_bytes=4096)["code"].alias("code"))


_TEMPLATE = compile_text('extractor "u" version="2026-01-01" language-version="2026-07-15" { source "html" { fetch mode="http" url="https://e.invalid/{id}/{title}?l={l}" }; input "id" type="int"; input "title" type="string"; input "l" type="string" required=#false default="ja"; field "t" type="string" { select "p"; value "text" } }')


@query("url_template", f"select page_id, 'https://e.invalid/' || page_id || '/' || url_encode({TITLE}) || '?l=ja' as url from pages")
def _template(spark, sf_dir):
    titles = fields(program(_TITLE_FIELD), table(spark, sf_dir, "pages"), keep=("page_id",))
    return titles.select("page_id", urls.url_column(_TEMPLATE, {"id": F.col("page_id"), "title": F.col("title")}).alias("url"))


@query("runtime_inputs", "select n_nationkey, case n_nationkey % 4 when 0 then 'https://e.invalid/' || n_nationkey || '/' || url_encode(n_name) || '?l=ja' when 1 then 'E_INPUT_REQUIRED' when 2 then 'E_INPUT_UNKNOWN' else 'E_INPUT_TYPE' end as got from nation")
def _inputs(spark, sf_dir):
    @F.udf("string", useArrow=True)
    def expanded(k: int, name: str) -> str:
        given = ({"id": k, "title": name}, {"id": k}, {"id": k, "title": name, "z": 1}, {"id": str(k), "title": name})[k % 4]
        try:
            return urls.expand_url(_TEMPLATE, given)
        except ExecutionError as e:
            return e.code

    return table(spark, sf_dir, "nation").select("n_nationkey", expanded("n_nationkey", "n_name").alias("got"))


@query(
    "url_policy",
    "select page_id, case page_id % 5 when 1 then 'address is not global' when 2 then 'scheme is not http or https' when 3 then 'URL carries a user' when 4 then 'host is local' end as refused from pages",
)
def _policy(spark, sf_dir):
    k = F.col("page_id") % 5
    address = F.concat(F.lit("http://10.0.0."), F.col("page_id") % 256, F.lit("/x"))
    url = F.when(k == 1, address).when(k == 2, F.replace("url", F.lit("http"), F.lit("ftp"))).when(k == 3, F.lit("https://u:p@example.com/")).when(k == 4, F.lit("http://a.localhost/")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.public_internet_column(url).alias("refused"))


@query("fetch_stage", "select page_id, case when page_id % 3 = 0 then null else 200 end as status, case when page_id % 3 = 0 then 'E_HTTP_STATUS' end as code, case when page_id % 3 = 0 then null else length(url) end::bigint as n from pages")
def _fetch(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("&fail="), (F.col("page_id") % 3 == 0).cast("string")).alias("url"))

    def answer(url, session, options):
        if url.endswith("true"):
            raise ExecutionError("E_HTTP_STATUS", "status 500")
        return {"status": 200, "content_type": "text/html", "body": url[: url.rindex("&fail=")].encode()}

    # The key comes along: addresses needn't be distinct.
    got = fetch.fetch(pages, keep=("page_id",), options=fetch.Options(policy=None), fetcher=answer)
    return got.select("page_id", "status", "code", F.length(F.decode("body", "UTF-8")).cast("long").alias("n"))


@query("sink_json", f"select page_id, '{{\"lang\":\"' || {LANG} || '\",\"x\":null}}' as json from pages")
def _sink(spark, sf_dir):
    p = program('field "lang" type="string" { select "html"; value "attr" name="lang" }\nfield "x" type="string" { select "table"; value "text" }')
    got = extract(p, table(spark, sf_dir, "pages"), keep=("page_id",))
    return sink_json(got.select(F.struct(F.col("page_id"), F.col("value")).alias("record")), "record").select(F.get_json_object("json", "$.page_id").cast("long").alias("page_id"), F.get_json_object("json", "$.value").alias("json"))


@query("decode_schema", f"select {LANG} as lang, null::varchar as x, count(*) as n from pages group by 1")
def _decode(spark, sf_dir):
    p = program('field "lang" type="string" { select "html"; value "attr" name="lang" }\nfield "x" type="string" { select "table"; value "text" }')
    got = decode(extract(p, table(spark, sf_dir, "pages"), keep=("page_id",)), p.schema)
    return got.groupBy("lang", "x").agg(F.count("*").alias("n"))


# -- live pages, by an adapter that finds the page in the address ------------------------------------------


class PageInAddress:
    """An adapter without a browser: the page's HTML is a parameter of its address; scripts are names of readings."""

    def navigate(self, url):
        self.root, self.steps = parse(parse_qs(urlsplit(url).query)["html"][0]), []

    def click(self, selector, timeout_ms):
        self.steps.append(selector)

    def scroll(self, x, y):
        self.steps.append((x, y))

    def evaluate(self, script, element, timeout_ms):
        return {"links": len(parse_selector("nav a").query(self.root)), "steps": float(len(self.steps)), "tag": element.tag if element is not None else None}[script]

    def query_all(self, scope, selector, limit):
        return parse_selector(selector).query(scope or self.root, limit)

    def text(self, element):
        return element.text_content()

    def html(self, element):
        return element.inner_html()

    def attribute(self, element, name):
        return element.attrs.get(name)

    def close(self):
        pass


def _live(spark, sf_dir, body: str, **options):
    text = 'extractor "b" version="2026-01-01" language-version="2026-07-15" {\n source "html" { fetch mode="browser" url="https://e.example/{page_id}?html={html}"; workflow { click ".go" timeout-ms=5; scroll 0 10 } }\n input "page_id" type="int"\n input "html" type="string"\n' + body + "\n}"
    return browser.extract_live(compile_text(text), table(spark, sf_dir, "pages").select("page_id", "html"), PageInAddress, **options)


@query("live_links", f"select page_id, (i - 1)::integer as pos, {TEXT.format('hs[i]')} as href from (select page_id, hs, unnest(range(1, len(hs) + 1)) as i from (select page_id, {HREFS} as hs from pages))")
def _live_links(spark, sf_dir):
    got = _live(spark, sf_dir, 'collection "links" { select "nav li"; field "href" type="string" required=#true { select "a"; value "attr" name="href" } }')
    return got.select("page_id", F.posexplode("value.links").alias("pos", "x")).select("page_id", "pos", "x.href")


@query("live_script", f"select page_id, {_LINKS}::bigint as links, 2::bigint as steps, 'article' as tag from pages")
def _live_script(spark, sf_dir):
    body = 'field "links" type="int" required=#true { evaluate-js "links" scope="document" returns="int" }\nfield "steps" type="int" required=#true { evaluate-js "steps" scope="document" returns="int" }\nfield "tag" type="string" required=#true { select "article"; evaluate-js "tag" scope="current" returns="string" }'
    return _live(spark, sf_dir, body, allow_javascript=True).select("page_id", F.col("value.links").cast("long").alias("links"), F.col("value.steps").cast("long").alias("steps"), "value.tag")


@query("live_script_type", "select page_id, 'E_JAVASCRIPT_RESULT_TYPE' as code, 'output.x' as path from pages")
def _live_type(spark, sf_dir):
    return _live(spark, sf_dir, 'field "x" type="string" required=#true { evaluate-js "links" scope="document" returns="string" }', allow_javascript=True).select("page_id", "error.code", "error.path")


@query("live_script_gate", "select page_id, 'E_JAVASCRIPT_DISABLED' as code from pages")
def _live_gate(spark, sf_dir):
    return _live(spark, sf_dir, 'field "x" type="int" required=#true { evaluate-js "links" scope="document" returns="int" }').select("page_id", "error.code")


@query("live_cardinality", f"select page_id, case when {_LINKS} > 1 then 'E_SELECTOR_CARDINALITY' end as code from pages")
def _live_cardinality(spark, sf_dir):
    return _live(spark, sf_dir, 'field "x" type="string" required=#true { select "nav a"; value "text" }').select("page_id", "error.code")


# -- writing programs, and what is decided before a page is read -------------------------------------------


@query("kdl_writing", f"select page_id, {TITLE} as title, case {LANG} when 'en' then 'say \"hi\"' else 'other' end as greeting, {_LINKS}::bigint as n from pages")
def _writing(spark, sf_dir):
    b = ExtractorBuilder("made", "https://example.invalid/{page_id}").input("page_id", "int")
    b.pipeline("clean", "string", "string", ["normalize-whitespace", ("replace", [], {"old": "\u0000", "new": ""})]).match("greet", "string", "string", {"en": 'say "hi"'}, "other")
    b.field("title", "string", "title", required=True, apply=["clean"]).field("greeting", "string", "html", attr="lang", required=True, apply=["greet"])
    b.collection("links", "nav li", Members().field("href", "string", "a", attr="href"), min_items=1)
    return fields(compile_text(b.text()), table(spark, sf_dir, "pages"), keep=("page_id",)).select("page_id", "title", "greeting", F.size("links").cast("long").alias("n"))


@query("transforms_unused", "select n_nationkey, 'browser.navigate,browser.query,browser.read-text,transform.external:nobody' as capabilities, 'E_EXTERNAL_TRANSFORM_MISSING' as code from nation")
def _unused(spark, sf_dir):
    # An external that nothing refers to still needs its host.
    text = _HEAD.replace('"http"', '"browser"') + 'transform "unused" input="string" output="string" { external symbol="nobody" }\n' + _FIELD + "\n}"
    try:
        extract(compile_text(text), table(spark, sf_dir, "pages"))
        code = None
    except ExecutionError as e:
        code = e.code
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(text).alias("source"))
    found = compile_documents(df, "n_nationkey")
    return found.select("n_nationkey", F.array_join(F.from_json(F.get_json_object("ir", "$.capabilities"), "array<string>"), ",").alias("capabilities"), F.lit(code).alias("code"))


@query("snapshot_of_browser_program", f"select page_id, {TITLE} as title from pages")
def _snapshot(spark, sf_dir):
    text = _HEAD.replace('"http"', '"browser"') + _TITLE_FIELD + "\n}"
    return fields(compile_text(text), table(spark, sf_dir, "pages"), keep=("page_id",))


@query("snapshot_gate", "select n_nationkey, case n_nationkey % 3 when 0 then 'E_SNAPSHOT_UNSUPPORTED at source.workflow' when 1 then 'E_SNAPSHOT_UNSUPPORTED at output.x' else 'none' end as refused from nation")
def _gate(spark, sf_dir):
    script = 'field "x" type="int" required=#true { evaluate-js "links" scope="document" returns="int" }'
    head = _HEAD.replace('"http"', '"browser"')
    texts = (head.replace("/\" }", "/\"; workflow { click \".go\" } }") + _FIELD + "\n}", head + script + "\n}", head + _FIELD + "\n}")

    def refused(text: str) -> str:
        try:
            extract(compile_text(text), table(spark, sf_dir, "pages"))
        except ExecutionError as e:
            return f"{e.code} at {e.path}"
        return "none"

    said = F.array(*[F.lit(refused(t)) for t in texts])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(said, F.col("n_nationkey") % 3 + 1).alias("refused"))


@query("session_policy", "select n_nationkey, case n_nationkey % 6 when 0 then 'none' when 1 then 'none' when 2 then 'none' when 3 then 'given' when 4 then 'E_SESSION_REQUIRED' else 'given' end as got from nation")
def _session(spark, sf_dir):
    def passed(policy: str, given: fetch.Session | None) -> str:
        p = compile_text(_HEAD.replace('/" }', f'/"; session policy="{policy}" }}') + _FIELD + "\n}")
        try:
            return "none" if fetch.session_for(p, given) is None else "given"
        except ExecutionError as e:
            return e.code

    said = F.array(*[F.lit(passed(policy, given)) for policy in ("none", "optional", "required") for given in (None, fetch.Session(headers={"A": "b"}))])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(said, F.col("n_nationkey") % 6 + 1).alias("got"))
