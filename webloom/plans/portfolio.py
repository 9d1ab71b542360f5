"""Queries over the test tables, each with SQL that gives the same rows.

Whole tables, whole texts: nothing is sampled or cut but where the feature is a limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions.columns import builtin
from webloom.operators import dom
from webloom.operators.extract import extract, fields, rows
from webloom.plans.compiler import compile_text
from webloom.plans.program import Program

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def program(body: str, declarations: str = "") -> Program:
    return compile_text(
        f'extractor "page" version="2026-01-01" language-version="2026-07-15" {{\n  source "html" {{ fetch mode="http" url="https://example.invalid/{{page_id}}" }}\n  input "page_id" type="int"\n{declarations}\n{body}\n}}\n'
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def pages_query(name: str, body: str, sql: str | None, shape: Callable[[DataFrame], DataFrame] = lambda df: df, collection: str | None = None, declarations: str = "", whole: bool = False):
    """A query that runs a program over ``pages`` and shapes what comes out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = table(spark, sf_dir, "pages")
        p = program(body, declarations)
        keep = ("page_id",)
        got = extract(p, pages, keep=keep) if whole else rows(p, pages, collection, keep=keep) if collection else fields(p, pages, keep=keep)
        return shape(got)

    query(name, sql)(run)


# The text of an element as SQL sees it: the driver's pages have four named references.
_TEXT = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TRIMMED = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_TITLE = _TRIMMED.format(_TEXT.format("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
_HEADING = _TEXT.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")
_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)"
_LANG = "regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)"
_PARAGRAPHS = "len(regexp_extract_all(html, '<p>'))::bigint"

pages_query("page_title", 'field "title" type="string" required=#true { select "title"; value "text"; apply "normalize-whitespace" }', f"select page_id, {_TITLE} as title from pages")
pages_query("page_heading", 'field "heading" type="string" required=#true { select "article > h1"; value "text" }', f"select page_id, {_HEADING} as heading from pages")
pages_query("page_lang", 'field "lang" type="string" required=#true { select "html[lang]"; value "attr" name="lang" }', f"select page_id, {_LANG} as lang from pages")
_LINKS = """collection "links" min-items=1 {
  select "nav ul > li"
  field "href" type="string" required=#true { select "a[href]" match="first"; value "attr" name="href" }
  field "label" type="string" required=#true { select "a"; value "text"; apply "normalize-whitespace" }
}"""
pages_query(
    "nav_links", _LINKS,
    f"select page_id, (i - 1)::integer as pos, {_TEXT.format('hs[i]')} as href, {_TRIMMED.format(_TEXT.format('ls[i]'))} as label from (select page_id, hs, ls, unnest(range(1, len(hs) + 1)) as i from (select page_id, {_HREFS} as hs, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) as ls from pages))",
    collection="links",
)
pages_query("nav_link_counts", _LINKS, f"select n_links, count(*) as n_pages from (select len({_HREFS})::integer as n_links from pages) group by 1", lambda df: df.groupBy(F.size("links").alias("n_links")).agg(F.count("*").alias("n_pages")))
pages_query(
    "link_nth",
    """field "second" type="string" required=#true { select "nav li:nth-child(2) > a"; value "attr" name="href" }
field "last" type="string" required=#true { select "nav li:last-child a"; value "attr" name="href" }
field "after_first" type="string" required=#true { select "nav li:not(:first-child) a" match="first"; value "attr" name="href" }
field "sibling" type="string" required=#true { select "li:first-child + li > a"; value "attr" name="href" }
field "later" type="string" required=#true { select "li:first-of-type ~ li > a[href^='/']" match="first"; value "attr" name="href" }""",
    f"select page_id, second, last, second as after_first, second as sibling, second as later from (select page_id, {_TEXT.format('hs[2]')} as second, {_TEXT.format('hs[-1]')} as last from (select page_id, {_HREFS} as hs from pages))",
)
pages_query("paragraph_counts", 'collection "ps" { select "article > p"; field "t" type="string" { select "missing"; value "text" } }', f"select page_id, {_PARAGRAPHS} as n from pages", lambda df: df.select("page_id", F.size("ps").cast("long").alias("n")))
_AD = "regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)"
pages_query("ad_text", 'field "ad" type="string" required=#true { select "div.ad"; value "text" }', f"select page_id, {_TEXT.format(_AD)} as ad from pages")
# As it is serialised: references other than &amp; are characters.
_HEAD = "replace(replace(replace(regexp_extract(html, '<head>(.*?)</head>', 1, 's'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"
pages_query("page_html", 'field "head" type="string" required=#true { select "head"; value "html" }', f"select page_id, {_HEAD} as head from pages")
pages_query(
    "url_resolve_links", _LINKS.replace('name="href" }', 'name="href"; apply "url-resolve" base="https://host.example/dir/" }'),
    # Escaped as a path is: DuckDB escapes a few characters more than a path needs.
    f"select page_id, (i - 1)::integer as pos, 'https://host.example' || replace(replace(url_encode({_TEXT.format('hs[i]')}), '%2F', '/'), '%2C', ',') as href from (select page_id, hs, unnest(range(1, len(hs) + 1)) as i from (select page_id, {_HREFS} as hs from pages))",
    lambda df: df.select("page_id", "pos", "href"), "links",
)
pages_query("lang_mix", 'field "lang" type="string" required=#true { select "html"; value "attr" name="lang" }', f"select {_LANG} as lang, count(*) as n from pages group by 1", lambda df: df.groupBy("lang").agg(F.count("*").alias("n")))
pages_query(
    "match_transform", 'field "language" type="string" required=#true { select "html"; value "attr" name="lang"; apply "language" }',
    f"select page_id, case {_LANG} when 'en' then 'English' when 'de' then 'German' else 'other' end as language from pages",
    declarations='transform "language" input="string" output="string" { match { case "en" "English"; case "de" "German"; default "other" } }',
)
_CLEAN = 'field "site" type="string" required=#true { select "nav li:first-child a"; value "attr" name="href"; apply "clean" }'
_CLEAN_TRANSFORM = 'transform "clean" input="string" output="string" { pipeline { apply "replace" old="/" new=""; apply "uppercase"; apply "append" value="!" } }'
pages_query("pipeline_transform", _CLEAN, f"select page_id, upper(replace({_TEXT.format(_HREFS + '[1]')}, '/', '')) || '!' as site from pages", declarations=_CLEAN_TRANSFORM)
_FAILS = f"not regexp_matches({_LANG}, '^(en|de)$')"
_LANG_FIELD = 'field "lang" type="string{q}"{d} {{ select "html"; value "attr" name="lang"; apply "assert-enum" "en" "de"; on-error "{p}" }}'
pages_query("recover_null", _LANG_FIELD.format(q="?", d="", p="null"), f"select page_id, case when {_FAILS} then null else {_LANG} end as lang, {_FAILS} as partial from pages", lambda df: df.select("page_id", "value.lang", "partial"), whole=True)
pages_query(
    "recover_warn", _LANG_FIELD.format(q="?", d="", p="warn"), f"select page_id, code, case when code = 'W_ERROR_RECOVERED' then 'output.lang' end as path from pages, (values ('W_ERROR_RECOVERED'), ('W_PARTIAL_EXTRACTION')) w(code) where {_FAILS}",
    lambda df: df.select("page_id", F.explode("warnings").alias("w")).select("page_id", "w.code", "w.path"), whole=True,
)
pages_query("recover_default", _LANG_FIELD.format(q="", d=' default="xx"', p="default"), f"select page_id, case when {_FAILS} then 'xx' else {_LANG} end as lang, {_FAILS} as partial from pages", lambda df: df.select("page_id", "value.lang", "partial"), whole=True)
pages_query("fail_errors", _LANG_FIELD.format(q="", d=" required=#true", p="fail"), f"select page_id, 'E_TRANSFORM' as code, 'output.lang' as path from pages where {_FAILS}", lambda df: df.where("error is not null").select("page_id", "error.code", "error.path"), whole=True)
pages_query("missing_default", 'field "x" type="string" default="none" { select "table"; value "text" }\nfield "y" type="string" { select "nav"; value "attr" name="id" }', "select page_id, 'none' as x, null::varchar as y, false as partial from pages", lambda df: df.select("page_id", "value.x", "value.y", "partial"), whole=True)
pages_query(
    "row_skip", 'collection "links" on-row-error="skip" { select "nav li"; field "href" type="string" required=#true { select "a"; value "attr" name="href"; apply "assert-matches" pattern="^/t" } }',
    f"select page_id, len(list_filter(hs, lambda x: starts_with(x, '/t')))::integer as kept, len(list_filter(hs, lambda x: not starts_with(x, '/t')))::integer as dropped from (select page_id, {_HREFS} as hs from pages)",
    lambda df: df.select("page_id", F.size("value.links").alias("kept"), F.size(F.filter("warnings", lambda w: w["code"] == "W_ROW_SKIPPED")).alias("dropped")), whole=True,
)
pages_query(
    "min_max_items", 'collection "links" min-items=5 max-items=5 { select "nav li"; field "t" type="string" { select "a"; value "text" } }',
    f"select page_id, case when len({_HREFS}) <> 5 then 'E_COLLECTION_CARDINALITY' end as code from pages", lambda df: df.select("page_id", "error.code"), whole=True,
)
pages_query("selector_cardinality", 'field "t" type="string" required=#true { select "nav a"; value "text" }', "select page_id, 'E_SELECTOR_CARDINALITY' as code from pages", lambda df: df.select("page_id", "error.code"), whole=True)


@query("site_join", f"select split_part(split_part(url, '://', 2), '/', 1) as host, lang, count(*) as n from (select url, {_LANG} as lang from pages) group by 1, 2")
def _site_join(spark, sf_dir):
    # The table's own columns come along with what is extracted: no join.
    lang = fields(program('field "lang" type="string" required=#true { select "html"; value "attr" name="lang" }'), table(spark, sf_dir, "pages"), keep=("page_id", "url"))
    return lang.groupBy(F.try_parse_url("url", F.lit("HOST")).alias("host"), "lang").agg(F.count("*").alias("n"))


@query("top_headings", f"select lang, heading, page_id, rank from (select {_LANG} as lang, {_HEADING} as heading, page_id, row_number() over (partition by {_LANG} order by length({_HEADING}) desc, page_id) as rank from pages) where rank <= 3")
def _top_headings(spark, sf_dir):
    p = program('field "lang" type="string" required=#true { select "html"; value "attr" name="lang" }\nfield "heading" type="string" required=#true { select "h1"; value "text" }')
    got = fields(p, table(spark, sf_dir, "pages"), keep=("page_id",))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.length("heading").desc(), "page_id")).cast("long")
    return got.withColumn("rank", place).where("rank <= 3").select("lang", "heading", "page_id", "rank")


# <b> is never closed: in each later paragraph, and in the footer, at most three of those still open are made again.
_BOLD = """select 'b' as tag, sum(n)::bigint as n from (
    select own + least(coalesce(sum(own) over (partition by page_id order by i rows between unbounded preceding and 1 preceding), 0), 3) as n from (
        select page_id, i, case when i = len(ps) + 1 then 0 else len(regexp_extract_all(ps[i], '<b>')) end as own
        from (select page_id, ps, unnest(range(1, len(ps) + 2)) as i from (select page_id, string_split(html, '<p>')[2:] as ps from pages))))"""
_TAGS = ("a", "article", "body", "br", "div", "footer", "h1", "head", "html", "li", "meta", "nav", "p", "script", "style", "title", "ul")


@query("dom_tag_histogram", f"select tag, sum(n)::bigint as n from (select t as tag, len(regexp_extract_all(html, '<' || t || '[ >]')) as n from pages, (values {', '.join(f'({t!r})' for t in _TAGS)}) v(t)) group by 1 union all {_BOLD}")
def _dom_tags(spark, sf_dir):
    return dom.dom_nodes(table(spark, sf_dir, "pages"), text=False).groupBy("tag").agg(F.count("*").alias("n"))


_COUNTED = ("nav ul > li:nth-child(2) a", "article > p", "li + li", "h1 ~ p", "h1, div.ad")
_COUNTS_SQL = f"select page_id, 'nav ul > li:nth-child(2) a' as selector, 1::bigint as n from pages union all select page_id, 'article > p', {_PARAGRAPHS} from pages union all select page_id, 'li + li', len({_HREFS}) - 1 from pages union all select page_id, 'h1 ~ p', {_PARAGRAPHS} from pages union all select page_id, 'h1, div.ad', 2 from pages"


@query("dom_selectors", _COUNTS_SQL)
def _dom_selectors(spark, sf_dir):
    return dom.page_matches(table(spark, sf_dir, "pages"), {s: s for s in _COUNTED})


@query("dom_relational_selectors", _COUNTS_SQL)
def _dom_relational(spark, sf_dir):
    nodes = dom.dom_nodes(table(spark, sf_dir, "pages"), text=False)
    return dom.select_many(nodes, {s: s for s in _COUNTED}).groupBy("page_id", "selector").agg(F.count("*").alias("n"))


# -- each scalar built-in over a column of a table, as Columns --------------------------------------------


def builtin_query(name: str, source: str, key: str, x: Callable[[], Column], sql: str, /, *positional, label: str = "", given: str = "string", **properties):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value, failed = builtin(name, x(), *positional, _given=given, **properties)
        return table(spark, sf_dir, source).select(key, value.alias("v"), failed.alias("failed"))

    query(f"builtin_{(label or name).replace('-', '_')}", sql)(run)


def _doc(expression: str, failed: str = "false") -> str:
    return f"select doc_id, {expression} as v, {failed} as failed from documents"


_SPACES = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_text = lambda: F.col("text")
_event = lambda s, failed="false": f"select event_id, {s} as v, {failed} as failed from events"
_k = lambda: F.regexp_extract("props", "([0-9]+)", 1)
builtin_query("trim", "documents", "doc_id", _text, _doc(f"regexp_replace(regexp_replace(text, '^{_SPACES}', ''), '{_SPACES}$', '')"))
builtin_query("normalize-whitespace", "documents", "doc_id", _text, _doc(f"trim(regexp_replace(text, '{_SPACES}', ' ', 'g'))"))
builtin_query("lowercase", "documents", "doc_id", _text, _doc("lower(text)"))
builtin_query("uppercase", "documents", "doc_id", _text, _doc("upper(replace(text, 'ß', 'ss'))"))
builtin_query("replace", "documents", "doc_id", _text, _doc("replace(text, 'th', 'TH')"), old="th", new="TH")
builtin_query("replace", "documents", "doc_id", _text, _doc("case when contains(text, ' the ') then split_part(text, ' the ', 1) || ' THE ' || substr(text, strpos(text, ' the ') + 5) else text end"), label="replace-count", old=" the ", new=" THE ", count=1)
builtin_query("regex-replace", "documents", "doc_id", _text, _doc("regexp_replace(text, '([a-z]+)\\s(the|und)\\b', '\\2-\\1', 'g')"), pattern="([a-z]+)\\s(the|und)\\b", replacement="$2-$1")
builtin_query("regex-capture", "documents", "doc_id", _text, _doc("case when regexp_matches(text, '(?i)licensed under ([^.]+)') then regexp_extract(text, '(?i)licensed under ([^.]+)', 1) end"), pattern="licensed under ([^.]+)", group=1, flags="i")
builtin_query("substring", "documents", "doc_id", _text, _doc("case when length(text) > 10 then substr(text, greatest(length(text) - 10, 0) + 1, greatest(length(text) - 3 - greatest(length(text) - 10, 0), 0)) else substr(text, 1, greatest(length(text) - 3, 0)) end"), start=-10, end=-3)
builtin_query("split", "documents", "doc_id", _text, _doc("array_to_string(string_split(text, '. ')[1:3], '|')"), separator=". ", limit=3)
_split = QUERIES["builtin_split"]
QUERIES["builtin_split"] = lambda spark, sf_dir: _split(spark, sf_dir).withColumn("v", F.array_join("v", "|"))
builtin_query("join", "documents", "doc_id", lambda: F.split("text", "\n"), _doc("replace(text, chr(10), ' / ')"), separator=" / ")
builtin_query("prepend", "part", "p_partkey", lambda: F.col("p_brand"), "select p_partkey, 'brand:' || p_brand as v, false as failed from part", value="brand:")
builtin_query("append", "part", "p_partkey", lambda: F.col("p_brand"), "select p_partkey, p_brand || '/x' as v, false as failed from part", value="/x")
builtin_query("parse-int", "events", "event_id", _k, _event("case when regexp_extract(props, '([0-9]+)', 1)::int <= 50 then regexp_extract(props, '([0-9]+)', 1)::int end::integer", "regexp_extract(props, '([0-9]+)', 1)::int > 255").replace("<= 50", "<= 255"), as_="u8")
_parse_int = QUERIES["builtin_parse_int"]
QUERIES["builtin_parse_int"] = lambda spark, sf_dir: _parse_int(spark, sf_dir).withColumn("v", F.col("v").cast("int"))
_signed = lambda: F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("-"), _k())).otherwise(F.concat(_k(), F.lit(" ")))
builtin_query("parse-int", "events", "event_id", _signed, _event("case when event_id % 3 = 1 then -regexp_extract(props, '([0-9]+)', 1)::bigint end", "event_id % 3 <> 1"), label="parse-int-invalid", as_="int")
_large = lambda: F.concat(F.lit("1844674407370955"), F.lpad((F.col("event_id") % 5000).cast("string"), 4, "0"))
_large_sql = "'1844674407370955' || lpad((event_id % 5000)::varchar, 4, '0')"
builtin_query("parse-int", "events", "event_id", _large, _event(f"case when event_id % 5000 <= 1615 then {_large_sql} end", "event_id % 5000 > 1615"), label="parse-int-u64", as_="u64")
_parse_u64 = QUERIES["builtin_parse_int_u64"]
QUERIES["builtin_parse_int_u64"] = lambda spark, sf_dir: _parse_u64(spark, sf_dir).withColumn("v", F.col("v").cast("string"))
builtin_query("parse-int", "events", "event_id", lambda: F.lower(F.hex("event_id")), "select event_id, event_id as v, false as failed from events", label="parse-int-radix", as_="int", radix=16)
builtin_query("parse-float", "events", "event_id", lambda: F.concat(_k(), F.lit(".5e1")), _event("(regexp_extract(props, '([0-9]+)', 1) || '.5e1')::double"), as_="f64")
builtin_query("parse-bool", "events", "event_id", lambda: F.col("event_type"), _event("case lower(event_type) when 'click' then true when 'view' then false end", "lower(event_type) not in ('click', 'view')"), true="CLICK", false="View")
builtin_query("to-string", "lineitem", "l_orderkey", lambda: F.col("l_linenumber"), "select l_orderkey, l_linenumber::varchar as v, false as failed from lineitem", given="i32")
builtin_query("to-string", "lineitem", "l_orderkey", lambda: F.col("l_extendedprice") * F.col("l_discount"), "select l_orderkey, regexp_replace((l_extendedprice * l_discount)::varchar, '\\.0$', '') as v, false as failed from lineitem", label="to-string-float", given="f64")
builtin_query("empty-to-null", "documents", "doc_id", lambda: F.regexp_extract("text", "(CC BY[^.]*)", 1), _doc("nullif(regexp_extract(text, '(CC BY[^.]*)', 1), '')"))
builtin_query("coalesce", "documents", "doc_id", lambda: F.nullif("lang", F.lit("en")), _doc("coalesce(nullif(lang, 'en'), 'none')"), value="none")
_URL = "select page_id, {} as v, false as failed from pages"
builtin_query("url-resolve", "pages", "page_id", lambda: F.concat(F.lit("../x/"), F.col("page_id").cast("string"), F.lit("?q=1")), _URL.format("'https://h.example/a/x/' || page_id || '?q=1'"), base="https://h.example/a/b/c.html")
builtin_query("url-query", "pages", "page_id", lambda: F.col("url"), _URL.format("case when regexp_matches(url, '[?&]page=') then regexp_extract(url, '[?&]page=([^&#]*)', 1) end"), name="page")
builtin_query("url-path", "pages", "page_id", lambda: F.col("url"), _URL.format("regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"))
_odd = ("'a b/' || page_id", "'http://h/a b/' || page_id || '?x=1'", "''", "'?x=' || page_id", "'mailto:a@b'", "'http://h:99999/' || page_id", "'/x#f%zz'", "'http://u p@h/' || page_id", "'x:' || page_id", "'1:' || page_id", "'http://h/%zz'", "'/é%20' || page_id")
_odd_paths = ("'a b/' || page_id", "'/a b/' || page_id", "''", "''", "''", "'/' || page_id", "null", "null", "''", "null", "null", "'/é ' || page_id")
_odd_case = lambda xs: "case page_id % 12 " + " ".join(f"when {i} then {x}" for i, x in enumerate(xs)) + " end"
builtin_query("url-path", "pages", "page_id", lambda: F.expr(_odd_case(_odd)), f"select page_id, {_odd_case(_odd_paths)} as v, page_id % 12 in (6, 7, 9, 10) as failed from pages", label="url-path-odd")
builtin_query("url-query", "pages", "page_id", lambda: F.concat(F.lit("/p?a=x+y&n="), F.col("page_id"), F.when(F.col("page_id") % 3 == 0, ";z").when(F.col("page_id") % 3 == 1, "&q=%C3%A9&n=%41").otherwise("&%zz")), "select page_id, case when page_id % 3 = 1 then page_id::varchar end as v, page_id % 3 <> 1 as failed from pages", label="url-query-odd", name="n")
builtin_query("path-segment", "pages", "page_id", lambda: F.col("url"), _URL.format("nullif(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[-1], '')"), index=-1)
builtin_query("assert-matches", "documents", "doc_id", lambda: F.col("source"), _doc("case when regexp_matches(source, '[0-4]$') then source end", "not regexp_matches(source, '[0-4]$')"), pattern="[0-4]$")
builtin_query("assert-enum", "documents", "doc_id", lambda: F.col("lang"), _doc("case when lang in ('en', 'de') then lang end", "lang not in ('en', 'de')"), "en", "de")
builtin_query("assert-min", "lineitem", "l_orderkey", lambda: F.col("l_quantity"), "select l_orderkey, case when l_quantity >= 10 then l_quantity end as v, l_quantity < 10 as failed from lineitem", given="f64", value=10)
builtin_query("assert-max", "lineitem", "l_orderkey", lambda: F.col("l_quantity"), "select l_orderkey, case when l_quantity <= 10 then l_quantity end as v, l_quantity > 10 as failed from lineitem", given="f64", value=10)


#: The catalogue as the language defines it (fixed values): name, category, what it takes and gives, whether its arguments are
#: positional, and its properties as name:kind, with ! if required or = and the default.
_CATALOG = """values
    ('trim', 'string', 'string', 'string', false, ''), ('normalize-whitespace', 'string', 'string', 'string', false, ''), ('lowercase', 'string', 'string', 'string', false, ''),
    ('uppercase', 'string', 'string', 'string', false, ''), ('replace', 'string', 'string', 'string', false, 'old:string! new:string! count:count'),
    ('regex-replace', 'string', 'string', 'string', false, 'pattern:string! replacement:string! flags:string="" count:count'),
    ('regex-capture', 'string', 'string', 'string?', false, 'pattern:string! group:count=0 flags:string=""'), ('substring', 'string', 'string', 'string', false, 'start:int! end:int'),
    ('split', 'string', 'string', 'string[]', false, 'separator:string! limit:count'), ('join', 'string', 'string[]', 'string', false, 'separator:string!'),
    ('prepend', 'string', 'string', 'string', false, 'value:string!'), ('append', 'string', 'string', 'string', false, 'value:string!'),
    ('parse-int', 'conversion', 'string', 'as', false, 'as:string! radix:int=10'), ('parse-float', 'conversion', 'string', 'as', false, 'as:string!'),
    ('parse-bool', 'conversion', 'string', 'bool', false, 'case-sensitive:bool=#false true:string="true" false:string="false"'), ('to-string', 'conversion', 'scalar', 'string', false, ''),
    ('empty-to-null', 'conversion', 'string', 'string?', false, ''), ('coalesce', 'conversion', 'nullable', 'bare', false, 'value:scalar!'),
    ('url-resolve', 'url', 'string', 'string', false, 'base:string!'), ('url-query', 'url', 'string', 'string?', false, 'name:string! index:count=0'), ('url-path', 'url', 'string', 'string', false, ''),
    ('path-segment', 'url', 'string', 'string?', false, 'index:int!'), ('assert-matches', 'validation', 'string', 'string', false, 'pattern:string! flags:string=""'),
    ('assert-enum', 'validation', 'any', 'same', true, ''), ('assert-min', 'validation', 'number', 'same', false, 'value:number!'), ('assert-max', 'validation', 'number', 'same', false, 'value:number!')"""


@query("builtin_catalog", f"select * from ({_CATALOG}) c(name, category, takes, gives, \"positional\", properties)")
def _catalog(spark, sf_dir):
    from webloom.plans.authoring import catalog

    written = lambda a: F.concat(a["name"], F.lit(":"), a["kind"], F.when(a["required"], "!").when(a["default_value"].isNotNull(), F.concat(F.lit("="), a["default_value"])).otherwise(""))
    return catalog(spark).withColumn("properties", F.array_join(F.transform("arguments", written), " ")).drop("arguments")


from webloom.plans import cases  # noqa: E402, F401  (it adds its queries to those above)
