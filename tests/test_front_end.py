"""KDL, types, selectors, diagnostics and the intermediate form."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from webloom.html.tree import parse
from webloom.plans.authoring import ExtractorBuilder, Members
from webloom.plans.compiler import compile_text, diagnose
from webloom.plans.diagnostics import CompileError
from webloom.plans.kdl import parse_kdl
from webloom.plans.selector import SelectorError, parse_selector
from webloom.plans.types import STRING, assignable, literal_fits, parse_type

HEAD = 'extractor "t" version="2026-01-01" language-version="2026-07-15" {\n  source "html" { fetch mode="http" url="https://example.invalid/" }\n'


def program(body, **options):
    return compile_text(HEAD + body + "\n}\n", **options)


def codes(body, mode="http", **options):
    head = HEAD.replace('"http"', f'"{mode}"')
    return [d.code for d in diagnose(head + body + "\n}\n", **options)[1] if d.severity == "error"]


@pytest.mark.parametrize(
    ("text", "value"),
    [('"a\\n\\u{41}"', "a\nA"), ('#"a\\b"#', "a\\b"), ('##"x"#y"##', 'x"#y'), ('#"""\n a\n b\n"""#', " a\n b"), ("0x1F", 31), ("-0b101", -5), ("0o17", 15), ("1_000", 1000), ("1.5e2", 150.0), ("#true", True), ("#null", None), ("-9223372036854775808", -(2**63))],
)
def test_values(text, value):
    nodes, found = parse_kdl("f", f"n {text}\n")
    assert not found and nodes[0].args[0].value == value and type(nodes[0].args[0].value) is type(value)


def test_structure_and_slashdash():
    nodes, found = parse_kdl("f", '/* a /* b */ */ a 1 k="v" /- 2 /- x=3 { b; /- c { d }\n e } // end\n/- gone { x }\nlast')
    assert not found and [n.name for n in nodes] == ["a", "last"]
    assert [v.value for v in nodes[0].args] == [1] and nodes[0].props[0][0] == "k" and [c.name for c in nodes[0].children] == ["b", "e"]


@pytest.mark.parametrize("text", ['n "a\nb', 'n "\\q"', "n 0x", "n 99999999999999999999", "n 1e999", "n {", "}", "n @", "/- /- n", 'n #"a', "/* x"])
def test_syntax_errors(text):
    assert {d.code for d in parse_kdl("f", text)[1]} == {"E_KDL_SYNTAX"}


def test_utf8_gate_and_annotations():
    assert [d.code for d in parse_kdl("f", b"n \xff")[1]] == ["E_KDL_SYNTAX"]
    assert [d.code for d in parse_kdl("f", "(t)n (u)1")[1]] == ["E_TYPE_ANNOTATION_UNSUPPORTED"] * 2


@given(st.text(max_size=60))
def test_parser_never_raises(text):
    parse_kdl("f", text)


@given(st.text(alphabet='extractorfield "{}=;\n/-#1', max_size=80))
def test_compiler_never_raises(text):
    diagnose(text)


def test_types():
    t = parse_type
    assert str(t("string?[]")) == "string?[]" and t("(string[])?").nullable and t("u8[]?").of.kind == "array"
    assert assignable(t("u8"), t("u8?")) and assignable(t("string[]"), t("string?[]")) and assignable(t("i8"), t("unknown")) and assignable(t("u8?"), t("u8?"))
    assert not assignable(t("string?"), STRING) and not assignable(t("u8"), t("u16"))
    assert literal_fits(None, t("u8?")) and not literal_fits(1, t("u8")) and literal_fits(1, t("int")) and literal_fits(1.5, t("float"))
    for bad in ("string??", "strin", "u8[", "(u8", "", "u8]"):
        with pytest.raises(ValueError):
            t(bad)


PAGE = parse(
    '<div id=a class="x y" data-k="en-US"><p class=x>1</p><span></span><p>2</p><b>3</b></div><div id=b><ul><li>A<li class=y>B<li>C<li>D</ul><p lang=en>x<!--c--></p><i><!--c--></i></div>'
)


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("p", ["1", "2", "x"]), ("P.x", ["1"]), ("#a > p", ["1", "2"]), ("div p", ["1", "2", "x"]), ("p + span ~ b", ["3"]), ("span + p", ["2"]), ("li:nth-child(2n+1)", ["A", "C"]), ("li:nth-child(odd)", ["A", "C"]),
        ("li:nth-last-child(1)", ["D"]), ("li:nth-child(-n+2)", ["A", "B"]), ("p:first-of-type", ["1", "x"]), ("p:last-of-type", ["2", "x"]), ("b:only-of-type", ["3"]), ("p:nth-of-type(2)", ["2"]), ("p:nth-last-of-type(2)", ["1"]),
        ("li:not(.y)", ["A", "C", "D"]), ("li:first-child, li:last-child", ["A", "D"]), ("[data-k|=en] p", ["1", "2"]), ("[class~=y]", ["12 3".replace(" ", ""), "B"]), ("div[id^=a] b", ["3"]), ("div[id$='b'] p", ["x"]), ('[lang*="e"]', ["x"]),
        ("span:empty", [""]), ("i:empty", [""]), ("ul:only-child", []), ("html > body > div > ul > li.y", ["B"]), ("*[lang]", ["x"]), ("p[lang^='']", ["x"]), (".missing", []),
    ],
)
def test_selectors(selector, texts):
    assert [n.text_content() for n in parse_selector(selector).query(PAGE)] == texts


def test_selector_limits_and_scope():
    s = parse_selector("li")
    assert [n.text_content() for n in s.query(PAGE, 2)] == ["A", "B"]
    first = parse_selector("#b").query(PAGE)[0]
    assert not parse_selector("#b").query(first) and len(parse_selector("#b li").query(first)) == 4


@pytest.mark.parametrize(("selector", "unsupported"), [("p::before", True), (":has(a)", True), ("p:is(a)", True), ("[a=b i]", True), ('[a="b"i]', False), ("", False), ("a >", False), ("#a#b", False), ("[a", False), (":nth-child(x)", False), ("a,,b", False)])
def test_bad_selectors(selector, unsupported):
    with pytest.raises(SelectorError) as e:
        parse_selector(selector)
    assert e.value.unsupported == unsupported


F = 'field "a" type="string" required=#true { select "p"; value "text" }'


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (F, []), (F + "\n" + F, ["E_DUPLICATE_SYMBOL"]), ('field "A" type="string" { select "p"; value "text" }', ["E_IDENTIFIER_INVALID"]), ('field "a" { select "p"; value "text" }', ["E_FIELD_TYPE_REQUIRED"]),
        ('field "a" type="strin" { select "p"; value "text" }', ["E_TYPE_UNKNOWN"]), ('field "a" type="string" { select "p" }', ["E_VALUE_SOURCE_MISSING"]), ('field "a" type="string" { value "text" }', ["E_SELECTOR_REQUIRED"]),
        ('field "a" type="string" { select "p"; value "text"; value "html" }', ["E_VALUE_SOURCE_MULTIPLE"]), ('field "a" type="string" { select "p"; value "attr" }', ["E_ATTRIBUTE_NAME_REQUIRED"]),
        ('field "a" type="string" { select "p:has(b)"; value "text" }', ["E_SELECTOR_UNSUPPORTED"]), ('field "a" type="string" { select "p["; value "text" }', ["E_SELECTOR_INVALID"]),
        ('field "a" type="u8" { select "p"; value "text" }', ["E_TYPE_MISMATCH"]), ('field "a" type="u8" { select "p"; value "text"; apply "trim" }', ["E_TRANSFORM_TYPE_MISMATCH"]),
        ('field "a" type="string" { select "p"; value "text"; apply "nope" }', ["E_TRANSFORM_UNKNOWN"]), ('field "a" type="string" { select "p"; value "text"; apply "trim" x=1 }', ["E_UNKNOWN_PROPERTY"]),
        ('field "a" type="string" { select "p"; value "text"; apply "replace" old="x" }', ["E_TRANSFORM_ARGUMENT"]), ('field "a" type="string" { select "p"; value "text"; apply "assert-matches" pattern="(?=a)" }', ["E_REGEX_INVALID"]),
        ('field "a" type="string" required=#true { select "p"; value "text"; on-error "warn" }', ["E_ERROR_POLICY_INVALID"]), ('field "a" type="string" { select "p"; value "text"; on-error "default" }', ["E_ERROR_POLICY_INVALID"]),
        ('field "a" type="string" required=#true default="x" { select "p"; value "text" }', ["E_DEFAULT_INVALID"]), ('collection "c" { select "p" }', ["E_COLLECTION_EMPTY_SCHEMA"]),
        ('collection "c" min-items=3 max-items=2 { select "p"; ' + F + " }", ["E_COLLECTION_BOUNDS"]), ('transform "trim" input="string" output="string" { pipeline { apply "trim" } }', ["E_TRANSFORM_SHADOWS_BUILTIN"]),
        ('transform "m" input="string" output="string" { match { case "a" "b"; case "a" "c"; default "d" } }', ["E_MATCH_DUPLICATE_CASE"]), ('transform "m" input="string" output="string" { match { case "a" "b" } }', ["E_MATCH_DEFAULT"]),
        ('field "a" type="string" { evaluate-js "() => 1" scope="document" returns="string" }', ["E_BROWSER_CAPABILITY_REQUIRED"]), ('input "x" type="string" default="a"', ["E_INPUT_REQUIRED_DEFAULT"]), ("bogus", ["E_UNKNOWN_NODE"]),
        ('field "a" type="string" x=1 { select "p"; value "text" }', ["E_UNKNOWN_PROPERTY"]), ('field "a" type="string" type="string" { select "p"; value "text" }', ["E_DUPLICATE_PROPERTY"]),
    ],
)
def test_compiler_codes(body, want):
    assert codes(body) == want


@pytest.mark.parametrize(("url", "want"), [("https://e.invalid/{x}", ["E_INPUT_UNDECLARED"]), ("https://e.invalid/{", ["E_TEMPLATE_INVALID"]), ("/relative", ["E_TEMPLATE_INVALID"]), ("https://e.invalid/{{x}}", [])])
def test_url_templates(url, want):
    text = HEAD.replace("https://example.invalid/", url) + F + "\n}"
    assert [d.code for d in diagnose(text)[1]] == want


MODULE = 'module "m" version="2026-01-01" language-version="2026-07-15" { transform "shout" input="string" output="string" { pipeline { apply "uppercase"; apply "append" value="!" } } }'


def test_imports():
    text = 'import "./lib/m.kdl" as="m"\n' + HEAD + 'field "a" type="string" required=#true { select "p"; value "text"; apply "m.shout" }\n}'
    p = compile_text(text, "dir/main.kdl", {"dir/lib/m.kdl": MODULE})
    assert [c.target for c in p.members[0].calls] == ["dir/lib/m.kdl#transform:shout"]
    for first, code in (('import "https://x/m.kdl" as="m"', "E_REMOTE_IMPORT_UNSUPPORTED"), ('import "m.kdl"', "E_IMPORT_ALIAS_REQUIRED"), ('import "main.kdl" as="m"', "E_IMPORT_CYCLE")):
        with pytest.raises(CompileError) as e:
            compile_text(first + "\n" + HEAD + F + "\n}", "main.kdl", {"m.kdl": MODULE})
        assert e.value.diagnostics[0].code == code


def test_versions():
    for old, new, code in (('version="2026-01-01" ', "", "E_DOCUMENT_VERSION_REQUIRED"), ("2026-01-01", "2026-02-30", "E_DOCUMENT_VERSION_INVALID"), ("2026-07-15", "2027-01-01", "E_LANGUAGE_VERSION_UNSUPPORTED")):
        assert [d.code for d in diagnose(HEAD.replace(old, new, 1) + F + "\n}")[1]] == [code]


def test_ir_and_schema():
    p = program('field "n" type="u8" { select "p"; value "text"; apply "parse-int" as="u8" }\ncollection "c" { select "li"; ' + F + " }")
    assert p.schema.simpleString() == "struct<n:smallint,c:array<struct<a:string>>>"
    ir = json.loads(p.ir_json())
    assert ir["capabilities"] == ["http.fetch"] and ir["output"]["members"][0]["effectiveType"]["kind"] == "nullable"
    assert p.descriptor() == {"source": {"fetchMode": "http", "urlTemplate": "https://example.invalid/", "sessionPolicy": "none"}}
    assert p.ir_json() == json.dumps(ir, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_writing_programs():
    b = ExtractorBuilder("made", "https://example.invalid/{id}", mode="browser", session="optional").input("id", "int").step("wait-for", ".x", state="visible", timeout_ms=5)
    b.match("m", "string", "string", {"a\"b\n": "c"}, "d").pipeline("p", "string", "string", ["trim", ("replace", [], {"old": "a", "new": "b"})])
    b.field("t", "string", "h1", required=True, apply=["p", "m"]).collection("rows", "li", Members().field("h", "string", "a", attr="href", match="first"), min_items=1, on_row_error="skip")
    p = b.build()
    assert p.workflow[0].kind == "wait-for" and len(p.transforms) == 2 and p.members[1].skip_rows and b.text() == b.text()
    assert [c for c in p.capabilities] == ["browser.navigate", "browser.query", "browser.read-attr", "browser.read-text", "browser.wait"]
    with pytest.raises(ValueError):
        b.field("z", "string", "p", apply=[("trim", [], {"x": 1})])
