import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.html.tree import parse


@pytest.mark.parametrize(
    ("html", "body"),
    [
        ("<p>one<p>two", "<p>one</p><p>two</p>"), ("<ul><li>a<li>b</ul>c", "<ul><li>a</li><li>b</li></ul>c"), ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"), ("<table>x<tr><td>y</table>z", "x<table><tbody><tr><td>y</td></tr></tbody></table>z"),
        ("<table><caption>c<col><tr><th>h</table>", "<table><caption>c</caption><colgroup><col></colgroup><tbody><tr><th>h</th></tr></tbody></table>"),
        ("<p><b><i>one</b> two</i> three</p>", "<p><b><i>one</i></b><i> two</i> three</p>"), ("<b>1<p>2</b>3", "<b>1</b><p><b>2</b>3</p>"), ("<p>x<b>y<p>z", "<p>x<b>y</b></p><p><b>z</b></p>"), ("<a>1<a>2", "<a>1</a><a>2</a>"),
        ("<select><option>1<option>2</select>", "<select><option>1</option><option>2</option></select>"), ("a</p>b", "a<p></p>b"), ("<br></br>x", "<br><br>x"), ("<div>x", "<div>x</div>"), ("x<div", "x"),
        ("<svg><title>t</title><foreignobject><p>h</p></foreignobject><rect/></svg>y", "<svg><title>t</title><foreignObject><p>h</p></foreignObject><rect></rect></svg>y"), ("<svg><p>x", "<svg></svg><p>x</p>"), ("<math><mi>a<b>c</mi></math>", "<math><mi>a<b>c</b></mi></math>"),
        ("&lt;&amp;&copy;&notit;&#65;&#x80;", "&lt;&amp;©¬it;A€"), ("<i title='?a=b&copy=1&lt;'>", '<i title="?a=b&amp;copy=1<"></i>'), ("<textarea>\n<b>&amp;</textarea>", "<textarea>&lt;b&gt;&amp;</textarea>"),
        ("<pre>\nx</pre>", "<pre>x</pre>"), ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"), ("<p>a<!-- c --!>b", "<p>a<!-- c -->b</p>"), ("<?php x>y", "<!--?php x-->y"), ("<input type=hidden><hr>", '<input type="hidden"><hr>'), ("<xmp><b></xmp>", "<xmp><b></xmp>"),
        ("<button>a<button>b", "<button>a</button><button>b</button>"), ("<form>a<form>b</form>c", "<form>ab</form>c"), ("x\r\ny\rz", "x\ny\nz"), ("<P CLASS=a id='b' class=c>", '<p class="a" id="b"></p>'),
    ],
)
def test_tree(html, body):
    root = parse("<!doctype html><body>" + html)
    assert root.children[-1].children[-1].inner_html() == body


def test_head_and_raw_text():
    root = parse('<title>A &amp; B</title><script>if (a < b) "</p>" && c</script><style>p > a {}</style><p>x')
    assert root.children[0].children[0].inner_html() == '<title>A &amp; B</title><script>if (a < b) "</p>" && c</script><style>p > a {}</style>'
    assert root.text_content() == 'A & Bif (a < b) "</p>" && cp > a {}x'


@settings(max_examples=300)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<a href=x>", "</a>", "<table>", "<tr>", "<td>", "</table>", "<svg>", "<math>", "<select>", "<option>", "<li>", "</ul>", "<template>", "</template>", "<script>", "</script>", "<!--", "-->", "x", "&amp", "<form>", "<caption>", "<frameset>", "</html>", "<title>", "<nobr>", "<i>", "</i>", "<div>", "</div>", "<h1>", "<button>", "<"]), max_size=25))
def test_never_raises(parts):
    root = parse("".join(parts))
    elements = [c for c in root.children if c.tag == "html"]
    assert len(elements) == 1
    root.inner_html(), root.text_content()


@given(st.text(max_size=80))
def test_any_text(text):
    parse(text)
