"""HTML trees, selectors, sanitizing, plain text and Markdown."""

import json
import time

import pytest

from millrace import InvalidArg, ItemError, batch
from millrace.errors import Fault
from millrace.functions import KERNELS, dom, selectors

PAGE = '<html><body><ul id="m"><li class="x y">One<li>Two</ul><p lang="en-GB">a <b>c</b></p><p>d</p><a href="https://a.io" data-k="v w">Go</a>'


def extract(selector, what="text", **options):
    return KERNELS["htmlExtract"](selector, what, **options).item


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("x", "<html><head></head><body>x</body></html>"),
        ("<title>a&amp;b</title><p>x<p>y", "<html><head><title>a&amp;b</title></head><body><p>x</p><p>y</p></body></html>"),
        ("<p><b>x<p>y</b>z", "<html><head></head><body><p><b>x</b></p><p><b>y</b>z</p></body></html>"),
        ("<table><tr><td>1<td>2<tr><th>3", "<html><head></head><body><table><tbody><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></tbody></table></body></html>"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<html><head></head><body><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul></body></html>"),
        ('<p>a<script>var t="</p>";</script>b', '<html><head></head><body><p>a<script>var t="</p>";</script>b</p></body></html>'),
        ("a<br/>b<img src=x>c</br>", '<html><head></head><body>a<br>b<img src="x">c<br></body></html>'),
        ("<p>a < b &lt; &copy; &#233; &nope;", "<html><head></head><body><p>a &lt; b &lt; © é &amp;nope;</p></body></html>"),
        ("<dl><dt>a<dd>b<dt>c</dl></p>", "<html><head></head><body><dl><dt>a</dt><dd>b</dd><dt>c</dt></dl><p></p></body></html>"),
        ("<table>x<tr><b>y</b><td>1", "<html><head></head><body>x<b>y</b><table><tbody><tr><td>1</td></tr></tbody></table></body></html>"),
        ("<p><table><tr><td>1</table>z", "<html><head></head><body><p></p><table><tbody><tr><td>1</td></tr></tbody></table>z</body></html>"),
        ("<svg><path d=m /><g><circle/></g></svg><p>a", '<html><head></head><body><svg><path d="m"></path><g><circle></circle></g></svg><p>a</p></body></html>'),
        ("<svg><g><div>x</div>y", "<html><head></head><body><svg><g></g></svg><div>x</div>y</body></html>"),
        ("<svg><foreignObject><p>x</p></foreignObject></svg>z", "<html><head></head><body><svg><foreignobject><p>x</p></foreignobject></svg>z</body></html>"),
        ("<a href=x/>l</a><br/>", '<html><head></head><body><a href="x/">l</a><br></body></html>'),
        ("<h1>a<h2>b", "<html><head></head><body><h1>a</h1><h2>b</h2></body></html>"),
    ],
)
def test_trees(source, want):
    assert dom.outer_html(dom.parse(source)) == want


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("li", ["One", "Two"]), ("li.x", ["One"]), ("#m > li", ["One", "Two"]), ("li + li", ["Two"]), ("ul ~ p", ["a c", "d"]), ("li:nth-child(2n+1)", ["One"]), ("p:last-of-type", ["d"]),
        ("li:not(.x)", ["Two"]), ("p:has(b)", ["a c"]), ("a[href^='https']", ["Go"]), ("a[data-k~=w], b", ["c", "Go"]), ("p[lang|=en]", ["a c"]), ("*:is(b, a)", ["c", "Go"]), ("BODY > A", ["Go"]),
        ("[class='X Y' i]", ["One"]), ("li:first-child:not(:last-child)", ["One"]), ("h1", []), ("p > b:only-child", ["c"]), (":root > body > p:nth-last-of-type(2)", ["a c"]),
    ],
)
def test_selectors(selector, want):
    assert json.loads(extract(selector, all=True)(PAGE)) == want
    assert extract(selector)(PAGE) == (want[0] if want else "")


@pytest.mark.parametrize("bad", ["li[", "", ">", "a >", "a,,b", ":nope", "li:nth-child(x)", "..a", "a:not("])
def test_bad_selectors(bad):
    with pytest.raises(InvalidArg, match="selector"):
        extract(bad)
    if bad:
        with pytest.raises(selectors.BadSelector):
            selectors.parse(bad)


def test_extraction_forms(spark):
    assert extract("li.x", "html")(PAGE) == '<li class="x y">One</li>'
    assert extract("li", {"attr": "class"}, all=True)(PAGE) == '["x y",null]'
    assert batch("htmlExtract", [PAGE, PAGE.encode(), "<i>é</i>"], "a, i", spark=spark) == ["Go", "Go", "é"]
    with pytest.raises(ItemError, match="item 1: htmlExtract: invalid utf-8"):
        batch("htmlExtract", [PAGE, b"\xff\xfe"], "a", spark=spark)
    for bad in ("words", {"attr": ""}):
        with pytest.raises(InvalidArg, match="htmlExtract"):
            extract("a", bad)


def clean(html, **policy):
    return KERNELS["sanitizeHtml"](**policy).item(html)


def test_sanitizing_by_default():
    assert clean('<b>k</b><script>x()</script><i onclick="y()">z</i><style>p{}</style>') == "<b>k</b><i>z</i>"
    assert clean('<a href="https://e.org" target=_top>x</a>') == '<a href="https://e.org" rel="noopener noreferrer">x</a>'
    for url in ("javascript:alert(1)", " java\tscript:alert(1)", "JAVASCRIPT:x", "data:text/html,x"):
        assert "href" not in clean(f'<a href="{url}">y</a>')
    assert 'href="/rel"' in clean('<a href="/rel">y</a>') and clean("a<!-- s -->b") == "ab"
    assert clean("<form><p lang=de title=t class=c>q</p></form>") == '<p lang="de" title="t">q</p>'
    assert clean("1 < 2 & 3 ümläut 🚀") == "1 &lt; 2 &amp; 3 ümläut 🚀"


def test_sanitizing_by_policy():
    assert clean("<b>k</b> <em>e</em>", allowed_tags=["b"]) == "<b>k</b> e"
    assert clean('<u title="t" data-y="2">w</u>', allowed_attrs={"*": ["data-y"]}) == '<u data-y="2">w</u>'
    assert clean('<a href="https://x" title="t" lang="en">g</a>', allowed_attrs={"a": ["href"]}) == '<a href="https://x" rel="noopener noreferrer">g</a>'
    assert clean('<a href="ftp://h">1</a> <a href="http://h">2</a>', url_schemes=["ftp"]).count("href") == 1
    assert clean("a<!-- s -->b", strip_comments=False) == "a<!-- s -->b"
    assert clean("<style>a{}</style>", allowed_tags=["style"]) == "<style>a{}</style>"
    assert clean('<a rel="me" href="https://x">y</a>', allowed_tags=["a"], allowed_attrs={"a": ["href", "rel"]}) == '<a rel="me" href="https://x">y</a>'
    for bad in ({"allowed_tags": [""]}, {"url_schemes": [""]}, {"allowed_attrs": {"": ["x"]}}, {"allowed_attrs": {"a": [""]}}):
        with pytest.raises(InvalidArg, match="sanitizeHtml"):
            KERNELS["sanitizeHtml"](**bad)


def test_plain_text():
    to_text = KERNELS["htmlToText"]().item
    assert to_text("<h2>T</h2><p>Some <b>bold</b> text<p>next<ul><li>a<li>b</ul><ol start=9><li>x<li>y</ol>") == "## T\n\nSome **bold** text\n\nnext\n\n* a\n* b\n\n9.  x\n10. y\n"
    assert to_text("<head><title>no</title></head><script>no</script><blockquote>q</blockquote>") == "> q\n"
    assert to_text('see <a href="http://x">here</a>') == "see [here][1]\n\n[1]: http://x\n"
    assert to_text("") == ""
    lines = KERNELS["htmlToText"](20).item("<p>" + " ".join(f"w{i}" for i in range(60))).splitlines()
    assert len(lines) > 8 and max(map(len, lines)) <= 20
    for bad in (0, 1001, -5, 2.5):
        with pytest.raises(InvalidArg, match="width"):
            KERNELS["htmlToText"](bad)


def test_deeply_nested_pages():
    n = 20_000
    assert KERNELS["htmlToText"]().item("<div>" * n + "x") == "x\n"
    assert clean("<div>" * n + "x").count("</div>") == n
    with pytest.raises(Fault, match="too deep"):
        KERNELS["htmlToText"]().item("<div>" * 60_000 + "x")


def test_too_narrow_is_an_item_error(spark):
    with pytest.raises(ItemError, match="item 0: htmlToText"):
        batch("htmlToText", ["<ul><li>x</ul>"], 2, spark=spark)


TABLE = "\n".join(["<table>", "<thead>", "<tr>", '<th align="left">a</th>', '<th align="right">b</th>', "</tr>", "</thead>", "<tbody>", "<tr>", '<td align="left">c</td>', '<td align="right"><code>d|e</code></td>', "</tr>", "</tbody>", "</table>", ""])


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("# Hello", "<h1>Hello</h1>\n"), ("a\nb", "<p>a\nb</p>\n"), ("A\n===", "<h1>A</h1>\n"), ("A\n---", "<h2>A</h2>\n"), ("***", "<hr />\n"), ("## a ##", "<h2>a</h2>\n"),
        ("*a **b** c*", "<p><em>a <strong>b</strong> c</em></p>\n"), ("**a*b**", "<p><strong>a*b</strong></p>\n"), ("a_b_c", "<p>a_b_c</p>\n"), ("***x***", "<p><em><strong>x</strong></em></p>\n"), ("\\*a\\*", "<p>*a*</p>\n"),
        ("`` a`b ``", "<p><code>a`b</code></p>\n"), ("a  \nb\\\nc", "<p>a<br />\nb<br />\nc</p>\n"), ("&copy; &amp; &#35;", "<p>© &amp; #</p>\n"),
        ("[l](/u \"t\")", '<p><a href="/u" title="t">l</a></p>\n'), ("![i *m*](/p)", '<p><img src="/p" alt="i m" /></p>\n'), ("[r]\n\n[R]: /x 'T'", '<p><a href="/x" title="T">r</a></p>\n'), ("[a [b](/c)](/d)", '<p>[a <a href="/c">b</a>](/d)</p>\n'),
        ("<http://x.y?a=1&b>", '<p><a href="http://x.y?a=1&amp;b">http://x.y?a=1&amp;b</a></p>\n'), ("    code\n\n    more", "<pre><code>code\n\nmore\n</code></pre>\n"), ("```py x\na<b\n```", '<pre><code class="language-py">a&lt;b\n</code></pre>\n'), ("~~~\n```", "<pre><code>```\n</code></pre>\n"),
        ("> a\nb\n> c", "<blockquote>\n<p>a\nb\nc</p>\n</blockquote>\n"), ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"), ("1. a\n\n2. b", "<ol>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ol>\n"), ("3) a\n   - b", '<ol start="3">\n<li>a\n<ul>\n<li>b</li>\n</ul>\n</li>\n</ol>\n'),
        ("- a\n\n  b\n- c", "<ul>\n<li>\n<p>a</p>\n<p>b</p>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>\n"), ("a\n1. b", "<p>a</p>\n<ol>\n<li>b</li>\n</ol>\n"), ("a\n2. b", "<p>a\n2. b</p>\n"), ("- a\n* b", "<ul>\n<li>a</li>\n</ul>\n<ul>\n<li>b</li>\n</ul>\n"),
        ("~~gone~~ ~a~", "<p><del>gone</del> <del>a</del></p>\n"), ("- [x] t\n- [ ] u", '<ul>\n<li><input type="checkbox" checked="" disabled="" /> t</li>\n<li><input type="checkbox" disabled="" /> u</li>\n</ul>\n'),
        ("www.a.b/c.", '<p><a href="http://www.a.b/c">www.a.b/c</a>.</p>\n'), ("a|b\n:-|-:\nc|`d\\|e`", TABLE),
        ("x <span>y</span>", "<p>x &lt;span&gt;y&lt;/span&gt;</p>\n"), ("[x](javascript:alert(1))", '<p><a href="">x</a></p>\n'), ("", ""),
    ],
)
def test_markdown(source, want):
    assert KERNELS["markdownToHtml"]().item(source) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("- a\n- b\n\n  [r]: /u\n- d", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>d</p>\n</li>\n</ul>\n"), ("- a\n  - b\n\n    c\n- d", "<ul>\n<li>a\n<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"),
        ("* a\n  > b\n  >\n* c", "<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n</li>\n<li>c</li>\n</ul>\n"), ("-\n  foo\n-\n  ```\n  bar\n  ```", "<ul>\n<li>foo</li>\n<li>\n<pre><code>bar\n</code></pre>\n</li>\n</ul>\n"),
        ("> ```\n> a\n\nb", "<blockquote>\n<pre><code>a\n</code></pre>\n</blockquote>\n<p>b</p>\n"), ("> a\n    - b", "<blockquote>\n<p>a\n- b</p>\n</blockquote>\n"), (">\t\tfoo", "<blockquote>\n<pre><code>  foo\n</code></pre>\n</blockquote>\n"), ("-\t\tfoo", "<ul>\n<li>\n<pre><code>  foo\n</code></pre>\n</li>\n</ul>\n"),
        ("foo\nbar\n===", "<h1>foo\nbar</h1>\n"), ("- foo\n***\n- bar", "<ul>\n<li>foo</li>\n</ul>\n<hr />\n<ul>\n<li>bar</li>\n</ul>\n"), ("*foo**bar**baz*", "<p><em>foo<strong>bar</strong>baz</em></p>\n"), ("***foo** bar*", "<p><em><strong>foo</strong> bar</em></p>\n"),
        ("**foo*bar**baz*", "<p><strong>foo*bar</strong>baz*</p>\n"), ("*(**foo**)*", "<p><em>(<strong>foo</strong>)</em></p>\n"), ("foo***", "<p>foo***</p>\n"), ("****foo*", "<p>***<em>foo</em></p>\n"), ("*foo [bar*](/u)", '<p>*foo <a href="/u">bar*</a></p>\n'),
        ("[foo [bar](/u)](/u)", '<p>[foo <a href="/u">bar</a>](/u)</p>\n'), ("![[[foo](u1)](u2)](u3)", '<p><img src="u3" alt="[foo](u2)" /></p>\n'), ("`a`` b`", "<p><code>a`` b</code></p>\n"), ("text\nh|i\n-|-\n1|2", "<p>text</p>\n<table>\n<thead>\n<tr>\n<th>h</th>\n<th>i</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td>2</td>\n</tr>\n</tbody>\n</table>\n"),
    ],
)
def test_markdown_by_the_published_specification(source, want):
    assert KERNELS["markdownToHtml"]().item(source) == want


@pytest.mark.parametrize("source", ["a*_" * 333_000, "**a" * 333_000, "> " * 500_000, "- " * 500_000 + "a", "[" * 10**6, "`a``" * 250_000, "<!--" * 250_000, "*a " * 160_000 + "b* " * 160_000, "@" * 300_000, "| " * 500_000], ids=lambda s: s[:4])
def test_markdown_of_hostile_texts_takes_linear_time(source):
    start = time.perf_counter()
    assert KERNELS["markdownToHtml"]().item(source)
    assert time.perf_counter() - start < 12


@pytest.mark.parametrize("source", ["<a " + '="x" ' * 200_000, "<a" * 500_000, "<" * 10**6, "a</x>" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<script>" + "</script " * 100_000, "<p class='" * 100_000], ids=lambda s: s[:9])
def test_hostile_pages_take_linear_time(source):
    start = time.perf_counter()
    for kernel in (KERNELS["sanitizeHtml"](), KERNELS["htmlExtract"]("p")):
        kernel.item(source)
    assert time.perf_counter() - start < 12


def test_markdown_nested_to_any_depth():
    n = 3000
    out = KERNELS["markdownToHtml"]().item("> " * n + "x")
    assert out.count("<blockquote>") == out.count("</blockquote>") == n and "<p>x</p>" in out


def test_markdown_options():
    render = lambda s, **o: KERNELS["markdownToHtml"](**o).item(s)
    assert "<del>" not in render("~~a~~", gfm=False) and "<table>" not in render("|a|\n|-|\n|b|", tables=False) and "<table>" in render("|a|\n|-|\n|b|", gfm=False, tables=True)
    assert render("x <i>y</i>", unsafe=True) == "<p>x <i>y</i></p>\n" and "&lt;script>" in render("<script>1</script>", unsafe=True) and "<script>" in render("<script>1</script>", unsafe=True, gfm=False)
    assert render('"hi" -- it\'s...', smart_punct=True) == "<p>“hi” – it’s…</p>\n" and "footnote" not in render("a[^1]\n\n[^1]: n")
    notes = render("a[^1] b[^x]\n\n[^x]: ex\n[^1]: one", footnotes=True)
    assert notes.index("one") < notes.index("ex") and notes.count("footnote-backref") >= 2


def test_markdown_then_sanitized(spark):
    from millrace import pipeline

    out = pipeline().markdown_to_html(unsafe=True, gfm=False).sanitize_html().run(["# Top\n\n<script>f()</script>\n\n*fine*"], spark)
    assert out == ["<h1>Top</h1>\n\n<p><em>fine</em></p>\n"]


def test_heading_as_it_is_written(spark, tmp_path):
    from millrace.queries import QUERIES

    heads = ["<h1>a &amp; b &quot;c&quot; &amp</h1>", "<h1>&am &lt;i&gt; &amp;amp; x > y</h1>", "<h1>1\u00a02&nbsp;3 &#233; \"q\"</h1>", "<h1>plain</h1>", ""]
    rows = [(i, f"<html><body><nav>&amp;</nav><article>{h}<p>t</article>") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {name: [r["value"] for r in QUERIES[name](spark, str(tmp_path)).orderBy("page_id").collect()] for name in ("html_extract_html", "html_extract_html_rewritten")}
    assert got["html_extract_html"] == heads
    assert got["html_extract_html_rewritten"][:2] == ['<h1>a &amp; b "c" &amp;</h1>', "<h1>&amp;am &lt;i&gt; &amp;amp; x &gt; y</h1>"]
