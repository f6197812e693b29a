import re

import pytest
from flowquery.llm import html_text
from flowquery.llm.html_text import visible_text
from hypothesis import given, settings
from hypothesis import strategies as st

CASES = [
    (None, ""), ("", ""), ("a<b", "a<b"), ("<p>one<p>two", "one\n\ntwo"), ("x<br>y", "x\ny"), ("<b>a</b> <i>b</i>c", "a bc"),
    ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"), ("<pre>  k\n   t</pre>", "  k\n   t"),
    ("<div hidden>n</div><p style='display: none'>n</p><script>var t='</p>'</script>y", "y"), ("<head><title>t</title></head>b", "b"),
    ("<table><tr><th>N<th>Name<tr><td>1<td>Alpha<tr><td colspan=2>wide one<tr><td rowspan=2>r<td>s<tr><td>t</table>", "N  Name\n1  Alpha\nwide one\nr  s\n   t"),
    ("<details><summary>s</summary>n</details>", "s"), ("<details open><summary>s</summary>n</details>", "s\nn"), ("&amp;&nbsp;&copy;", "& ©"),
    ("<dl><dt>T<dd>d</dl>", "T\n  d"), ("<td>x</td><li>y", "x\n- y"), ("</p></div>x</b>", "x"), ("<div>" * 5000 + "x", "x"), ("<table><tr><td>a", "a"), ("<!-- c -->x<!--", "x"),
    ("<p style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</p>d", "b\n\nd"), ("<p style='display:none;display:block'>x", "x"),
    ("<p style='display:block!important;display:none'>x", "x"), ("<p hidden style='display:block'>x", "x"), ("<p style='--display:none'>x", "x"),
    ("<style>.x{display:none} #a.x, div > b {display: none /* c */}</style><p class='y x'>n</p><div><b>n</b><i><b>s</b></i></div>", "s"),
    ("<style>p{display:none} p.y{display:block} @media print{b{display:none}} @media screen{i{display:none}}</style><p>n<p class=y>s <b>t</b><i>n</i>", "s t"),
    ("<style>div p b[lang=x] {visibility:hidden} a:hover{display:none}</style><div><p><b lang=x>n</b><b lang=y>s</b><a>t</a></div>", "st"),
    ("<style>p{display:none}</style><p style='display:block'>x<style>q</style>", "x"), ("<style>p{display:none!important}</style><p style='display:block'>x", ""),
    ("<ol reversed><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n6. c"), ("<ol><li style='visibility:hidden'>a<li>b</ol>", "2. b"),
    ("<input value=v> <input type=hidden value=n><input type=submit value=Go><input type=checkbox value=n>", "v Go"),
    ("<table><tr><td>日本<td>a<tr><td>xy<td>b</table>", "日本  a\nxy    b"), ("<table><tr><td rowspan=0>r<td>s<tr><td>t<tbody><tr><td>u</table>", "r  s\n   t\nu"),
    ("<table>" + "<tr><td rowspan=3000>r<td>s" + "<tr><td>t" * 2999 + "<tr><td>u</table>", "r  s" + "\n   t" * 2999 + "\nu"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_layout(html, text):
    assert visible_text(html) == text


WORDS = st.text("abc", min_size=1, max_size=3)
TREES = st.recursive(WORDS, lambda inner: st.tuples(st.sampled_from(["p", "div", "b", "ul", "li", "td", "table"]), st.sampled_from(["", "none", "hidden", "visible"]), st.lists(inner, max_size=4)), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(st.lists(TREES, max_size=4), st.booleans())
def test_all_visible_words_and_no_others(trees, by_class):
    """The words of the page in order, against a walk over the tree that it was made from."""
    prop = {"none": "display:none", "hidden": "visibility:hidden", "visible": "visibility:visible"}

    def source(x):
        if isinstance(x, str):
            return f"<i> {x} </i>"
        tag, how, inner = x
        style = "" if not how else f" class={how}" if by_class else f" style='{prop[how]}'"
        return f"<{'span' if tag in ('li', 'td') else 'div' if tag in ('p', 'table') else tag}{style}>{''.join(map(source, inner))}</{'span' if tag in ('li', 'td') else 'div' if tag in ('p', 'table') else tag}>"

    def shown(x, visible=True):
        if isinstance(x, str):
            return [x] * visible
        _, how, inner = x
        return [] if how == "none" else [w for y in inner for w in shown(y, {"hidden": False, "visible": True}.get(how, visible))]

    sheet = "<style>" + "".join(f".{k}{{{v}}}" for k, v in prop.items()) + "</style>"
    assert re.findall("[abc]+", visible_text(sheet * by_class + "".join(map(source, trees)))) == [w for x in trees for w in shown(x)]


def test_long_pages():
    text = visible_text("<style>.n{display:none}</style>" + "<p>word <span class=n>no</span> word" * 30_000)
    assert text.count("word") == 60_000 and "no" not in text


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", None), (None, None, "<b>x</b>")], "page_id long, url string, html string").selectExpr("*", "1 AS text")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(pages).collect()) == [(0, "x"), (1, ""), (1, "a")]
    assert html_text.extract(pages.limit(0)).count() == 0
