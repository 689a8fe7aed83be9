import os
import random
import re
import time
from html import unescape

import pandas as pd
import pytest

from gleanery.llm import wrappers

SCHEMA = "page_id long, url string, html string, host string, wrapper int"


def page(rng, style):
    """A page and the article that it was made from."""
    word = lambda: rng.choice(["alpha", "béta", "gamma", "delta &amp; co", "<i>eps</i>", "&#233;ta", "a\n b"])
    plain = lambda t: " ".join(t.replace("&amp;", "&").replace("<i>", "").replace("</i>", "").replace("&#233;", "é").split())
    title, parts = word(), [" ".join(word() for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 6))]
    menu = "".join(f'<li><a href="/{k}">{word()}</a>' for k in range(rng.randrange(2, 6)))
    ad = f'<div class="ad-box">{word()}</div>' * rng.randrange(3)
    body = "".join(f"<p>{p}" + rng.choice(["</p>", "", "<br>"]) for p in parts)
    comments = f'<section class="comments"><p>{word()}</p></section>' * rng.randrange(2)
    if style == "article":
        inner = f"<article><h1>{title}</h1>{body}{ad}{comments}</article><aside>{word()}</aside>"
    else:
        inner = f'<div class="content"><h1>{title}</h1>{body}</div><div id="sidebar-2"><p>{word()}</p></div>{comments}'
    html = (
        f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p>";</script></head><body><header>{word()}</header><nav><ul>{menu}</ul></nav>'
        f"<!-- c -->{ad}{inner}<form>{word()}</form><footer>&copy; {word()}</footer></body></html>"
    )
    return html, "\n".join(plain(x) for x in [title, *parts])


def run(spark, rows):
    return {r.page_id: r for r in wrappers.extract_articles(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_articles_are_recovered(spark):
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(160):
        host = rng.choice(["a.example", "a.example", "a.example", "b.example", "c.example"])
        html, text = page(rng, "plain" if host.startswith("c") else "article")
        rows.append((i, f"https://{host}/{i}", html, "x", 1))
        truth[i] = text
    got = run(spark, rows)
    assert {i: r.text for i, r in got.items()} == truth
    assert all(r.n_chars == len(truth[i]) and r.url == rows[i][1] for i, r in got.items())


def test_odd_pages(spark):
    html = "<body><article><p>one<p>two</article></body>"
    rows = [
        (1, "http://h/", None, None, None), (2, "http://h/", "", None, None), (3, None, html, None, None), (4, "http://h/", html, None, None), (4, "http://h/", html, None, None),
        (None, "no url", html, None, None), (6, "http://h/", "<article><p>" + "word " * 50000 + "</article>", None, None), (7, "http://h/", "<div>" * 5000 + "x" + "<b", None, None),
        (8, "http://k/", "just text &lt;b&gt; <script>no", None, None),
    ]
    got = wrappers.extract_articles(spark.createDataFrame(rows, SCHEMA)).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == 9 and by_id[1] == "" and by_id[2] == "" and by_id[3] == by_id[4] == by_id[None] == "one\ntwo"
    assert by_id[6] == " ".join(["word"] * 50000) and by_id[8] == "just text <b>"
    assert wrappers.extract_articles(spark.createDataFrame([], SCHEMA)).count() == 0


TABLE = "/root/testdata/sf0.1/pages.parquet"
DISGUISES = {
    "as they are": lambda h: h,
    "no article element, an unknown class": lambda h: h.replace('class="ad"', 'class="q"').replace("<article>", "<div>").replace("</article>", "</div>"),
    "nothing but div": lambda h: re.sub(r"<(/?)(?:nav|footer|article)>", r"<\1div>", h.replace('class="ad"', 'class="q"')),
}


@pytest.mark.skipif(not os.path.exists(TABLE), reason="no test tables")
@pytest.mark.parametrize("disguise", DISGUISES)
def test_the_hosts_pages_tell_articles_from_furniture(spark, tmp_path, disguise):
    """All pages of the test table, also when no name tells the article from menus, adverts and footers."""
    table = pd.read_parquet(TABLE)
    truth = {}
    for i, html in zip(table.page_id, table.html):
        inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
        parts = (" ".join(unescape(re.sub(r"<br>|</?b>", lambda m: " " * (m.group() == "<br>"), x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        truth[i] = "\n".join(x for x in parts if x)
    table.assign(html=[DISGUISES[disguise](h) for h in table.html]).to_parquet(tmp_path / "pages.parquet")
    got = wrappers.extract_articles(spark.read.parquet(f"{tmp_path}/pages.parquet").repartition(4)).collect()
    assert len(got) == len(truth) and {r.page_id: r.text for r in got} == truth


@pytest.mark.parametrize(
    ("inner", "expected"),
    [
        ('<p>one</p><svg class="i"/><p>two</p><p>three</p>', "one two three"),
        ("<p>one</p><svg><text>x</text></svg><p>two</p>", "one two"),
        ("<p>one <button>Press</p><p>two</p><select><option>a<option>b</select><p>three</p>", "one two three"),
        ("<p>one <math><mi>x</mi></math></p><address>two</address><object>three</object>", "one x two three"),
        ('<p class="alert">one</p><h2 id="search-algorithms">two</h2><div class="related-work"><p>three</p></div>', "one two three"),
        ('<p>one</p><div class="comments"><p>a</p></div><form><p>b</p></form><aside>c</aside><nav>d</nav><div class="ad">e</div>', "one"),
        ("<p>one</p>" + "<div>" * 400 + "two" + "</div>" * 400 + "<p>three</p>", "one two three"),
        ("<p>1 &lt; 2 <3 &amp; 4</p><!-- a > b --><p>a<textarea><p>x</textarea>b<br>c</p>", "1 < 2 <3 & 4 ab c"),
        ('<p title="a > b">one</p><p title=\'x>one</p><p>two</p>', "one one two"),
    ],
)
def test_nothing_else_is_dropped(spark, inner, expected):
    html = f'<html><body class="no-sidebar"><nav>menu</nav><article>{inner}</article><footer>end</footer></body></html>'
    (got,) = wrappers.extract_articles(spark.createDataFrame([(1, "http://h/", html, None, None)], SCHEMA)).collect()
    assert got.text.replace("\n", " ") == expected


def test_broken_pages_take_time_in_proportion():
    for html in ("<a " * 100_000, '<a "' * 100_000, "<a '>" * 100_000, "<div>" * 50_000, "<!--" * 100_000, "<p>x" * 50_000, "<svg>" * 50_000):
        began = time.perf_counter()
        wrappers.generalise(wrappers.parse(html)[0])
        assert time.perf_counter() - began < 10, html[:8]


def test_long_lists_of_unlike_elements_are_aligned():
    rng = random.Random(4)
    a = [f"k{i}" for i in range(20_000)]
    b = [k for k in a if rng.random() < 0.9]
    began = time.perf_counter()
    found = wrappers._matches(a, b, 40_000)
    assert time.perf_counter() - began < 10 and [b[j] for _, j in found] == b
    small = [rng.choice("abcde") for _ in range(60)], [rng.choice("abcde") for _ in range(50)]
    assert all(small[0][i] == small[1][j] for i, j in wrappers._matches(*small, 10)) and len(wrappers._longest(*small)) == len(wrappers._matches(*small, 10**6))


def tree(html):
    return wrappers.generalise(wrappers.parse(html)[0])


def test_repeats_options_and_groups():
    one = tree("<ul><li>a<li>b</ul><p>x</p>")
    two = tree("<ul><li>a</ul><h2>t</h2><p>x</p>")
    assert wrappers.expression(wrappers._merge(one, two)) == "(<ul>{<li>{#}+} <h2>{#}? <p>{#})"
    group = tree("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p></div>")
    assert wrappers.expression(group) == "(<div>{(<h2>{#} <p>{#})+})"
    merged = wrappers._merge(group, tree("<div><h2>a</h2><p>b</p></div>"))
    assert wrappers.expression(merged) == "(<div>{(<h2>{#} <p>{#})+})"
