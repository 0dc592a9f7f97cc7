"""HTML extraction: tree matching against plain recursion, what the template decides, and odd pages."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from torrentia.llm import html_extract

KIND = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, KIND)).collect()}


def tree(rnd, depth):
    tag = rnd.choice(["div", "section", "p"]) if depth else "p"
    inside = "".join(tree(rnd, depth - 1) for _ in range(rnd.randint(0, 4))) if depth and tag != "p" else "x"
    return f"<{tag} class='{rnd.choice('ab')}'>{inside}</{tag}>"


def most_pairs(a, b):
    """Simple tree matching as it is defined."""
    if a.label != b.label:
        return 0

    @functools.cache
    def best(i, j):
        if not i or not j:
            return 0
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + most_pairs(a.children[i - 1], b.children[j - 1]))

    return 1 + best(len(a.children), len(b.children))


def test_tree_matching_against_recursion():
    rnd = random.Random(1)
    m = html_extract.Matcher()
    for _ in range(150):
        a, b = (html_extract.fold(html_extract.Dom("".join(tree(rnd, 3) for _ in range(rnd.randint(1, 5)))), m.shapes) for _ in range(2))
        pairs = m.pairs(a[0], b[0])
        assert len(pairs) == m.count(a[0], b[0]) == most_pairs(a[0], b[0])
        assert all(x.label == y.label for x, y in pairs)
        numbers = [y.number for _, y in sorted(pairs, key=lambda p: p[0].number)]
        assert len(set(numbers)) == len(numbers) and numbers == sorted(numbers)  # ordered, one partner each


def test_long_and_deep_pages_are_aligned_whole():
    m = html_extract.Matcher()
    a = html_extract.fold(html_extract.Dom("<h2>a</h2><p>b</p>" * 3000), m.shapes)
    b = html_extract.fold(html_extract.Dom("<h2>a</h2><p>b</p>" * 1500 + "<ul><li>x</ul>" + "<h2>a</h2><p>b</p>" * 1500), m.shapes)
    assert len(m.pairs(a[0], b[0])) == 6001
    deep = html_extract.fold(html_extract.Dom("<div>" * 20000 + "end"), m.shapes)
    assert len(m.pairs(deep[0], deep[0])) == 20001


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'><nav><ul><li>Home<li>{nav}</ul></nav><div class='top'><span>Site motto</span></div>"
    "<div class=ad>Buy {nav}</div>{open}<h1>Title {i}</h1><p>One&amp;two&nbsp;{i}<br>more <b>bo</b>ld<p>Second\n para {i}</p>{close}<aside>side</aside><section id='comments'><article class='comment'><p>nice {i}</article></section>"
    "<form><p>mail</p></form><script>var t='</p>';</script><footer>&copy; x</footer></body></html>"
)


@pytest.mark.parametrize(("open_", "close"), [("<article>", "</article>"), ("<div class='c'>", "</div>"), ("<article class='post has-comments'>", "</article>"), ("<div class='share-price-report'>", "</div>")])
def test_article_text(spark, open_, close):
    rows = [(i, "https://h.example.com/a", PAGE.format(i=i, nav=f"n{i % 3}", open=open_, close=close)) for i in range(12)]
    rows += [(100, None, None), (101, "no url", ""), (102, "http://x.org", "plain <b>text</b>"), (103, "http://x.org", "<p>" * 3000 + "deep" + "</div>" * 50), (3, *rows[3][1:]), (None, *rows[3][1:])]
    df = spark.createDataFrame(rows, KIND).withColumns({"host": F.lit("clash"), "template": F.lit(1), "text": F.lit("clash")})
    found = html_extract.extract(df).collect()
    got = {r.page_id: r for r in found}
    for i in range(12):
        assert got[i].text == f"Title {i} One&two {i} more bold Second para {i}" and got[i].n_chars == len(got[i].text)
    assert len(found) == len(rows) and got[None].text == got[3].text
    assert got[100].text == got[101].text == "" and got[102].text == "plain text" and got[103].text == "deep"
    assert html_extract.extract(df.limit(0)).count() == 0


def pages(body, n=30, url="http://h.org/a"):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    said = [" ".join(word() for _ in range(40)) for _ in range(n)]
    return said, [(i, url, "<html><body>" + body.format(said=t, i=i, turn=i % 4) + "</body></html>") for i, t in enumerate(said)]


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<article>{}</article>", "<main>{}</main>", "<div class='sidebar'>{}</div>", "<div class='content-sidebar-wrap'><main>{}</main></div>", "<div id='search'><article>{}</article></div>"])
def test_the_template_decides(spark, monkeypatch, wrap):
    """A line that all pages have and a slot that rotates are left out, inside and around the article; without a template they stay."""
    inner = "<p>{said}</p><p>Read more on our site.</p><h3>Number {i}</h3>"
    said, rows = pages("<div class='x'>House of news</div><div class='y'>Offer {turn}</div>" + wrap.format(inner))
    got = texts(spark, rows)
    assert all(got[i] == f"{t} Number {i}" for i, t in enumerate(said))
    monkeypatch.setattr(html_extract, "CONSTANT", 1.1)
    monkeypatch.setattr(html_extract, "VARIED", -1.0)
    without = texts(spark, rows)
    assert all("Read more on our site." in t for t in without.values())


def test_an_odd_first_page_and_copies(spark):
    """References are several, so one odd page spoils nothing; copies of an article keep it; copies of a page count once."""
    said, rows = pages("<div class='x'>House of news</div><p>{said}</p>")
    odd = [(-1, rows[0][1], "<html><body><table><tr><td>nothing alike</table></body></html>")]
    got = texts(spark, odd + rows)
    assert all(got[i] == t for i, t in enumerate(said)) and got[-1] == "nothing alike"
    copies = [(i, "http://c.org/", f"<html><body><div class='x'>Tag {i}</div><article><h1>The title</h1><p>{said[0]}</p></article></body></html>") for i in range(40)]
    assert set(texts(spark, copies).values()) == {f"The title {said[0]}"}
    same = [(i, "http://s.org/", rows[0][2]) for i in range(40)]
    assert set(texts(spark, same).values()) == {f"House of news {said[0]}"}


def test_teasers_in_articles_do_not_hide_the_text(spark):
    body = "<div class='cards'><article><p>Card {turn}</p></article></div><div class='text'><p>{said}</p><p>{said} again {i}</p></div>"
    said, rows = pages(body)
    got = texts(spark, rows)
    assert all(got[i].endswith(f"{t} {t} again {i}") for i, t in enumerate(said))


def test_given_pages_by_a_plain_reading(spark):
    """In the given pages the text is that of the article element."""
    import html
    import re

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html or "", re.S).group(1)
        body = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body)
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", body)).split())


@pytest.mark.parametrize("name", ["share", "search", "notice", "social", "widget"])
def test_class_words_drop_no_varying_text_of_an_article(spark, name):
    """Text that varies stays whatever its class; text that all pages have goes; reader comments go."""
    body = f"<article><p>{{said}}</p><section class='{name}'><p>{{said}} in short {{i}}</p></section><div class='{name}'><p>Follow us here</p></div><div class='comments'><p>nice {{i}}</p></div></article>"
    said, rows = pages("<nav>menu</nav>" + body)
    got = texts(spark, rows)
    assert all(got[i] == f"{t} {t} in short {i}" for i, t in enumerate(said))


def test_given_pages_without_article_tags(spark):
    """The given pages with their article and main tags made plain: the template finds the same text on nearly all of them, and matters."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    masked = [(i, u, h and __import__("re").sub(r"(?i)<(/?)(article|main)\b[^>]*>", r"<\1div>", h)) for i, u, h in rows]
    whole, plain = texts(spark, rows), texts(spark, masked)
    assert whole.keys() == plain.keys()
    same = sum(whole[i] == plain[i] for i in whole)
    print(same, len(whole))
    assert same >= 0.9 * len(whole)


def test_pages_are_not_shuffled_to_meet_few_templates(spark, monkeypatch):
    """By a broadcast of the templates, or by a shuffle where they are too large for one: the same texts."""
    rows = [(k, f"http://h.org/{k}", f"<body><div><p>Always the same line</p></div><div><p>Text {k * 7919 % 101} of page {k}</p></div></body>") for k in range(40)]
    df = spark.createDataFrame(rows, KIND)
    small = html_extract.extract(df)
    monkeypatch.setattr(html_extract, "BROADCAST", -1)
    shuffled = html_extract.extract(df)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (small, shuffled)]
    assert "BroadcastHashJoin" in plans[0] and "Exchange hashpartitioning" not in plans[0] and "SortMergeJoin" in plans[1]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, shuffled.collect()))
