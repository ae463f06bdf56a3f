"""Template deduction on synthetic hosts, against brute force and without names."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import html_template
from marlstone.llm.html_template import Page

SCHEMA = "page_id long, url string, html string"


def said(draw, n):
    return " ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(n))


def article_host(host, n, seed):
    """n pages of a host as (html, article's blocks): menus, a search form, some adverts, a site line in the article, a sidebar, comments."""
    draw = random.Random(seed)
    pages = []
    for k in range(n):
        blocks = [said(draw, 6), *(said(draw, draw.randint(8, 40)) for _ in range(draw.randint(2, 7)))]
        body = f"<h1>{blocks[0]}</h1><p class='share-bar'>Tell your friends of {host} now</p>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        ad = f"<div class='ad'><p>{said(draw, 8)}</p></div>" if k % 3 else ""
        menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in said(draw, draw.randint(3, 6)).split())
        form = "<form><p>Find in this site</p><input name=q></form>"
        comments = "".join(f"<div class='comment'><p>{said(draw, 5)}</p></div>" for _ in range(k % 4))
        pages.append(
            (
                f"<html><head><title>{blocks[0]}</title></head><body class='with-sidebar'><nav><ul>{menu}</ul></nav>{form}{ad}"
                f"<div class='content-with-sidebar'><article class='story-body has-comments'>{body}</article>"
                f"<aside class='sidebar'><h3>Also read</h3><ul>{menu}</ul></aside>"
                f"<section class='comments'><h3>Comments</h3>{comments}</section></div><footer><p>All about {host} and {k}</p></footer></body></html>",
                "\n".join(blocks),
            )
        )
    return pages


def stripped(html):
    html = re.sub(r"\sclass='[^']*'", "", html)
    return re.sub(r"<(/?)(?:nav|article|footer|header|aside|section|main|form)\b", r"<\1div", html)


def texts(spark, rows, **how):
    return {r.page_id: r for r in html_template.extract(spark.createDataFrame(rows, SCHEMA), **how).collect()}


@pytest.mark.parametrize("change", [lambda x: x, stripped])
@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": -1}])
def test_the_template_finds_the_article_with_and_without_names(spark, change, how):
    rows, want = [], {}
    for h in range(3):
        for k, (html, text) in enumerate(article_host(f"h{h}.example", 9, h)):
            rows.append((100 * h + k, f"http://h{h}.example/{k}", change(html)))
            want[100 * h + k] = text
    found = texts(spark, rows, **how)
    assert all(r.by_template for r in found.values())
    assert {k: r.text for k, r in found.items()} == want


def test_the_template_changes_what_names_alone_give(spark):
    pages = article_host("h.example", 6, 5)
    rows = [(k, "http://h.example/", stripped(p)) for k, (p, _) in enumerate(pages)]
    found = texts(spark, rows)
    alone = texts(spark, rows, min_pages=100)
    assert not any(r.by_template for r in alone.values())
    assert all(found[k].text == pages[k][1] and alone[k].text != pages[k][1] for k in found)


@pytest.mark.parametrize("times", [1, 2])
def test_classes_are_those_of_equal_occurrence_vectors(spark, times):
    rows = [(k, "http://h.example/", p) for k, (p, _) in enumerate(article_host("h.example", 8, 7))]
    vectors = defaultdict(lambda: [0] * len(rows))
    for k, (_, _, html) in enumerate(rows):
        page = Page(html)
        for t, n in Counter([*page.tokens, *page.text_tokens()]).items():
            vectors[t][k] += n
    frequent = {t: tuple(v) for t, v in vectors.items() if sum(map(bool, v)) >= 4}
    by_vector = defaultdict(set)
    for t, v in frequent.items():
        by_vector[v].add(t)
    want = {frozenset(c) for c in by_vector.values() if len(c) > 1}
    found = html_template.templates(spark.createDataFrame(rows * times, SCHEMA)).collect()
    got = defaultdict(set)
    for r in found:
        got[r["class"]].add(r.token % (1 << 64))
    assert {frozenset(c) for c in got.values()} == want and len(want) > 1
    root = next(r["class"] for r in found if r.token == 0)
    own = {r.token % (1 << 64): r for r in found}
    page = Page(rows[0][2])
    for t, p in zip(page.tokens[1:], page.parents[1:], strict=True):
        if t in own and page.tokens[p] in own:
            assert own[t].parent == own[page.tokens[p]]["class"]
    assert any(r.parent == root for r in found)


def test_copies_of_an_article_are_articles(spark):
    (html, text), = article_host("h.example", 1, 9)
    rows = [(k, "http://h.example/", html.replace("All about", f"About {k}")) for k in range(5)]
    found = texts(spark, rows).values()
    assert {r.text for r in found} == {text} and all(r.by_template for r in found)


def test_site_text_goes_where_no_name_tells(spark):
    page = "<body><div><p>Site name</p></div><div><p>Own text {0}</p></div><div><p>All about us</p></div></body>"
    rows = [(k, "http://plain.example/", page.format(k)) for k in range(5)]
    assert {k: r.text for k, r in texts(spark, rows).items()} == {k: f"Own text {k}" for k in range(5)}


def test_empty_table_nulls_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", ""), (None, "http://a/", "<p>x"), (3, "http://a/", "<p>y"), (3, "http://a/", "<p>y")], SCHEMA)
    for name in ("host", "page", "dealt", "unique", "container", "text", "_row", "of", "token"):
        d = d.withColumn(name, F.lit("x"))
    assert html_template.digests(html_template.extract(d.limit(0))).collect() == []
    assert html_template.templates(d.limit(0)).collect() == []
    got = sorted((r.page_id or 0, r.text) for r in html_template.digests(html_template.extract(d)).collect())
    assert got == [(0, "x"), (1, ""), (2, ""), (3, "y"), (3, "y")]


def test_tags_of_any_length_and_unclosed_quotes():
    long = "x>" * 50_000
    for quote in "\"'":
        page = Page(f"<div data-a={quote}{long}{quote} class='post'><p>one</p><img src={quote}{long}{quote}><p>two</p></div>")
        assert (page.texts, page.tags, page.of) == (["one", "two"], ["#", "div", "p", "p"], [2, 3])
    assert Page('<p title="abc>Hello</p><p class="x">more</p>').texts == ["Hello", "more"]
    assert Page("<p>a < b and <3</p><p id='q>end</p>").texts == ["a < b and <3", "end"]
    assert Page("<i title='>" * 20_000 + "end").texts[0].endswith("end")
    assert Page("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds").texts == ["so x=2 holds"]
