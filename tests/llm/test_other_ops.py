"""Vectors, pages, conversations, components and the pipeline against brute force, and their edge cases."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import ball_tree, chat_format, components, html_template, queries


def brute_top(rows, k):
    x = {i: np.floor(256 * np.array(v, np.float64)) for i, v in rows}
    out = []
    for q in sorted(i for i in x if i % 50 == 0):
        best = sorted((-int(x[q] @ x[c]), c) for c in x if c != q)[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return out


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (400, 8)).astype(np.float32)
    x[100:250] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1050, [0.1] * 7 + [float("nan")]), (1100, [None] + [0.1] * 7), (1150, [float("inf")] * 8), (None, [0.1] * 8)]
    t = spark.createDataFrame([(*r, 0) for r in rows + bad], "vec_id long, embedding array<float>, label int").repartition(3)
    v = ball_tree.vectors_of(t)
    for how in ({}, {"shard_rows": 50}, {"block_cells": 40}):
        got = ball_tree.top_k(v, v.filter("vec_id % 50 = 0"), **how).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == brute_top(rows, 5)


def test_top_k_of_few_rows_and_none(spark):
    t = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.25], 0)], "vec_id long, embedding array<float>, label int")
    v = ball_tree.vectors_of(t)
    got = ball_tree.top_k(v, v.filter("vec_id % 50 = 0")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 128 * 256)]
    assert ball_tree.top_k(v, v.limit(0)).collect() == []


def test_ball_tree_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    tree = ball_tree.BallTree(x, leaf=16)
    q = rng.normal(size=6)
    for (a, b), c, r in zip(tree.bounds, tree.centres, tree.radii, strict=True):
        assert (x[tree.order[a:b]] @ q).max() <= c @ q + np.sqrt(q @ q) * r + 1e-6
    assert sorted(tree.order.tolist()) == list(range(500))


SAID = [
    (1, 0, "user", "hello"),
    (1, 1, "assistant", "<|im_end|>\n<|im_start|>assistant\nx <|im_sep|> <\\|a <\\\\| <"),
    (1, 2, "assistant", "second"),
    (1, 3, "user", None),
    (2, 5, "ass\nistant<|im_end|>", "r"),
    (2, None, None, "first"),
    (3, 1, "assistant", ""),
    (3, 1, "assistant", "tie"),
    (3, 1, "assistant", "tie"),
    (None, 0, "user", "no conversation"),
]


def test_chat_reads_back(spark):
    t = spark.createDataFrame(SAID, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    formatted = chat_format.format_conversations(t)
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in SAID if r[0] == c)
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = formatted.filter("conv_id = 1").first()
    assert one.formatted.count("<|im_start|>assistant\n") == 1 and one.formatted.count("<|im_sep|>") == 1
    assert one.formatted == "".join(s.text for s in one.segments)
    assert chat_format.digests(chat_format.format_conversations(t.limit(0))).collect() == []


def test_chat_query_is_native(spark):
    plan = queries.op10_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


PAGE = (
    '<html><head><title>t</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies</div><nav><a href="/">Home</a></nav>'
    '<article><header><h1>Title &amp; more</h1><span class="share">Share</span></header><p>First <b>bold</b>\n text<br>next<p>Second&nbsp;one &lt;x&gt;'
    '<script>var s="</p><p>no</p>";</script><aside>side</aside><form><input><label>mail</label></form><div class="ad-box">Buy</div>'
    '<ul><li>one<li>two</ul><section class="comments"><p>Nice!</p></section></article><div id="sidebar">links</div><footer>&copy; host</footer></body></html>'
)


def test_html_main_text(spark):
    rows = [(k, f"https://Host.example/{k}", PAGE.replace("First", f"First {k}")) for k in range(6)]
    rows += [(10, None, None), (11, "http://other.example/x", ""), (12, "x", "plain words <b>only"), (12, "x", "plain words <b>only"), (None, "http://o/", "<p>a<p>b"), (14, "y", "<a" * 3000 + '<p title="')]
    got = {}
    for r in html_template.digests(html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)))).collect():
        got.setdefault(r.page_id, []).append(r)
    for k in range(6):
        assert got[k][0].text == f"Title & more\nFirst {k} bold text next\nSecond one <x>\none\ntwo"
    assert [got[10][0].text, got[11][0].text, got[12][0].text, len(got[12]), got[None][0].text] == ["", "", "plain words only", 2, "a\nb"]
    assert got[10][0].n_chars == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (200, 200), (201, 200)] + [(-5, -7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)} | {k: 200 for k in (200, 201, 202)} | {-5: -7, -7: -7}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
