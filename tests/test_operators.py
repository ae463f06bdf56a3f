"""Operators on small tables: laws, edges and examples."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import exprs as X
from marlstone.operators import combine, expand, feedback, lifecycle, overlay, parse, predict, rank, search
from marlstone.sources import adapters, files


def nodes(spark, texts):
    rows = [(f"h{k:024x}", f"f{k % 3}.txt", k, 7, len(t) // 4, t[:20], t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, file_path string, node_ord long, node_type int, token_count int, preview string, content string")


def ids(df):
    return sorted(r.node_ord for r in df.collect())


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("*.rs", "src/a.rs", True), ("**/auth/**", "a/auth/b.py", True), ("**/auth/**", "auth/b.py", True), ("src/*.py", "lib/a.py", False),
        ("{a,b}/*.ts", "b/x.ts", True), ("{a,b}/*.ts", "c/x.ts", False), ("f[0-9].txt", "f3.txt", True), ("f[!0-9].txt", "f3.txt", False),
        ("a?c", "a/c", True), ("A.txt", "a.txt", False), ("a.b", "axb", False), ("**/main.py", "main.py", True),
    ],
)
def test_globs(spark, glob, path, hit):
    assert bool(re.match(X.glob_regex(glob), path)) == hit
    assert spark.range(1).select(X.glob_match(F.lit(path), glob)).first()[0] == hit


def test_grep_terms_phrases_and_accents(spark):
    n = nodes(spark, ["the Quick brown fox", "quick_brown thing", "brown quick", "Élan vital", "", "naïve ÉLAN"])
    assert ids(search.grep(n, "quick brown")) == [0, 1, 2]
    assert ids(search.grep(n, '"quick brown"')) == [0, 1]
    assert ids(search.grep(n, "quick_brown")) == [0, 1]
    assert ids(search.grep(n, "elan")) == [3, 5]
    assert ids(search.grep(n, "Élan", "fox")) == [0, 3, 5]
    assert ids(search.grep(n, "brown", none_of=("fox",))) == [1, 2]
    assert ids(search.grep(n, "bro*")) == [] and ids(search.grep(n, "")) == [] and ids(search.grep(n, "--")) == []


def test_set_laws(spark):
    n = nodes(spark, [f"a{k % 2} b{k % 3} c{k % 5}" for k in range(30)])
    a, b = search.grep(n, "a0", limit=None), search.grep(n, "b1", limit=None)
    union = combine.union_any([a, b], None)
    assert ids(union) == sorted(set(ids(a)) | set(ids(b)))
    assert ids(combine.intersect_all([a, b], None)) == sorted(set(ids(a)) & set(ids(b)))
    bounded = combine.intersect_all([search.grep(n, "a0", limit=6), search.grep(n, "b1", limit=6)], 3)
    assert set(ids(bounded)) <= set(ids(combine.intersect_all([a, b], None)))
    assert {r.branch for r in union.collect() if r.node_ord in ids(a)} == {0}
    assert ids(combine.dedupe(a.unionByName(a))) == ids(a)
    s = combine.summary(a, 10).first()
    assert (s.total_matches, s.truncated, s.returned) == (15, True, 10)


def test_symbols(spark):
    rows = [("a.rs", 1, 3, "h1", "Run", "run", "app"), ("a.rs", 2, 0, "h2", "run", "run", "app"), ("b.rs", 1, 4, "h3", "run_all", "run_all", None)]
    n = spark.createDataFrame(rows, "file_path string, node_ord long, node_type int, id string, name string, name_lower string, parent_name_lower string")
    assert [r.id for r in search.code(n, "RUN").collect()] == ["h1"]
    assert [r.id for r in search.code(n, "all").collect()] == ["h3"]
    assert [r.id for r in search.definition(n, "all").collect()] == []
    assert [r.id for r in search.children(n, "App", "run").collect()] == ["h1", "h2"]


def test_previews_and_ids(spark):
    text = "Hello, 世界!   and\nmore"
    row = spark.range(1).select(
        X.preview(F.lit(text), F.lit(0), F.lit(9), 100).alias("cut"),
        X.preview(F.lit(text), F.lit(8), F.lit(60), 10).alias("inner"),
        X.raw_id(F.lit("h" + "a" * 24)).alias("raw"),
        X.raw_id(F.lit("nothing")).alias("none"),
        X.line_of(F.lit(text), F.lit(25)).alias("line"),
        X.split_terms(F.lit("Foo_bar foo_BAR, baz")).alias("terms"),
    ).first()
    assert row.cut == "Hello," and row.inner == "界! a..." and row.raw == "a" * 24 and row.none is None and row.line == 2
    assert row.terms == ["foo_bar", "baz"]


@settings(deadline=None)
@given(st.text(max_size=40))
def test_terms_of_a_literal(text):
    assert all(t == t.lower() and t for t in X.terms_of(text.lower()))


def test_durations():
    assert [X.duration_seconds(x) for x in ("30s", "5m", "1h", "2d", "x", "5")] == [30, 300, 3600, 172800, 3600, 3600]


def test_markdown(spark):
    text = "intro\nline\n\n# One #\n\npara\n```py\n# no heading\n\ncode\n```\n\n## Two\nlast\n"
    rows = parse.markdown(spark.createDataFrame([("a.md", text), ("b.md", "")], "file_path string, content string")).collect()
    cut = lambda r: text.encode()[r.start_byte : r.end_byte].decode()
    sections = sorted((r.line_start, r.heading) for r in rows if r.node_type == 0)
    assert sections == [(4, "One"), (13, "Two")]
    assert [(r.heading, cut(r)) for r in rows if r.node_type == 1] == [("py", "```py\n# no heading\n\ncode\n```")]
    assert sorted(cut(r) for r in rows if r.node_type == 2) == ["intro\nline", "last", "para"]


SNIPPETS = (
    ("a/shop.py", "import os\nfrom shop.db import connect\n\nclass Cart:\n    def add(self, item):\n        self.items.append(item)\n\n    def total(self):\n        return sum(i.price for i in self.items)\n\ndef main():\n    Cart().add(1)\n"),
    ("a/lib.rs", "use std::fs;\n\npub struct Config {\n    name: String,\n}\n\nimpl Config {\n    pub fn load(path: &str) -> Config {\n        parse(fs::read(path))\n    }\n}\n\nfn helper() {}\n"),
    ("a/app.ts", "import x from 'lib';\nexport class App {\n  run() {\n    start(x);\n  }\n}\nexport const go = async () => {\n  App.run();\n}\n"),
    ("a/main.go", "package main\n\nimport \"net/http\"\n\ntype Server struct {\n\tport int\n}\n\nfunc (s *Server) Run() {\n\thttp.Listen(s.port)\n}\n\nfunc main() {\n\tnewServer().Run()\n}\n"),
)


def snippet_files(spark):
    return spark.createDataFrame(SNIPPETS, "file_path string, content string")


def test_declarations_and_references(spark):
    rows = {(r.file_path, r.name): r for r in parse.declarations(snippet_files(spark)).collect()}
    add = rows["a/shop.py", "add"]
    assert (add.node_type, add.parent_name, add.line_start, add.line_end) == (6, "Cart", 5, 6)
    assert rows["a/shop.py", "main"].node_type == 3 and rows["a/lib.rs", "load"].parent_name == "Config"
    assert (rows["a/main.go", "Run"].node_type, rows["a/main.go", "Run"].parent_name) == (6, "Server")
    assert (rows["a/app.ts", "run"].node_type, rows["a/app.ts", "run"].parent_name) == (6, "App")
    assert rows["a/app.ts", "go"].node_type == 3
    refs = {(r.file_path, r.ref_type, r.name, r.qualifier) for r in parse.references(snippet_files(spark)).collect()}
    assert {("a/shop.py", "import", "connect", None), ("a/shop.py", "import", "os", None), ("a/lib.rs", "call", "read", "fs"), ("a/app.ts", "import", "x", None), ("a/main.go", "import", "http", "net/http"), ("a/main.go", "call", "Run", "newServer()"), ("a/shop.py", "call", "add", "Cart()"), ("a/shop.py", "call", "append", "self.items"), ("a/main.go", "call", "Listen", "http")} <= refs
    assert not any(t == "call" and n in ("load", "total", "Config") for _, t, n, _ in refs)
    assert ("a/app.ts", "call", "run", None) not in refs and ("a/app.ts", "call", "run", "App") in refs


def test_imported_names(spark):
    texts = {
        "a.py": "import os, sys\nfrom a.b import (\n  c as d,\n  e,\n)\nfrom x import y  # z\n",
        "b.rs": "use std::collections::{HashMap, io::Read};\npub use a::b as c;\nuse solo;\n",
        "c.js": "import {a, b as c} from 'lib'\nimport d, * as e from \"m\";\nimport 'side';\n",
        "d.go": 'package main\n\nimport (\n\t"net/http"\n\tx "a/b"\n)\nimport "fmt"\nvar z = []string{\n\t"foo/bar",\n}\n',
    }
    refs = parse.references(spark.createDataFrame(list(texts.items()), "file_path string, content string")).filter("ref_type = 'import'")
    got = {}
    for r in refs.collect():
        got.setdefault(r.file_path, set()).add((r.name, r.line_start))
    assert got["a.py"] == {("os", 1), ("sys", 1), ("a.b", 2), ("c", 3), ("e", 4), ("x", 6), ("y", 6)}
    assert got["b.rs"] == {("collections", 1), ("HashMap", 1), ("Read", 1), ("b", 2), ("solo", 3)}
    assert got["c.js"] == {("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2)}
    assert got["d.go"] == {("http", 4), ("b", 5), ("fmt", 7)}


def test_reference_spans(spark):
    text = "# f(x)\nimport os\nnäme = 'g(1)'\nx = a.b(\n    c(d[0](2)),\n)\n"
    rows = parse.references(spark.createDataFrame([("a.py", text), ("b.py", ""), ("c.py", None), ("d.txt", "f(1)")], "file_path string, content string")).collect()
    cut = lambda r: text.encode()[r.start_byte : r.end_byte].decode()
    assert [(r.name, r.qualifier, cut(r), r.line_start, r.line_end) for r in rows] == [
        ("os", None, "os", 2, 2), ("b", "a", "a.b(\n    c(d[0](2)),\n)", 4, 6), ("c", None, "c(d[0](2))", 5, 5),
    ]
    assert [r.preview for r in rows] == ["import os", "x = a.b( c(d[0](2)), )", "c(d[0](2)),"]


def test_fences_are_closed_by_their_own_kind(spark):
    text = "```\n~~~\n# no heading\n~~~\n```\n# One\n~~~\n```\n~~~\nend\n"
    rows = parse.markdown(spark.createDataFrame([("a.md", text)], "file_path string, content string")).collect()
    assert [(r.line_start, r.heading) for r in rows if r.node_type == 0] == [(6, "One")]
    assert sorted((r.line_start, r.line_end) for r in rows if r.node_type == 1) == [(1, 5), (7, 9)]


def test_enclosing_against_brute_force(spark):
    import random

    draw = random.Random(1)
    spans = [("f", a, a + draw.choice([0, 3, 900, 5_000, 70_000, 2_000_000]), k, f"n{k}") for k, a in enumerate(draw.randrange(3_000_000) for _ in range(300))]
    points = [("f", a, a + draw.randrange(50)) for a in (draw.randrange(3_000_000) for _ in range(300))]
    n = spark.createDataFrame(spans, "file_path string, start_byte long, end_byte long, node_ord long, id string")
    got = {(r.start_byte, r.end_byte): r.source_id for r in search.enclosing(spark.createDataFrame(points, "file_path string, start_byte long, end_byte long"), n).collect()}
    for _, a, b in points:
        inside = [(d - c, k, i) for _, c, d, k, i in spans if c <= a and b <= d]
        assert got[a, b] == (min(inside)[2] if inside else None)


def test_fingerprint_changes_with_the_files(spark):
    d = spark.createDataFrame([(f"p{k}", k) for k in range(50)], "path string, mtime long")
    one = files.fingerprint(d)
    assert one.first() == files.fingerprint(d.repartition(7)).first() != files.fingerprint(d.withColumn("mtime", F.col("mtime") + 1)).first()
    assert [files.changed_since(d, x).first().changed for x in (one, one.limit(0), files.fingerprint(d.limit(3)))] == [False, True, True]


def test_chunks_cover_the_file(spark):
    text = "\n".join(f"line {k} é" for k in range(100)) + "\n"
    rows = sorted(parse.chunks(spark.createDataFrame([("a", text), ("b", "x\n")], "file_path string, content string"), 10, 2, 100).collect(), key=lambda r: (r.file_path, r.start_byte))
    a = [r for r in rows if r.file_path == "a"]
    assert len(a) == 13 and a[0].line_start == 1 and a[-1].line_end == 100
    assert all(y.line_start == x.line_start + 8 for x, y in zip(a, a[1:]))
    assert text.encode()[a[3].start_byte : a[3].end_byte].decode().split("\n") == [f"line {k} é" for k in range(24, 34)]
    assert [(r.start_byte, r.end_byte, r.line_end) for r in rows if r.file_path == "b"] == [(0, 2, 1)]


def test_budget_choice_keeps_its_rules(spark):
    rows = [(f"h{k}", f"f{k % 4}", k, 3 + k % 4, 10 * k, 10 * k + (k % 3) * 5, 10 + 7 * (k % 5), f"thing {k}") for k in range(40)]
    n = spark.createDataFrame(rows, "id string, file_path string, node_ord long, node_type int, line_start int, line_end int, token_count int, preview string")
    picked = [r for r in rank.choose(n, "thing", 100).collect() if r.chosen]
    assert picked and sum(r.token_count for r in picked) <= 100
    by_file = {}
    for r in picked:
        by_file.setdefault(r.file_path, []).append((r.line_start, r.line_end))
    for spans in by_file.values():
        spans.sort()
        assert len(spans) <= 2 and all(b - a2 > 2 for (_, a2), (b, _) in zip(spans, spans[1:]))
    assert not [r for r in rank.choose(n, "thing", 0).collect() if r.chosen]


@pytest.mark.parametrize("step", [1, 7, 10_000])
def test_budget_choice_equals_a_walk_over_all(spark, step):
    import random

    draw = random.Random(step)
    rows = [(f"h{k}", f"f{draw.randrange(9)}", k, draw.randrange(8), (a := draw.randrange(120)), a + draw.randrange(6), draw.choice([0, 1, 3, 9, 30]), draw.choice(["thing", "other"])) for k in range(150)]
    n = spark.createDataFrame(rows, "id string, file_path string, node_ord long, node_type int, line_start int, line_end int, token_count int, preview string").repartition(5)
    got = rank.choose(n, "thing", 70, step=step).collect()
    used, taken, want = 0, {}, set()
    for r in sorted(got, key=lambda r: (-r.score, r.token_count, r.file_path, r.node_ord)):
        own = taken.setdefault(r.file_path, [])
        if len(own) < 2 and used + r.token_count <= 70 and not any(r.line_start <= d + 2 and c <= r.line_end + 2 for c, d in own):
            own.append((r.line_start, r.line_end))
            used += r.token_count
            want.add(r.id)
    assert len(got) == 150 and len(want) > 5 and {r.id for r in got if r.chosen} == want


def test_pack_equals_a_loop(spark):
    n = nodes(spark, [f"word{k % 7} thing {'x' * (k * 37 % 90)}" for k in range(60)])
    pack = [r.id for r in rank.evidence(n, "thing word3", 8, 2).orderBy("rank").collect()]
    scored = sorted(n.withColumn("s", F.round(rank.score("thing word3"), 9)).collect(), key=lambda r: (-r.s, r.token_count, r.file_path, r.node_ord))
    want, seen = [], {}
    for r in scored:
        if seen.get(r.file_path, 0) < 2 and len(want) < 8:
            want.append(r.id)
            seen[r.file_path] = seen.get(r.file_path, 0) + 1
    assert pack == want
    empty = rank.evidence(n.limit(0), "thing")
    g = rank.guidance(empty, combine.summary(n.limit(0), 10)).first()
    assert (g.confidence, g.band, g.action, g.expand_count, g.more_queries) == (0.0, "low", "refine_query", 0, 2)


def test_expand_strictness(spark):
    n = spark.createDataFrame([("h" + "1" * 24, "a", 0, 3, "x"), ("h" + "2" * 24, "b", 0, 3, "old")], "id string, file_path string, start_byte long, end_byte long, indexed_hash string")
    f = spark.createDataFrame([("a", "héllo", "x"), ("b", "text", "new")], "file_path string, content string, content_hash string")
    asked = spark.createDataFrame([(0, "1" * 24), (1, "h" + "2" * 24), (2, "zz")], "position int, id string")
    got = {r.position: (r.status, r.content) for r in expand.expand(asked, n, f).collect()}
    assert got == {0: ("ok", "hé"), 1: ("stale", None), 2: ("not_found", None)}
    with pytest.raises(LookupError):
        expand.require_all(expand.expand(asked, n, f))


def test_overlay_is_idempotent(spark):
    n = nodes(spark, [f"text {k}" for k in range(9)])
    dirty = spark.createDataFrame([("f1.txt",)], "path string")
    once = overlay.merge(n.filter("node_ord <> 4"), n, dirty)
    assert ids(once) == [0, 1, 2, 3, 5, 6, 7, 8]
    assert ids(overlay.merge(once, once, dirty)) == ids(once)


def test_dirty_records(spark):
    z = "0 0 0 0 0"
    records = [f"1 .M N... {z} src/a b.rs", f"1 A. N... {z} new.rs", f"1 .D N... {z} gone.rs", f"2 R. N... {z} R100 to.rs", "from.rs", f"u UU N... {z} 0 0 both.rs", "? extra.rs"]
    status = "\0".join(records) + "\0"
    got = spark.range(1).select(files.dirty_files(F.lit(status)).alias("d")).first().d
    assert [(r.path, r.status) for r in got] == [
        ("src/a b.rs", "modified"), ("new.rs", "added"), ("gone.rs", "deleted"), ("to.rs", "renamed"), ("both.rs", "unmerged"), ("extra.rs", "added"),
    ]


def test_file_scan(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in (("src/a.py", b"x = 1\n"), ("src/b.txt", b"b"), ("bad.py", b"\xff\xfe\x00"), ("node_modules/c.py", b"c")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text)
    found = files.scan(spark, str(root), "**/*.py")
    assert [(r.file_path, r.content) for r in found.collect()] == [("src/a.py", "x = 1\n")]


def test_feedback_examples(spark):
    q = spark.createDataFrame([(1, 1000, ["**/a/**", "**/b/**"]), (2, 1000, None)], "id long, ts long, predicted_globs array<string>")
    h = spark.createDataFrame([(1, "x", 3, 10, "**/a/**"), (1, "y", 3, 20, "**/b/**"), (2, "x", 9, 5, None)], "query_event_id long, handle_id string, node_type int, token_count int, first_match_glob string")
    e = spark.createDataFrame([(1, 1, "x", 50, 1000)], "id long, query_event_id long, handle_id string, token_count int, expanded_at long")
    m = feedback.metrics(q, h, e, 2000, 1.0).first()
    assert m.sample_count == 2 and m.avg_tokens_per_expand == 50.0 and m.glob_hit_rate_at_k == 0.5 and m.handle_expand_accept_rate == pytest.approx(1 / 3)
    assert {r.glob: r.score for r in feedback.glob_scores(q, h, e, 2000).collect()} == {"**/a/**": 1.0, "**/b/**": 0.0}
    assert {r.node_type: r.prior for r in feedback.node_type_priors(h, e).collect()} == {3: 0.5}
    none = feedback.metrics(q.limit(0), h.limit(0), e.limit(0), 2000, 1.0).first()
    assert tuple(none) == (0, 0.0, 0.0, 0.0)
    kept = feedback.prune(q, h, e, 1000 + 31 * 86400)
    assert [t.count() for t in kept] == [0, 0, 0]


def test_decayed_scores_of_any_split_of_the_log(spark):
    import random

    draw = random.Random(4)
    q = [(k, draw.randrange(1_000_000)) for k in range(60)]
    h = [(k, f"h{n}", f"g{draw.randrange(4)}" if draw.random() < 0.9 else None, t) for k, t in q for n in range(draw.randrange(4))]
    e = [(k, i, draw.randrange(t, 1_100_000)) for k, i, _, t in h for _ in range(draw.choice([0, 0, 1, 2]))] + [(5, "none", 7)]
    queries = spark.createDataFrame(q, "id long, ts long")
    handles = spark.createDataFrame(h, "query_event_id long, handle_id string, first_match_glob string, ts long")
    expands = spark.createDataFrame(e, "query_event_id long, handle_id string, expanded_at long")
    want = {r.glob: r.score for r in feedback.glob_scores(queries, handles.drop("ts"), expands, 2_000_000).collect()}
    for _ in range(2):
        # events come in any order: an expansion may be there before its handle
        part = lambda t: t.withColumn("_p", F.pmod(F.xxhash64(*t.columns, F.lit(draw.random())), F.lit(3)))
        hs, es, state = part(handles).cache(), part(expands).cache(), spark.createDataFrame([], feedback.STATE)
        for k in range(3):
            cut = lambda t, how, k=k: t.filter(f"_p {how} {k}").drop("_p")
            state = feedback.update_decayed(state, (cut(hs, "="), cut(es, "=")), (cut(hs, "<"), cut(es, "<")), 1_200_000 + k)
        got = {r.glob: r.score for r in feedback.decayed_scores(feedback.merge_decayed(state, at=2_000_000)).collect()}
        assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_one_scan_for_all_branches(spark):
    n = nodes(spark, [f"{'alpha ' * (k % 2)}{'beta ' * (k % 3)}x{k}" for k in range(40)])
    terms = ("alpha", "beta", "x7")
    conditions = [search.condition(n, t) for t in terms]
    for each, limit in ((None, None), (9, 15), (3, 100)):
        apart = [search.grep(n, t, limit=each) for t in terms]
        for one, two in ((combine.union_where(n, conditions, each, limit), combine.union_any(apart, limit)), (combine.intersect_where(n, conditions[:2], each, limit), combine.intersect_all(apart[:2], limit))):
            assert sorted(r.id for r in one.collect()) == sorted(r.id for r in two.collect())


def test_prediction_falls_back(spark):
    p = predict.predicted_globs(predict.literal_queries(spark, ("Some FEEDBACK", "xyz")), ("py",)).collect()
    assert "**/db/**/*.py" in {r.glob for r in p if r.query == "Some FEEDBACK"}
    assert {r.glob for r in p if r.query == "xyz"} == {"**/main.py", "**/index.py", "**/app.py", "**/server.py", "src/**/*.py", "packages/**/*.py"}


def test_enclosing_prefers_the_smallest(spark):
    n = spark.createDataFrame([("a", 0, 100, 0, "all"), ("a", 10, 50, 1, "part"), ("a", 10, 50, 2, "same"), ("b", 0, 9, 0, "other")], "file_path string, start_byte long, end_byte long, node_ord long, id string")
    p = spark.createDataFrame([("a", 12, 14), ("a", 60, 61), ("b", 5, 12)], "file_path string, start_byte long, end_byte long")
    assert {(r.file_path, r.start_byte): r.source_id for r in search.enclosing(p, n).collect()} == {("a", 12): "part", ("a", 60): "all", ("b", 5): None}


def test_adapter_clock():
    assert adapters.NOW == 1706745600


def test_index_update_and_search(spark, tmp_path):
    from marlstone.operators import index, postings
    from marlstone.sources.snapshots import Snapshots

    files = [
        ("a.py", "class A:\n    def run(self):\n        go(1)\n", 5), ("b.md", "# Top\n\ntext of Ärger\n", 5), ("c.txt", "plain words", 5), ("d.py", "x = f(1)\n", 5), ("e.md", "", 5), ("f.py", None, 5),
    ]
    make = lambda rows: spark.createDataFrame(rows, "file_path string, content string, mtime long").withColumns({"content_hash": F.sha2("content", 256), "token_count": F.lit(1)})
    stored = spark.createDataFrame([], "file_path string, content_hash string, mtime long, indexed_at long")
    of = Snapshots(spark, f"file://{tmp_path}/index")
    index.update(make(files), stored, of, 100)
    nodes, refs = of.read("nodes"), of.read("refs")
    got = {(r.file_path, r.node_type, r.name, r.parent_name) for r in nodes.collect()}
    assert got == {("a.py", 4, "A", None), ("a.py", 6, "run", "A"), ("b.md", 0, None, None), ("b.md", 2, None, None), ("c.txt", 7, None, None), ("d.py", 7, None, None)}
    run = nodes.filter("name = 'run'").first()
    assert [(r.name, r.source_id) for r in refs.filter("file_path = 'a.py'").collect()] == [("go", run.id)]
    assert {r.file_path for r in search.grep(nodes, "arger").collect()} == {"b.md"}
    assert [r.name for r in search.definition(nodes, "RUN").collect()] == ["run"]
    # an unchanged file is left alone, a changed one is replaced
    seen = make(files).filter("file_path <> 'a.py'").select("file_path", "content_hash", "mtime", F.lit(90).cast("long").alias("indexed_at"))
    done = index.update(make([("a.py", "def other():\n    pass\n", 6), *files[1:]]), seen, of, 100)
    assert {r.file_path for r in done.filter("action = 'index'").collect()} == {"a.py"}
    after = of.read("nodes")
    assert postings.grep(of, "go").count() == 0 and {r.name for r in postings.grep(of, "other").collect()} == {"other"}
    assert {r.name for r in after.filter("file_path = 'a.py'").collect()} == {"other"} and after.count() == 5
    assert index.nodes(make(files).limit(0)).count() == 0


def test_metadata_json_reads_back(spark):
    df = spark.createDataFrame([(4, "A", None, "P"), (0, None, "Top", None)], "t int, name string, heading string, parent string")
    rows = df.select(X.metadata_of(X.metadata_json(F.col("t"), F.col("name"), F.col("heading"), F.col("parent"))).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in rows] == [("class", "A", None, "P"), ("section", None, "Top", None)]


def test_head_commit_and_fingerprint(spark, tmp_path):
    from marlstone.sources import files

    assert files.head_commit(str(tmp_path)) is None
    dirty = spark.createDataFrame([("a", 1), ("b", 2)], "path string, mtime long")
    files.save_fingerprint(dirty, f"file://{tmp_path}/fp")
    saved = spark.read.parquet(f"file://{tmp_path}/fp")
    assert not files.changed_since(dirty, saved).first().changed
    assert files.changed_since(dirty.limit(1), saved).first().changed


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    from marlstone.streaming import feedback_stream as S

    schema = "ts timestamp, event_type string"
    row = lambda day, kind: spark.sql(f"SELECT TIMESTAMP '2024-01-0{day} 12:00:00' AS ts, '{kind}' AS event_type")
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([], schema).write.parquet(source)
    stream = lambda: S.windowed_rates(spark.readStream.schema(schema).parquet(source), "1 day", "1 day")
    assert S.run_available(stream(), ("window_start",), folder).count() == 0
    row(1, "view").write.mode("append").parquet(source)
    assert [(r["views"], r["acts"]) for r in S.run_available(stream(), ("window_start",), folder).collect()] == [(1, 0)]
    row(1, "click").union(row(2, "view")).write.mode("append").parquet(source)
    rows = S.run_available(stream(), ("window_start",), folder).orderBy("window_start").collect()
    assert [(r["views"], r["acts"], r["rate"]) for r in rows] == [(1, 1, 1.0), (1, 0, 0.0)]
