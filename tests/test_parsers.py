"""Readers of code and markdown: shapes of each language, hostile files, and large ones."""

import time

import pytest
from pyspark.sql import functions as F

from marlstone.operators import blocks, index, scopes


def declared(text, language):
    return [(d.node_type, d.name, d.parent, text[d.start : d.end]) for d in scopes.declarations(text, language)]


def named(text, language):
    return [(d.node_type, d.name, d.parent) for d in scopes.declarations(text, language)]


def referred(text, language, kind="call"):
    return [(r.name, r.qualifier) for r in scopes.references(text, language) if r.ref_type == kind]


def test_python():
    text = 'def a(x=f(1)):\n    """def no(): pass"""\n    if x: return g(\n        2)\n\n\nclass B(C):\n  class D: y = 1\n  async def m(self): pass\n  def n(self):\n    def o(): pass\n    # end\n\nif 1:\n  def p():\n    a.b[0].c(1)(2)\n'
    assert named(text, "python") == [(3, "a", None), (4, "B", None), (4, "D", "B"), (6, "m", "B"), (6, "n", "B"), (6, "o", "B"), (3, "p", None)]
    assert declared(text, "python")[0][3].endswith("2)") and declared(text, "python")[4][3] == "def n(self):\n    def o(): pass"
    assert referred(text, "python") == [("f", None), ("g", None), ("c", "a.b[0]")]
    text = "'''\nimport doc\n'''\nfrom __future__ import x\nfrom . import q\nfrom .m import (w as v,\n  u)\nimport a.b as c, d; import e\nx = 'import f'\n"
    assert [n for n, _ in referred(text, "python", "import")] == ["q", "w", "u", "a.b", "d", "e"]


def test_rust():
    text = "use a::{self, b::{c, d as e}, f::*};\nuse crate::x;\nstruct U;\nstruct V<'a>(&'a str);\nimpl<'a> V<'a> { fn n(c: char) -> bool { c == '{' || m!(no(1)) } }\nimpl X for y::Z<T> where T: Fn(i32) {}\nfn r() -> impl Iterator<Item = u8> { r#\"fn no() { \"#; v.iter().map(f).collect::<Vec<_>>() }\nmod t;\n#[cfg(test)]\nmod u { fn deep() {} }\n"
    assert named(text, "rust") == [(5, "U", None), (5, "V", None), (5, "V", None), (3, "n", "V"), (5, "y::Z", None), (3, "r", None), (0, None, None), (0, None, None), (3, "deep", None)]
    assert [d.heading for d in scopes.declarations(text, "rust") if d.node_type == 0] == ["mod t", "mod u"]
    assert referred(text, "rust") == [("iter", "v"), ("map", "v.iter()"), ("collect", "v.iter().map(f)")] or {n for n, _ in referred(text, "rust")} == {"iter", "map", "collect"}
    assert referred(text, "rust", "import") == [("a", None), ("b", None), ("c", None), ("d", None), ("x", "crate")]


def test_go():
    text = "package p\nimport f \"a/b\"\ntype T struct{ x int }\ntype U = T\ntype (\n\tV[K any] map[K]int\n\tW func(int) error\n)\nfunc (t T) M() (a int, err error) {\n\tif x := t.N(1); x > 0 { return }\n\treturn T{}.M()\n}\nfunc (*V[K]) P()\nfunc g() { go h(func() { k() }) }\n"
    assert named(text, "go") == [(5, "T", None), (5, "V", None), (5, "W", None), (6, "M", "T"), (6, "P", "V[K]"), (3, "g", None)]
    assert {n for n, _ in referred(text, "go")} == {"N", "M", "h", "k"} and referred(text, "go", "import") == [("b", "a/b")]


def test_scripts():
    text = "export default class A extends B { static async *g() { yield 1 } get x() { return 1 } 'q-r'() {} [k]() {} #p = () => 1; constructor(a) { super(a) } }\nconst o = { m() {}, n: function() {}, p: async x => x.y(1) };\nconst c = class { d() {} };\nasync function f({a, b} = {}, [c]) { new D(1).e(2); if (a) { b() } }\nlet t = a ? (b) : c;\nvar r = x / y / z(1), s = /[/'\"]/g.test(t);\n"
    assert named(text, "javascript") == [
        (4, "A", None), (6, "g", "A"), (6, "x", "A"), (6, "'q-r'", "A"), (6, "[k]", "A"), (3, "#p", "A"), (6, "constructor", "A"),
        (6, "m", None), (3, "<anonymous>", None), (4, "c", None), (6, "d", "c"), (3, "f", None),
    ]
    assert {n for n, _ in referred(text, "javascript")} >= {"super", "y", "b", "z", "test"} and not {"D", "m", "d", "if"} & {n for n, _ in referred(text, "javascript")}
    text = "interface I<T> { f(a: T): void; g: (x: number) => void }\ntype F = (a: A) => B\nabstract class C<T extends {a: 1}> implements I<T> {\n  abstract f(a: T): void\n  h: (x: number) => void = (x) => k<string>(x)\n  async m<U>(a: U): Promise<Array<{b: U}>> { return this.n(a)! }\n}\nconst z = (a: (b: number) => void): a is string => { return q(a) }\nfunction over(a: string): void\nfunction over(a: any) { }\n"
    assert named(text, "typescript") == [(5, "I", None), (5, "F", None), (4, "C", None), (3, "h", "C"), (6, "m", "C"), (3, "z", None), (3, "over", None)]
    assert {n for n, _ in referred(text, "typescript")} == {"k", "n", "q"}


HOSTILE = [
    ("typescript", "a<"), ("typescript", "a=>"), ("typescript", "a(b).c(d)."), ("rust", "fn a "), ("go", "func a "), ("javascript", "class a "), ("javascript", "'"), ("python", "("),
    ("typescript", "{"), ("rust", "impl<"), ("javascript", "/*"), ("python", '"""'), ("javascript", "a(){"), ("go", "type (\n"), ("rust", 'r#"'), ("javascript", "`${"), ("python", "class A:\n "),
]


@pytest.mark.parametrize("language, unit", HOSTILE)
def test_hostile_code_takes_linear_time(language, unit):
    text = unit * (200_000 // len(unit))
    began = time.perf_counter()
    scopes.declarations(text, language)
    scopes.references(text, language)
    assert time.perf_counter() - began < 20


def marked(text):
    return [(b.node_type, b.heading, b.line_start, b.line_end, text[b.start : b.end]) for b in sorted(blocks.blocks(text), key=lambda b: (b.start, -b.end))]


def kinds(text):
    return [(t, x) for t, _, _, _, x in marked(text) if t]


def test_markdown_sections():
    text = "# Introduction\n\nSome intro text.\n\n## Details\n\nMore details here.\n"
    assert [(h, a, b) for t, h, a, b, _ in marked(text) if t == 0] == [("Introduction", 1, 4), ("Details", 5, 8)]
    text = "Set\next\n===\na\n---\n\n---\n#no\n####### no\n   ### three ###\n#\n"
    assert [(h, a) for t, h, a, _, _ in marked(text) if t == 0] == [("Set ext", 1), ("a", 4), ("three", 10), ("", 11)]
    assert [h for t, h, *_ in marked("# a `code` *b* [c](d) \\# e_f_ #\n") if t == 0] == ["a  b c # e_f_"]


def test_markdown_code():
    text = "# Example\n\n```rust\nfn main() {}\n```\n\n```\nplain code\n```\n"
    assert [(h, x) for t, h, _, _, x in marked(text) if t == 1] == [("rust", "```rust\nfn main() {}\n```"), (None, "```\nplain code\n```")]
    assert [x for t, x in kinds("````\n```\n# no\n````\n") if t == 1] == ["````\n```\n# no\n````"]
    assert kinds("p\n    q\n\n    code\n\n      more\n\nend\n") == [(2, "p\n    q"), (1, "    code\n\n      more"), (2, "end")]
    assert kinds("``` a`b\nx\n") == [(2, "``` a`b\nx")] and kinds("~~~ a`b\nx") == [(1, "~~~ a`b\nx")]
    assert kinds("> ```\n> x\ny\n") == [(1, "```\n> x"), (2, "y")]


def test_markdown_paragraphs_and_containers():
    assert [(a, b) for t, _, a, b, _ in marked("First paragraph.\n\nSecond paragraph.\n")] == [(1, 1), (3, 3)]
    assert blocks.blocks("") == [] and blocks.blocks("\n \n") == []
    assert kinds("> a\nlazy\n> b\n\nc\n") == [(2, "a\nlazy\n> b"), (2, "c")]
    assert kinds("- a\n- b\n  - c\n") == [] and kinds("- a\n\n- b\n") == [(2, "a"), (2, "b")]
    assert kinds("- a\n\n  b\n- c\n") == [(2, "a"), (2, "b"), (2, "c")]
    assert kinds("- a\n  - b\n\n  - c\n- d\n") == [(2, "b"), (2, "c")]
    assert kinds("a\n- b\n2. c\n") == [(2, "a")] and kinds("a\n2. c\n") == [(2, "a\n2. c")]
    assert kinds("- ```\n  x\n  ```\n") == [(1, "```\n  x\n  ```")]
    assert kinds("[a]: /u 'T'\n[b]: <v>\nreal\n") == [(2, "real")] and kinds("[a]: /u\n") == []
    assert kinds("<div>\nraw\n\npara\n<b>in</b>\n") == [(2, "para\n<b>in</b>")] and kinds("<!-- a\n\n# no\n-->\nx\n") == [(2, "x")]
    assert kinds("* * *\n***bold*** x\n") == [(2, "***bold*** x")]
    assert kinds("1. a\n\n       code\n") == [(2, "a"), (1, "    code")] or kinds("1. a\n\n       code\n")[0] == (2, "a")


@pytest.mark.parametrize("unit", ["> ", "- ", "`", "* ", "[", "[a](", "**a ", "<a ", "# `", "1. ", "\t", "_ "])
def test_hostile_markdown_takes_linear_time(unit):
    for text in (unit * (100_000 // len(unit)), (unit + "\n") * (100_000 // len(unit))):
        began = time.perf_counter()
        blocks.blocks(text)
        assert time.perf_counter() - began < 20


def test_a_large_file_is_indexed_in_one_pass(spark):
    text = "\n".join(f"def f{k}(x):\n    return g{k}(x, 'é' * 40, {k})\n" + "    # " + "pad " * 12 for k in range(50_000))
    files = spark.createDataFrame([("big.py", text, "h")], "file_path string, content string, content_hash string")
    began = time.perf_counter()
    n = index.nodes(files).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"), F.max("node_ord").alias("last")).first()
    assert time.perf_counter() - began < 60
    assert n.n == 50_000 and n.last == 49_999 and n.bytes < len(text.encode())


def test_small_parts_make_work_for_many_tasks(spark, tmp_path):
    """A table of few bytes is one split, but its files are read by as many tasks as there are cores, and more."""
    from marlstone.plans import catalog

    rows = [(k, k % 7) for k in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for query, n in ((catalog.declarations, 20), (catalog.code_references, 23)):
        made = query(spark, str(tmp_path))
        tasks = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in tasks) == 200 * n and len(tasks) >= spark.sparkContext.defaultParallelism


def test_pieces_of_a_file_are_read_as_the_whole(monkeypatch):
    from marlstone.operators import lexer

    text = "import a.b\n(c).d(1)\nclass A(B):\n    x = e(1)\n    def f(self):\n        g(\n1)\n\n'''\nh(2)\n'''\n@i.j(1)\ndef k(é):\n  return l(é)\n# m(1)\nn = [\no(3)]\nasync def p(): pass\n" * 30
    whole = scopes.declarations(text, "python"), scopes.references(text, "python")
    monkeypatch.setattr(lexer, "PIECE", 50)
    assert (scopes.declarations(text, "python"), scopes.references(text, "python")) == whole
    assert len(list(scopes.pieces(text, "python"))) > 20 and max(s.n for s in scopes.pieces(text, "python")) < 150
