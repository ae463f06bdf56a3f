"""Registry of the retrieval and feedback queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import bpe
from marlstone.functions import exprs as X
from marlstone.operators import combine, expand, feedback, index, lifecycle, overlay, parse, postings, predict, rank, search
from marlstone.plans import sql as S
from marlstone.sources import adapters as A
from marlstone.sources import ignores
from marlstone.sources.snapshots import Snapshots
from marlstone.sources.state import shared_folder, written
from marlstone.streaming import feedback_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def handles(found: DataFrame) -> DataFrame:
    return found.select(*search.HANDLE)


def of(where: str, nodes: str = S.NODES, table: str = "nodes", limit: int | None = 100) -> str:
    return f"WITH {nodes}, {S.found(where, table, limit)} SELECT * FROM f"


C = S.contains


# ---- full-text search


MERGES = ("th", "the", "in", "ing", " a", " an", " and")


@query(
    "SELECT doc_id, CAST(strlen(text) - "
    + " - ".join(f"CAST(length(regexp_replace(text, '{m}', '{m}#', 'g')) - length(text) AS BIGINT)" for m in ("th", "the", "in", "ing", " a", " an", " and"))
    + " AS INTEGER) AS tokens FROM documents"
)
def token_counts(spark, d):
    """Tokens of documents by byte pairs, over a vocabulary of all bytes and a few merges that never meet in a letter."""
    ranks = {bytes([b]): b for b in range(256)} | {m.encode(): 256 + k for k, m in enumerate(MERGES)}
    return A.read(spark, d, "documents").select("doc_id", bpe.counter(spark, ranks)(F.col("text")).alias("tokens"))


@query(of(C("thing")))
def grep_single(spark, d):
    return handles(search.grep(A.doc_nodes(spark, d), "thing"))


@query(of(C("of the"), limit=None))
def grep_phrase(spark, d):
    return handles(search.grep(A.doc_nodes(spark, d), '"of the"', limit=None))


@query(of(f"{C('thing')} AND {C('thtion')}", limit=None))
def grep_all_terms(spark, d):
    return handles(search.grep(A.doc_nodes(spark, d), "thing thtion", limit=None))


@query(of(f"({C('thing')} OR {C('attion')}) AND NOT {C('thble')}", limit=None))
def grep_or_not(spark, d):
    return handles(search.grep(A.doc_nodes(spark, d), "thing", "attion", none_of=("thble",), limit=None))


@query(of(C("échch".replace("é", "e")), limit=None))
def grep_accents(spark, d):
    return handles(search.grep(A.doc_nodes(spark, d), "ÉCHCH", limit=None))


@query(of(f"file_path LIKE 'src3/%' AND {C('thing')}", limit=50))
def in_file_grep(spark, d):
    return handles(search.in_files(search.grep(A.doc_nodes(spark, d), "thing", limit=None), "src3/**", 50))


@query(
    f"WITH {S.NODES}, {S.found(C('the'), limit=100, name='sub')}, f AS (SELECT * FROM sub WHERE file_path LIKE '%/en/%' ORDER BY file_path, node_ord LIMIT 50) SELECT * FROM f"
)
def in_file_other_bounded(spark, d):
    return handles(search.in_files(search.grep(A.doc_nodes(spark, d), "the", limit=100), "**/en/**", 50))


@query(f"WITH {S.NODES} SELECT {S.HANDLE}, line_end FROM nodes WHERE regexp_matches(file_path, '^src[12]/(de|fr)/.*')")
def file_glob(spark, d):
    found = search.files(A.files(spark, d), "src[12]/{de,fr}/**")
    return found.select(*search.HANDLE, "line_end")


@query(
    f"WITH f AS (SELECT 'pages/' || page_id || '.html' AS file_path, html AS content FROM pages) SELECT file_path, CAST(strlen(content) // 4 AS INTEGER) AS token_count FROM f WHERE contains({S.norm('content')}, ' footer ')"
)
def grep_pages(spark, d):
    p = A.read(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.col("html").alias("content"))
    found = search.grep(p.withColumn("node_ord", F.lit(0)), "footer", limit=None)
    return found.select("file_path", X.token_count(F.col("content")).alias("token_count"))


# ---- symbols, children, references


@query(of("name_lower = 'red plate' AND node_type IN (3, 4, 5, 6)", S.PARTS, "parts"))
def code_exact(spark, d):
    return handles(search.code(A.part_nodes(spark, d), "Red Plate"))


@query(of(f"node_type IN (3, 4, 5, 6) AND {C('plate', 'name')}", S.PARTS, "parts"))
def code_fuzzy_fallback(spark, d):
    return handles(search.code(A.part_nodes(spark, d), "plate"))


@query(of("name_lower = 'red plate' AND node_type IN (3, 4, 5, 6)", S.PARTS, "parts", 20))
def definition(spark, d):
    return handles(search.definition(A.part_nodes(spark, d), "red plate", 20))


@query(of("parent_name_lower = 'brand#12'", S.PARTS, "parts"))
def children(spark, d):
    return handles(search.children(A.part_nodes(spark, d), "Brand#12"))


@query(of("parent_name_lower = 'brand#12' AND name_lower = 'red plate'", S.PARTS, "parts"))
def children_named(spark, d):
    return handles(search.children(A.part_nodes(spark, d), "Brand#12", "red plate"))


@query(of("node_type = 3", S.PARTS, "parts", 40))
def nodes_by_type(spark, d):
    return handles(search.by_type(A.part_nodes(spark, d), 3, 40))


REF_COLUMNS = "r.file_path, r.name, qualifier, ref_type, start_byte, end_byte, r.preview"


@query(
    f"WITH {S.PARTS}, {S.REFS} SELECT {REF_COLUMNS}, p.id AS source_id, p.node_type AS source_type FROM refs r LEFT JOIN parts p ON r.source_id = p.id WHERE r.name_lower = 'red plate'"
)
def references_root(spark, d):
    return search.references(A.lineitem_refs(spark, d), A.part_nodes(spark, d), "red plate", None)


@query(of("id IN (SELECT source_id FROM refs WHERE name_lower = 'red plate')", f"{S.PARTS}, {S.REFS}", "parts", None))
def reference_sources(spark, d):
    return handles(search.reference_sources(A.lineitem_refs(spark, d), A.part_nodes(spark, d), "red plate", None))


# ---- set operations, caps, summaries

BRANCHES = f"""{S.NODES}, {S.found(C('thing'), limit=60, name='a')}, {S.found(C('attion'), limit=60, name='b')}, {S.found(C('thble'), limit=60, name='c')}"""


@query(
    f"""WITH {BRANCHES}, u AS (SELECT *, 0 AS branch FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY branch, file_path, node_ord) AS n FROM u)
SELECT {S.HANDLE}, branch FROM o WHERE n = 1 ORDER BY branch, file_path, node_ord, id LIMIT 100"""
)
def union_any(spark, d):
    nodes = A.doc_nodes(spark, d)
    return combine.union_where(nodes, [search.condition(nodes, t) for t in ("thing", "attion", "thble")], 60)


@query(of(f"{C('thing')} AND {C('attion')}", limit=None))
def intersect_all(spark, d):
    nodes = A.doc_nodes(spark, d)
    return handles(combine.intersect_where(nodes, [search.condition(nodes, t) for t in ("thing", "attion")], limit=None))


@query(
    f"WITH {BRANCHES} SELECT * FROM a WHERE id IN (SELECT id FROM b) ORDER BY file_path, node_ord LIMIT 30"
)
def intersect_bounded(spark, d):
    nodes = A.doc_nodes(spark, d)
    return handles(combine.intersect_where(nodes, [search.condition(nodes, t) for t in ("thing", "attion")], 60, 30))


@query(f"WITH {BRANCHES} SELECT * FROM a ORDER BY file_path, node_ord LIMIT 5")
def limit_nested(spark, d):
    return handles(search.first(search.grep(A.doc_nodes(spark, d), "thing", limit=60), 5))


SUMMARY = """r AS (SELECT *, row_number() OVER (ORDER BY file_path, node_ord) AS n FROM (SELECT * FROM m ORDER BY file_path, node_ord LIMIT {two}))
SELECT count(*) AS total_matches, count(*) > {one} AS truncated, count(*) FILTER (n <= {one}) AS returned, CAST(coalesce(sum(token_count) FILTER (n <= {one}), 0) AS BIGINT) AS total_tokens FROM r"""


@query(f"WITH {S.NODES}, {S.found(C('thing'), limit=None, name='m')}, {SUMMARY.format(one=50, two=100)}")
def query_summary(spark, d):
    return combine.summary(search.grep(A.doc_nodes(spark, d), "thing", limit=None), 50)


@query(f"WITH {S.NODES}, {S.found(C('thing'), limit=50, name='m')}, {SUMMARY.format(one=50, two=100)}")
def query_summary_with_limit(spark, d):
    return combine.summary(search.grep(A.doc_nodes(spark, d), "thing", limit=50), 50)


@query(f"WITH {S.EVENTS} SELECT 'k' || k AS key, min(ts) AS first_seen FROM e GROUP BY k ORDER BY first_seen DESC, key DESC LIMIT 128")
def query_cache_fifo(spark, d):
    e = A.read(spark, d, "events")
    seen = e.select(F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return combine.newest_keys(seen, 128)


# ---- scalars


@query(f"WITH {S.NODES} SELECT file_path, id, substring(id, 2) AS raw FROM nodes")
def handle_ids(spark, d):
    return A.doc_nodes(spark, d).select("file_path", "id", X.raw_id(F.col("id")).alias("raw"))


@query(f"WITH {S.NODES} SELECT id, preview, token_count FROM nodes")
def preview_and_tokens(spark, d):
    return A.doc_nodes(spark, d).select("id", "preview", "token_count")


@query(
    r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS l FROM documents) SELECT doc_id, CAST(len(list_distinct(l)) AS INTEGER) AS n_terms, CAST(len(l) AS INTEGER) AS n_all, l[1] AS first_term FROM t"
)
def split_terms(spark, d):
    t = A.read(spark, d, "documents").select("doc_id", X.split_terms(F.col("text")).alias("l"), F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: x != "").alias("every"))
    return t.select("doc_id", F.size("l").alias("n_terms"), F.size("every").alias("n_all"), F.get("l", F.lit(0)).alias("first_term"))


@query(
    r"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'markdown' ELSE 'other' END AS kind FROM part"
)
def file_types(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("rs", "tsx", "md", "zip"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("a/b.c/"), F.col("p_name"), F.lit("."), ext)
    return A.read(spark, d, "part").select("p_partkey", X.file_type(path).alias("kind"))


RULE_FILES = (("", "*7.txt\n!src1/en/*7.txt\nsrc2/\n/src4/fr/\n# none\n"), ("src5", "/de/*\n!/de/1*.txt\n"), ("src6/en", "**/?[0-4].txt\n"))


@query(
    f"""WITH {S.FILES}, r AS (SELECT file_path, CASE WHEN file_path LIKE 'src2/%' OR file_path LIKE 'src4/fr/%' THEN true WHEN file_path LIKE 'src5/de/%' THEN file_path NOT LIKE 'src5/de/1%'
  WHEN file_path LIKE 'src6/en/%' AND regexp_matches(file_path, '^src6/en/.[0-4][.]txt$') THEN true ELSE file_path LIKE '%7.txt' AND file_path NOT LIKE 'src1/en/%' END AS gone FROM files)
SELECT file_path FROM r WHERE NOT gone"""
)
def walk_ignored(spark, d):
    """The paths that the ignore rules of three folders leave."""
    rules = spark.createDataFrame([r for base, text in RULE_FILES for r in ignores.rules_of(base, text)], ignores.RULES)
    f = A.files(spark, d).select("file_path")
    return f.join(ignores.ignored(f, rules), "file_path", "left_anti")


# ---- parsing

LINES = """l AS (SELECT file_path, n, i, ls[i] AS line FROM (SELECT file_path, string_split(content, chr(10)) AS ls, len(string_split(content, chr(10))) AS n FROM files), unnest(range(1, n + 1)) AS t(i)),
p AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l)"""


@query(
    f"""WITH {S.FILES}, {LINES}, big AS (SELECT file_path, content, len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END AS n FROM files),
w AS (SELECT file_path, o FROM big, unnest(range(0, n, 4)) AS t(o) WHERE strlen(content) > 2000),
c AS (SELECT w.file_path, o, min(a) AS s, max(a + strlen(line)) AS e, min(i) AS f, max(i) AS g FROM w JOIN p ON p.file_path = w.file_path AND i > o AND i <= o + 5 JOIN big ON big.file_path = w.file_path AND i <= big.n GROUP BY ALL)
SELECT file_path, CAST(s AS BIGINT) AS start_byte, CAST(e AS BIGINT) AS end_byte, CAST(f AS INTEGER) AS line_start, CAST(g AS INTEGER) AS line_end, 'h' || substring(sha256(file_path || ':7:' || CAST(s AS BIGINT) || '-' || CAST(e AS BIGINT)), 1, 24) AS id FROM c
UNION ALL SELECT file_path, 0, strlen(content), 1, CAST(n AS INTEGER), 'h' || substring(sha256(file_path || ':7:0-' || strlen(content)), 1, 24) FROM big WHERE strlen(content) <= 2000 AND content <> ''"""
)
def chunk_lines(spark, d):
    return parse.chunks(A.files(spark, d), 5, 1, 2000)


CONVERSATIONS = "files AS (SELECT 'conv/' || conv_id || '.md' AS file_path, string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"


def conversation_files(spark, d):
    part = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"))
    c = A.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("ps"))
    return c.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("file_path"), F.array_join(F.transform("ps", lambda x: x.p), "").alias("content"))


SECTIONS = f"""{CONVERSATIONS}, {LINES}, m AS (SELECT *, sum(CAST(line LIKE '## %' AS INTEGER)) OVER (PARTITION BY file_path ORDER BY i) AS s FROM p),
sections AS (SELECT file_path, 0 AS node_type, CAST(min(a) AS BIGINT) AS start_byte, CAST(max(a + strlen(line)) AS BIGINT) AS end_byte, CAST(min(i) AS INTEGER) AS line_start, CAST(max(i) AS INTEGER) AS line_end, arg_min(substring(line, 4), i) AS heading FROM m WHERE s > 0 GROUP BY file_path, s)"""


@query(f"WITH {SECTIONS} SELECT * FROM sections")
def section_parse(spark, d):
    return parse.markdown(conversation_files(spark, d)).filter("node_type = 0")


@query(f"WITH {SECTIONS} SELECT file_path, start_byte, heading FROM sections WHERE lower(heading) LIKE '%user%2%' ORDER BY file_path, start_byte LIMIT 100")
def section_like(spark, d):
    nodes = parse.markdown(conversation_files(spark, d)).withColumn("node_ord", F.col("start_byte"))
    return search.sections(nodes, "User%2").select("file_path", "start_byte", "heading")


# One source file of each language for every part; {k} is its key, {s} its size.
SHAPES = {
    "py": "\'\'\'\nimport doc\ndef doc(): pass\n\'\'\'\nfrom a.b import c as d\nclass P{k}(Base):\n    x = f(1)\n    @deco\n    async def run(self): return self.find{s}(\n        \"g(1)\")\n\n    def end(self):\n        def inner():\n            pass\n\n# done\n",
    "rs": "use std::collections::{HashMap, io::Read};\n// fn no() {}\npub(crate) struct P{k}<T>(T);\nimpl<T: Clone> Show for P{k}<T> { pub unsafe extern \"C\" fn run(&self) -> u32 { println!(\"{}\", no(1)); a::b::find{s}::<T>(\"g(1)\") } }\npub trait Named { fn name(&self); fn twice(&self) { self.name() } }\nmod m{k} {}\n",
    "ts": "import e, {a, b as c} from 'lib';\n/*\nimport {no} from 'y'\n*/\nexport class P{k}<T> extends Q<{x: T}> {\n  async run<U>(a: U): Promise<void> { return this.find{s}(/[(\"]/, new Foo(1)); }\n  go = (x: number): number => twice(x);\n  later(a: string): void;\n}\nexport const f{k} = async (a: number): Promise<X> => { g<string>(a) };\ninterface I{k} { call(x: number): void }\nlist.map(x => x + {s});\n",
    "go": "package main\n\nimport (\n\t\"fmt\"\n\tweb \"net/http\"\n)\n\ntype (\n\tA{k} struct { x int }\n\tB{k} interface { M(a int) string }\n)\n\nfunc (s *A{k}) Run() interface{} { return web.Get{s}(`g(1)`) }\n\nfunc Map[T any](xs []T) []T {\n\tdefer s.go(1)\n\treturn make().Run(xs)\n}\n",
}
SHAPES_MD = "Title *{k}*\n===\n\nFirst of {k}\nsecond line\n---\n\n````py\n```\n# no {s}\n````\n\n    indented {k}\n\n> quoted {k}\nlazy\n\n- tight {k}\n- two\n\n1. loose\n\n2. items {s}\n\n   # Third `{s}` #\n\n[a]: /b\n<div>\nraw {k}\n</div>\n\n~~~\nopen # {k}\n"
# Blocks of each: node type, heading, the text of the block, and what stands before it.
MARKED = (
    ("md", 0, "Title {k}", "Title *{k}*\n===\n", ""),
    ("md", 0, "First of {k} second line", SHAPES_MD[SHAPES_MD.index("First") : SHAPES_MD.index("   # Third") - 1], ""),
    ("md", 0, "Third", SHAPES_MD[SHAPES_MD.index("# Third") :], ""),
    ("md", 1, "py", "````py\n```\n# no {s}\n````", ""), ("md", 1, None, "    indented {k}", ""), ("md", 1, None, "~~~\nopen # {k}\n", ""),
    ("md", 2, None, "quoted {k}\nlazy", "> "), ("md", 2, None, "loose", "1. "), ("md", 2, None, "items {s}", "2. "),
)
# What each file declares: language, node type, name, heading, parent, and the text of the node.
DECLARED = (
    ("py", 4, "P{k}", None, None, "class P{k}(Base):\n    x = f(1)\n    @deco\n    async def run(self): return self.find{s}(\n        \"g(1)\")\n\n    def end(self):\n        def inner():\n            pass"),
    ("py", 6, "run", None, "P{k}", "async def run(self): return self.find{s}(\n        \"g(1)\")"),
    ("py", 6, "end", None, "P{k}", "def end(self):\n        def inner():\n            pass"),
    ("py", 6, "inner", None, "P{k}", "def inner():\n            pass"),
    ("rs", 5, "P{k}", None, None, "pub(crate) struct P{k}<T>(T);"),
    ("rs", 5, "P{k}", None, None, "impl<T: Clone> Show for P{k}<T> { pub unsafe extern \"C\" fn run(&self) -> u32 { println!(\"{}\", no(1)); a::b::find{s}::<T>(\"g(1)\") } }"),
    ("rs", 3, "run", None, "P{k}", "pub unsafe extern \"C\" fn run(&self) -> u32 { println!(\"{}\", no(1)); a::b::find{s}::<T>(\"g(1)\") }"),
    ("rs", 4, "Named", None, None, "pub trait Named { fn name(&self); fn twice(&self) { self.name() } }"),
    ("rs", 3, "twice", None, "Named", "fn twice(&self) { self.name() }"),
    ("rs", 0, None, "mod m{k}", None, "mod m{k} {}"),
    ("ts", 4, "P{k}", None, None, "class P{k}<T> extends Q<{x: T}> {\n  async run<U>(a: U): Promise<void> { return this.find{s}(/[(\"]/, new Foo(1)); }\n  go = (x: number): number => twice(x);\n  later(a: string): void;\n}"),
    ("ts", 6, "run", None, "P{k}", "async run<U>(a: U): Promise<void> { return this.find{s}(/[(\"]/, new Foo(1)); }"),
    ("ts", 3, "go", None, "P{k}", "(x: number): number => twice(x)"),
    ("ts", 3, "f{k}", None, None, "async (a: number): Promise<X> => { g<string>(a) }"),
    ("ts", 5, "I{k}", None, None, "interface I{k} { call(x: number): void }"),
    ("ts", 3, "<anonymous>", None, None, "x => x + {s}"),
    ("go", 5, "A{k}", None, None, "type (\n\tA{k} struct { x int }\n\tB{k} interface { M(a int) string }\n)"),
    ("go", 5, "B{k}", None, None, "B{k} interface { M(a int) string }"),
    ("go", 6, "Run", None, "A{k}", "func (s *A{k}) Run() interface{} { return web.Get{s}(`g(1)`) }"),
    ("go", 3, "Map", None, None, "func Map[T any](xs []T) []T {\n\tdefer s.go(1)\n\treturn make().Run(xs)\n}"),
)
# What each file refers to: language, kind, name, qualifier, the text of the reference, and what stands before it.
REFERRED = (
    ("py", "import", "a.b", None, "a.b", "from "), ("py", "import", "c", None, "c as d", "import "), ("py", "call", "f", None, "f(1)", "x = "), ("py", "call", "find{s}", "self", "self.find{s}(\n        \"g(1)\")", "return "),
    ("rs", "import", "collections", "std", "std::collections", "use "), ("rs", "import", "HashMap", None, "HashMap", "{"), ("rs", "import", "Read", "io", "io::Read", ", "), ("rs", "call", "find{s}", "a::b", "a::b::find{s}::<T>(\"g(1)\")", "; "), ("rs", "call", "name", "self", "self.name()", "{ "),
    ("ts", "import", "e", None, "e", "import "), ("ts", "import", "a", None, "a", "{"), ("ts", "import", "b", None, "b", ", "), ("ts", "import", "c", None, "c", "as "), ("ts", "call", "find{s}", "this", "this.find{s}(/[(\"]/, new Foo(1))", "return "), ("ts", "call", "twice", None, "twice(x)", "=> "),
    ("ts", "call", "g", None, "g<string>(a)", "{ "), ("ts", "call", "map", "list", "list.map(x => x + {s})", "\n"),
    ("go", "import", "fmt", "fmt", "\"fmt\"", "\t"), ("go", "import", "http", "net/http", "web \"net/http\"", "\t"), ("go", "call", "Get{s}", "web", "web.Get{s}(`g(1)`)", "return "), ("go", "call", "go", "s", "s.go(1)", "defer "), ("go", "call", "make", None, "make()", "return "), ("go", "call", "Run", "make()", "make().Run(xs)", "return "),
)


def source_files(spark, d):
    """part as source files and one of markdown, one of each language for every part."""
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
    shapes = {**SHAPES, "md": SHAPES_MD}
    each = F.array(*(F.struct(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(f".{e}")).alias("file_path"), filled(t).alias("content")) for e, t in shapes.items()))
    # a part is much work in few bytes, so that a split of the table holds too much of it
    parts = A.read(spark, d, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return parts.select(F.explode(each).alias("r")).select("r.*")


def filled_sql(t: str | None) -> str:
    if t is None:
        return "CAST(NULL AS VARCHAR)"
    quoted = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in t.split("\n"))
    return f"replace(replace({quoted}, '{{k}}', CAST(p_partkey AS VARCHAR)), '{{s}}', CAST(p_size AS VARCHAR))"


def placed_sql(rows: tuple, columns: str) -> str:
    """Rows (language, values, text, what stands before it) as spans and lines in the files of their language."""
    each = " UNION ALL ".join(
        f"SELECT 'src/p' || p_partkey || '.{r[0]}' AS file_path, {filled_sql(SHAPES.get(r[0], SHAPES_MD))} AS content, {', '.join(str(x) if isinstance(x, int) else filled_sql(x) for x in r[1:-2])}, {filled_sql(r[-2])} AS x, {filled_sql(r[-1])} AS b FROM part"
        for r in rows
    )
    return f"""e(file_path, content, {columns}, x, b) AS ({each}), placed AS (SELECT *, strpos(content, b || x) - 1 + strlen(b) AS s FROM e)
SELECT file_path, {columns}, CAST(s AS BIGINT) AS start_byte, CAST(s + strlen(x) AS BIGINT) AS end_byte, CAST(1 + length(content[1:s]) - length(replace(content[1:s], chr(10), '')) AS INTEGER) AS line_start,
  CAST(1 + length(content[1:s + length(x)]) - length(replace(content[1:s + length(x)], chr(10), '')) AS INTEGER) AS line_end FROM placed"""


@query(f"WITH {placed_sql(tuple((*r, '') for r in DECLARED), 'node_type, name, heading, parent_name')}")
def declarations(spark, d):
    return parse.declarations(source_files(spark, d))


@query(f"WITH {placed_sql(MARKED, 'node_type, heading')}")
def markdown_blocks(spark, d):
    """Headings of both kinds, fences of any length, indented code, quotes and lists, in one file for every part."""
    return parse.markdown(source_files(spark, d).filter("file_path LIKE '%.md'"))


@query(f"WITH {placed_sql(REFERRED, 'ref_type, name, qualifier')}")
def code_references(spark, d):
    return parse.references(source_files(spark, d), previews=False).drop("name_lower")


@query(
    f"""WITH {S.FILES}, {LINES}, big AS (SELECT * FROM p WHERE i <= n),
pts AS (SELECT file_path, CAST(a AS BIGINT) AS start_byte, CAST(a + 1 AS BIGINT) AS end_byte FROM p WHERE strlen(line) > 0),
w AS (SELECT file_path, k, min(a) AS s, max(a + strlen(line)) AS e FROM p, unnest(range(0, 2)) AS t(k) WHERE k = 0 OR i <= 3 GROUP BY ALL),
j AS (SELECT pts.*, arg_min(k, (e - s) * 10 + k) AS k FROM pts JOIN w ON w.file_path = pts.file_path AND s <= start_byte AND end_byte <= e GROUP BY ALL)
SELECT file_path, start_byte, end_byte, CAST(k AS INTEGER) AS k FROM j"""
)
def enclosing_node(spark, d):
    ls = parse.lines(A.files(spark, d))
    points = ls.filter(F.octet_length("text") > 0).select("file_path", "start_byte", (F.col("start_byte") + 1).alias("end_byte"))
    spans = [F.struct(F.lit(k).alias("k"), cond.alias("in")) for k, cond in ((0, F.lit(True)), (1, F.col("line") <= 3))]
    nodes = (
        ls.select("*", F.explode(F.array(*spans)).alias("z"))
        .filter("z.in")
        .groupBy("file_path", F.col("z.k").alias("k"))
        .agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"))
        .select("file_path", "start_byte", "end_byte", F.col("k").alias("node_ord"), F.col("k").alias("id"))
    )
    return search.enclosing(points, nodes).select("file_path", "start_byte", "end_byte", F.col("source_id").alias("k"))


# ---- index build

INDEXED = f"""{CONVERSATIONS}, {LINES}, k AS (SELECT *, CASE WHEN line LIKE '## %' THEN 0 WHEN trim(line) = '' THEN -1 ELSE 2 END AS kind, sum(CAST(line LIKE '## %' AS INTEGER)) OVER (PARTITION BY file_path ORDER BY i) AS s FROM p),
g AS (SELECT *, sum(CAST(kind = 0 OR kind <> before AS INTEGER)) OVER (PARTITION BY file_path ORDER BY i) AS r FROM (SELECT *, lag(kind, 1, -2) OVER (PARTITION BY file_path ORDER BY i) AS before FROM k)),
spans AS (SELECT file_path, 0 AS node_type, CAST(min(a) AS BIGINT) AS start_byte, CAST(max(a + strlen(line)) AS BIGINT) AS end_byte, min(i) AS f, max(i) AS t, arg_min(substring(line, 4), i) AS heading, string_agg(line, chr(10) ORDER BY i) AS body FROM g WHERE s > 0 GROUP BY file_path, s
  UNION ALL SELECT file_path, 2, CAST(min(a) AS BIGINT), CAST(max(a + strlen(line)) AS BIGINT), min(i), max(i), NULL, string_agg(line, chr(10) ORDER BY i) FROM g WHERE kind = 2 GROUP BY file_path, r),
indexed AS (SELECT 'h' || substring(sha256(file_path || ':' || node_type || ':' || start_byte || '-' || end_byte), 1, 24) AS id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_byte, end_byte DESC, node_type) - 1 AS node_ord, node_type, start_byte, end_byte,
  CAST(f AS INTEGER) AS line_start, CAST(t AS INTEGER) AS line_end, CAST((end_byte - start_byte) // 4 AS INTEGER) AS token_count, {S.preview('body')} AS preview, heading, body AS content FROM spans)"""


def conversation_nodes(spark, d):
    return index.nodes(conversation_files(spark, d).withColumn("content_hash", F.sha2("content", 256)))


@query(f"WITH {INDEXED} SELECT * EXCLUDE content, sha256(content) AS content_sha, sha256({S.norm('content')}) AS norm_sha FROM indexed")
def index_nodes(spark, d):
    shown = ("id", "file_path", "node_ord", "node_type", "start_byte", "end_byte", "line_start", "line_end", "token_count", "preview", "heading")
    return conversation_nodes(spark, d).select(*shown, F.sha2("content", 256).alias("content_sha"), F.sha2("norm_text", 256).alias("norm_sha"))


def stored_index(spark, nodes):
    """A new index of nodes, in the shared folder."""
    made = Snapshots(spark, shared_folder(spark, "index"))
    index.write(made, nodes, None)
    return made


@query(f"WITH {INDEXED} SELECT {S.HANDLE} FROM indexed WHERE {C('thing')} OR {C('user')}")
def index_grep(spark, d):
    return handles(postings.grep(stored_index(spark, written(conversation_nodes(spark, d))), "thing", "user", limit=None))


@query(f"WITH {S.NODES} SELECT {S.HANDLE} FROM nodes WHERE ({C('of the')} OR ({C('thing')} AND {C('attion')})) AND NOT {C('this')} AND NOT {C('and the')} AND file_path LIKE '%/en/%' ORDER BY file_path, node_ord LIMIT 50")
def index_phrase(spark, d):
    """Phrases and terms, some of them excluded, from postings alone; the first fifty nodes are then looked up."""
    of = stored_index(spark, A.doc_nodes(spark, d))
    return handles(postings.grep(of, '"of the"', "thing attion", none_of=("this", '"and the"'), glob="*/en/*", limit=50))


CHANGED = f"""{S.NODES}, again AS (SELECT file_path, 'thing rewritten ' || doc_id AS content FROM files WHERE doc_id % 10 = 3 AND file_path NOT LIKE 'src5/%'),
live AS (SELECT 1 AS generation, file_path, content FROM nodes UNION ALL SELECT 2, file_path, content FROM nodes WHERE file_path NOT IN (SELECT file_path FROM again) UNION ALL SELECT 2, file_path, content FROM again),
every AS (SELECT * FROM live UNION ALL SELECT generation + g, file_path, content FROM live, (VALUES (1), (2)) t(g) WHERE generation = 2 AND file_path NOT LIKE 'src5/%')"""


def changed_index(spark, d):
    """An index of documents in four generations: as they are, a tenth of them written anew, a source dropped, and compacted."""
    made = stored_index(spark, A.doc_nodes(spark, d))
    files = A.files(spark, d).filter("doc_id % 10 = 3 AND source <> 'src5'").withColumn("content", F.concat(F.lit("thing rewritten "), F.col("doc_id").cast("string")))
    again = A.whole_file_nodes(files)
    index.write(made, again, None, again)
    index.invalidate(made, "src5/*")
    made.compact()
    return made


@query(f"WITH {CHANGED} SELECT generation, file_path FROM every WHERE {C('thing')} AND NOT {C('the')}")
def index_generations(spark, d):
    """A search of each generation of an index that was updated, invalidated and compacted."""
    of = changed_index(spark, d)
    each = [postings.grep(of, "thing", none_of=("the",), limit=None, generation=g).select(F.lit(g).alias("generation"), "file_path") for g in of.generations()]
    return functools.reduce(DataFrame.unionByName, each)


@query(f"WITH {S.NODES}, gone AS (SELECT count(*) AS n FROM nodes WHERE regexp_matches(file_path, '^src[12]/.*')) SELECT n AS files_dropped, (SELECT count(*) FROM nodes WHERE {C('the')} AND NOT regexp_matches(file_path, '^src[12]/.*')) AS found, (SELECT count(*) FROM nodes) - n AS nodes FROM gone")
def index_invalidate(spark, d):
    """How many files an invalidation by glob dropped from an index, and what searches and reads find after it."""
    of = stored_index(spark, A.doc_nodes(spark, d))
    n = index.invalidate(of, "{src1,src2}/*")
    hits = postings.found(of, "the").agg(F.count("*").alias("found"))
    return hits.join(of.read("nodes").agg(F.count("*").alias("nodes"))).select(F.lit(n).cast("long").alias("files_dropped"), "found", "nodes")


CODE = """u AS (SELECT 'shop/' || replace(p_brand, '#', '') || '.py' AS file_path, p_partkey, 'class Part' || p_partkey || '(Base):' AS c, '    def price(self, n):' AS m, '        return ' AS h, 'shop.find' || p_size || '(n, "f(1)")' AS x, p_size FROM part),
o AS (SELECT *, 12 + coalesce(sum(strlen(c || m || h || x) + 4) OVER w, 0) AS a, row_number() OVER w - 1 AS k FROM u WINDOW w AS (PARTITION BY file_path ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT * REPLACE (CAST(k_ AS BIGINT) AS k) FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY p_partkey) - 1 AS k_ FROM o)),
z AS (SELECT *, CAST(a AS BIGINT) AS s, CAST(a + strlen(c) + 5 AS BIGINT) AS d, CAST(a + strlen(c || m) + 2 + strlen(h) AS BIGINT) AS r, CAST(a + strlen(c || m || h || x) + 2 AS BIGINT) AS e, CAST(4 * k + 4 AS INTEGER) AS l FROM q),
cn AS (SELECT file_path, 2 * k AS node_ord, 4 AS node_type, s AS start_byte, e AS end_byte, CAST(4 * k + 2 AS INTEGER) AS line_start, l AS line_end, 'Part' || p_partkey AS name, CAST(NULL AS VARCHAR) AS parent_name, '{"kind":"class","name":"Part' || p_partkey || '"}' AS metadata FROM z
  UNION ALL SELECT file_path, 2 * k + 1, 6, d, e, CAST(4 * k + 3 AS INTEGER), l, 'price', 'Part' || p_partkey, '{"kind":"method","name":"price","parent":"Part' || p_partkey || '"}' FROM z)"""


def part_files(spark, d):
    """part as Python files, one of each brand, with a class of one method and one call for every part."""
    path = F.concat(F.lit("shop/"), F.regexp_replace("p_brand", "#", ""), F.lit(".py"))
    p = A.read(spark, d, "part").select(path.alias("file_path"), "p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "file_path")
    unit = lambda x: F.format_string('class Part%d(Base):\n    def price(self, n):\n        return shop.find%d(n, "f(1)")\n\n', x.p_partkey, x.p_size)
    f = p.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("us"))
    f = f.select("file_path", F.concat(F.lit("import shop\n"), F.array_join(F.transform("us", unit), "")).alias("content"))
    return f.withColumn("content_hash", F.sha2("content", 256))


@query(f"WITH {CODE} SELECT *, 'h' || substring(sha256(file_path || ':' || node_type || ':' || start_byte || '-' || end_byte), 1, 24) AS id, CAST((end_byte - start_byte) // 4 AS INTEGER) AS token_count FROM cn")
def index_code_nodes(spark, d):
    shown = ("id", "file_path", "node_ord", "node_type", "start_byte", "end_byte", "line_start", "line_end", "token_count", "name", "parent_name", "metadata")
    return index.nodes(part_files(spark, d)).select(*shown)


@query(
    f"""WITH {CODE} SELECT file_path, 'find' || p_size AS name, 'shop' AS qualifier, 'call' AS ref_type, r AS start_byte, CAST(r + strlen(x) AS BIGINT) AS end_byte, CAST(4 * k + 4 AS INTEGER) AS line_start, CAST(4 * k + 4 AS INTEGER) AS line_end, 'return ' || x AS preview, 'h' || substring(sha256(file_path || ':6:' || d || '-' || e), 1, 24) AS source_id FROM z
UNION ALL SELECT DISTINCT file_path, 'shop', NULL, 'import', 7, 11, 1, 1, 'import shop', NULL FROM u"""
)
def index_refs(spark, d):
    return index.build(part_files(spark, d))[1].drop("name_lower")


@query(
    f"""WITH {INDEXED}, c AS (SELECT DISTINCT conv_id FROM conversations) SELECT file_path, node_type, start_byte, end_byte FROM indexed JOIN c ON file_path = 'conv/' || conv_id || '.md' WHERE conv_id % 10 > 1
UNION ALL SELECT 'conv/' || conv_id || '.md', t, s, e FROM c, (VALUES (0, 0, 10), (2, 8, 10)) v(t, s, e) WHERE conv_id % 10 = 0"""
)
def overlay_rebuild(spark, d):
    c = A.read(spark, d, "conversations").select("conv_id").distinct()
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md"))
    dirty = c.filter("conv_id % 10 <= 1").select(path.alias("path"), F.when(F.col("conv_id") % 10 == 1, "deleted").otherwise("modified").alias("status"))
    files = c.select(path.alias("file_path"), F.lit("## new\n\nhi").alias("content"), F.lit("new").alias("content_hash"))
    return overlay.rebuild(conversation_nodes(spark, d), files, dirty).select("file_path", "node_type", "start_byte", "end_byte")


# ---- ranking and evidence

TEXT = "thing attion src1"
TERMS = ["thing", "attion", "src1"]
HITS = f"({C('thing')} OR {C('attion')})"
PACK = f"{S.SOURCES}, {S.found(HITS, 'snodes', None)}, {S.pack('f', TERMS)}"
TOTALS = "totals AS (SELECT least(count(*), 200) AS total_matches, count(*) > 100 AS truncated FROM f)"


def evidence_pack(spark, d):
    found = search.grep(A.source_nodes(spark, d), "thing", "attion", limit=None)
    return found, rank.evidence(found, TEXT)


@query(f"WITH {S.SOURCES}, hay AS (SELECT *, lower(file_path) || ' ' || lower(preview) AS hay FROM snodes) SELECT id, {S.score(TERMS)} AS score FROM hay")
def score(spark, d):
    return A.source_nodes(spark, d).select("id", F.round(rank.score(TEXT), 9).alias("score"))


@query(f"WITH {PACK} SELECT {S.HANDLE}, score, rank FROM pack")
def evidence_handles(spark, d):
    return evidence_pack(spark, d)[1].select(*search.HANDLE, "score", "rank")


@query(f"WITH {PACK} SELECT file_path, string_agg(id, ',' ORDER BY rank) AS handle_ids, CAST(sum(token_count) AS BIGINT) AS tokens, min(rank) AS first_rank FROM pack GROUP BY file_path")
def evidence_files(spark, d):
    return rank.evidence_files(evidence_pack(spark, d)[1])


@query(
    f"""WITH {PACK}, {TOTALS}, facts AS (SELECT count(*) AS selected, count(DISTINCT file_path) AS files, coalesce(avg(score) FILTER (rank <= 3), 0) AS top FROM pack),
g AS (SELECT *, round(least(greatest(0.55::DOUBLE * top + 0.2::DOUBLE * least(files, 3) / 3 + 0.15::DOUBLE * least(selected / 8, 1.0::DOUBLE) + 0.1::DOUBLE * CASE WHEN total_matches = 0 THEN 0 WHEN total_matches < 3 THEN 0.4 ELSE 1 END - CASE WHEN truncated THEN 0.1::DOUBLE ELSE 0 END, 0), 1), 9) AS confidence FROM facts, totals),
h AS (SELECT *, confidence >= 0.55 OR (selected >= 4 AND files >= 2) AS stop FROM g)
SELECT confidence, CASE WHEN confidence < 0.35 THEN 'low' WHEN confidence < 0.7 THEN 'medium' ELSE 'high' END AS band, stop AS stop_querying, CASE WHEN stop THEN 'expand_then_answer' ELSE 'refine_query' END AS action,
CAST(least(selected, CASE WHEN confidence >= 0.75 THEN 2 WHEN confidence >= 0.5 THEN 3 ELSE 4 END) AS INTEGER) AS expand_count, CASE WHEN stop THEN 0 ELSE 1 END AS more_queries FROM h"""
)
def evidence_guidance(spark, d):
    found, pack = evidence_pack(spark, d)
    return rank.guidance(pack, combine.summary(found, 100))


@query(
    f"""WITH {PACK}, s AS (SELECT *, rank <= 2 OR rank = 5 AS is_recent FROM pack WHERE rank <= 6)
SELECT CAST(row_number() OVER (ORDER BY is_recent, rank) AS INTEGER) AS place, id, is_recent FROM s"""
)
def expand_suggestions(spark, d):
    pack = evidence_pack(spark, d)[1]
    return rank.suggestions(pack, pack.filter("rank <= 2 OR rank = 5").select("id"))


GREEDY = f"""{S.SOURCES}, f AS (SELECT * FROM snodes WHERE {C('thing')} ORDER BY file_path, node_ord LIMIT 32), hay AS (SELECT *, lower(file_path) || ' ' || lower(preview) AS hay FROM f), scored AS (SELECT * EXCLUDE (hay), {S.score(TERMS)} AS score FROM hay),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, token_count, file_path, node_ord) AS n FROM scored),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST([] AS STRUCT(p VARCHAR, a INTEGER, b INTEGER)[]) AS taken, false AS chosen
  UNION ALL SELECT n, CASE WHEN ok THEN used + token_count ELSE used END, CASE WHEN ok THEN list_append(taken, {{'p': file_path, 'a': line_start, 'b': line_end}}) ELSE taken END, ok FROM
  (SELECT r.n, used, taken, token_count, file_path, line_start, line_end, used + token_count <= 4000 AND len(list_filter(taken, lambda t: t.p = file_path)) < 2 AND len(list_filter(taken, lambda t: t.p = file_path AND line_start <= t.b + 2 AND t.a <= line_end + 2)) = 0 AS ok FROM walk JOIN r ON r.n = walk.n + 1))"""


@query(f"WITH RECURSIVE {GREEDY} SELECT id, file_path, node_ord, line_start, line_end, token_count, score, chosen FROM r JOIN (SELECT n, chosen FROM walk) USING (n)")
def expand_budget_greedy(spark, d):
    found = search.grep(A.source_nodes(spark, d), "thing", limit=32)
    return rank.choose(found, TEXT, 4_000)


@query(
    rf"""WITH {PACK}, w AS (SELECT unnest(list_filter(regexp_split_to_array(preview, '[^\p{{L}}\p{{N}}_]+'), lambda x: strlen(x) >= 4)) AS symbol FROM pack WHERE rank <= 8),
o AS (SELECT symbol, CAST(sum(1 + CASE WHEN regexp_matches(symbol, '\p{{Lu}}') THEN 2 ELSE 0 END + CASE WHEN contains(symbol, '_') THEN 1 ELSE 0 END) AS BIGINT) AS weight FROM w
  WHERE NOT regexp_matches(symbol, '^[0-9]') AND lower(symbol) NOT IN ({', '.join(repr(x) for x in [*rank.STOP_WORDS, *TERMS])}) GROUP BY symbol)
SELECT * FROM o ORDER BY weight DESC, strlen(symbol) DESC, symbol LIMIT 8"""
)
def symbol_candidates(spark, d):
    return rank.symbol_candidates(evidence_pack(spark, d)[1], TEXT)


@query(
    f"WITH {S.PARTS}, {S.found(C('red', 'name') + ' OR ' + C('plate', 'name'), 'parts')} SELECT * FROM f"
)
def pattern_fallback(spark, d):
    """A pattern of several words that finds nothing as a whole is asked again with any of its words; one plan does both."""
    nodes = A.part_nodes(spark, d).withColumn("content", F.col("name"))
    whole, words = search.grep(nodes, "red zzz plate", limit=None), search.grep(nodes, "red", "zzz", "plate", limit=None)
    none = whole.agg((F.count("*") == 0).alias("none"))
    return handles(search.first(handles(whole).unionByName(handles(words.join(F.broadcast(none)).filter("none"))), 100))


@query(f"WITH {S.EVENTS} SELECT 'k' || k AS name, count(*) AS n FROM e GROUP BY k ORDER BY n DESC, name LIMIT 20")
def top_patterns(spark, d):
    e = A.read(spark, d, "events").select(F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("pattern"))
    return rank.top_counts(e, "pattern")


@query(
    "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value) AS BIGINT)) // count(*) AS BIGINT) AS avg_value FROM events GROUP BY event_type"
)
def service_averages(spark, d):
    e = A.read(spark, d, "events")
    total = F.sum(F.round("value").cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.floor(total / F.count("*")).cast("long").alias("avg_value"))


# ---- expansion

OLD_HASH = "CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE content_hash END"


def expansion(spark, d):
    f = A.files(spark, d)
    nodes = A.whole_file_nodes(f).join(f.select("file_path", "doc_id", "content_hash"), "file_path").withColumn("indexed_hash", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("content_hash")))
    ids = nodes.select(F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("id", "^h", "")).when(F.col("doc_id") % 11 == 0, F.lit("h" + "0" * 24)).otherwise(F.col("id")).alias("id"))
    return expand.expand(ids, nodes, f.filter("doc_id % 13 <> 0"))


EXPANSION = f"""{S.NODES}, ids AS (SELECT f.doc_id AS position, CASE WHEN f.doc_id % 7 <> 0 AND f.doc_id % 11 = 0 THEN 'h000000000000000000000000' ELSE n.id END AS id, n.file_path, n.content, f.doc_id % 13 = 0 AS gone, f.doc_id % 10 = 0 AS stale FROM nodes n JOIN files f USING (file_path)),
x AS (SELECT position, id, CASE WHEN id LIKE 'h00000000000%' THEN NULL ELSE file_path END AS file_path, CASE WHEN gone OR id LIKE 'h00000000000%' THEN 'not_found' WHEN stale THEN 'stale' ELSE 'ok' END AS status, content FROM ids)"""


@query(f"WITH {EXPANSION} SELECT position, id, CASE WHEN status = 'ok' THEN sha256(content) END AS content_sha FROM x")
def expand_content(spark, d):
    return expansion(spark, d).select("position", "id", F.sha2("content", 256).alias("content_sha"))


@query(f"WITH {EXPANSION} SELECT position, file_path, status FROM x")
def expand_status_stale(spark, d):
    return expansion(spark, d).select("position", "file_path", "status")


@query(
    f"WITH {S.NODES}, f AS (SELECT * FROM nodes WHERE {C('thing')} ORDER BY file_path, node_ord LIMIT 20), t AS (SELECT sum(token_count) <= 1000000 AS fit FROM f) SELECT count(*) FILTER (fit) AS expanded_count, CAST(coalesce(sum(token_count) FILTER (fit), 0) AS BIGINT) AS expanded_tokens, count(*) AS handles FROM f, t"
)
def auto_expand_all(spark, d):
    return expand.expand_summary(expand.auto_expand(search.grep(A.doc_nodes(spark, d), "thing", limit=20), 1_000_000))


@query(
    f"""WITH RECURSIVE {GREEDY}, t AS (SELECT count(*) FILTER (chosen) AS expanded_count, CAST(coalesce(sum(token_count) FILTER (chosen), 0) AS BIGINT) AS expanded_tokens, count(*) AS handles, CAST(sum(token_count) AS BIGINT) AS total_tokens FROM r JOIN (SELECT n, chosen FROM walk) USING (n))
SELECT *, false AS auto_expanded, 'Expanded ' || expanded_count || '/' || handles || ' handles (' || expanded_tokens || '/' || total_tokens || ' tokens).' AS note FROM t"""
)
def expand_within_budget(spark, d):
    return expand.expand_note(expand.budget_expand(search.grep(A.source_nodes(spark, d), "thing", limit=32), TEXT, 4_000))


@query(
    "WITH p AS (SELECT o_orderkey, CASE WHEN o_custkey % 6 = 5 THEN NULL ELSE o_custkey % 6 END AS repo_id, CASE WHEN o_custkey % 6 = 1 THEN o_orderkey % 2 ELSE o_custkey % 6 END AS generation FROM orders) SELECT o_orderkey FROM p WHERE coalesce(repo_id <> 2 AND (repo_id <> 1 OR NOT EXISTS (SELECT 1 FROM p WHERE repo_id = 1 AND generation <> 1)), true)"
)
def provenance_of_generation(spark, d):
    repo = F.col("o_custkey") % 6
    p = A.read(spark, d, "orders").select("o_orderkey", F.when(repo != 5, repo).alias("repo_id"), F.when(repo == 1, F.col("o_orderkey") % 2).otherwise(repo).alias("generation"))
    shards = spark.range(4).select(F.col("id").alias("repo_id"), F.when(F.col("id") == 2, 9).otherwise(F.col("id")).alias("generation"))
    return overlay.drop_stale_provenance(p, shards).select("o_orderkey")


@query(
    f"""WITH {S.REFS}, r AS (SELECT *, row_number() OVER (ORDER BY file_path, start_byte, end_byte, preview) AS n FROM refs)
SELECT count(*) AS total_matches, count(*) > 100 AS truncated, count(*) FILTER (n <= 100) AS returned, CAST(sum(strlen(preview) // 4) FILTER (n <= 100) AS BIGINT) AS total_tokens FROM r WHERE n <= 200"""
)
def references_summary(spark, d):
    return combine.references_summary(A.lineitem_refs(spark, d), 100)


@query(
    f"WITH {S.NODES}, i AS (SELECT id, doc_id FROM nodes JOIN files USING (file_path)) SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'local' WHEN doc_id % 5 = 0 THEN 'shared' ELSE 'failed' END AS source FROM i"
)
def expand_by_provenance(spark, d):
    f = A.files(spark, d)
    n = A.whole_file_nodes(f).join(f.select("file_path", "doc_id"), "file_path")
    return expand.by_provenance(n, n.filter("doc_id % 3 = 0"), n.filter("doc_id % 5 = 0")).select("id", "source")


@query(
    "SELECT o_orderkey, CASE o_custkey % 4 WHEN 3 THEN 'not_ready' WHEN 2 THEN 'not_ready' ELSE CASE WHEN o_orderkey % 5 = o_custkey % 4 THEN 'ok' ELSE 'conflict' END END AS status FROM orders"
)
def expand_generation(spark, d):
    o = A.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("repo_id"), (F.col("o_orderkey") % 5).alias("generation"))
    shards = spark.range(3).select(F.col("id").alias("repo_id"), F.col("id").alias("generation"), F.when(F.col("id") == 2, "indexing").otherwise("ready").alias("status"))
    return expand.check_generation(o, shards).select("o_orderkey", "status")


# ---- overlay

DIRTY = "dirty AS (SELECT DISTINCT source || '.txt' AS file_path FROM documents WHERE source IN ('src3', 'src7'))"
MERGED = f"""{S.SOURCES}, {DIRTY}, local AS (SELECT * FROM snodes WHERE file_path IN (SELECT file_path FROM dirty) AND NOT (file_path = 'src7.txt' AND node_ord % 5 = 0)),
merged AS (SELECT {S.HANDLE}, 'local' AS source FROM local UNION ALL SELECT {S.HANDLE}, 'shared' FROM snodes WHERE file_path NOT IN (SELECT file_path FROM dirty))"""


def dirty_paths(spark, d):
    return A.read(spark, d, "documents").filter("source IN ('src3', 'src7')").select(F.concat("source", F.lit(".txt")).alias("path")).distinct()


def merged(spark, d):
    nodes = A.source_nodes(spark, d)
    local = nodes.filter("NOT (file_path = 'src7.txt' AND node_ord % 5 = 0)")
    return overlay.merge(local, nodes, dirty_paths(spark, d))


@query(f"WITH {MERGED} SELECT * FROM merged")
def merge_overlay(spark, d):
    return merged(spark, d)


@query(f"WITH {MERGED} SELECT count(*) AS total_matches, CAST(sum(token_count) AS BIGINT) AS total_tokens, true AS truncated, CAST(0 AS BIGINT) AS expanded_count, false AS auto_expanded FROM merged")
def merge_summary(spark, d):
    return overlay.merged_summary(merged(spark, d), False, True)


@query(
    f"""WITH {S.REFS}, m AS (SELECT DISTINCT file_path, line_start, line_end, name, preview, CASE WHEN file_path = 'part/STANDARD' THEN 'local' ELSE 'shared' END AS source FROM refs) SELECT source, count(*) AS n, count(DISTINCT file_path) AS files FROM m GROUP BY source"""
)
def merge_refs(spark, d):
    refs = A.lineitem_refs(spark, d)
    dirty = spark.range(1).select(F.lit("part/STANDARD").alias("path"))
    return overlay.merge_refs(refs, refs, dirty).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))


@query(
    f"""WITH {S.FILES}, l AS (SELECT file_path || ':' || mtime || chr(10) AS line, CAST('0x' || substring(sha256(file_path), 1, 4) AS INTEGER) AS bucket FROM files),
b AS (SELECT bucket, sha256(string_agg(line, '' ORDER BY line)) AS digest FROM l GROUP BY bucket)
SELECT sha256(string_agg(bucket || ':' || digest || chr(10), '' ORDER BY bucket)) AS fingerprint FROM b"""
)
def dirty_fingerprint(spark, d):
    from marlstone.sources.files import fingerprint

    return fingerprint(A.files(spark, d).select(F.col("file_path").alias("path"), "mtime"))


# ---- index lifecycle

PLANNED = f"""{S.FILES}, planned AS (SELECT file_path, token_count, CASE WHEN doc_id % 9 = 0 THEN 'index' WHEN doc_id % 4 = 0 AND {S.NOW} - indexed_at < 3600 THEN 'skip_fresh' WHEN doc_id % 3 = 0 THEN 'index' ELSE 'skip_same_hash' END AS action FROM files)"""


def planned(spark, d):
    f = A.files(spark, d)
    stored = f.filter("doc_id % 9 <> 0").select(
        "file_path",
        F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("doc_id") % 4 == 0, F.col("mtime")).otherwise(F.col("mtime") - 1).alias("mtime"),
        "indexed_at",
    )
    return lifecycle.plan_index(f, stored, A.NOW)


@query(f"WITH {PLANNED} SELECT file_path, action FROM planned")
def index_skip_rules(spark, d):
    return planned(spark, d).select("file_path", "action")


@query(f"WITH {PLANNED} SELECT count(*) FILTER (action = 'index') AS files_indexed, count(*) FILTER (action <> 'index') AS files_skipped, CAST(sum(token_count) AS BIGINT) AS total_tokens FROM planned")
def index_stats(spark, d):
    return lifecycle.index_stats(planned(spark, d))


@query(f"WITH {S.FILES}, a AS (SELECT count(*) AS files, CAST(sum(token_count) AS BIGINT) AS tokens, max(indexed_at) AS last_indexed FROM files WHERE doc_id >= 10) SELECT *, ({S.NOW} - last_indexed) // 60 || ' minutes ago' AS age FROM a")
def index_status(spark, d):
    return lifecycle.status(A.files(spark, d).filter("doc_id >= 10"), A.NOW)


@query(f"WITH {S.FILES} SELECT file_path FROM files WHERE NOT (file_path LIKE 'src1/%' OR file_path LIKE 'src2/%')")
def invalidate_glob(spark, d):
    return lifecycle.invalidate(A.files(spark, d), "{src1,src2}/**").select("file_path")


@query(f"WITH {S.FILES} SELECT file_path, CASE WHEN doc_id % 50 = 0 THEN 'new' ELSE content_hash END AS content_hash FROM files")
def replace_files(spark, d):
    f = A.files(spark, d)
    new = f.filter("doc_id % 50 = 0").select("file_path", F.lit("new").alias("content_hash"))
    return lifecycle.replace_files(f.select("file_path", "content_hash"), new)


# ---- feedback


@query(
    f"WITH {S.EVENTS}, w AS (SELECT first_match_glob AS g, expanded, exp(-greatest({S.NOW} - ts, 0) * ln(2.0::DOUBLE) / 604800) AS weight FROM flagged JOIN queries ON id = query_event_id) SELECT g AS \"glob\", round(sum(CASE WHEN expanded THEN weight ELSE 0 END) / sum(weight), 6) AS score FROM w GROUP BY g"
)
def glob_scores_decay(spark, d):
    return feedback.glob_scores(*A.feedback(spark, d), A.NOW).withColumn("score", F.round("score", 6))


@query(SQL["glob_scores_decay"])
def glob_scores_incremental(spark, d):
    """The same scores from a state that takes the events of ten days at a time, each once."""
    q, h, e = A.feedback(spark, d)
    h = written(h.join(q.select(F.col("id").alias("query_event_id"), "ts"), "query_event_id"))
    e = written(e)
    state, day = spark.createDataFrame([], feedback.STATE), 86_400
    for upto in (A.NOW - 22 * day, A.NOW - 12 * day, A.NOW):
        new = [t.filter((F.col(c) >= (upto - 10 * day if upto < A.NOW else upto - 12 * day)) & (F.col(c) < upto)) for t, c in ((h, "ts"), (e, "expanded_at"))]
        known = [t.filter(F.col(c) < (upto - 10 * day if upto < A.NOW else upto - 12 * day)) for t, c in ((h, "ts"), (e, "expanded_at"))]
        state = written(feedback.update_decayed(state, tuple(new), tuple(known), upto))
    return feedback.decayed_scores(state).withColumn("score", F.round("score", 6))


@query(f"WITH {S.EVENTS} SELECT node_type, round(avg(CAST(expanded AS DOUBLE)), 9) AS prior FROM flagged GROUP BY node_type")
def node_type_priors(spark, d):
    _, handles_, expands = A.feedback(spark, d)
    return feedback.node_type_priors(handles_, expands).withColumn("prior", F.round("prior", 9))


@query(f"WITH {S.EVENTS} SELECT handle_id, arg_max(query_event_id, (ts, query_event_id)) AS query_event_id FROM handles JOIN queries ON id = query_event_id GROUP BY handle_id")
def latest_query(spark, d):
    queries_, handles_, _ = A.feedback(spark, d)
    return feedback.latest_query(handles_, queries_)


SHAPED = "'## a' || chr(10) || '# ' || role || chr(10) || '### c' || chr(10) || repeat('- src/x.py is in ' || role || '/y.rs' || chr(10), CAST(turn + 1 AS INTEGER)) || text || CASE WHEN conv_id % 3 = 0 THEN chr(10) || '```' ELSE '' END"


@query(
    rf"""WITH a AS (SELECT conv_id * 1000 + turn AS id, {SHAPED} AS text FROM conversations), c AS (SELECT id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[a-z]{{1,4}}\b')) AS INTEGER) AS paths,
CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} '))) AS INTEGER) AS headings, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[-*] '))) AS INTEGER) AS bullets,
CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^```'))) AS INTEGER) AS fences FROM a)
SELECT *, paths >= 3 AS grounded, headings >= 3 AND (bullets >= 5 OR fences >= 1) AS structured FROM c"""
)
def answer_shape(spark, d):
    shaped = F.concat(
        F.lit("## a\n# "), "role", F.lit("\n### c\n"),
        F.repeat(F.concat(F.lit("- src/x.py is in "), "role", F.lit("/y.rs\n")), (F.col("turn") + 1).cast("int")),
        "text", F.when(F.col("conv_id") % 3 == 0, "\n```").otherwise(""),
    )
    c = A.read(spark, d, "conversations")
    return feedback.answer_shape(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), shaped.alias("text")))


SINCE = S.NOW - 14 * 86400
HIT_RATE = """asked AS (SELECT id, unnest(predicted_globs[1:5]) AS g FROM queries WHERE ts >= {since}),
hits AS (SELECT avg(CAST(EXISTS (SELECT 1 FROM flagged f WHERE f.expanded AND f.query_event_id = asked.id AND f.first_match_glob = g) AS DOUBLE)) AS r FROM asked)"""


@query(
    f"""WITH {S.EVENTS}, {HIT_RATE.format(since=SINCE)} SELECT (SELECT count(*) FROM queries WHERE ts >= {SINCE}) AS sample_count,
(SELECT round(avg(CAST(expanded AS DOUBLE)), 9) FROM flagged JOIN queries ON id = query_event_id WHERE ts >= {SINCE}) AS handle_expand_accept_rate,
(SELECT round(avg(token_count), 6) FROM expands WHERE expanded_at >= {SINCE}) AS avg_tokens_per_expand, (SELECT round(r, 9) FROM hits) AS glob_hit_rate_at_k"""
)
def feedback_metrics(spark, d):
    m = feedback.metrics(*A.feedback(spark, d), A.NOW, 14)
    return m.select("sample_count", F.round("handle_expand_accept_rate", 9).alias("handle_expand_accept_rate"), F.round("avg_tokens_per_expand", 6).alias("avg_tokens_per_expand"), F.round("glob_hit_rate_at_k", 9).alias("glob_hit_rate_at_k"))


@query(f"WITH {S.EVENTS}, {HIT_RATE.format(since=0)} SELECT round(r, 9) AS glob_hit_rate_at_k FROM hits")
def glob_hit_rate(spark, d):
    queries_, handles_, expands = A.feedback(spark, d)
    return feedback.hit_rate(queries_, feedback.flagged(handles_, expands)).select(F.round("glob_hit_rate_at_k", 9).alias("glob_hit_rate_at_k"))


KEPT = f"""q AS (SELECT * FROM queries WHERE ts >= {S.NOW} - 30 * 86400 ORDER BY ts DESC, id DESC LIMIT {{cap}}), x AS (SELECT * FROM expands WHERE expanded_at >= {S.NOW} - 30 * 86400)
SELECT (SELECT count(*) FROM q) AS queries, (SELECT count(*) FROM handles WHERE query_event_id IN (SELECT id FROM q)) AS handles, (SELECT count(*) FROM x) AS expands, (SELECT count(*) FROM x WHERE query_event_id NOT IN (SELECT id FROM q)) AS orphans"""


def pruned(spark, d, cap):
    q, h, e = feedback.prune(*A.feedback(spark, d), A.NOW, cap, 10_000_000)
    counts = [
        q.agg(F.count("*").alias("queries")),
        h.agg(F.count("*").alias("handles")),
        e.agg(F.count("*").alias("expands"), F.count_if(F.col("query_event_id").isNull()).alias("orphans")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))
    return out


@query(f"WITH {S.EVENTS}, {KEPT.format(cap=10_000_000)}")
def prune_retention(spark, d):
    return pruned(spark, d, 10_000_000)


@query(f"WITH {S.EVENTS}, {KEPT.format(cap=500)}")
def prune_cap(spark, d):
    return pruned(spark, d, 500)


@query(
    """SELECT o_orderpriority AS variant, count(*) AS runs, CAST(sum(o_custkey) AS BIGINT) AS tokens, round(max(o_totalprice), 2) AS max_duration, round(avg(o_totalprice), 4) AS avg_duration, CAST(sum(o_custkey % 7) AS BIGINT) AS turns,
round(avg(CAST(o_orderstatus = 'F' AS DOUBLE)), 9) AS success_rate, round(avg(CAST(o_custkey % 3 = 0 AS DOUBLE)), 9) AS grounded_rate, round(avg(CAST(o_custkey % 2 = 0 AS DOUBLE)), 9) AS structured_rate FROM orders GROUP BY 1"""
)
def run_summary(spark, d):
    o, k = A.read(spark, d, "orders"), F.col("o_custkey")
    runs = o.select(F.col("o_orderpriority").alias("variant"), k.alias("tokens"), F.col("o_totalprice").cast("double").alias("duration"), (k % 7).alias("turns"), (F.col("o_orderstatus") == "F").alias("success"), (k % 3 == 0).alias("grounded"), (k % 2 == 0).alias("structured"))
    s = feedback.run_summary(runs)
    places = {"max_duration": 2, "avg_duration": 4, "success_rate": 9, "grounded_rate": 9, "structured_rate": 9}
    return s.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(f"WITH {S.EVENTS} SELECT id, ts, query_text, CASE WHEN id % 5 > 0 THEN len(predicted_globs) ELSE -1 END AS globs FROM queries")
def feedback_append(spark, d):
    """Query events in two runs, read back; the events of every fifth id come without globs."""
    from marlstone.sources.state import shared_folder

    folder = shared_folder(spark, "events")
    q, h, e = A.feedback(spark, d)
    q = q.withColumn("predicted_globs", F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("predicted_globs")))
    feedback.append_events(folder, q.filter("id % 2 = 0"), h)
    feedback.append_events(folder, q.filter("id % 2 = 1"), expands=e)
    return spark.read.parquet(f"{folder}/queries").select("id", "ts", "query_text", F.when(F.col("predicted_globs").isNotNull(), F.size("predicted_globs")).otherwise(-1).cast("long").alias("globs"))


# ---- prediction

ASKED = ("how does login work", "sql migration runner", "nothing known here", "feedback handler")
EXTENSIONS = ("py", "rs")


def _predicted_sql() -> str:
    words = ", ".join(f"({k}, '{w}')" for k, (ws, _) in enumerate(predict.KEYWORDS) for w in ws)
    names = ", ".join(f"({k}, '**/{n}/**')" for k, (_, ns) in enumerate(predict.KEYWORDS) for n in ns)
    return f"""asked AS (SELECT DISTINCT ({[*ASKED]})[1 + conv_id % {len(ASKED)}] || ' ' || text AS query FROM conversations WHERE role = 'user'), ext AS (SELECT * FROM (VALUES {', '.join(f"('{e}')" for e in EXTENSIONS)}) t(ext)),
words AS (SELECT * FROM (VALUES {words}) t(k, word)), names AS (SELECT * FROM (VALUES {names}) t(k, pattern)),
hit AS (SELECT DISTINCT query, k FROM asked JOIN words ON contains(lower(query), word)),
globs AS (SELECT query, pattern || '/*.' || ext AS g FROM hit JOIN names USING (k), ext UNION SELECT query, '**/' || n || '.' || ext FROM asked, ext, (VALUES {', '.join(f"('{n}')" for n in predict.ENTRY_POINTS)}) t(n)
  UNION SELECT query, n || '/**/*.' || ext FROM asked, ext, (VALUES ('src'), ('packages')) t(n) WHERE query NOT IN (SELECT query FROM hit)),
predicted AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY g) - 1 AS INTEGER) AS place, g FROM globs)"""


def asked_queries(spark, d):
    """What users say in conversations, each after one of ASKED."""
    first = F.element_at(F.array(*map(F.lit, ASKED)), (1 + F.col("conv_id") % len(ASKED)).cast("int"))
    return A.read(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws(" ", first, "text").alias("query")).distinct()


@query(f"WITH {_predicted_sql()} SELECT query, place, g AS \"glob\" FROM predicted")
def predict_globs(spark, d):
    return predict.predicted_globs(asked_queries(spark, d), EXTENSIONS)


@query(
    f"WITH {_predicted_sql()}, s AS (SELECT *, CASE WHEN g LIKE '**/main%' THEN 0.75::DOUBLE WHEN g LIKE '%.rs' THEN 0.25::DOUBLE ELSE 0 END AS score FROM predicted) SELECT query, g AS \"glob\", score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, place) - 1 AS INTEGER) AS place FROM s"
)
def predict_globs_reranked(spark, d):
    p = predict.predicted_globs(asked_queries(spark, d), EXTENSIONS)
    s = F.when(F.col("glob").startswith("**/main"), 0.75).when(F.col("glob").endswith(".rs"), 0.25)
    return predict.reranked(p, p.select("glob", s.alias("score")).filter("score IS NOT NULL").distinct())


@query(
    f"WITH {S.FILES} SELECT file_path, CASE WHEN file_path LIKE '%/de/%' THEN '**/de/**' WHEN file_path LIKE 'src1%' THEN 'src1*/**' END AS first_match_glob FROM files"
)
def first_match_glob(spark, d):
    return predict.first_globs(A.files(spark, d).select("file_path"), ("**/de/**", "src1*/**"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x' || p_size || ',y' WHEN 1 THEN 'z' || p_size ELSE 'ts,js,py,rs' END AS extensions FROM part")
def glob_extensions(spark, d):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 3
    glob = F.when(k == 0, F.concat(F.lit("**/*.{x"), size, F.lit(", y}"))).when(k == 1, F.concat(F.lit("src/**/*.z"), size)).otherwise("src/*.d/lib")
    return A.read(spark, d, "part").select("p_partkey", F.array_join(predict.extensions(glob), ",").alias("extensions"))


# ---- streaming

WINDOWS = """w AS (SELECT e.*, s FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type FROM events) e, unnest(range(0, 7)) AS x(s)), g AS (SELECT t - t % 86400 - s * 86400 AS window_start, event_type FROM w),
a AS (SELECT window_start, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type IN ('click', 'purchase')) AS acts FROM g GROUP BY 1)
SELECT window_start, views, acts, CASE WHEN views > 0 THEN acts / views ELSE 0 END AS rate FROM a"""


@query(f"WITH {WINDOWS}")
def feedback_windows(spark, d):
    return feedback_stream.windowed_rates(A.read(spark, d, "events"))


@query(f"WITH {WINDOWS}")
def stream_feedback_available_now(spark, d):
    from marlstone.sources.state import shared_folder

    events = A.read(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return feedback_stream.run_available(feedback_stream.windowed_rates(stream), ("window_start",), shared_folder(spark, "feedback"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search for either of two terms, score, two handles a file, best eight."""
    return evidence_handles(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
