"""Stored indexes: postings against scans, generations, replaced and dropped files, failed and rival writers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import index, postings, search
from marlstone.sources import adapters
from marlstone.sources.snapshots import Snapshots


def files(spark, texts, start=0):
    rows = [(f"d{k % 3}/f{start + k:03}.txt", t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file_path string, content string").withColumns({"token_count": F.lit(1), "content_hash": F.sha2("content", 256)})


def stored(spark, tmp_path, texts):
    of = Snapshots(spark, f"file://{tmp_path}/index")
    index.write(of, adapters.whole_file_nodes(files(spark, texts)), None)
    return of


def drawn(n, seed=3):
    rng = random.Random(seed)
    words = ["to", "be", "or", "not", "Ärger", "x1", "漢字", "foo.bar", "a-b", "--", "é", "don't"]
    return [" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(n)]


ASKED = [
    (("to",), ()), (("to be",), ()), (('"to be"',), ()), (('"to be to"',), ()), (("foo.bar",), ()), (("a-b",), ()), (("arger", '"be or not"'), ("x1",)),
    (("漢字 é",), ('"not to"', "don't")), (("nothing",), ()), (("--",), ()), (("to --",), ()), (("to", "--"), ("--",)), ((), ("to",)), (('"be be be"',), ()),
]


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    texts = [*drawn(120), "", "to " * 3_000 + "be", None]
    of = stored(spark, tmp_path, texts)
    nodes = adapters.whole_file_nodes(files(spark, texts))
    for any_of, none_of in ASKED:
        want = {r.file_path for r in search.grep(nodes, *any_of, none_of=none_of, limit=None).collect()} if any_of else set()
        assert {r.file_path for r in postings.found(of, *any_of, none_of=none_of).collect()} == want, (any_of, none_of)
    want = [r.id for r in search.first(search.grep(nodes, "to be", limit=None).filter("file_path LIKE 'd1/%'"), 7).orderBy("file_path").collect()]
    assert [r.id for r in postings.grep(of, "to be", glob="d1/*", limit=7).orderBy("file_path").collect()] == want


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    of = stored(spark, tmp_path, drawn(60))
    df = postings.found(of, "to be")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert len(scans) == 1 and re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|INSET|=)", scans[0]) and "token" in scans[0].split("PushedFilters")[1]
    read = df.inputFiles()
    buckets = {int(re.search(r"bucket=(\d+)", f)[1]) for f in of.read("postings", where=F.col("token").isin("to", "be")).select("bucket").distinct().withColumn("f", F.concat(F.lit("bucket="), "bucket")).toPandas()["f"]}
    assert len(buckets) <= 2 < len({re.search(r"bucket=(\d+)", f)[1] for f in read})


def test_generations_replacement_and_invalidation(spark, tmp_path):
    of = stored(spark, tmp_path, ["one two", "two three", "three four", "two"])
    names = lambda *a, **k: sorted(r.file_path[-7:-4] for r in postings.found(of, *a, **k).collect())
    again = adapters.whole_file_nodes(files(spark, ["five two", "six"]))
    assert index.write(of, again, None, again) == 2
    assert names("two") == ["000", "003"] and names("five") == ["000"] and names("one") == []
    assert names("two", generation=1) == ["000", "001", "003"] and of.read("nodes", 1).count() == 4
    assert index.invalidate(of, "d2/*") == 1 and index.invalidate(of, "none/*") == 0
    assert names("three") == [] and names("three", generation=2) == ["002"] and of.generations() == [1, 2, 3]
    assert of.compact() == 4 and not of.manifest()["gone"]
    assert names("two") == ["000", "003"] and names("two", generation=3) == ["000", "003"]
    assert index.invalidate(of) == 3 and of.read("nodes").count() == 0 and names("two") == []
    index.write(of, again, None, again)
    assert names("two") == ["000"]


def test_a_writer_that_fails_leaves_the_last_generation(spark, tmp_path):
    of = stored(spark, tmp_path, ["one two", "two three"])
    again = adapters.whole_file_nodes(files(spark, ["nine"]))
    broken = again.withColumn("line_end", F.expr("CAST(raise_error('killed') AS INT)"))
    part = F.lit(0).alias("part")
    with pytest.raises(Exception, match="killed"):
        of.commit({"postings": postings.postings(again), "nodes": broken.select("*", part)}, again)
    assert of.generations() == [1] and of.read("nodes").count() == 2
    assert [r.file_path for r in postings.found(of, "nine").collect()] == [] and postings.found(of, "two").count() == 2


def test_the_slower_of_two_writers_fails(spark, tmp_path, monkeypatch):
    of = stored(spark, tmp_path, ["one"])
    seen = of.manifest()
    index.write(of, adapters.whole_file_nodes(files(spark, ["two"], 5)), None)
    monkeypatch.setattr(of, "manifest", lambda generation=None: seen)
    with pytest.raises(RuntimeError, match="another"):
        of.drop(files(spark, ["x"]))
    monkeypatch.undo()
    assert of.read("nodes").count() == 2


def test_empty_index_and_unknown_names(spark, tmp_path):
    of = stored(spark, tmp_path, [])
    assert postings.grep(of, "to").collect() == [] and of.read("nodes").columns
    with pytest.raises(LookupError):
        of.read("nodes", 7)
    with pytest.raises(LookupError):
        of.read("other")
    with pytest.raises(ValueError, match="columns"):
        of.commit({"nodes": files(spark, ["x"])})
    assert Snapshots(spark, f"file://{tmp_path}/none").generations() == []


def test_references_are_in_the_nodes_of_their_file(spark):
    """source_id, made file by file, is what the join of all references and nodes gives, and no shuffle is needed."""
    from marlstone.operators import parse

    rng = random.Random(5)
    lines = ["class A:", "    def f(self): g(1)", "def h(é): i(j(2))", "k(3)", "  l(4)", "import m.n", "    class B: o = p(5)", "async def q():", "        r(6)"]
    texts = [("\n".join(rng.choices(lines, k=rng.randrange(1, 30))), "py") for _ in range(40)]
    texts += [("a(x => b(x));\nclass C { d() { e(1); f(y => { g(2) }) } }\nh(1)\n" * 3, "ts"), ("i(1)\n" * 60, "py"), ("", "py"), (None, "py"), ("# x\n\ny(1)\n", "md"), ("z(1)", "txt")]
    rows = [(f"p{k}.{e}", t) for k, (t, e) in enumerate(texts)]
    own = spark.createDataFrame(rows, "file_path string, content string").withColumn("content_hash", F.sha2("content", 256)).repartition(3)
    for threshold in (1_000_000, 100):
        want = search.enclosing(parse.references(own), index.nodes(own, threshold))
        got = index.refs(own, threshold)
        assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(got.columns)).collect()))
    n, r = index.build(own)
    assert all(x not in y._jdf.queryExecution().optimizedPlan().toString() for x in ("Join", "Aggregate") for y in (n, r))


def test_writes_leave_no_shuffle_files_and_postings_are_never_shuffled(spark, tmp_path, monkeypatch):
    import time

    frame = type(spark.range(0))
    env = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.getAllFiles()) if f.getName().startswith("shuffle_")}
    before, dealt, deal = held(), [], frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(set(self.columns)) or deal(self, *a))
    of = stored(spark, tmp_path, drawn(60))
    index.write(of, again := adapters.whole_file_nodes(files(spark, ["new"])), None, again)
    of.compact()
    assert dealt and not any("positions" in columns for columns in dealt)
    end = time.time() + 20
    while (left := {x for x in held() - before if x.endswith(".data")}) and time.time() < end:
        time.sleep(0.5)
    assert len(left) <= 4  # of the small queries in between
    assert "id" not in of.read("postings").columns and of.read("postings").count() == of.read("postings", 2).count() > 100


def test_files_that_an_invalidation_of_a_large_index_drops_are_broadcast(spark, tmp_path, monkeypatch):
    """300,000 dropped files: no search or read shuffles the rows of the index by file for them; the results are the same."""
    of = stored(spark, tmp_path, drawn(60))
    assert index.invalidate(of, "d1/*") == 20
    want = sorted(r.file_path for r in postings.found(of, "to").collect())
    real = of.manifest()
    monkeypatch.setattr(of, "manifest", lambda generation=None: real | {"gone": [g | {"files": 300_000} for g in real["gone"]]})
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (postings.found(of, "to"), of.read("nodes"))]
    finally:
        spark.conf.unset(key)
    assert all("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan for plan in plans)
    assert sorted(r.file_path for r in postings.found(of, "to").collect()) == want and not any(f.startswith("d1/") for f in want)
