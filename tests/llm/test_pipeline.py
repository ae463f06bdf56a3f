"""The pipeline against a plain Python version of its stages."""

import importlib.util

import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_ops import brute_hits, brute_targets

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not there", allow_module_level=True)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    planted = [
        (9001, "12345 --- 678", "en", "src1", 13),
        (9002, f"before {item} after", "en", "src1", 10),
        (9003, "The password=hunter2hunter2 is here and the rest of the text stays as it was", "en", "src2", 10),
        (9004, docs.orderBy("doc_id").first().text, "en", "src2", 10),
        (9005, None, None, None, None),
    ]
    docs.union(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def brute_kept(texts, similarity=0.8, n=5):
    """The least ids of the groups that links of that Jaccard similarity of word shingles make."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {root(i) for i in texts}


def test_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(spark.createDataFrame(stage(spark, tables[-1], folder).collect(), stage(spark, tables[-1].limit(0), folder).schema))
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    for t in tables[1:-1]:
        assert t.columns == docs.columns
    assert set(rows[0]) - set(rows[1]) == {9001, 9005}
    assert set(rows[2]) == brute_kept({i: r.text for i, r in rows[1].items()})
    assert 9004 not in rows[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert set(rows[3]) == {i for i, r in rows[2].items() if not brute_hits(r.text, items)[4]}
    assert 9002 in rows[2] and 9002 not in rows[3]
    assert set(rows[4]) == set(rows[3])
    assert rows[4][9003].text == "The [assign removed] is here and the rest of the text stays as it was"
    assert rows[4][9003].n_chars == len(rows[4][9003].text)
    sizes = {}
    for r in rows[4].values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    want = brute_targets(sizes)
    taken = {}
    for r in rows[5].values():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in sizes)


def test_run_and_clashing_columns(spark, folder, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("_doc", "_row", "score", "fp", "n_hit", "taken", "size", "owner", "lang_pred"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    one = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, folder).collect()}
    two = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert one and one == two


def test_near_duplicates_at_eight_tenths_of_five_word_shingles(spark):
    import random

    from marlstone.llm.simhash import jaccard, shingles_of

    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(5000)}"
    texts = {}
    for k in range(60):
        base = [word() for _ in range(200)]
        texts[10 * k] = " ".join(base)
        for n, edits in ((1, 2), (2, 4), (3, 16)):
            other = list(base)
            for at in range(edits):
                other[10 + at * 12 if edits == 16 else 10 + at * 45] = word()
            texts[10 * k + n] = " ".join(other)
    sets = {i: shingles_of(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(60):
        own = range(10 * k, 10 * k + 4)
        for a in own:
            for b in own:
                if jaccard(sets[a], sets[b]) >= 0.8:
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    want = {root(i) for i in texts}
    assert len(want) == 120
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(i, t, "en", "s", 0) for i, t in ((9000, ""), (9001, None), (9002, " \n"), (None, "a lone text"))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want | {9000, None}


def test_language_stage_rejects_what_is_in_no_language_or_in_too_many(spark):
    import random

    import corpus_pipeline
    from marlstone.llm import langid

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.lang: r.text for r in d.orderBy("doc_id").collect() if 2000 < r.n_chars < 5000}
    assert len(text) == 4
    draw = random.Random(4)
    four = "\n".join(t[:500] for t in text.values())
    texts = ["".join(draw.choices("bcdfghjklmnpqrstvwxz ", k=2000)), "Быстрая коричневая лиса прыгает через собаку " * 9, four]
    texts += [text["en"][:600] + "\n" + text["de"][:600], *text.values()]
    added = spark.createDataFrame([(10_000_000 + k, t, None, "s", len(t)) for k, t in enumerate(texts)], d.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, d.unionByName(added), "").collect()}
    assert [k for k in range(len(texts)) if 10_000_000 + k in kept] == list(range(3, len(texts)))
    assert kept >= {r.doc_id for r in d.collect() if any(c.isalpha() for c in r.text)}
    row = langid.predict(added.filter("doc_id = 10000002"), *langid.learn(d)).first()
    assert {x.lang for x in row.languages} == set(text) and abs(sum(x.share for x in row.languages) - 1) < 1e-3
    assert row.languages[0].lang == row.lang_pred and row.languages[0].share == row.score


def test_stages_on_empty_tables_repeated_rows_and_ties(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for name, d in (("empty", docs.limit(0)), ("twice", docs.unionByName(docs).unionByName(docs.limit(3).withColumn("source", F.lit(None).cast("string"))))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    once = docs
    twice = spark.read.parquet(f"{tmp_path}/twice/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, twice, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {r.doc_id for r in corpus_pipeline.near_duplicates(spark, once, "").collect()}
    one = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/twice").collect()}
    assert one <= set(kept) and len(one) > 0.5 * len(kept)


def test_twins_in_a_crowd_are_linked(spark):
    """Texts alike at 0.5 to 0.7, each with a twin at 0.86 or more: no text of another pair comes between twins."""
    import random

    from marlstone.llm.simhash import jaccard, keep_one, shingles_of

    draw, base, texts = random.Random(1), [f"b{k}" for k in range(300)], []
    for k in range(250):
        own = list(base)
        for j, at in enumerate(draw.sample(range(50), draw.choice([6, 7, 8, 9]))):
            own[6 * at + 3] = f"x{k}e{j}"
        twin = list(own)
        for at in draw.sample(range(50), 3):
            twin[6 * at] = f"y{k}e{at}"
        texts += [" ".join(own), " ".join(twin)]
    sets = [shingles_of(t) for t in texts]
    assert all(jaccard(sets[2 * k], sets[2 * k + 1]) >= 0.86 for k in range(250)) and jaccard(sets[0], sets[2]) < 0.8
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in keep_one(d).collect()} == {2 * k for k in range(250)}


def test_neighbours_of_a_large_crowd_meet_in_blocks(monkeypatch):
    import numpy as np

    from marlstone.llm import simhash

    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 62, (300, 16)).astype(np.uint64)
    words[1::2] = words[::2] ^ np.uint64(5)
    order = np.lexsort(words.T)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    label, size = np.arange(300), np.full(300, 500)
    pairs = {(int(min(order[i], order[j])), int(max(order[i], order[j]))) for a, b in simhash._neighbours(label[order], words[order], size, 0.8) for i, j in zip(a, b, strict=True)}
    assert pairs == {(2 * k, 2 * k + 1) for k in range(150)}


def test_all_neighbours_of_a_crowd_are_paired(monkeypatch):
    """Twelve close nodes in each of 25 groups, strewn over the blocks, with two labels' nodes in some."""
    import numpy as np

    from marlstone.llm import simhash

    rng = np.random.default_rng(4)
    words = np.repeat(rng.integers(0, 1 << 62, (25, 16)).astype(np.uint64), 12, axis=0) ^ (np.uint64(1) << rng.integers(0, 62, (300, 16)).astype(np.uint64))
    order, label, size = rng.permutation(300), np.arange(300), np.full(300, 500)
    label[:12] %= 2
    monkeypatch.setattr(simhash, "BLOCK", 40)
    pairs = {tuple(sorted((int(order[i]), int(order[j])))) for a, b in simhash._neighbours(label[order], words[order], size, 0.8) for i, j in zip(a, b, strict=True)}
    assert pairs == {(a, b) for a in range(300) for b in range(a + 1, a // 12 * 12 + 12) if label[a] != label[b]}


def test_links_behind_closer_looking_texts_are_found(spark, monkeypatch):
    """Texts alike at 0.73 to 0.8, some above it, each have a twin at 0.81 or more; crowds that are dealt into parts
    give the same."""
    import random

    from marlstone.llm import simhash

    draw, base, texts = random.Random(8), [f"b{k}" for k in range(400)], {}
    for k in range(100):
        own = list(base)
        for j, at in enumerate(draw.sample(range(66), 6)):
            own[6 * at + 3] = f"x{k}e{j}"
        twin = list(own)
        for at in draw.sample(range(66), 8):
            twin[6 * at] = f"y{k}e{at}"
        texts |= {2 * k: " ".join(own), 2 * k + 1: " ".join(twin)}
    want = brute_kept(texts)
    assert 80 < len(want) < 120
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.keep_one(d).collect()} == want
    monkeypatch.setattr(simhash, "BLOCK", 30)
    assert {r.doc_id for r in simhash.keep_one(d).collect()} == want


def test_shared_values_against_brute_force():
    import numpy as np

    from marlstone.llm import simhash

    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 62, 700).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(common, rng.integers(1, 700)), rng.integers(0, 3000, rng.integers(0, 300)).astype(np.uint64)))) for _ in range(200)]
    for part, first in ((sets, 90), (sets[:3], 1), (sets[:2], 1), ([s[:1] for s in sets], 7)):
        got = simhash._shared(part, first)
        assert (got == [[len(np.intersect1d(a, b)) for b in part[first:]] for a in part[:first]]).all()


def test_rows_of_a_group_that_meets_in_many_cells_and_blocks_grow_with_it(spark, monkeypatch):
    """A group that meets in nearly all cells is a few crowds, each of its nodes being in all pairs; over blocks it is one crowd."""
    import numpy as np

    from marlstone.llm import simhash
    from marlstone.llm.common import cut

    rng, n = np.random.default_rng(6), 800
    flips = np.packbits(rng.random((n, 32, 32)) < 0.03, axis=2).view(">u4")[:, :, 0]
    bands = (rng.integers(0, 1 << 32, 32).astype(np.uint32) ^ flips.astype(np.uint32)).astype("<u4")
    rows = [(k, k, 200, bytearray(bands[k].tobytes())) for k in range(n)]
    nodes = cut(spark.createDataFrame(rows, "node long, label long, size int, bands binary"))
    crowds = cut(simhash._crowds(simhash._to_band_cells(nodes, range(32), 32, 2, 4), 2, 4))
    assert crowds.count() == crowds.distinct().count() < 12 * n
    assert crowds.groupBy("crowd").count().agg(F.max("count")).first()[0] == n
    monkeypatch.setattr(simhash, "BLOCK", 50)
    one = cut(nodes.select(F.lit(1).cast("long").alias("crowd"), "node"))
    near = simhash._candidates(one, nodes, 0.8)
    assert near.select("node").distinct().count() == n and near.count() < 3 * n


def test_stages_hand_small_batches_to_python(spark, folder, tmp_path):
    """20 MB of texts of one partition come in batches of about 4 MB, and none is lost; a session's own value stays."""
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    text = F.concat(F.lit("der Hund und die Katze "), F.repeat(F.concat(F.lit("sind hier "), F.col("id").cast("string"), F.lit(" ")), 700))
    docs = spark.range(2000).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    docs = docs.select("*", F.lit("de").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        try:
            found = stage(spark, docs.limit(0), folder)
            if name != "mixing":
                seen = docs.coalesce(1).mapInArrow(sizes, "n long, bytes long").collect()
                assert sum(r.n for r in seen) == 2000 and sum(r.bytes for r in seen) > 20_000_000
                assert max(r.bytes for r in seen) < 5_000_000, name
            assert found.count() == 0
        finally:
            spark.conf.unset(key)
    corpus_pipeline.run(spark, folder)
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "1m")
    try:
        corpus_pipeline.run(spark, folder)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_variants_of_a_cell_are_held_few_times():
    """The variants of a cell and their owners, 8 bytes each, are made and sorted in place."""
    import tracemalloc

    import numpy as np

    from marlstone.llm import simhash

    rng = np.random.default_rng(2)
    fps, left = rng.integers(0, 1 << 22, 20_000).astype(np.uint64), np.full(20_000, 1)
    tracemalloc.start()
    simhash._chain(fps, left, 22, 1, simhash.CHUNK)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * 8 * 20_000 * 23
