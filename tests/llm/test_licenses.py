"""Licence scans of whole licences, wrapped or not, among other documents; their confirmation against brute force."""

import random
import re
import textwrap

from pyspark.sql import functions as F

from marlstone.llm import licenses

OF = {f: [t for g, t in licenses.NOTICES if g == f] for f in licenses.FAMILIES}


def words(t):
    return re.findall("[a-z0-9]+", t.lower())


def test_whole_licences_are_found_and_others_are_not(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mit = [t for t in OF["mit"] if len(t) > 100][-3:]
    bsd = [t for t in OF["bsd"] if len(t) > 90]
    wrapped = lambda parts, width, mark="": "\n\n".join("\n".join(mark + x for x in textwrap.wrap(p, width)) for p in parts)
    found = {
        "mit": [wrapped(["Copyright (c) 2021 Jane Roe", *mit], 72), wrapped(mit, 50, "# "), "\n".join(mit), " ".join(mit), "  * " + mit[0][:300]],
        "apache": [wrapped(OF["apache"][-2:], 60, "// "), wrapped(OF["apache"][13:17], 78), OF["apache"][12]],
        "gpl": [wrapped(OF["gpl"][2:6], 70), wrapped([t for t in OF["gpl"] if t.startswith("This program")], 66, "-- "), OF["gpl"][7]],
        "bsd": [wrapped(bsd, 74), "words before the notice go here.\n" + bsd[1] + "\nand words after it"],
        "isc": [wrapped(OF["isc"], 70)],
        "lgpl": [wrapped([t for t in OF["lgpl"] if t.startswith("This library")], 70)],
        "mpl": [wrapped(OF["mpl"][:1], 40)],
        "proprietary": ["Copyright 2020 Acme Corp. All rights reserved.", "All rights reserved."],
        "public-domain": [wrapped(OF["public-domain"][:2], 60)],
    }
    nothing = [
        "All rights reserved to the members of the club.",
        "The permission to enter the public domain of the park is granted free of charge to any person who holds a copy of the ticket.",
        "Copyright is a subject that the licence plate office does not deal with; redistribution of income is another matter.",
        "He said that the software was provided by the authors, and that they were not liable for any of it.",
    ]
    texts = [(f, t) for f, ts in found.items() for t in ts] + [("", t) for t in nothing]
    added = spark.createDataFrame([(10**7 + k, t, "en", "s", len(t)) for k, (_, t) in enumerate(texts)], d.schema)
    got = {r.doc_id: r for r in licenses.scan(d.unionByName(added)).collect()}
    right = sum(got[10**7 + k].family == f and f in got[10**7 + k].families for k, (f, _) in enumerate(texts) if f)
    assert right >= 0.9 * sum(map(bool, (f for f, _ in texts)))
    assert not any(got[10**7 + k].n_licence for k, (f, _) in enumerate(texts) if not f)
    assert got[10**7].families == "mit" and got[10**7].n_paragraphs == 4 and got[10**7].n_licence == 3


def brute_match(w, label, overlap):
    own = set(zip(w, w[1:]))
    for f, t in licenses.NOTICES:
        v = words(t)
        theirs = set(zip(v, v[1:]))
        n = len(own & theirs)
        ends = t not in licenses.ENDINGS or w[-len(v) :] == v
        if n and f == label and ends and n >= overlap * min(len(own), len(theirs)) and n >= min(licenses.LEAST_PAIRS, len(theirs)):
            return True
    return False


def test_confirmation_against_brute_force(spark):
    draw = random.Random(11)
    cases = []
    for _ in range(300):
        family, text = draw.choice(licenses.NOTICES)
        w = words(text)
        a = draw.randrange(max(1, len(w) - 5))
        w = w[a : a + draw.randint(2, 60)]
        for _ in range(draw.choice([0, 0, 1, 3, 8])):
            w.insert(draw.randrange(len(w) + 1), draw.choice(["other", "the", "reserved", "x"]))
        cases.append((" ".join(w), draw.choice([*[family] * 20, *licenses.FAMILIES[1:]])))
    cases += [("all rights reserved", "proprietary"), ("all rights reserved here", "proprietary"), ("", "mit"), ("mit", "mit")]
    rows = [(k, t, licenses.FAMILIES.index(f)) for k, (t, f) in enumerate(cases)]
    d = spark.createDataFrame(rows, "k int, text string, label int").withColumn("w", licenses.words(F.col("text")))
    hit = licenses.matches(F.col("w"), licenses.known_texts(spark), 0.6, F.col("label"))
    got = {r.k: r.hit for r in d.select("k", hit.alias("hit")).collect()}
    assert got == {k: brute_match(words(t), f, 0.6) for k, (t, f) in enumerate(cases)}
    assert 50 < sum(got.values()) < 290


def test_paragraphs_join_short_lines_and_cover_all_words(spark):
    draw = random.Random(12)
    texts = ["", " ", "\n\n", "one", "a\nb\n\nc", "x " * 60 + "\ny\nz", "\n".join(["short"] * 30_000), "tab\x0bbed\nline\r\nmore"]
    texts += ["\n".join("w" * draw.choice([0, 1, 50, 100, 101, 300]) for _ in range(20)) for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in d.withColumn("p", licenses.paragraphs(F.col("text"))).collect():
        want, last = [], None
        for line in r.text.split("\n"):
            short = len(line) <= licenses.WRAPPED and line.strip(" \t\r") != ""
            if short and last:
                want[-1] += "\x0b" + line
            else:
                want.append(line)
            last = short
        assert r.p == [x for x in want if x.strip(" ") != ""], r.k


def test_the_scan_is_native(spark):
    plan = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_all_slices_of_all_documents_are_examples(spark):
    """5,000 documents of one slice each, a licence text in every tenth; none is left out of the unknown class but these."""
    own = [f"w{k} of the software x{k} y{k}" if k % 10 else OF["mit"][-1] for k in range(5000)]
    d = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    rows = licenses.unknown_examples(d, licenses.known_texts(spark), licenses.known_terms(spark)).collect()
    assert sum(r.n for r in rows) == 4500 and {r.half for r in rows} == {0, 1} and len(rows) == 2


def test_words_are_split_once_for_all_slices_and_few_pairs_need_no_comparison(spark):
    """The plan of the examples has the words of a paragraph once; pairs that licence texts hold decide as all pairs do."""
    d = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    known, terms = licenses.known_texts(spark), licenses.known_terms(spark)
    plan = licenses.unknown_examples(d, known, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1
    draw, cases = random.Random(13), []
    for _ in range(200):
        w = words(draw.choice(licenses.NOTICES)[1])
        a = draw.randrange(max(1, len(w) - 5))
        w = w[a : a + draw.randint(1, 40)]
        for _ in range(draw.choice([0, 1, 4, 15])):
            w.insert(draw.randrange(len(w) + 1), draw.choice(["other", "the", "reserved", "x"]))
        cases.append(" ".join(w))
    cases += ["all rights reserved", "x all rights reserved", "all rights reserved x", "public domain", "x", ""]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, text string").withColumn("w", licenses.words(F.col("text")))
    held = licenses._held(rows, terms)
    for overlap in (0.4, 0.6):
        got = held.select("k", licenses.matches(F.col("w"), known, overlap, held=F.col("pairs_held")).alias("hit")).collect()
        want = {k: any(brute_match(words(t), f, overlap) for f in licenses.FAMILIES) for k, t in enumerate(cases)}
        assert {r.k: r.hit for r in got} == want and 0 < sum(want.values()) < len(want)


def test_features_are_those_of_hashing_in_fewer_columns(spark):
    from pyspark.ml.feature import HashingTF

    hashes = licenses.known_hashes(spark)
    draw = random.Random(14)
    rows = [(k, [draw.choice(hashes) for _ in range(draw.choice([0, 1, 9, 60]))]) for k in range(200)]
    d = spark.createDataFrame(rows, "k int, grams array<long>")
    want = {r.k: r.f.values.tolist() for r in HashingTF(inputCol="grams", outputCol="f", numFeatures=licenses.FEATURES).transform(d).collect()}
    got = {r.k: r.features for r in licenses._counted(d, hashes).collect()}
    assert {k: sorted(v.values.tolist()) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(v.size < len(hashes) for v in got.values())
