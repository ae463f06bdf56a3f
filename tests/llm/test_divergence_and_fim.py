"""Source divergence and fill-in-middle against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import divergence, fill_in_middle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, least=3, top=200):
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: c for (x, s), c in count.items() if x == lang}

        def share(c, kept=kept):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in kept}

        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in groups.items():
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(order) if part == "pair" or k < top]
    return sorted(out)


def mixed_rows(n=150):
    rng = random.Random(7)
    words = ["Alpha", "beta", "ΓΑΜΜΑ", "ſharp", "éa", "İ", "x" * 30, *(f"w{chr(97 + k)}" for k in range(26)), *(f"r{chr(97 + k)}r" for k in range(20))]
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["hot"] * 4 + ["a", "b", "c", "ü", None, "none"])
        own = words if source == "hot" else words[: 12 + 3 * (k % 9)]
        rows.append((k, " ".join(rng.choices(own, k=rng.randrange(40))) if source != "none" else "1 2 3", lang, source, 1))
    rows += [(n, None, "en", "a", None), (n + 1, "alone in its lang", "xx", "s1", 1), (n + 2, "", "xx", "s2", 1), (None, "beta,beta;BETA", "en", "a", 1)]
    return rows + rows[:3]


@pytest.mark.parametrize("how", [{}, {"heavy": 2.0}, {"heavy": 0.0, "cells": 16}, {"heavy": 0.5, "top_terms": 3}])
def test_audit_against_brute_force(spark, how):
    rows = mixed_rows()
    d = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit("x")).withColumn("term", F.lit(1)).repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(d, **how).collect())
    assert got == brute_audit([r[1:4] for r in rows], top=how.get("top_terms", 200))


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(none).collect() == []
    assert divergence.audit(none).columns == ["lang", "source", "part", "item", "value", "rank"]
    one = spark.createDataFrame([(1, "a a a", "en", "s", 1)], SCHEMA)
    assert divergence.audit(one).collect() == []


def test_postings_in_small_parts_and_shares_of_large_counts():
    n = np.array([1, 10**6, 10**12, 9 * 10**13], np.int64)
    for total in (7, 10**9 + 1, 10**14 + 3):
        c = np.minimum(n, total)
        assert divergence.shares(c, np.int64(total)).tolist() == [1 + 10**9 * int(x) // total for x in c]


def test_long_texts_are_counted_whole(monkeypatch):
    text = "ab Cd é " * 500 + "z" * 300 + " ab"
    whole = divergence.terms_of(text)
    monkeypatch.setattr(divergence, "PIECE", 50)
    assert divergence.terms_of(text) == whole and whole[b"z" * 300] == 1 and whole[b"ab"] == 501


# ---- fill-in-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
    form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(units), form, None if plain else len(p), None if plain else len(m), sha(out), sha(text)


def fim_rows():
    rng = random.Random(3)
    bits = ["a", "word", " ", "\n", "\t", "\x0b\x0c\r", "\x01", "\x02", "\x02e", "\x02d", "\x1f", "\x85", "\xa0", "é漢\U0001f600", "<", "<P", "S>", "M>", "$1", "\\", "\x00"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randrange(25))), "en", "s", 1) for k in range(400)]
    rows += [(1000 + k, t, "en", None, 1) for k, t in enumerate([None, "", " ", " \n ", "x", "has <S> in it", "<P", "word " * 60_000, "y" * 200_000, " " * 200_000])]
    return rows + [(None, "no id here", "en", "s", 1)] + rows[:5]


def test_fill_in_middle_against_brute_force(spark):
    rows = fim_rows()
    d = spark.createDataFrame(rows, SCHEMA)
    for name in ("form", "_n", "prefix", "n", "output", "_text", "_h1"):
        d = d.withColumn(name, F.lit("x"))
    got = sorted((tuple(r) for r in fill_in_middle.digests(fill_in_middle.transform(d)).collect()), key=str)
    assert got == sorted((brute_fim(r[0], r[1]) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_parameters_and_kept_columns(spark):
    d = spark.createDataFrame(fim_rows(), SCHEMA)
    made = fill_in_middle.transform(d, fim_percent=100, spm_percent=0, keep=("source", "text")).filter("form <> 'plain'")
    assert {r.form for r in made.select("form").distinct().collect()} == {"psm"}
    assert made.filter(F.concat("prefix", "middle", "suffix") != F.col("text")).count() == 0
    assert made.filter(fill_in_middle.restore(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert fill_in_middle.digests(fill_in_middle.transform(d.limit(0))).collect() == []


def test_fill_in_middle_runs_no_python(spark):
    plan = fill_in_middle.digests(fill_in_middle.transform(spark.createDataFrame(fim_rows(), SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
