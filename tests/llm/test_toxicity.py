"""Toxicity: held-out accuracy, features, and edge cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["grumk", "zorbel", "flintig"]


def made(n=700):
    """Texts of drawn words; toxic ones hold words of BAD, or beginnings of them again and again, or a fixed insult."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        own = rng.choices(words, k=rng.randrange(15, 120))
        toxic = k % 6 == 0
        if toxic:
            for _ in range(max(2, len(own) // 15)):
                at = rng.randrange(len(own))
                own[at] = rng.choice(BAD) if k % 4 else "snarvel" + rng.choice(words)
        elif k % 5 == 0:
            own[0] = "snarvel" + rng.choice(words)
        docs.append((k, " ".join(own).capitalize() + ".", "en", "s", 1))
        if k % 3 != 2:
            labels.append((k, 1, int(toxic)))
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_documents(spark):
    docs, labels = made()
    found = {r.doc_id: r for r in toxicity.score(*tables(spark, docs, labels)).collect()}
    assert len(found) == len(docs) and all(r.held_out == is_held_out(k) for k, r in found.items())
    own = [r for k, r in found.items() if is_held_out(k)]
    hits = sum(r.predicted for r in own if r.doc_id % 6 == 0) / sum(r.doc_id % 6 == 0 for r in own)
    wrong = sum(r.predicted for r in own if r.doc_id % 6) / sum(r.doc_id % 6 != 0 for r in own)
    assert hits >= 0.9 and wrong <= 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in own)


def test_held_out_labels_teach_nothing_and_odd_rows_keep_their_number(spark):
    docs, labels = made(300)
    docs += [(None, "grumk", None, None, None), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, " \n\t", "en", "s", 3), docs[1], docs[1], (903, "word grumk " * 60_000, "en", "s", 1)]
    plain = toxicity.score(*tables(spark, docs, labels), rounds=4).orderBy("doc_id", "score").collect()
    # other labels of held-out rows, null labels and ids, languages and sources change nothing; clashing names are ignored
    other = [(k, q, 1 - t if is_held_out(k) else t) for k, q, t in labels] + [(None, 1, 1), (5, 1, None)]
    d, l = tables(spark, [(k, t, "xx", f"{k}", 7) for k, t, *_ in docs], other)  # noqa: E741
    for name in ("toxic", "features", "score", "h", "fold", "margin", "half", "prediction", "rawPrediction", "_text to map"):
        d = d.withColumn(name, F.lit("x"))
    again = toxicity.score(d, l, rounds=4).orderBy("doc_id", "score").collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in again] and len(plain) == len(docs)
    assert len({r.score for r in plain if r.doc_id in (900, 901, 902)}) == 1


@pytest.mark.parametrize("kind", ["no labels", "one kind", "no documents", "held out only"])
def test_little_to_learn_from(spark, kind):
    docs, labels = made(40)
    labels = {"no labels": [], "one kind": [(k, 1, 1) for k, _, _ in labels], "no documents": labels, "held out only": [x for x in labels if is_held_out(x[0])]}[kind]
    d, l = tables(spark, [] if kind == "no documents" else docs, labels)  # noqa: E741
    rows = toxicity.score(d, l).collect()
    assert len(rows) == d.count() and {r.score for r in rows} <= ({1.0} if kind == "one kind" else {0.0})


def test_few_examples(spark):
    docs, labels = made(40)
    rows = toxicity.score(*tables(spark, docs, labels[:8]), rounds=2).collect()
    assert len(rows) == 40 and all(0 <= r.score <= 1 for r in rows)


def test_features():
    lexicon = toxicity.Lexicon([("grumk", 1, 2.0), ("snarv*", 2, 3.0)])
    at = {name: k for k, name in enumerate(toxicity.FEATURES)}
    x = toxicity.features("You are a GRUMK, an id10t and s.c.u.m! snarvel snarvet", lexicon)
    assert len(x) == len(toxicity.FEATURES)
    assert abs(x[at["words_hit"]] - 100 / 10) < 2 and x[at["stem_count"]] == 2 and x[at["decoded_hit"]] == 20 and x[at["near_address"]] >= 10
    assert toxicity.features("snarvel alone", lexicon)[at["stem_count"]] == 0
    assert toxicity.features(None, lexicon) == toxicity.features(" \n", lexicon) == [0.0] * len(toxicity.FEATURES)
    assert toxicity.features("IDIOOOOT", lexicon)[at["decoded_hit"]] == 100
    assert toxicity.decoded("m0r0n") == "moron" and toxicity.decoded("st*u*pid") == "stupid"


def test_long_texts_are_read_whole(monkeypatch):
    lexicon = toxicity.Lexicon([("grumk", 1, 2.0)])
    text = "plain words " * 3_000 + "grumk"
    whole = toxicity.features(text, lexicon)
    monkeypatch.setattr(toxicity, "PIECE", 1_000)
    assert toxicity.features(text, lexicon)[:6] == whole[:6] and whole[0] > 0
