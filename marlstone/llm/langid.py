"""Language ID as multilingual mixture inference.

A document is a mixture of languages: each word, a run of letters, is drawn from one of them with the product of its letter
trigrams' likelihoods. Expectation-maximisation estimates the proportions over all learned languages, then over the best
one, two, three of them and on, as long as the likelihood after a penalty for each further language improves; the best set
wins, and its largest proportion gives the prediction. The fit tells how much likelier the text is in these languages than
by evenly drawn trigrams.

The model is trigram counts per language, hashed to buckets: 65,536 of them, or a lower power of two where languages are so
many that the model would have more than MODEL_CELLS numbers. So its size is bounded whatever the corpus. It learns from a
sample bounded by max_docs per language; every word of a sampled document counts.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, map_text

MODEL_CELLS, MOST_BUCKETS_LOG2 = 1 << 24, 16
#: Characters of a text whose trigrams are looked up at once; longer texts are cut between words.
PIECE = 1_000_000
#: Sizes of the set that are tried in any case; larger ones only as long as the last one was better.
TRIED = 3
ROUNDS = 8
#: Log-likelihood that a further language must add, times the log of the words plus one.
PENALTY = 3.0
#: Least log-odds of a word against its best language, so no single word rules a language out.
FLOOR = -30.0


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None], buckets_log2: int = MOST_BUCKETS_LOG2):
    """Bucket of every trigram, the first trigram of every word, and the first word of every text (with one end more)."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[np.minimum(code, 0x10FFFF)], code, 0).astype(np.uint64)
    before = np.concatenate(([0], c[:-1])).astype(np.uint64)
    twice = np.concatenate(([0], before[:-1])).astype(np.uint64)
    twice[before == 0] = 0
    at = np.flatnonzero((c | before) != 0)
    c, before, twice = c[at], before[at], twice[at]
    h = (twice * np.uint64(0x9E3779B97F4A7C15) + before) * np.uint64(0xC2B2AE3D27D4EB4F) + c
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    words = np.flatnonzero((c != 0) & (before == 0))
    ends = np.cumsum([len(t) + 1 for t in low])
    texts_at = np.searchsorted(at[words], np.concatenate(([0], ends)))
    return (h >> np.uint64(64 - buckets_log2)).astype(np.int64), words, texts_at


def pieces_of(text: str | None, most: int) -> list[str]:
    """text in pieces of at most so many characters, cut at white space; a longer run of letters is cut as it comes."""
    text, out = text or "", []
    while len(text) > most:
        at = max(text.rfind(" ", 1, most), text.rfind("\n", 1, most))
        at = at if at > 0 else most
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def word_likelihoods(texts: list[str | None], model: np.ndarray, piece: int = PIECE):
    """Log-likelihood of each word under each language (words x languages), the first word of every text (with one end more),
    and the trigrams of every text."""
    buckets_log2 = len(model).bit_length() - 1
    rows, words, trigrams = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    owners, parts, size = [], [], 0

    def take():
        h, first, texts_at = grams(parts, buckets_log2)
        if len(first):
            rows.append(np.add.reduceat(model[h], first, axis=0))
        np.add.at(words, owners, np.diff(texts_at))
        ends = np.append(first, len(h))
        np.add.at(trigrams, owners, np.diff(ends[texts_at]))

    for k, text in enumerate(texts):
        for part in pieces_of(text, piece):
            if parts and size + len(part) > piece:
                take()
                owners, parts, size = [], [], 0
            owners.append(k)
            parts.append(part)
            size += len(part)
    if parts:
        take()
    every = np.concatenate(rows) if rows else np.zeros((0, model.shape[1]), model.dtype)
    return every, np.concatenate(([0], np.cumsum(words))), trigrams


def _proportions(e: np.ndarray, texts_at: np.ndarray, allowed: np.ndarray):
    """Proportions (texts x languages) and log-likelihood of words e, relative to each word's best, by EM."""
    n = np.diff(texts_at)
    owner = np.repeat(np.arange(len(n)), n)
    p = (allowed / allowed.sum(1, keepdims=True)).astype(e.dtype)
    for _ in range(ROUNDS if allowed.sum(1).max() > 1 else 0):
        r = e * p[owner]
        r /= r.sum(1, keepdims=True)
        p = (np.add.reduceat(r, texts_at[:-1], axis=0) / n[:, None]).astype(e.dtype)
    return p, np.add.reduceat(np.log((e * p[owner]).sum(1, dtype=np.float64)), texts_at[:-1])


def classify(texts: list[str | None], model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every text, index of the predicted language (-1: none), its proportion, all proportions (0: not in the set) and
    the fit, the log-likelihood of a trigram above that of evenly drawn ones; model: buckets x languages, log."""
    found, share = np.full(len(texts), -1), np.zeros(len(texts))
    mix, gain = np.zeros((len(texts), model.shape[1])), np.zeros(len(texts))
    if not model.shape[1]:
        return found, share, mix, gain
    likelihood, texts_at, trigrams = word_likelihoods(texts, model)
    some = np.flatnonzero(np.diff(texts_at))
    if not len(some):
        return found, share, mix, gain
    top = likelihood.max(1, keepdims=True)
    likelihood -= top
    e = np.exp(np.maximum(likelihood, FLOOR))
    starts = np.concatenate((texts_at[some], texts_at[-1:]))
    p, _ = _proportions(e, starts, np.ones((len(some), model.shape[1])))
    order = np.argsort(-p, axis=1, kind="stable")
    cost = PENALTY * np.log1p(np.diff(starts))
    best, best_p, undecided = np.full(len(some), -np.inf), p, np.arange(len(some))
    best_fit = np.zeros(len(some))
    for k in range(1, model.shape[1] + 1):
        # a k-th language with less than half a word cannot pay for itself
        undecided = undecided[p[undecided, order[undecided, k - 1]] * np.diff(starts)[undecided] >= 0.5 * (k > 1)]
        if not len(undecided):
            break
        allowed = np.zeros((len(undecided), model.shape[1]))
        np.put_along_axis(allowed, order[undecided, :k], 1.0, 1)
        own = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in undecided]) if len(undecided) < len(some) else slice(None)
        at = np.concatenate(([0], np.cumsum(np.diff(starts)[undecided])))
        q, fit = _proportions(e[own], at, allowed)
        after = fit - cost[undecided] * (k - 1)
        better = after > best[undecided]
        best[undecided[better]] = after[better]
        best_fit[undecided[better]] = fit[better]
        if k == 1:
            best_p = p.copy()
        best_p[undecided[better]] = q[better]
        if k >= TRIED:
            undecided = undecided[better]
    found[some] = best_p.argmax(1)
    share[some] = best_p.max(1)
    mix[some] = best_p
    gain[some] = (np.add.reduceat(top[:, 0].astype(np.float64), starts[:-1]) + best_fit) / trigrams[some] + np.log(len(model))
    return found, np.clip(share, 0, 1), np.clip(mix, 0, 1), gain


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, max_docs: int = 200_000, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods of buckets, of docs(doc_id, text, lang) that are neither held out nor without id or lang.

    Of a language with more than max_docs documents about that many are taken, by a hash of the id. The driver holds the names
    of the languages and a model of MODEL_CELLS at most, but for 256 buckets a language.
    """
    own = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    numbers = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}
    languages = sorted(numbers)
    buckets_log2 = max(8, min(MOST_BUCKETS_LOG2, (MODEL_CELLS // max(1, len(languages))).bit_length() - 1))
    many = {lang: max_docs / n for lang, n in numbers.items() if n > max_docs}
    if many:
        kept = F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[F.col("lang")]
        own = own.filter(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < kept * (1 << 30), F.lit(True)))

    def count(batches):
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                held, size = [], 0
                own = (part for i in np.flatnonzero(langs == lang) for part in pieces_of(texts[i], PIECE))
                for part in [*own, None]:
                    if held and (part is None or size > PIECE):
                        made = np.bincount(grams(held, buckets_log2)[0], minlength=1 << buckets_log2)
                        totals[lang] = totals.get(lang, 0) + made
                        held, size = [], 0
                    if part is not None:
                        held.append(part)
                        size += len(part)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counted = own.select("lang", F.col("text").cast("string")).mapInArrow(count, "lang string, bucket long, n long")
    table = np.zeros((1 << buckets_log2, len(languages)))
    place = {lang: k for k, lang in enumerate(languages)}
    for r in cut(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toLocalIterator():
        table[r.bucket, place[r.lang]] = r.n
    return languages, np.log((table + smoothing) / (table.sum(0) + smoothing * len(table))).astype(np.float32)


def typical_fit(model: np.ndarray) -> float:
    """Least of the languages' mean fits over the trigrams that they were learned from; infinite without a language."""
    own = model.astype(np.float64)
    return float(((np.exp(own) * own).sum(0) + np.log(len(own))).min()) if own.shape[1] else np.inf


ADDED = "lang_pred string, score double, languages array<struct<lang: string, share: double>>, fit double"


def predict(docs: DataFrame, languages: list[str], model: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs(doc_id, text) with held_out, lang_pred and score, the proportion of the predicted language; with
    languages, all that the text mixes and their proportions, largest first; and with fit, see classify().

    lang_pred is und, score and fit are 0 and languages is empty for a text that is null or has no letter, and where nothing was learned. Ties go to the
    language first in order. Repeated rows are predicted each; further columns are ignored unless named in keep.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [*languages, "und"]

    def run(texts):
        found, share, mix, gain = classify(texts, held.value)
        sets = [
            [{"lang": names[k], "share": float(row[k])} for k in np.argsort(-row, kind="stable")[: np.count_nonzero(row)]] for row in mix
        ]
        return [[names[k] for k in found], share, sets, gain]

    carry = list(dict.fromkeys(("doc_id", *keep)))
    made = map_text(docs, carry, "text", run, ADDED, max(50_000, 1_000_000 // max(4, len(languages))))
    return made.select(*carry, held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "fit")


def identify(docs: DataFrame, keep: tuple[str, ...] = (), **how) -> DataFrame:
    """predict() of docs(doc_id, text, lang) by what learn() takes from the same table."""
    return predict(docs, *learn(docs, **how), keep=keep)
