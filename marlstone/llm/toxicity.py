"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of lexicon words and stems, how near those stand to a word of address, the rates of
capitals, punctuation and obfuscation, and how long and varied the text is. The lexicon is a short fixed list, and what the
labelled documents teach: words, and beginnings of words, that toxic documents hold far more often, once or repeatedly.

All is learned from a sample of labelled documents, bounded by max_docs. Lexicons are learned in folds, so the features of a
training document rest on a lexicon that has not seen it; calibration rests on trees that have not seen the document either.
Copies of a text are one example. Scoring is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, map_text

# Insults, and words of address, in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns fool jerk creep bastard filth vermin "
    "dummkopf trottel abschaum versager arschloch schwachkopf imbécile crétin connard abruti ordure salaud imbécil estúpido basura escoria cabrón"
).split()
ADDRESS = "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta vous votre tú ti usted ustedes vosotros vuestro".split()
LEET = str.maketrans("0134578@$!|", "oieastbasil")

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‚‘’¡¿…–—"
#: Lengths of learned beginnings, and how often a document must hold an entry at least, in two kinds of entries.
STEMS, LEVELS = (4, 5, 6, 7), (1, 2)
#: A learned entry is in that many toxic documents, and that many standard deviations above chance; of those the best stay.
LEAST_DOCS, LEAST_Z, MOST_ENTRIES = 3, 4.0, 500
FOLDS, SAMPLE_PARTS, GROW_PARTS = 5, 16, 4
#: Terms of several toxic documents that are looked at, the most frequent ones.
MOST_CANDIDATES = 50_000
#: Words from a word of address that count as near; characters that are split at once; (term, fold) pairs that a task holds.
NEAR, PIECE, HELD = 6, 1_000_000, 400_000

FEATURES = (
    "words_hit words_evidence words_distinct stem_count stem_evidence all_evidence fixed_hit decoded_hit near_address address "
    "capitals shouted exclaims asks symbols doubled digits obfuscated stretched spaced word_length distinct log_words log_hits"
).split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _pieces(text: str | None):
    """text in pieces of about PIECE characters, cut at white space if there is some."""
    text, at = text or "", 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
        end = end if end > at else at + PIECE
        yield text[at:end]
        at = end


def words_of(tokens: Counter) -> Counter:
    """Tokens without punctuation around them, lower-cased."""
    found = Counter()
    for token, n in tokens.items():
        if word := token.strip(PUNCTUATION).lower():
            found[word] += n
    return found


def decoded(token: str) -> str:
    """What an obfuscated token may stand for: digits and signs read as letters, signs inside and repeated letters left out."""
    found = []
    for c in token.strip("!\"'()*+,-./:;<=>?[]^_`{}~#%&").lower().translate(LEET):
        if c.isalpha() and not (len(found) > 1 and found[-1] == found[-2] == c):
            found.append(c)
    word = "".join(found)
    return word if word in _FIXED else "".join(c for k, c in enumerate(word) if not k or word[k - 1] != c)


_FIXED, _ADDRESS = frozenset(INSULTS), frozenset(ADDRESS)


class Lexicon:
    """Learned entries: weights of words and of beginnings of words, with the number of times a document must hold them."""

    def __init__(self, entries: list[tuple[str, int, float]]):
        self.words = {t: (n, w) for t, n, w in entries if not t.endswith("*")}
        self.stems = {t[:-1]: (n, w) for t, n, w in entries if t.endswith("*")}
        self.starts = frozenset(t[: STEMS[0]] for t in self.stems)
        self.known = _FIXED | self.words.keys()


#: Letters with other signs between them.
_OBFUSCATED = re.compile(r"[^\W\d_](?:[\d@$!|*._-]|[^\w\s'’-])+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")


class _Letters:
    """Counts over the bytes of a text, piece by piece."""

    def __init__(self):
        self.each, self.doubled, self.spaced, self.stretched = np.zeros(256, np.int64), 0, 0, 0

    def add(self, piece: str) -> None:
        raw = piece.encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, np.uint8)
        self.each += np.bincount(b, minlength=256)
        self.doubled += raw.count(b"!!") + raw.count(b"??") + raw.count(b"***")
        if len(b) > 4:
            low = b | 32
            same = (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (low[2:] >= 97) & (low[2:] <= 122)
            self.stretched += int(np.count_nonzero(same))
            gap = b == 32
            alone = gap[:-4] & gap[2:-2] & gap[4:] & ~gap[1:-3] & ~gap[3:-1]
            self.spaced += int(np.count_nonzero(alone))

    def of(self, signs: str) -> int:
        return sum(int(self.each[ord(c)]) for c in signs)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """FEATURES of a text; all are zero for one without a token."""
    tokens, letters = Counter(), _Letters()
    for piece in _pieces(text):
        tokens.update(piece.split())
        letters.add(piece)
    n = tokens.total()
    if not n:
        return [0.0] * len(FEATURES)
    words: dict[str, int] = {}
    shouted = obfuscated = hidden = size = 0
    hits = set()
    for token, c in tokens.items():
        word = token.strip(PUNCTUATION).lower()
        words[word] = words.get(word, 0) + c
        size += len(word) * c
        if len(token) > 1 and token.isupper():
            shouted += c
        if word.isalpha():
            if letters.stretched and len(word) > 4 and word not in _FIXED and _STRETCHED.search(word) and decoded(token) in _FIXED:
                hidden += c
                hits.add(word)
        elif word and not word.isdigit() and _OBFUSCATED.search(token):
            obfuscated += c
            if decoded(token) in lexicon.known and word not in _FIXED:
                hidden += c
                hits.add(word)
    hit, evidence, distinct = 0, 0.0, 0
    for word in lexicon.words.keys() & words.keys():
        least, weight = lexicon.words[word]
        if (c := words[word]) >= least:
            hit, evidence, distinct = hit + c, evidence + c * weight, distinct + 1
            hits.add(word)
    fixed = 0
    for word in _FIXED & words.keys():
        fixed += words[word]
        hits.add(word)
    stems: Counter = Counter()
    if lexicon.stems:
        k, starts = STEMS[0], lexicon.starts
        for word in [w for w in words if w[:k] in starts]:
            for m in STEMS:
                if len(word) > m and word[:m] in lexicon.stems and word.isalpha():
                    stems[word[:m]] += words[word]
                    hits.add(word)
    best, best_count = 0.0, 0
    for stem, c in stems.items():
        least, w = lexicon.stems[stem]
        if c >= least:
            best, best_count = max(best, c * w), max(best_count, c)
    second = sum(words[w] for w in _ADDRESS & words.keys())
    near = _near(text, hits) if hits and second else 0
    upper, lower, chars = int(letters.each[65:91].sum()), int(letters.each[97:123].sum()), max(1, int(letters.each.sum()))
    return [
        100 * hit / n, 100 * evidence / n, float(distinct), float(best_count), 100 * best / n, 100 * (best + evidence) / n,
        100 * fixed / n, 100 * hidden / n, 100 * near / n, 100 * second / n,
        upper / max(1, upper + lower), shouted / n, letters.of("!") / n, letters.of("?") / n, letters.of("#$%&*@^~|_<>") / n, letters.doubled / n,
        letters.of("0123456789") / chars, obfuscated / n, letters.stretched / n, letters.spaced / n, size / n, len(words) / n, math.log1p(n),
        math.log1p(hit + best_count + fixed + hidden),
    ]


def _near(text: str, hits: set[str]) -> int:
    """How many of the words that are hits stand at most NEAR words from a word of address."""
    found = 0
    for piece in _pieces(text):
        own = [t.strip(PUNCTUATION).lower() for t in piece.split()]
        at = np.array([k for k, t in enumerate(own) if t in hits])
        to = np.array([k for k, t in enumerate(own) if t in _ADDRESS])
        if len(at) and len(to):
            right = np.searchsorted(to, at)
            after = to[np.minimum(right, len(to) - 1)] - at
            before = at - to[np.maximum(right - 1, 0)]
            found += int(((after >= 0) & (after <= NEAR) | (before >= 0) & (before <= NEAR)).sum())
    return found


def _terms(text: str) -> Counter:
    """Words of a text, and their beginnings, which end with a star."""
    tokens = Counter()
    for piece in _pieces(text):
        tokens.update(piece.split())
    found = words_of(tokens)
    for word, n in list(found.items()):
        if word.isalpha():
            for k in STEMS:
                if len(word) > k:
                    found[word[:k] + "*"] += n
    return found


def _counted(fields: list[str], candidates=None):
    """Rows (text, toxic, fold) to sums by (term, level, fold), one pair of fields, documents and occurrences, for each toxic."""

    def run(batches):
        import pyarrow as pa

        def emit():
            columns = [*zip(*held, strict=True), *zip(*held.values(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["term", "level", "fold", *fields])

        held: dict = {}
        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                place = 0 if toxic else 2
                for term, n in _terms(text).items():
                    for level in LEVELS:
                        if n >= level and (candidates is None or (term, level) in candidates.value):
                            own = held.get((term, level, fold))
                            if own is None:
                                own = held[term, level, fold] = [0] * len(fields)
                            own[place] += 1
                            own[place + 1] += n
                if len(held) > HELD:
                    yield emit()
                    held = {}
        if held:
            yield emit()

    return run


def lexicons(sample: DataFrame) -> list[Lexicon]:
    """Of sample(text, toxic, fold): the lexicon of all folds but each one, and that of all."""
    docs = np.zeros((FOLDS, 2), np.int64)
    for r in sample.groupBy("fold", "toxic").count().collect():
        docs[r.fold, 1 - r.toxic] = r["count"]
    pos, neg = docs.sum(0).tolist()
    if not pos or not neg:
        return [Lexicon([])] * (FOLDS + 1)
    # only what several toxic documents hold can be an entry, so nothing else is counted in the others
    rows, key = sample.select("text", "toxic", "fold"), "term string, level long, fold long"
    own = rows.filter("toxic = 1").mapInArrow(_counted(["pos", "pos_n"]), f"{key}, pos long, pos_n long")
    often = own.groupBy("term", "level").agg(F.sum("pos").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    some = often.orderBy(F.desc("n"), "term", "level").limit(MOST_CANDIDATES).collect()
    candidates = sample.sparkSession.sparkContext.broadcast(frozenset((r.term, r.level) for r in some))
    counted = rows.mapInArrow(_counted(["pos", "pos_n", "neg", "neg_n"], candidates), f"{key}, pos long, pos_n long, neg long, neg_n long")
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("pos", "neg", "pos_n", "neg_n")]
    total = lambda c: sum((F.col(f"{c}{f}") for f in range(1, FOLDS)), F.col(f"{c}0"))
    seen, share = total("pos") + total("neg"), pos / (pos + neg)
    z = (total("pos") - seen * share) / F.sqrt(seen * (share * (1 - share)) + 0.1)
    by_term = counted.groupBy("term", "level").agg(*sums).withColumn("z", z).filter((total("pos") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z - 1))
    rows = by_term.orderBy(F.desc("z"), "term", "level").limit(4 * MOST_ENTRIES).collect()
    found = []
    for left_out in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left_out]
        p, q = docs[folds].sum(0).tolist()
        scored = []
        for r in rows:
            a, b, an, bn = (sum(r[f"{c}{f}"] for f in folds) for c in ("pos", "neg", "pos_n", "neg_n"))
            s = p / max(1, p + q)
            deviation = (a - (a + b) * s) / math.sqrt((a + b) * s * (1 - s) + 0.1)
            if a >= LEAST_DOCS and deviation >= LEAST_Z:
                scored.append((-deviation, r.term, r.level, math.log((an + 0.5) / (bn + 0.5) * (q + 1) / (p + 1))))
        best = {}
        for _, term, level, weight in sorted(scored)[:MOST_ENTRIES]:
            if weight > 0:
                best.setdefault(term, (term, level, weight))
        found.append(Lexicon(list(best.values())))
    return found


def _featured(docs: DataFrame, carry: list[str], lexicon) -> DataFrame:
    """docs with features, a vector."""

    def run(texts):
        return [[features(t, lexicon.value) for t in texts]]

    return map_text(docs, carry, "text", run, "features array<double>", 4_000_000).select(*carry, array_to_vector("features").alias("features"))


class Scorer:
    """A lexicon, trees and their calibration; without both kinds of examples, one score for all texts."""

    def __init__(self, lexicon, trees, calibration, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, carry: list[str]) -> DataFrame:
        if self.trees is None:
            return docs.select(*carry, F.lit(self.constant).alias("score"))
        made = _judged(self.trees, _featured(docs, carry, self.lexicon), carry)
        found = self.calibration.transform(made)
        return found.select(*carry, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def _judged(trees, rows: DataFrame, carry: list[str]) -> DataFrame:
    return trees.transform(rows).select(*carry, vector_to_array("probability")[1].alias("margin"))


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, rounds: int = 12, depth: int = 3, seed: int = 42) -> Scorer:
    """The scorer of docs(doc_id, text) by labels(doc_id, toxic), from rows that are not held out.

    About max_docs labelled documents are taken, all if there are no more, by a hash of their id. A document that is labelled
    differently counts as toxic; null ids, labels and texts teach nothing. The driver holds a lexicon of at most MOST_ENTRIES
    for each fold.
    """
    spark = docs.sparkSession
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    ids = marked.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    some = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    share = max_docs / max(1, marked.count())
    chosen = F.broadcast(ids.filter(some < int(min(1.0, share) * (1 << 30))) if share < 1 else ids)
    named = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(chosen, "doc_id")
    # copies of a text are one example, and fall into one fold
    own = named.select("text", "toxic", F.xxhash64("text").alias("h")).groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    # a bounded sample: in few partitions, so that what their tasks count is small
    sample = cut(own.select("text", "toxic", "h", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))).coalesce(SAMPLE_PARTS)
    kinds = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return Scorer(None, None, None, float(kinds.get(1, 0) > 0))
    found = [spark.sparkContext.broadcast(x) for x in lexicons(sample)]
    parts = [_featured(sample.filter(F.col("fold") == f), ["toxic", "h"], found[f]) for f in range(FOLDS)]
    made = parts[0]
    for part in parts[1:]:
        made = made.union(part)
    rows = made.select("h", F.col("toxic").cast("double").alias("toxic"), "features", F.pmod(F.shiftright("h", 20), F.lit(2)).alias("half"))
    # a bounded sample: few partitions, in one order, so that reruns agree
    rows = cut(rows.repartitionByRange(GROW_PARTS, "h").sortWithinPartitions("h")).coalesce(GROW_PARTS)
    grow = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=3, seed=seed)
    seen = None
    for half in range(2):
        learned, other = rows.filter(F.col("half") != half), rows.filter(F.col("half") == half)
        if learned.select("toxic").distinct().count() == 2:
            judged = _judged(grow.fit(learned), other, ["toxic"])
            seen = judged if seen is None else seen.union(judged)
    trees = grow.fit(rows)
    seen = cut(seen if seen is not None else _judged(trees, rows, ["toxic"])).coalesce(GROW_PARTS)
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="margin", predictionCol="score").fit(seen)
    return Scorer(found[FOLDS], trees, calibration)


def score(docs: DataFrame, labels: DataFrame, least: float = 0.3, keep: tuple[str, ...] = (), **how) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, held_out, score (0 to 1) and predicted, 1 from score least on.

    Learned from labels(doc_id, toxic) of rows that are not held out, see learn(). Null and empty texts score as a text without
    words; repeated rows are scored each, and alike; where no document, or only one kind, is labelled, every text has the same
    score, 0 without a toxic one. Further columns are ignored unless named in keep; an empty table gives no rows.
    """
    carry = list(dict.fromkeys(("doc_id", *keep)))
    made = learn(docs, labels, **how).score(docs, carry)
    return made.select(*carry, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
