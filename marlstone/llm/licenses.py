"""License scans by a trained paragraph classifier, in DataFrame operations and Spark's own learner only.

A paragraph is a line, or a run of short lines, as of a text that was wrapped; such a run is read as a whole and line by line.
Paragraphs become sparse counts of those of their words and word pairs that licence texts hold, slice by slice. A multinomial
logistic regression, trained on pieces of licence texts and on the paragraphs of all documents, gives each slice a family or the
class unknown. Slices of the same counts are one weighted example, so all of them are few. The unknown class is calibrated on paragraphs that were not trained on: a family is predicted only above the probability that
a stated share of them stays under. A prediction counts once the slice shares enough word pairs with a text of its family.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import cut
from marlstone.llm.license_texts import NOTICES

FEATURES = 1 << 14
#: Longest slice of a paragraph that is classified at once, in words, and the step between slices; slices cover all words.
SLICE, STEP = 60, 45
#: Longest line, in characters, that may be a part of a wrapped paragraph.
WRAPPED = 100
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *dict.fromkeys(f for f, _ in NOTICES))
# Texts that are a notice only as the end of a paragraph, as their words go on in other sentences.
ENDINGS = ("All rights reserved.",)
#: Share of word pairs with a licence text from which a paragraph is no example of the unknown class.
NEAR = 0.4
#: Word pairs that a slice must share with a longer licence text.
LEAST_PAIRS = 5
#: All examples of the unknown class weigh so many times as much as all pieces of licence texts, however many there are.
UNKNOWN_WEIGHT = 5.0
#: Probabilities are counted in steps of 1 / BINS to find a level.
BINS = 10_000
#: The probability of a family is never asked to be below or above these.
LEVELS = (0.5, 0.9)


def words(text: Column) -> Column:
    """Hashes of the words, runs of a-z and 0-9 whatever their case."""
    found = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def pairs(w: Column) -> Column:
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))


def paragraphs(text: Column) -> Column:
    """Lines that are not blank; a vertical tab joins the lines of a run of short ones."""
    short = rf"[^\n]{{1,{WRAPPED}}}"
    joined = F.regexp_replace(text, rf"(?dm)^(?=[ \t\r]*+\S)({short})\n(?=[ \t\r]*+\S)(?={short}$)", "$1\x0b")
    return F.filter(F.split(joined, "\n"), lambda x: F.trim(x) != "")


def readings(paragraph: Column) -> Column:
    """A paragraph as a whole, and its lines if there are several."""
    lines = F.split(paragraph, "\x0b")
    return F.concat(F.array(paragraph), F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")))


def slices(w: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - SLICE + STEP, F.lit(1)), F.lit(STEP))
    return F.transform(starts, lambda i: F.slice(w, i, SLICE))


def _cuts(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, w: the slices of the text of each of the rows. The generator makes the words one column, so they are computed once, not
    once for each slice."""
    made = rows.select(*keep, F.explode(F.array(words(F.col(text)))).alias("w"))
    return made.select(*keep, F.explode(slices(F.col("w"))).alias("w"))


def _held(rows: DataFrame, terms: str) -> DataFrame:
    """rows(w) with words_held and pairs_held, the words and word pairs that licence texts hold."""
    both = rows.withColumn("_pairs", pairs(F.col("w")))
    return both.withColumn("words_held", F.expr(f"filter(w, x -> x IN ({terms}))")).withColumn("pairs_held", F.expr(f"filter(_pairs, x -> x IN ({terms}))")).drop("_pairs")


def _counted(rows: DataFrame, hashes: list[int]) -> DataFrame:
    """rows(grams) with features, the counts of the words and pairs of words by hash.

    Of FEATURES hashes, only those that a licence text's term has are columns, as all others are zero in every row: the model's matrix is
    dense then, and a slice costs its own terms only.
    """
    place = F.transform("grams", lambda x: F.pmod(F.hash(x), F.lit(FEATURES)).cast("string"))
    terms = rows.sparkSession.range(1).select(F.expr(f"array({_listed(hashes)})").alias("grams"))
    known = terms.select(F.array_sort(F.array_distinct(place)).alias("x")).first().x
    return CountVectorizerModel.from_vocabulary(known, inputCol="_terms", outputCol="features").transform(rows.withColumn("_terms", place)).drop("grams", "_terms")


def _texts(spark: SparkSession) -> DataFrame:
    """label, text of the licence texts."""
    quoted = ((FAMILIES.index(f), t.replace("\\", "\\\\").replace("'", "\\'")) for f, t in NOTICES)
    rows = ", ".join(f"({k}, '{t}')" for k, t in quoted)
    return spark.sql(f"SELECT col1 AS label, col2 AS text FROM VALUES {rows}")


def known_hashes(spark: SparkSession) -> list[int]:
    """The hashes of the licence texts' words and word pairs."""
    w = _texts(spark).select(words(F.col("text")).alias("w"))
    return [r.x for r in w.select(F.explode(F.concat("w", pairs(F.col("w")))).alias("x")).distinct().orderBy("x").collect()]


def _listed(hashes: list[int]) -> str:
    return ", ".join(f"{x}L" if x > -(1 << 63) else "CAST('-9223372036854775808' AS BIGINT)" for x in hashes)


def known_terms(spark: SparkSession) -> str:
    """known_hashes(), comma-joined."""
    return _listed(known_hashes(spark))


def known_texts(spark: SparkSession) -> Column:
    """The licence texts as a literal struct of few, those of fewer than LEAST_PAIRS distinct word pairs, and more, the others: arrays
    of structs of label, pairs (distinct), ending (words of one of ENDINGS, else empty)."""
    ending = F.when(F.col("text").isin(*ENDINGS), F.col("w")).otherwise(F.array().cast("array<bigint>"))
    found = _texts(spark).withColumn("w", words(F.col("text"))).select("label", F.array_distinct(pairs(F.col("w"))).alias("pairs"), ending.alias("ending"))
    # one literal, not one for each number
    few, t = F.size("pairs") < LEAST_PAIRS, F.struct("label", "pairs", "ending")
    parts = (F.array_sort(F.collect_list(F.when(own, t))).alias(name) for name, own in (("few", few), ("more", ~few)))
    rows = found.agg(F.to_json(F.struct(*parts))).first()[0]
    kind = "array<struct<label: int, pairs: array<bigint>, ending: array<bigint>>>"
    return F.from_json(F.lit(rows), f"struct<few: {kind}, more: {kind}>")


def _bound(value: Column, use) -> Column:
    """use(value), the value being computed once although a lambda function uses it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(w: Column, known: Column, overlap: float, label: Column | None = None, held: Column | None = None) -> Column:
    """Whether a slice and a text of known, of the label if one is given, share that share of the shorter one's word pairs.

    They share LEAST_PAIRS at least, or all of a text with fewer; an ending must be the slice's last words. held are those of the
    slice's word pairs that any text of known has, all pairs if it is not given: only texts that so many can be enough for are compared.
    """
    every = pairs(w)

    def one(mine: Column, t: Column, least: Column) -> Column:
        enough = (F.size(mine) >= least) & (F.size(F.array_intersect(mine, t["pairs"])) >= least)
        size = F.greatest(F.size(t["ending"]), F.lit(1))
        whole = enough & ((F.size(t["ending"]) == 0) | (F.slice(w, -size, size) == t["ending"]))
        return whole if label is None else (t["label"] == label) & whole

    def of_more(mine: Column, own: Column) -> Column:
        return F.exists(known["more"], lambda t: one(mine, t, F.greatest(F.lit(overlap) * F.least(own, F.size(t["pairs"])), F.lit(LEAST_PAIRS))))

    def any_of(mine: Column) -> Column:
        few = F.exists(known["few"], lambda t: one(mine, t, F.greatest(F.size(t["pairs"]), F.lit(1))))
        return few | ((F.size(mine) >= LEAST_PAIRS) & _bound(F.size(F.array_distinct(every)), lambda own: of_more(mine, own)))

    return _bound(F.array_distinct(every if held is None else held), any_of)


def unknown_examples(docs: DataFrame, known: Column, terms: str) -> DataFrame:
    """half, grams, n: how many slices of the paragraphs of all docs(text) hold just these licence words and pairs, in two halves by
    a hash of their words. Slices that share NEAR of their word pairs, or of a licence text's, are no examples."""
    cuts = _cuts(docs.filter("text is not null").select(F.explode(paragraphs(F.col("text"))).alias("p")), "p")
    held = _held(cuts.filter(F.size("w") > 0), terms)
    near = F.when(F.size("pairs_held") > 0, matches(F.col("w"), known, NEAR, held=F.col("pairs_held"))).otherwise(F.lit(False))
    grams = F.array_sort(F.concat("words_held", "pairs_held"))
    each = held.select(F.pmod(F.xxhash64("w"), F.lit(2)).alias("half"), grams.alias("grams"), F.when(near, 0).otherwise(1).alias("one"))
    return each.groupBy("half", "grams").agg(F.sum("one").alias("n")).filter("n > 0")


def train(docs: DataFrame, known: Column, hashes: list[int], share: float = 0.999):
    """The model, and the probability that a family must have.

    The slices of all documents' paragraphs stand for the unknown class, see unknown_examples(). Of these, half trains, and of
    the other half a share must stay below the level that is returned; it is kept within LEVELS, so that licences among the
    examples cannot raise it out of reach.
    """
    spark, terms = docs.sparkSession, _listed(hashes)
    other = cut(unknown_examples(docs, known, terms))
    text = _texts(spark).select("label", words(F.col("text")).alias("w"))
    # a text may be cut anywhere: its beginnings and its parts are examples as well
    pieces = text.select(
        "label",
        F.explode(
            F.concat(
                F.array("w"),
                F.transform(F.sequence(F.least(F.lit(6), F.size("w")), F.least(F.size("w"), F.lit(SLICE)), F.lit(4)), lambda n: F.slice("w", 1, n)),
                *(
                    F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n // 2, F.lit(1)), F.lit(step)), lambda i, n=n: F.slice("w", i, n))
                    for n, step in ((12, 4), (30, 10), (SLICE, 15))
                ),
            )
        ).alias("w"),
    ).distinct()
    # what another family's text holds as well says nothing of a family
    shared = _bound(
        F.array_distinct(pairs(F.col("w"))),
        lambda own: F.exists(F.concat(known["few"], known["more"]), lambda t: (t["label"] != F.col("label")) & (F.size(F.array_except(own, t["pairs"])) == 0)),
    )
    pieces = _held(pieces.filter(~shared), terms).select("label", F.concat("words_held", "pairs_held").alias("grams"), F.lit(1.0).alias("weight"))
    pieces = cut(pieces)
    total = other.filter("half = 0").agg(F.sum("n").alias("n")).first().n or 1
    weight = F.col("n") * F.lit(UNKNOWN_WEIGHT * pieces.count() / total)
    examples = pieces.union(other.filter("half = 0").select(F.lit(0).alias("label"), "grams", weight.alias("weight")))
    vectors = _counted(examples, hashes).select(F.col("label").cast("double").alias("label"), "features", "weight")
    model = LogisticRegression(maxIter=20, regParam=1e-4, family="multinomial", weightCol="weight").fit(vectors)
    others = model.transform(_counted(other.filter("half = 1"), hashes))
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES)))
    bins = others.groupBy((F.ceil(best * BINS) / BINS).alias("p")).agg(F.sum("n").alias("n"))
    level = bins.agg(F.percentile("p", F.lit(share), F.col("n")).alias("p")).first().p
    return model, min(max(LEVELS[0], level or 0.0), LEVELS[1])


def scan(docs: DataFrame, share: float = 0.999, overlap: float = 0.6) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, n_paragraphs, n_licence, families (sorted, comma-joined), family, score.

    n_licence counts paragraphs with a slice that the classifier gives a family, and that a text of the family confirms, see
    matches(). Every slice of every paragraph is classified. family is the confirmed one of the highest probability, ties to
    the name first in order; unknown, with score 0, where there is none. Null, empty and blank texts have no paragraphs.
    Repeated rows are scanned each; further columns are ignored; an empty table gives no rows.
    """
    known = known_texts(docs.sparkSession)
    hashes = known_hashes(docs.sparkSession)
    model, level = train(docs, known, hashes, share)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    each = rows.select("doc_id", "_row", F.posexplode_outer(paragraphs(F.col("text"))).alias("_no", "p"))
    read = each.select("doc_id", "_row", "_no", F.explode(readings(F.coalesce("p", F.lit("")))).alias("r"))
    cuts = _cuts(read, "r", "doc_id", "_row", "_no")
    # the generator makes the probabilities one column, so they are computed once
    family = F.slice(vector_to_array("probability"), 2, len(FAMILIES))
    held = _held(cuts, _listed(hashes)).withColumn("grams", F.concat("words_held", "pairs_held"))
    scored = model.transform(_counted(held, hashes)).select("doc_id", "_row", "_no", "w", "pairs_held", F.explode(F.array(family)).alias("family"))
    judged = scored.select(
        "doc_id", "_row", "_no", "w", "pairs_held", F.array_max("family").alias("p"), F.array_position("family", F.array_max("family")).cast("int").alias("k")
    )
    hit = F.when((F.col("p") >= level) & (F.size("w") > 1), matches(F.col("w"), known, overlap, F.col("k"), F.col("pairs_held"))).otherwise(F.lit(False))
    name = F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("k") + 1)
    by_row = (
        judged.withColumn("hit", hit)
        .groupBy("_row", "doc_id")
        .agg(
            (F.max("_no") + 1).alias("n_paragraphs"),
            F.collect_set(F.when(F.col("hit"), F.col("_no"))).alias("_hits"),
            F.array_sort(F.collect_set(F.when(F.col("hit"), name))).alias("_families"),
            F.max(F.when(F.col("hit"), F.struct(F.col("p").alias("p"), (-F.col("k")).alias("k"), name.alias("f")))).alias("_best"),
        )
    )
    return by_row.select(
        "doc_id",
        F.coalesce(F.col("n_paragraphs").cast("long"), F.lit(0)).alias("n_paragraphs"),
        F.size("_hits").cast("long").alias("n_licence"),
        F.array_join("_families", ",").alias("families"),
        F.coalesce("_best.f", F.lit(UNKNOWN)).alias("family"),
        F.coalesce("_best.p", F.lit(0.0)).alias("score"),
    )
