"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, secret scans and mixing, one after another.

run() writes each stage's result as Parquet below the session's checkpoint folder and reads it again as the next one's input.
In every stage an empty table gives no rows, extra columns stay whatever their names (the mix keeps its own columns only), and
rows without a doc_id or source are rows like others. Where a stage treats nulls, ties or repeated rows in a way of its own, it
says so.

A stage is evaluated after it returns, so those that run Python leave the session's Arrow batches small, unless the session has set
their bytes itself; run() takes that back.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, langid, mixing, secrets, simhash
from marlstone.llm.common import BATCH, checkpoint_dir, packed, small_batches, table
from marlstone.sources.ship import shipped

#: Least proportion of a kept document's main language; one that mixes two languages evenly, or has a foreign licence line, stays.
LEAST_SHARE = 0.34


#: Least fit of a kept document, as a part of what is typical of the documents that the languages were learned from.
LEAST_FIT = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the learned languages: those without a letter (null and empty texts too), without a main language, or that fit
    none of them, go. Repeated rows are judged each, and alike."""
    rows = packed(docs, "lang")
    languages, model = langid.learn(rows)
    found = langid.predict(rows, languages, model, keep=("_doc",))
    least = LEAST_FIT * langid.typical_fit(model)
    kept = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE) & (F.col("fit") >= least)
    return found.filter(kept).select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), that of the least doc_id; of repeated
    rows one stays, and so does one of all texts without a word."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside an occurrence of a benchmark window; null and empty texts have none, and stay."""
    found = decontaminate.contamination(packed(docs), table(spark, sf_dir, "benchmark"), keep=("_doc",))
    return found.filter("n_hit = 0").select("_doc.*")


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets cut out of their texts and n_chars following, where it was not null."""
    columns = docs.columns
    return (
        secrets.redact(docs)
        .withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
        .select(*columns)
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (words, repeats counted); null and empty texts
    have no words, and go. Equal keys go by doc_id, then size."""
    return mixing.mix(docs, keep=("source", "lang")).filter("taken > 0")


def batched(stage):
    """stage, the batches that its tasks hand to Python being small."""

    @functools.wraps(stage)
    def run(spark, *arguments):
        small_batches(spark)
        return stage(spark, *arguments)

    return run


STAGES = [
    ("language_id", shipped(batched(language))),
    ("simhash_neardup", shipped(batched(near_duplicates))),
    ("decontamination", shipped(batched(benchmark))),
    ("secret_scan", shipped(batched(secret))),
    ("mixing", shipped(mix)),
]

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    changed = small_batches(spark)
    try:
        for k, (name, stage) in enumerate(STAGES):
            out = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(out)
            docs = spark.read.parquet(out)
    finally:
        if changed:
            spark.conf.unset(BATCH)
    return docs
