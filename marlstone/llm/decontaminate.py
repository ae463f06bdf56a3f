"""Benchmark decontamination: one Aho-Corasick automaton over windows of the normalised test items scans each text once.

Normalising works on UTF-8 bytes: A-Z become a-z, and ASCII bytes that are neither letters nor digits separate words. It
keeps every byte's place, so hits map back to byte offsets of the original text.

Windows reach the tasks as a broadcast of bounded size; a larger benchmark is split by window hash into blocks of that size,
every block scans all documents, and what the blocks find in a document is united.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, map_text

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Bytes of windows and item ids that one broadcast block may hold; the automaton of a block takes about 22 times as much in
#: every Python worker.
BLOCK_BYTES = 6_000_000


def clean(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def windows_of(text: str | None, length: int) -> list[bytes]:
    words = clean(text).split()
    return [b" ".join(words[i : i + length]) for i in range(max(1, len(words) - length + 1))] if words else []


@functools.lru_cache(maxsize=2)
def _automaton(block):
    """Of a broadcast block, built once per Python worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (window, _) in enumerate(block.value):
        found.add_word(f" {window.decode('latin-1')} ", (k, window.count(b" ") + 1))
    if len(found):
        found.make_automaton()
    return found


def _windows(benchmark: DataFrame, length: int) -> DataFrame:
    """window, item_ids: the distinct items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    split = map_text(
        items, ["item_id"], "text", lambda texts: [[list(dict.fromkeys(windows_of(t, length))) for t in texts]], "windows array<binary>"
    )
    return (
        split.select("item_id", F.explode("windows").alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )


def _scan(rows: DataFrame, carry: list[str], block) -> DataFrame:
    """rows with n_words, runs (first and last word of each run of hit words), items, spans (byte offsets of the runs)."""

    def one(text):
        auto, original = _automaton(block), clean(text)
        words = original.split()
        if not words or not len(auto):
            return len(words), [], [], []
        hits = list(auto.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not hits:
            return len(words), [], [], []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        lasts = np.searchsorted(ends, np.array([end for end, _ in hits]))
        firsts = lasts - np.array([n for _, (_, n) in hits]) + 1
        mark = np.zeros(len(words) + 1, np.int32)
        np.add.at(mark, firsts, 1)
        np.add.at(mark, lasts + 1, -1)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(mark)[:-1] > 0, [0])).astype(np.int8)))
        runs = [[int(a), int(b) - 1] for a, b in edges.reshape(-1, 2)]
        is_word = np.frombuffer(original, np.uint8) != 32
        places = np.flatnonzero(np.diff(np.concatenate(([0], is_word, [0])).astype(np.int8)))
        items = {x for _, (k, _) in hits for x in block.value[k][1]}
        return len(words), runs, sorted(items), [[int(places[2 * a]), int(places[2 * b + 1])] for a, b in runs]

    return map_text(
        rows,
        carry,
        "text",
        lambda texts: list(zip(*map(one, texts), strict=True)),
        "n_words long, runs array<array<long>>, items array<string>, spans array<array<long>>",
    )


def _covered(runs: Column) -> Column:
    """Words under the union of the sorted runs."""
    return F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("last")),
        lambda a, r: F.struct(
            (a.n + F.greatest(F.lit(0), r[1] - F.greatest(a["last"], r[0] - 1))).alias("n"),
            F.greatest(a["last"], r[1]).alias("last"),
        ),
    ).n


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = 10,
    block_bytes: int = BLOCK_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_words, n_hit, items, spans (byte offsets of the runs of hit words).

    A null or empty text, or one of separators only, has no words and no hits. Items without words have no window; items
    with a null id hit, but are not listed. Repeated documents count each for itself; repeated items are listed once.
    Further columns are ignored, but for those of docs named in keep. An empty benchmark hits nothing.
    """
    context = docs.sparkSession.sparkContext
    windows = cut(_windows(benchmark, length))
    held = F.length("window") + F.aggregate("item_ids", F.lit(64), lambda n, x: n + F.length(x))
    total = windows.agg(F.sum(held)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def block(k: int):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        return context.broadcast([(bytes(r.window), r.item_ids) for r in part.toLocalIterator()])

    carry = list(dict.fromkeys(("doc_id", *keep)))
    found = ["n_words", _covered(F.col("runs")).alias("n_hit"), "items", "spans"]
    if blocks == 1:
        return _scan(docs, carry, block(0)).select(*carry, *found)
    rows = cut(docs.select(*dict.fromkeys((*carry, "text")), F.monotonically_increasing_id().alias("_row")))
    every = functools.reduce(
        DataFrame.unionByName, [_scan(rows.select("_row", "text"), ["_row"], block(k)) for k in range(blocks)]
    )
    united = every.groupBy("_row").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    return rows.join(united, "_row").select(*carry, *found)


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
