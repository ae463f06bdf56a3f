"""Divergence of sources within a language: exact integer scores of every pair of sources, and of their terms.

Each group, a (lang, source), gives every kept term of its language a share p in parts of a thousand million, and
f = (p - q)**2 / q, rounded down, says how far it is from another group's share q. The sum over all kept terms for all pairs of
groups is split by how many groups hold a term:

* Heavy terms, held by many groups, are dense: tiles of terms x groups in numpy, all pairs at once.
* Light terms are sparse. Where neither group of a pair holds a term, f is the same for all of them, so it is taken once, times
  the number of light terms. A group's terms of one count, taken together, correct that against every other group as if that
  held none of them; and the postings of each term, in pairs, correct what two of its holders took wrongly.

The parts are integers and are added exactly. Counting is one pass over the texts that emits sums for each batch of rows, and
one shuffle by term. A term's postings are a row, as long as there are groups in its language.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.llm.common import cut

SCALE = 1_000_000_000
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Distinct (term, group) pairs that a task holds before it emits their sums, and bytes of one text that are counted at once.
HELD, PIECE = 400_000, 4_000_000
#: Share of a language's groups that must hold a term for it to be dense; most terms, and cells (terms x groups), of a tile.
HEAVY, TERMS, CELLS = 0.3, 512, 1 << 20


def terms_of(text: str | None) -> Counter:
    """Counts of the terms of a text, as UTF-8: runs of ASCII letters, A-Z lowered, and of whatever is not ASCII."""
    line, found = (text or "").encode("utf-8", "surrogatepass").translate(_TERMS), Counter()
    at = 0
    while at < len(line):
        end = len(line) if len(line) - at <= PIECE else line.rfind(b" ", at, at + PIECE)
        end = end if end > at else (line.find(b" ", at + PIECE) % (len(line) + 1))
        found.update(line[at:end].split())
        at = end
    return found


def _count(places: dict):
    """Rows (term, l, g, c, d): occurrences in, and documents of, a group, summed over batches."""

    def run(batches):
        import pyarrow as pa

        def emit():
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([t.decode("utf-8", "surrogatepass") for t, _ in keys], pa.string()),
                    pa.array([places[k][0] for _, k in keys], pa.int32()),
                    pa.array([places[k][1] for _, k in keys], pa.int32()),
                    *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(2)),
                ],
                names=["term", "l", "g", "c", "d"],
            )

        held: dict = {}
        for batch in batches:
            for text, lang, source in zip(*(batch.column(k) for k in range(3)), strict=True):
                group = lang.as_py(), source.as_py()
                for term, n in terms_of(text.as_py()).items():
                    if (own := held.get((term, group))) is None:
                        held[term, group] = [n, 1]
                    else:
                        own[0] += n
                        own[1] += 1
                if len(held) > HELD:
                    yield emit()
                    held = {}
        if held:
            yield emit()

    return run


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + count * SCALE / total, rounded down, for 0 < count <= total, in int64 however large they are: base 1,000 by hand."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def scores(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Groups:
    """What a task needs to know of all groups: language, number within it, and the denominator of its shares."""

    def __init__(self, lang: list[int], denominator: list[int]):
        self.lang, self.denominator = np.array(lang, np.int64), np.array(denominator, np.int64)
        self.of = {int(k): np.flatnonzero(self.lang == k) for k in np.unique(self.lang)}
        self.none = shares(np.ones(len(lang), np.int64), self.denominator) if lang else np.zeros(0, np.int64)


def _sent(g: np.ndarray, h: np.ndarray, value: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x) for x in (g.astype(np.int32), h.astype(np.int32), value)], names=["g", "h", "value"])


_SUMS = "g int, h int, value long"


def _dense(held, cells: int):
    """terms(l, tile, gs, cs) to sums of scores of all pairs of groups; the rows of a tile follow each other."""

    def run(batches):
        groups = held.value

        def solve(lang, rows):
            own = groups.of[lang]
            for k in range(0, len(rows), step := max(1, cells // len(own))):
                part = rows[k : k + step]
                count = np.zeros((len(own), len(part)), np.int64)
                for i, (gs, cs) in enumerate(part):
                    count[np.searchsorted(own, gs), i] = cs
                p = shares(count + 1, groups.denominator[own][:, None])
                for i, g in enumerate(own):
                    value = scores(p[i], p).sum(1)
                    other = own != g
                    yield _sent(np.full(len(own) - 1, g), own[other], value[other])

        lang, rows = None, []
        for batch in batches:
            for l, tile, gs, cs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):  # noqa: E741
                if (l, tile) != lang and rows:
                    yield from solve(lang[0], rows)
                    rows = []
                lang = l, tile
                rows.append((gs, cs))
        if rows:
            yield from solve(lang[0], rows)

    return run


def _postings(held, most: int = 1 << 20):
    """terms(gs, cs) to the corrections of pairs of groups that hold a term both, summed over what a task reads.

    Terms with as many holders are taken together, about most pairs at once.
    """

    def run(batches):
        groups = held.value
        parts: list = []

        def pairs(g, c):
            p, none, m = shares(c + 1, groups.denominator[g]), groups.none[g], g.shape[1]
            for a in range(0, m, step := max(1, most // (len(g) * m))):
                one, two = (slice(None), slice(a, a + step), None), (slice(None), None)
                value = scores(p[one], p[two]) - scores(p[one], none[two]) - scores(none[one], p[two]) + scores(none[one], none[two])
                key = g[one] << 32 | g[two]
                other = np.broadcast_to(g[one] != g[two], key.shape)
                parts.append((key[other], value[other]))

        def united():
            key, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, np.concatenate([x[1] for x in parts]))
            return key, total

        sent = lambda key, total: _sent(key >> 32, key & 0xFFFFFFFF, total)
        for batch in batches:
            sizes = pa_lengths(batch.column(0))
            firsts = np.concatenate(([0], np.cumsum(sizes)))
            gs, cs = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in range(2))
            for m in np.unique(sizes[sizes > 1]).tolist():
                rows = firsts[:-1][sizes == m]
                for k in range(0, len(rows), step := max(1, most // (m * m))):
                    at = rows[k : k + step, None] + np.arange(m)[None, :]
                    pairs(gs[at], cs[at])
                    if sum(len(x[0]) for x in parts) > most:
                        parts = [united()]
                        if len(parts[0][0]) > most // 2:
                            yield sent(*parts[0])
                            parts = []
        if parts:
            yield sent(*united())

    return run


def pa_lengths(lists) -> np.ndarray:
    """Lengths of the rows of an Arrow column of lists."""
    return np.diff(lists.offsets.to_numpy())


def _alone(held):
    """hist(g, c, n), n light terms with count c in g, or with c = 0 all light terms of its language, to sums for all pairs of g.

    The rows of a group follow each other, and those with c = 0 make sure that each pair has a sum.
    """

    def run(batches):
        groups = held.value
        g, ahead, back = None, None, None

        def made():
            own = groups.of[int(groups.lang[g])]
            other = own != g
            n = int(other.sum())
            yield _sent(np.full(n, g), own[other], ahead[other])
            yield _sent(own[other], np.full(n, g), back[other])

        for batch in batches:
            for at, c, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at != g:
                    if g is not None:
                        yield from made()
                    g, none = at, groups.none[groups.of[int(groups.lang[at])]]
                    ahead, back = np.zeros(len(none), np.int64), np.zeros(len(none), np.int64)
                mine = groups.none[g]
                if c == 0:
                    ahead += scores(mine, none) * n
                else:
                    p = shares(np.array([c + 1]), groups.denominator[[g]])[0]
                    ahead += (scores(p, none) - scores(mine, none)) * n
                    back += (scores(none, p) - scores(none, mine)) * n
        if g is not None:
            yield from made()

    return run


def audit(docs: DataFrame, least_docs: int = 3, top_terms: int = 200, heavy: float = HEAVY, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank of docs(text, lang, source): part pair scores each other source of the language,
    part term the top_terms terms that a source overuses most against its language.

    Kept are terms in at least least_docs documents of a language. Null text, lang and source are empty strings; a repeated row
    is a document of its own; groups without terms have their pairs too, of value 0 in languages without kept terms. Ties rank
    by item, as UTF-8. Further columns are ignored; an empty table gives no rows. The driver and each task hold the names of
    all groups; the result has a row for each pair of them.
    """
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    names = sorted((r.lang, r.source) for r in rows.select("lang", "source").distinct().collect())
    langs = {lang: k for k, lang in enumerate(dict.fromkeys(lang for lang, _ in names))}
    places = {(lang, source): (langs[lang], k) for k, (lang, source) in enumerate(names)}
    number = Counter(langs[lang] for lang, _ in names)

    counted = rows.mapInArrow(_count(places), "term string, l int, g int, c long, d long").repartition("l", "term")
    by_group = counted.groupBy("l", "term", "g").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    by_term = by_group.groupBy("l", "term").agg(
        F.sum("d").alias("d"), F.sum("c").alias("total"), F.array_sort(F.collect_list(F.struct("g", "c"))).alias("own")
    )
    least_heavy = F.element_at(F.array(*(F.lit(max(3, int(np.ceil(heavy * number[k])))) for k in range(len(langs))), F.lit(0)), F.col("l") + 1)
    kept = cut(
        by_term.filter(F.col("d") >= least_docs)
        .select("l", "term", "total", F.col("own.g").alias("gs"), F.col("own.c").alias("cs"))
        .withColumn("dense", F.size("gs") >= least_heavy)
    )
    sizes = {r.g: r.n for r in kept.select(F.explode(F.arrays_zip("gs", "cs")).alias("x")).groupBy("x.gs").agg(F.sum("x.cs").alias("n")).toDF("g", "n").collect()}
    terms = {r.l: (r.all, r.dense) for r in kept.groupBy("l").agg(F.count("*").alias("all"), F.count_if("dense").alias("dense")).collect()}
    in_lang = Counter()
    for k, (lang, _) in enumerate(names):
        in_lang[langs[lang]] += sizes.get(k, 0)

    # a denominator of a language without kept terms is never used
    described = [
        (k, langs[lang], sizes.get(k, 0) + terms.get(langs[lang], (0, 0))[0] or 1, in_lang[langs[lang]] + terms.get(langs[lang], (0, 0))[0] or 1)
        for k, (lang, _) in enumerate(names)
    ]
    held = spark.sparkContext.broadcast(Groups([x[1] for x in described], [x[2] for x in described]))
    titles = spark.createDataFrame([(k, *name) for k, name in enumerate(names)], "g int, lang string, source string")
    of_group = spark.createDataFrame(described, "g int, l int, own long, whole long")

    # pairs
    in_tile = {k: max(1, min(TERMS, cells // number[k])) for k in number}
    tiles = F.element_at(F.array(*(F.lit(-(-terms.get(k, (0, 0))[1] // in_tile[k]) or 1) for k in range(len(langs))), F.lit(1)), F.col("l") + 1)
    dense = kept.filter("dense").select("l", F.pmod(F.xxhash64("term"), tiles).cast("int").alias("tile"), "gs", "cs")
    dense = dense.repartition("l", "tile").sortWithinPartitions("l", "tile").mapInArrow(_dense(held, cells), _SUMS)
    sparse = kept.filter("NOT dense")
    both = sparse.select("gs", "cs").mapInArrow(_postings(held), _SUMS)
    hist = sparse.select(F.explode(F.arrays_zip("gs", "cs")).alias("x")).select(F.col("x.gs").alias("g"), F.col("x.cs").alias("c"))
    base = spark.createDataFrame(
        [(k, 0, int(np.subtract(*terms.get(langs[lang], (0, 0))))) for k, (lang, _) in enumerate(names)], "g int, c long, n long"
    )
    alone = hist.groupBy("g", "c").agg(F.count("*").alias("n")).union(base).repartition("g").sortWithinPartitions("g").mapInArrow(_alone(held), _SUMS)
    summed = dense.union(both).union(alone).groupBy("g", "h").agg(F.sum("value").alias("value"))
    item = titles.select(F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = summed.join(F.broadcast(item), "h").select("g", F.lit("pair").alias("part"), "item", "value")

    # terms
    one = kept.select("term", "total", F.explode(F.arrays_zip("gs", "cs")).alias("x")).select("term", "total", F.col("x.gs").alias("g"), F.col("x.cs").alias("c"))
    share = lambda n, total: F.expr(f"1 + (cast({n} + 1 as decimal(19, 0)) * {SCALE}) div cast({total} as decimal(19, 0))")
    placed = one.join(F.broadcast(of_group), "g").select("g", "term", share("c", "own").alias("p"), share("total", "whole").alias("q"))
    over = placed.filter("p > q").select("g", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("g").orderBy(F.desc("value"), "item")
        return found.withColumn("rank", F.row_number().over(order))

    every = ranked(pairs).union(ranked(over).filter(F.col("rank") <= top_terms))
    return every.join(F.broadcast(titles), "g").select("lang", "source", "part", "item", "value", "rank")
