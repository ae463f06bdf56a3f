"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at up to r differing bits share a variant at up to r/2 bits from each. A fingerprint's variants are shuffled
by their leading bits (the cell): the fingerprint is sent once to each cell that holds variants of it, and the cell's task
makes the variants of that cell, so a few dozen rows travel in place of thousands. Fingerprints that share a variant are
within r of each other, so in place of all their pairs a chain through them is kept, verified, and thinned to a forest.

Equal texts, and equal fingerprints, are one row before anything is shuffled by variant. Cells that hold more than
cell_rows fingerprints are dealt anew by the leading bits after the cell's.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, fits, map_text, release, spread_join
from marlstone.llm.components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Variants that a task makes and sorts at once, about.
CHUNK = 4_000_000


def fingerprint(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """64 bits: each is 1 if set in over half of the shingles' XXH64; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - words_per_shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words_per_shingle, len(words)) - 1 :][:n] - 1).tolist()
    one = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, n, 50_000):
        part = zip(starts[k : k + 50_000], stops[k : k + 50_000], strict=True)
        h = np.array([one(line[a:b], seed) for a, b in part], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) with fp, the fingerprint as a signed long."""

    def run(texts):
        made = np.array([fingerprint(t, words_per_shingle, seed) for t in texts], np.uint64)
        return [made.view(np.int64)]

    return map_text(docs, list(dict.fromkeys(("doc_id", *keep))), "text", run, "fp long")


def _masks(bits: int, radius: int) -> list[int]:
    return [
        sum(1 << b for b in chosen) for n in range(min(radius, bits) + 1) for chosen in itertools.combinations(range(bits), n)
    ]


def _chain(fps: np.ndarray, left: np.ndarray, bits: int, radius: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of fps that share a variant of their lowest bits, left[i] flips being allowed to fps[i].

    Beyond most variants the leading eight of the bits are enumerated and each value is done by itself, so memory is bounded.
    """
    made = np.array([sum(math.comb(bits, n) for n in range(k + 1)) for k in range(radius + 1)], np.int64)
    if made[left].sum() > most and bits > 8:
        top, out = (fps >> np.uint64(bits - 8)) & np.uint64(255), []
        for value in range(256):
            rest = left - _POPCOUNT[(top ^ np.uint64(value)).astype(np.int64)]
            own = np.flatnonzero(rest >= 0)
            if len(own) > 1:
                out += [(own[a], own[b]) for a, b in _chain(fps[own], rest[own], bits - 8, radius, most)]
        return out
    low = fps & np.uint64((1 << bits) - 1)
    ends = np.cumsum(made * np.bincount(left, minlength=radius + 1)[: radius + 1])
    # filled and sorted in place, as copies of all variants are most of a task's memory
    v, o = np.empty(int(ends[-1]), np.uint64), np.empty(int(ends[-1]), np.int64)
    for allowed in range(radius + 1):
        own, masks = np.flatnonzero(left == allowed), np.array(_masks(bits, allowed), np.uint64)
        part = slice(int(ends[allowed]) - len(own) * len(masks), int(ends[allowed]))
        np.bitwise_xor(low[own][:, None], masks[None, :], out=v[part].reshape(len(own), len(masks)))
        o[part].reshape(len(own), len(masks))[:] = own[:, None]
    width = max(1, int(len(fps) - 1).bit_length())
    if bits + width <= 64:
        v <<= np.uint64(width)
        v |= o.view(np.uint64)
        v.sort()
        np.bitwise_and(v, np.uint64((1 << width) - 1), out=o.view(np.uint64))
        v >>= np.uint64(width)
    else:
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    pairs = np.unique(np.stack((o[same], o[same + 1]), 1), axis=0) if len(same) else np.zeros((0, 2), np.int64)
    return [(pairs[:, 0], pairs[:, 1])]


_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.int64)


def _forest(fps: np.ndarray, left: np.ndarray, bits: int, radius: int, most: int) -> list[tuple[int, int]]:
    """Verified links between fps, of which none closes a ring."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for firsts, seconds in _chain(fps, left, bits, radius // 2, most):
        for i, j in zip(firsts.tolist(), seconds.tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _to_cells(rows: DataFrame, done: int, bits: int, radius: int) -> DataFrame:
    """rows(cell, left, fp) sent on to the cells of the next bits after the first done."""
    top = F.shiftrightunsigned("fp", 64 - done - bits).bitwiseAND(F.lit((1 << bits) - 1))
    out = None
    for n in range(radius // 2 + 1):
        masks = [m for m in _masks(bits, n) if m.bit_count() == n]
        part = rows.filter(F.col("left") >= n).select(
            F.col("cell"), (F.col("left") - n).alias("left"), "fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")
        )
        out = part if out is None else out.union(part)
    return out.select(
        F.shiftleft(F.col("cell"), bits).bitwiseOR(top.bitwiseXOR(F.col("mask").cast("long"))).alias("cell"), "left", "fp"
    )


def _link_cells(cells: DataFrame, done: int, radius: int) -> DataFrame:
    """a, b: links found in cells(cell, left, fp); cells are sorted, and one at a time is held."""
    bits = 64 - done

    def run(batches):
        import pyarrow as pa

        def solve(parts):
            fps = np.concatenate([p[1] for p in parts]).view(np.uint64)
            left = np.concatenate([p[2] for p in parts])
            return [(int(fps[i]), int(fps[j])) for i, j in _forest(fps, left, bits, radius, CHUNK)] if len(fps) > 1 else []

        def emit(found):
            a = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        held, cell, found = [], None, []
        for batch in batches:
            c, f, k = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(3))
            edges = np.flatnonzero(np.diff(c)) + 1
            for at, to in zip([0, *edges], [*edges, len(c)], strict=True):
                if at == to:
                    continue
                if c[at] != cell and held:
                    found += solve(held)
                    held = []
                cell = c[at]
                held.append((cell, f[at:to], k[at:to].astype(np.int64)))
            if len(found) > 10_000:
                yield emit(found)
                found = []
        if held:
            found += solve(held)
        yield emit(found)

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.select("cell", "fp", "left").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = 4, cell_bits: int = 12, cell_rows: int = 50_000) -> DataFrame:
    """a, b: links that connect any two of distinct(fp) with at most radius differing bits, directly or by others."""
    rows = distinct.select(F.lit(0).cast("long").alias("cell"), F.lit(radius // 2).alias("left"), "fp")
    cells = _to_cells(rows, 0, cell_bits, radius)
    hot = [r.cell for r in cells.groupBy("cell").count().filter(F.col("count") > cell_rows).select("cell").collect()]
    is_hot = F.col("cell").isin(hot) if hot else F.lit(False)
    found = _link_cells(cells.filter(~is_hot), cell_bits, radius)
    if hot:
        again = _to_cells(cells.filter(is_hot), cell_bits, cell_bits, radius)
        found = found.union(_link_cells(again, 2 * cell_bits, radius))
    return found


def classes(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs(doc_id, text) with fp (signed long) and component_id, the least doc_id reachable over links.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with a null doc_id are linked too;
    a component with null ids only has a null component_id. Repeated rows are returned each. Further columns are ignored
    unless named in keep; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, words_per_shingle, seed, keep))
    firsts = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = cut(firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # a component and a fingerprint may hold any share of the documents
    by_fp = spread_join(rooted, least, "root", "fp").select("fp", "component_id")
    return spread_join(rows, by_fp, "fp", "doc_id").select(*rows.columns, "component_id")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near-duplicates by similarity

#: Bits of one of a text's short fingerprints; about so many of them share a cell, which leading bits choose.
BAND_BITS, BAND_CELL_ROWS = 32, 50_000
#: Shingles below which a text's bits are compared more loosely.
SMALL = 40
#: Nodes on each side of a block, in which all are compared with each other, and their shingles, about; larger crowds are dealt into
#: pairs of parts, so that every two nodes meet in one block.
BLOCK, BLOCK_SHINGLES = 1_000, 400_000
#: Nodes that hang together in a block, beyond which all such ones of a crowd's blocks are one crowd.
LARGE = 64
#: Rows of such a comparison that are in memory at once.
ROWS = 128
_TABLE = (np.arange(256)[:, None] >> np.arange(7, -1, -1)[None, :] & 1).astype(np.float32)


def shingles_of(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles, letters A-Z lowered; the only one of a shorter text is all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - words_per_shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words_per_shingle, len(words)) - 1 :][:n] - 1).tolist()
    one = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((one(line[a:b]) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def bands_of(shingles: np.ndarray, bands: int) -> np.ndarray:
    """So many re-seeded SimHash fingerprints of BAND_BITS each of a set of shingles; a set counts a shingle once."""
    words = (bands * BAND_BITS + 63) // 64
    seeds = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    counts = np.zeros(words * 8 * 256, np.int64)
    places = (np.arange(words * 8) * 256)[None, :]
    for k in range(0, len(shingles), 4_000):
        h = shingles[k : k + 4_000, None] ^ seeds
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        counts += np.bincount((h.view(np.uint8) + places).ravel(), minlength=len(counts))
    sums = counts.reshape(-1, 256).astype(np.float32) @ _TABLE
    return np.packbits(2 * sums.ravel() > len(shingles)).view(">u4")[:bands].astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


_ENTRY = np.dtype([("node", "<i8"), ("label", "<i8"), ("fp", "<u4"), ("left", "u1")])


def _cell_bits(rows: int) -> int:
    """So many leading bits that a cell of evenly spread fingerprints holds BAND_CELL_ROWS at most; what meets stays the same."""
    bits = 4
    while bits < 16 and rows * (1 + bits) >> bits > BAND_CELL_ROWS:
        bits += 1
    return bits


def _to_band_cells(nodes: DataFrame, chosen: range, bands: int, radius: int, cell_bits: int) -> DataFrame:
    """cell, held: of nodes(node, label, bands), the entries of a batch that go to a cell of one of the chosen bands, packed: node,
    label, the rest of the fingerprint, and the flips that are left.

    Of leading bits only set ones are flipped, so two fingerprints that differ in one of them meet in one cell, not in two; the
    few that differ in two leading bits, both set in the same one, meet by other bands.
    """
    low = BAND_BITS - cell_bits
    masks = [(m, m.bit_count()) for m in _masks(cell_bits, radius // 2)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.zeros(batch.num_rows, _ENTRY)
            rows["node"], rows["label"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(len(rows), bands)
            cells, blobs = [], []
            for band in chosen:
                rows["fp"] = fps[:, band] & np.uint32((1 << low) - 1)
                top = (fps[:, band] >> np.uint32(low)).astype(np.int64)
                goes = [np.flatnonzero(top & m == m) for m, _ in masks]
                to = np.concatenate([top[own] ^ m for own, (m, _) in zip(goes, masks, strict=True)])
                sent = rows[np.concatenate(goes)]
                sent["left"] = np.repeat([radius // 2 - flips for _, flips in masks], list(map(len, goes)))
                order = np.argsort(to, kind="stable")
                firsts = np.flatnonzero(np.diff(to[order], prepend=-1))
                for a, b in zip(firsts, [*firsts[1:], len(order)], strict=True):
                    cells.append(band << cell_bits | int(to[order[a]]))
                    blobs.append(sent[order[a:b]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(blobs, pa.binary())], names=["cell", "held"])

    return nodes.select("node", "label", "bands").mapInArrow(run, "cell int, held binary")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n places, the least place of the component that the links a, b put it in."""
    parent = np.arange(n)
    while True:
        least = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, before[a], least)
        np.minimum.at(parent, before[b], least)
        np.minimum.at(parent, a, least)
        np.minimum.at(parent, b, least)
        parent = parent[parent]
        if np.array_equal(parent, before):
            return parent


def _keys(node: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each node, a key of its group by the two nodes of it that come first by a hash.

    Groups that are much alike have mostly the same key, as under min-hashing; rows of the same key are then one crowd, of the nodes
    of all of these groups, so that a pair that meets in many cells is compared once or a few times.
    """
    h = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    order = np.lexsort((h, group))
    firsts = np.flatnonzero(np.diff(group[order], prepend=-1))
    seconds = np.minimum(firsts + 1, np.append(firsts[1:], len(order)) - 1)
    least, next_ = h[order[firsts]], h[order[seconds]]
    made = (least ^ (next_ >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + next_
    out = np.zeros(len(node), np.uint64)
    out[order] = np.repeat(made, np.diff(np.append(firsts, len(order))))
    return out.view(np.int64)


def _crowds(cells: DataFrame, radius: int, cell_bits: int) -> DataFrame:
    """crowd, node: the nodes of a cell that hang together by variants that they share, where they have more than one label. Groups of
    several cells that are much alike are one crowd, which holds the nodes of all of them once."""
    low = BAND_BITS - cell_bits

    def run(batches):
        import pyarrow as pa

        def solve(held):
            rows = np.frombuffer(b"".join(held), _ENTRY)
            rows = rows[np.argsort(rows["label"], kind="stable")]
            fps, left = rows["fp"].astype(np.uint64), rows["left"].astype(np.int64)
            parts = _chain(fps, left, low, radius // 2, CHUNK)
            a, b = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ((), ())))
            root = _roots(len(rows), a, b)
            # a component counts if any link in it goes to another label
            mixed = np.zeros(len(rows), bool)
            mixed[root[a[rows["label"][a] != rows["label"][b]]]] = True
            own = np.flatnonzero(mixed[root])
            node = rows["node"][own].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(_keys(node, root[own])), pa.array(node)], names=["crowd", "node"])

        cell, held = None, []
        for batch in batches:
            for c, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != cell and held:
                    yield solve(held)
                    held = []
                cell = c
                held.append(h)
        if held:
            yield solve(held)

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.select("cell", "held").mapInArrow(run, "crowd long, node long").distinct()


def _most_bits(similarity: float, size: np.ndarray, bits: int) -> np.ndarray:
    """Differing bits, of so many, up to which two sets may be so similar; size: of the smaller set.

    Each bit is drawn by a hash function of its own, and differs with the chance arccos(2 s / (1 + s)) / pi at similarity s. Four
    standard deviations more are allowed, and 10% more for sets of under SMALL shingles, whose bits differ more often.
    """
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    slack = 4 * math.sqrt(chance * (1 - chance) / bits)
    return np.where(size < SMALL, chance + max(slack, 0.1), chance + slack) * bits


def _neighbours(label: np.ndarray, words: np.ndarray, size: np.ndarray, similarity: float, first: int = 0):
    """Positions i < j of all pairs of nodes of different labels whose sizes and bits let them be similar enough, in parts.

    With a number of nodes first, only pairs of one of these with one of the others.
    """
    bits = 64 * words.shape[1]
    for r in range(0, first or len(label), ROWS):
        rows = slice(r, min(r + ROWS, first or len(label)))
        for k in range(first or r, len(label), BLOCK):
            cols = slice(k, k + BLOCK)
            apart = np.zeros((len(label[rows]), len(label[cols])), np.uint16)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(words[rows, None, w] ^ words[None, cols, w])
            i, j = np.nonzero((label[rows, None] != label[None, cols]) & (apart <= _most_bits(similarity, np.zeros(1), bits)))
            apart, i, j = apart[i, j], i + r, j + k
            least, most = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            kept = (i < j) & (least >= similarity * most - 1e-6) & (apart <= _most_bits(similarity, least, bits))
            yield i[kept], j[kept]


def _blocks(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """rows(crowd, node, ...) with part, a pair of a crowd's parts, and two, whether the row is on the second's side.

    parts(crowd, _n) are the crowds that are dealt into several parts. A row of these is repeated for each part that its own meets,
    so any two rows meet once: on different sides, or in the pair of a part with itself.
    """
    if parts is None:
        return rows.withColumn("part", F.lit(0).cast("long")).withColumn("two", F.lit(False))
    own, n = F.pmod(F.xxhash64("crowd", "node"), F.col("_n")), F.coalesce("_n", F.lit(1))
    known = rows.join(parts, "crowd", "left").withColumn("_n", n).withColumn("_own", own)
    each = known.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    part = F.least("_own", "_other") * F.lit(1 << 31) + F.greatest("_own", "_other")
    return each.withColumn("part", part).withColumn("two", F.col("_own") > F.col("_other")).drop("_n", "_own", "_other")


def _beyond(rows: DataFrame, size: str | None = None) -> DataFrame | None:
    """crowd, _n: of the crowds of rows, a checkpoint, that are more than a block, the number of parts; None if there are none."""
    parts = F.ceil(F.count("*") / BLOCK)
    if size is not None:
        parts = F.greatest(parts, F.ceil(F.sum(size) / BLOCK_SHINGLES))
    found = cut(rows.groupBy("crowd").agg(parts.cast("long").alias("_n")).filter("_n > 1"))
    return None if found.isEmpty() else found


def _runs(batches):
    """Rows of sorted batches as a table for each value of the first two columns."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        crowd, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((np.diff(crowd) != 0) | (np.diff(part) != 0)) + 1
        for at, to in zip([0, *edges], [*edges, len(crowd)], strict=True):
            if held and last != (crowd[at], part[at]):
                yield pa.Table.from_batches(held)
                held = []
            last = (crowd[at], part[at])
            held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)


def _sides(table):
    """A block's rows, those of the first side first: node, label, size, the last column's values, and the number on the first side,
    0 in the pair of a part with itself. No rows if one of two sides is empty."""
    node, part, two, label, size = (table.column(c).to_numpy() for c in ("node", "part", "two", "label", "size"))
    order, first = np.lexsort((node, two)), int((~two).sum())
    if part[0] >> 31 == part[0] & (1 << 31) - 1:
        first = 0
    elif first in (0, len(node)):
        order, first = order[:0], 0
    held = table.column(table.num_columns - 1).to_pylist()
    return node[order], label[order], size[order].astype(np.int64), [held[k] for k in order], first


def _candidates(crowds: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """crowd, node, label, size: of the nodes of each of the crowds, a checkpoint, those that hang together by pairs of different
    labels that may be similar enough by sizes and all bits. All pairs are compared; much the same nodes found in several crowds or
    blocks are one."""

    def run(batches):
        import pyarrow as pa

        for table in _runs(batches):
            node, label, size, held, first = _sides(table)
            if not held:
                continue
            words = np.frombuffer(b"".join(held), "<u8").reshape(len(node), -1)
            root, met = np.arange(len(node)), np.zeros(len(node), bool)
            for i, j in _neighbours(label, words, size, similarity, first):
                met[i] = met[j] = True
                # what is joined already stays so, by links to its root
                root = _roots(len(node), np.concatenate((np.arange(len(node)), i)), np.concatenate((root, j))) if len(i) else root
            own = np.flatnonzero(met)
            if not len(own):
                continue
            keys = _keys(node[own], root[own])
            if table.column("part")[0].as_py():
                # of several blocks: what is large in many of them is one, so that rows grow with the crowd, not with its blocks
                keys[np.bincount(root[own])[root[own]] > LARGE] = table.column("crowd")[0].as_py()
            made = (keys, node[own], label[own], size[own])
            yield pa.RecordBatch.from_arrays(list(map(pa.array, made)), names=["crowd", "node", "label", "size"])

    known = crowds.join(nodes.select("node", "label", "size", "bands"), "node")
    blocks = _blocks(known, _beyond(crowds)).select("crowd", "part", "node", "two", "label", "size", "bands")
    dealt = blocks.repartition("crowd", "part").sortWithinPartitions("crowd", "part")
    return dealt.mapInArrow(run, "crowd long, node long, label long, size long").distinct()


def _shared(sets: list[np.ndarray], first: int) -> np.ndarray:
    """For each of the first sets and each of the others, the number of values in both; each is sorted and distinct.

    Values in a large share of the sets are counted by a product of matrices, others by their pairs.
    """
    n, m = first, len(sets) - first
    row = np.repeat(np.arange(n + m), list(map(len, sets)))
    order = np.argsort(values := np.concatenate(sets), kind="stable")
    row, starts = row[order], np.flatnonzero(np.diff(values[order], prepend=values[order[:1]] ^ np.uint64(1)))
    ends = np.append(starts[1:], len(row))
    split = starts + np.add.reduceat((row < n).astype(np.int64), starts) if len(starts) else starts
    own, other = split - starts, ends - split
    out = np.zeros(n * m, np.int64)
    heavy = own * other > max(4096, n * m // 64)
    places = np.flatnonzero(heavy)
    for k in range(0, len(places), ROWS * 4):
        left, right = np.zeros((n, ROWS * 4), np.float32), np.zeros((m, ROWS * 4), np.float32)
        for c, p in enumerate(places[k : k + ROWS * 4]):
            left[row[starts[p] : split[p]], c] = 1
            right[row[split[p] : ends[p]] - n, c] = 1
        out += (left @ right.T).astype(np.int64).ravel()
    places = np.flatnonzero(~heavy & (own * other > 0))
    work = np.cumsum(own[places] * other[places])
    for k in range(int(work[-1]) // 1_000_000 + 1 if len(places) else 0):
        some = places[np.searchsorted(work, k * 1_000_000, "right") : np.searchsorted(work, (k + 1) * 1_000_000, "right")]
        number = own[some] * other[some]
        at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        width = np.repeat(other[some], number)
        i, j = row[np.repeat(starts[some], number) + at // width], row[np.repeat(split[some], number) + at % width] - n
        out += np.bincount(i * m + j, minlength=n * m)
    return out.reshape(n, m)


def _linked(crowds: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect any two nodes of different labels of one of the crowds(crowd, node, label, size), a checkpoint, whose
    sets(node, shingles) are so similar, directly or by others. All pairs of a crowd are compared."""

    def run(batches):
        import pyarrow as pa

        for table in _runs(batches):
            node, label, size, held, first = _sides(table)
            if not held:
                continue
            held, all_first = [np.frombuffer(h, "<u8") for h in held], first or len(node)
            a, b = [], []
            # in slices of rows, so that a block's matrix is small; a part with itself needs only later rows
            for r in range(0, all_first, ROWS * 2):
                rows, cols = slice(r, min(r + ROWS * 2, all_first)), slice(first or r, len(node))
                both = _shared(held[rows] + held[cols], len(held[rows]))
                alike = both / np.maximum(size[rows, None] + size[None, cols] - both, 1) >= similarity
                i, j = np.nonzero(alike & (label[rows, None] != label[None, cols]))
                root = _roots(len(node), i + r, j + cols.start)
                far = np.flatnonzero(root != np.arange(len(node)))
                a.append(node[root[far]])
                b.append(node[far])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    known = crowds.join(sets, "node")
    blocks = _blocks(known, _beyond(crowds, "size")).select("crowd", "part", "node", "two", "label", "size", "shingles")
    dealt = blocks.repartition("crowd", "part").sortWithinPartitions("crowd", "part")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _only(rows: DataFrame, keys: DataFrame, key: str, how: str, broadcast_rows: int) -> DataFrame:
    """rows joined to keys, a checkpoint with each key once; keys are broadcast if they are few, so that rows need no shuffle."""
    return rows.join(F.broadcast(keys) if fits(keys, broadcast_rows) else keys, key, how)


def similar(
    nodes: DataFrame, texts: DataFrame, key: str, similarity: float = 0.8, words_per_shingle: int = 5,
    phases: tuple[int, ...] = (4, 28), radius: int = 2, broadcast_rows: int = 200_000,
) -> DataFrame:
    """node, root: the components of nodes(node, bands, size, key) by links that are so similar by the Jaccard measure of their word
    shingles, without nodes that have none; the key gives a node's text in texts(key, text).

    Candidates share one of their short SimHash fingerprints at radius flips: two texts at similarity 0.8 differ in 15% of
    the bits, so one fingerprint meets with a chance of 0.12, and one of 32 with 0.98. Nodes that share variants, directly or by
    others, are a crowd; in a crowd all nodes are compared with each other on all bits, and those that may be similar enough on
    their shingles. The fingerprints are taken in phases, so many in each: what one phase has linked has one label in the next
    and is not paired again.
    """

    def run(texts_of):
        return [[shingles_of(t, words_per_shingle).astype("<u8").tobytes() for t in texts_of]]

    found, first, roots, cell_bits = None, 0, None, _cell_bits(nodes.count())
    for n in phases:
        labelled = nodes.withColumn("label", F.col("node")) if roots is None else nodes.join(roots.withColumnRenamed("root", "label"), "node", "left")
        labelled = labelled.withColumn("label", F.coalesce("label", "node"))
        cells = _to_band_cells(labelled, range(first, first + n), sum(phases), radius, cell_bits)
        near = cut(_candidates(cut(_crowds(cells, radius, cell_bits)), labelled, similarity))
        asked = cut(nodes.join(near.select("node").distinct(), "node", "left_semi").select("node", key))
        # a key that several equal rows have gives their text more than once
        own = _only(texts, asked, key, "inner", broadcast_rows).select("node", "text").dropDuplicates(["node"])
        links = cut(_linked(near, map_text(own, ["node"], "text", run, "shingles binary"), similarity))
        release(links.sparkSession)
        found = links if found is None else found.union(links)
        first += n
        # labels of a phase need not be whole components, only right ones
        roots = components(found, None if first == sum(phases) else 2)
    return roots


def keep_one(
    docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, phases: tuple[int, ...] = (4, 28), broadcast_rows: int = 200_000
) -> DataFrame:
    """docs without the rows that another row of their component stands for; the row with the least doc_id stays.

    Links are at similarity of the sets of word shingles, see similar(); texts of the same words are one node, and so are
    texts without a word, null ones among them. Rows without a doc_id stand for a group only if no other does; of rows equal in
    all columns one stays, of others with the same least doc_id the first by a hash. All columns stay; an empty table gives no
    rows. These parameters are apart from those of classes(). Texts are shuffled only if what is asked of them, or what goes, is
    more than broadcast_rows rows.
    """
    columns, row = docs.columns, "_row"
    while row in columns:
        row += "_"
    # a row's key is a hash of all its columns, so it is the same in every scan; rows equal in all of them are one key
    held = [F.col(f"`{c}`") for c in columns]
    named = docs.withColumn(row, F.struct(F.xxhash64(*held).alias("one"), F.xxhash64(F.lit("two"), *held).alias("two")))

    def run(texts):
        words, sizes, made = [], [], []
        for t in texts:
            line = b" ".join((t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())
            shingles = shingles_of(t, words_per_shingle)
            words.append(xxhash.xxh3_128_digest(line))
            sizes.append(len(shingles))
            made.append(bands_of(shingles, sum(phases)).astype("<u4").tobytes() if line else None)
        return [words, sizes, made]

    seen = map_text(named.select("doc_id", row, "text"), ["doc_id", row], "text", run, "words binary, size int, bands binary")
    seen = cut(seen.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("key")).alias("order"), "words", "size", "bands"))
    nodes = seen.groupBy("words").agg(F.min("order").alias("order"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    # numbered as they are written, once
    nodes = cut(nodes.select("order", "bands", "size", F.monotonically_increasing_id().alias("node")))
    own = nodes.filter("bands is not null").select("node", "bands", "size", F.col("order.key").alias(row))
    texts = named.select(row, F.col("text").cast("string").alias("text"))
    roots = similar(own, texts, row, similarity, words_per_shingle, phases, broadcast_rows=broadcast_rows)
    rooted = nodes.join(roots, "node", "left").select("order", F.coalesce("root", "node").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("order").alias("least")).select(F.col("least.key").alias(row), F.lit(True).alias("stays"))
    keys = seen.groupBy(F.col("order.key").alias(row)).agg(F.count("*").alias("rows")).join(stays, row, "left")
    # keys of rows that go, or that are there several times and stay once
    odd = cut(keys.filter("stays IS NULL OR rows > 1"))
    once = odd.filter("stays").select(row)
    rest = _only(named, odd.select(row), row, "left_anti", broadcast_rows)
    return rest.union(_only(named, once, row, "left_semi", broadcast_rows).dropDuplicates([row])).select(*columns)
