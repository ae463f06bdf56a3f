"""Repeated byte strings across a corpus, removed everywhere but where they start first.

A string of `window` bytes that starts earlier, in a document before or further up in the same one, covers bytes to remove.
Strings meet at anchors (see anchors.py): equal strings have equal anchors at the same distance, so only strings of one anchor
need comparing, and anchors that occur once are done with.

1. Each task finds its documents' anchors. Occurrences of one span (all strings of an anchor with their surroundings) that
   repeat inside the task's block are resolved there, so of a hot passage one row per block travels, not one per document.
2. Rows are shuffled by anchor. Later occurrences of a span are resolved: all their strings occur before. Anchors with several
   spans, which lie at the edges of repeated passages, need their bytes compared: those are asked from the documents.
3. The spans' bytes are shuffled by anchor; a suffix array over those of many anchors at a time puts equal strings side by
   side, and all but the first of them are resolved. In that text an anchor's bytes are one letter.
4. Resolved strings are united by document and cut out of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.anchors import anchors, window_hashes
from marlstone.llm.common import cut
from marlstone.llm.suffix_array import suffix_array

GRAM = 32
#: Text bytes whose anchors are found at once, and those whose repeats a task resolves itself.
CHUNK_BYTES, BLOCK_BYTES = 4_000_000, 48_000_000
#: Rows that are grouped by anchor at once, and bytes of one suffix array; whole anchors, so a larger one is not split.
GROUP_ROWS, ARRAY_BYTES = 400_000, 400_000
_NULL = -(2**63)


def _unite(doc, mark, start, end):
    """Sorted rows, overlapping or touching stretches of one document being one."""
    if not len(doc):
        return doc, mark, start, end
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))
    group = np.cumsum(new)
    # ends in one rising line, each document above the one before
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new[1:] |= start[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    stop = np.concatenate((at[1:], [len(doc)])) - 1
    return doc[at], mark[at], start[at], reach[stop] - lift[stop]


def _ranked(keys, *order):
    """Order by keys, then by order; whether a row starts a new combination of keys."""
    at = np.lexsort((*order[::-1], *keys[::-1]))
    new = np.zeros(len(at), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[at][1:] != k[at][:-1]
    return at, new


def _find(window: int):
    """docs(doc, mark, text) to rows: h, span, doc, place of first occurrences; resolved stretches have span -1 - end."""

    def run(batches):
        import pyarrow as pa

        def emit(parts):
            doc, mark, first, length, lead, h, span = (np.concatenate(x) for x in zip(*parts, strict=True))
            at, new = _ranked((h, span), doc, mark, first)
            later = at[~new]
            kept = at[new]
            r_doc, r_mark, r_start, r_end = _unite(doc[later], mark[later], first[later], first[later] + length[later] + window)
            fields = (
                np.concatenate((h[kept].view(np.int64), (r_doc * 2654435761) ^ r_mark)),
                np.concatenate(((span[kept] << 16 | lead[kept] << 8 | length[kept]), -1 - r_end)),
                np.concatenate((doc[kept], r_doc)),
                np.concatenate((mark[kept] << 32 | first[kept], r_mark << 32 | r_start)),
            )
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in fields], names=["h", "span", "doc", "place"])

        parts, size, texts, ids, held = [], 0, [], [], 0

        def take():
            joined = np.frombuffer(b"".join(texts), np.uint8)
            starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            text, at, first, last, h, span = anchors(joined, starts, window, GRAM)
            own = np.array(ids, np.int64).reshape(-1, 2)
            parts.append(
                (
                    own[text, 0],
                    own[text, 1],
                    first - starts[text],
                    last - first,
                    at - first,
                    h,
                    (span >> np.uint64(17)).astype(np.int64),
                )
            )

        for batch in batches:
            for doc, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                texts.append(raw)
                ids.append((doc, mark))
                held += len(raw)
                if held >= CHUNK_BYTES:
                    take()
                    size, texts, ids, held = size + held, [], [], 0
                if size >= BLOCK_BYTES:
                    yield emit(parts)
                    parts, size = [], 0
        if texts:
            take()
        if parts:
            yield emit(parts)

    return run


def _blocks(batches, most: int, cost=None):
    """Runs of whole groups of the first column, as lists of numpy columns, of about most rows or cost."""
    held, n = [], 0
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        h = columns[0]
        if not len(h):
            continue
        if held and n >= most:
            # the group that is open goes on in this batch
            same = int(np.argmax(np.append(h != held[-1][0][-1], True)))
            held.append([c[:same] for c in columns])
            columns = [c[same:] for c in columns]
            if len(columns[0]):
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, n = [], 0
        if len(columns[0]):
            while True:
                sizes = np.cumsum(cost(columns) if cost else np.ones(len(columns[0]), np.int64))
                if n + sizes[-1] < 2 * most:
                    break
                h = columns[0]
                edges = np.flatnonzero(h[1:] != h[:-1]) + 1
                edges = edges[n + sizes[edges - 1] >= most]
                if not len(edges):
                    break
                held.append([c[: edges[0]] for c in columns])
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, n = [], 0
                columns = [c[edges[0] :] for c in columns]
            held.append(columns)
            n += int(sizes[-1])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _group(window: int):
    """Rows sorted by h to doc, mark, start, end, lead, h: resolved stretches (lead -1), and spans whose bytes are asked for."""

    def run(batches):
        import pyarrow as pa

        for h, packed, doc, place in _blocks(batches, GROUP_ROWS):
            done = packed < 0
            stretch = doc[done], place[done] >> 32, place[done] & 0xFFFFFFFF, -1 - packed[done]
            h, packed, doc, place = h[~done], packed[~done], doc[~done], place[~done]
            mark, first, length, lead, span = place >> 32, place & 0xFFFFFFFF, packed & 255, packed >> 8 & 255, packed >> 16
            at, new = _ranked((h, span), doc, mark, first)
            later, reps = at[~new], at[new]
            out = _unite(
                *(np.concatenate(x) for x in zip(stretch, (doc[later], mark[later], first[later], first[later] + length[later] + window), strict=True))
            )
            several = np.zeros(len(reps), bool)
            same = h[reps][1:] == h[reps][:-1]
            several[1:] |= same
            several[:-1] |= same
            ask = reps[several]
            none = np.zeros(len(out[0]), np.int64)
            fields = (
                np.concatenate((out[0], doc[ask])),
                np.concatenate((out[1], mark[ask])),
                np.concatenate((out[2], first[ask])),
                np.concatenate((out[3], first[ask] + length[ask] + window)),
                np.concatenate((none - 1, lead[ask])),
                np.concatenate((none, h[ask])),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in fields], names=["doc", "mark", "start", "end", "lead", "h"]
            )

    return run


def _cut_spans(batches):
    """doc, mark, text, asked (structs of start, end, lead, h) to the spans' bytes."""
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            doc, mark, text, asked = (batch.column(c)[k].as_py() for c in range(4))
            raw = text.encode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a["h"] for a in asked], pa.int64()),
                    pa.array([doc] * len(asked), pa.int64()),
                    pa.array([mark] * len(asked), pa.int64()),
                    pa.array([a["start"] for a in asked], pa.int64()),
                    pa.array([a["lead"] for a in asked], pa.int64()),
                    pa.array([raw[a["start"] : a["end"]] for a in asked], pa.binary()),
                ],
                names=["h", "doc", "mark", "start", "lead", "bytes"],
            )


def repeats(h, doc, mark, start, lead, spans, window: int):
    """doc, mark, start of every string that another span of its anchor holds earlier; the anchor is GRAM bytes from lead on."""
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    # strings without an equal hash in their anchor's spans are unique, and the array needs no span without others
    joined = np.frombuffer(b"".join(spans), np.uint8)
    bases = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(spans)), sizes - window + 1)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes - window + 1) - (sizes - window + 1), sizes - window + 1)
    hashes = window_hashes(joined, window)[bases[owner] + at]
    order, new = _ranked((h[owner], hashes))
    alone = new & np.append(new[1:], True)
    keep = np.zeros(len(owner), bool)
    keep[order] = ~alone
    letters, text, of, offset = {}, [], [], []
    if not keep.any():
        return doc[:0], mark[:0], start[:0]
    kept = np.flatnonzero(keep)
    first = np.full(len(spans), np.iinfo(np.int64).max)
    last = np.full(len(spans), -1)
    np.minimum.at(first, owner[kept], at[kept])
    np.maximum.at(last, owner[kept], at[kept])
    for k in np.flatnonzero(last >= 0).tolist():
        a, b, p, raw = int(first[k]), int(last[k]), int(lead[k]), spans[k]
        letter = letters.setdefault(int(h[k]), 258 + len(letters))
        piece = [*raw[a:p], letter, *raw[p + GRAM : b + window]]
        of.append(np.full(len(piece) + 1, k))
        offset.append(np.concatenate((np.arange(a, p + 1), np.full(len(piece) - (p - a), -1))))
        text += [c + 2 if c < 256 else c for c in piece]
        text.append(1)
    of, offset = np.concatenate(of), np.concatenate(offset)
    order = np.array(suffix_array(text))
    length = window - GRAM + 1
    last_of = np.where(last >= 0, last, -1)[of[order]]
    order = order[(offset[order] >= 0) & (offset[order] <= last_of)]
    symbols = np.array(text + [0] * length)
    equal = np.ones(len(order) - 1, bool)
    for k in range(length):
        live = np.flatnonzero(equal)
        equal[live] = symbols[order[live] + k] == symbols[order[live + 1] + k]
    group = np.concatenate(([0], np.cumsum(~equal)))
    k = of[order]
    place = start[k] + offset[order]
    ranked, new = _ranked((group,), doc[k], mark[k], place)
    later = ranked[~new]
    return doc[k][later], mark[k][later], place[later]


def _compare(window: int):
    def run(batches):
        import pyarrow as pa

        for h, doc, mark, start, lead, spans in _blocks(batches, ARRAY_BYTES, lambda c: np.fromiter(map(len, c[5]), np.int64, len(c[5]))):
            d, m, s = repeats(h, doc, mark, start, lead, list(spans), window)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in _unite(d, m, s, s + window)], names=["doc", "mark", "start", "end"])

    return run


def _clean(batches):
    """doc, text, found (structs of start, end) to the document's digest columns."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            raw = (batch.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass")
            found = batch.column(2)[k].as_py() or []
            kept, at, removed, runs = [], 0, 0, []
            for f in sorted(found, key=lambda x: x["start"]):
                if runs and f["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], f["end"])
                else:
                    runs.append([f["start"], f["end"]])
            for a, b in runs:
                kept.append(raw[at:a])
                at, removed = b, removed + b - a
            kept.append(raw[at:])
            rows.append((len(raw), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
        made = [list(x) for x in zip(*rows, strict=True)] or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))],
            names=["doc", "n_bytes", "n_removed", "runs", "kept_sha256"],
        )


def repeated_spans(docs: DataFrame, window: int = 100) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, n_bytes, n_removed, runs (removed byte ranges), kept_sha256.

    Documents are in order of doc_id, null first, then of a hash of their text, so rows that repeat a doc_id with another text
    are documents of their own; rows equal in both count as one and get the same result. Null and empty texts have no bytes.
    The id -2**63 is taken for null. Further columns are ignored; an empty table gives no rows.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"),
        # never null, so that both joins below share one exchange of the texts
        F.xxhash64(body).bitwiseAND(F.lit((1 << 31) - 1).cast("long")).alias("mark"),
        body.alias("text"),
    )
    found = rows.mapInArrow(_find(window), "h long, span long, doc long, place long")
    by_anchor = found.repartition("h").sortWithinPartitions("h")
    grouped = cut(by_anchor.mapInArrow(_group(window), "doc long, mark long, start long, end long, lead long, h long"))
    asked = (
        grouped.filter("lead >= 0")
        .groupBy("doc", "mark")
        .agg(F.collect_list(F.struct("start", "end", "lead", "h")).alias("asked"))
    )
    spans = (
        rows.join(asked, ["doc", "mark"])
        .select("doc", "mark", "text", "asked")
        .mapInArrow(_cut_spans, "h long, doc long, mark long, start long, lead long, bytes binary")
    )
    compared = (
        spans.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(window), "doc long, mark long, start long, end long")
    )
    stretches = (
        grouped.filter("lead < 0")
        .select("doc", "mark", "start", "end")
        .union(compared)
        .groupBy("doc", "mark")
        .agg(F.collect_list(F.struct("start", "end")).alias("found"))
    )
    cleaned = (
        rows.join(stretches, ["doc", "mark"], "left")
        .select("doc", "text", "found")
        .mapInArrow(_clean, "doc long, n_bytes long, n_removed long, runs array<array<long>>, kept_sha256 string")
    )
    return cleaned.select(F.when(F.col("doc") != _NULL, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "runs", "kept_sha256")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), "kept_sha256")
