"""Files to the nodes and references that searches read, and their upkeep in tables."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import exprs as X
from marlstone.operators import blocks, lifecycle, parse, postings, scopes
from marlstone.sources.snapshots import Snapshots
from marlstone.sources.state import written

#: Folders that the nodes of a new index are dealt over, by file.
PARTS = 64

#: Columns of the nodes of an index.
NODE = (
    "id", "file_path", "node_ord", "node_type", "start_byte", "end_byte", "line_start", "line_end", "token_count", "preview",
    "name", "name_lower", "heading", "parent_name", "parent_name_lower", "metadata", "indexed_hash", "content", "norm_text",
)


#: Lines of a chunk, and those that it shares with the next one.
CHUNK, OVERLAP = 50, 10

# node_type, name, heading, parent_name, start, end (characters), line_start, line_end
_START, _END = 4, 5


def _in_order(d: tuple):
    none_first = lambda x: (x is not None, x or "")
    return d[_START], -d[_END], d[0], d[6], d[7], none_first(d[1]), none_first(d[2]), none_first(d[3])


def _chunks(text: str, feeds, threshold: int):
    """Spans of a file of no known form, see parse.chunks()."""
    n = len(feeds) + 1 - text.endswith("\n")
    if len(text) * 4 <= threshold or len(text.encode("utf-8", "surrogatepass")) <= threshold:
        yield 7, None, None, None, 0, len(text), 1, n
        return
    for first in range(0, n, CHUNK - OVERLAP):
        last = min(first + CHUNK, n) - 1
        yield 7, None, None, None, feeds[first - 1] + 1 if first else 0, feeds[last] if last < len(feeds) else len(text), first + 1, last + 1


def _read(text: str, language: str, feeds, threshold: int):
    """Spans and references of a file, each in order, piece by piece: no span reaches over what is in another piece."""
    if language == "markdown":
        yield sorted(((b.node_type, None, b.heading, None, b.start, b.end, b.line_start, b.line_end) for b in blocks.blocks(text)), key=_in_order), []
        return
    line = lambda place: bisect.bisect_left(feeds, place) + 1
    #: References before the first declaration; in a file without one, they are in its chunks.
    early, bare = [], True
    for s in scopes.pieces(text, language) if language in parse.CODE_LANGUAGES else ():
        found, referred = scopes.read(s)
        spans = sorted(((d.node_type, d.name, d.heading, d.parent, d.start, d.end, line(d.start), line(d.end)) for d in found), key=_in_order)
        if bare and not spans:
            early += referred
            continue
        if bare and early:
            yield [], early
            early = []
        bare = False
        yield spans, referred
    if bare:
        yield list(_chunks(text, feeds, threshold)), early


def _around(points: list, spans: list[tuple]) -> list[int | None]:
    """For each (start, end), in order of start, the place of the smallest span around it, of the first of equals; None without one."""
    out, opened, nested, k = [], [], True, 0
    for a, b in points:
        while k < len(spans) and spans[k][_START] <= a:
            while opened and spans[opened[-1]][_END] <= spans[k][_START]:
                opened.pop()
            nested = nested and not (opened and spans[opened[-1]][_END] < spans[k][_END])
            opened.append(k)
            k += 1
        while opened and spans[opened[-1]][_END] <= a:
            opened.pop()
        best, least = None, 0
        for j in reversed(opened):
            size = spans[j][_END] - spans[j][_START]
            if spans[j][_END] >= b and (best is None or size <= least):
                best, least = j, size
            elif best is not None and nested:
                break
        out.append(best)
    return out


_NODES = {
    "file_path": "string", "indexed_hash": "string", "node_ord": "long", "node_type": "int", "start_byte": "long", "end_byte": "long",
    "line_start": "int", "line_end": "int", "name": "string", "heading": "string", "parent_name": "string", "content": "string",
}
_REFS = {
    "file_path": "string", "name": "string", "qualifier": "string", "ref_type": "string", "start_byte": "long", "end_byte": "long",
    "line_start": "int", "line_end": "int", "preview": "string", "source_id": "string",
}


def nodes(files: DataFrame, threshold: int = 1_000_000) -> DataFrame:
    """Nodes of files(file_path, content, content_hash), in the columns NODE; a file's nodes are numbered by their place.

    Sections, code blocks and paragraphs of markdown, declarations of code, and chunks of what has neither. A file is read in one
    pass and one place, without a shuffle, and its nodes leave it in batches. Null and empty files have no nodes; files longer
    than threshold bytes, of no known form, are cut into chunks. Tokens are stored with the nodes, so that a search need not
    make them.
    """

    def read(batches):
        def rows():
            for path, text, language, held in parse.each_file(batches):
                if not text:
                    continue
                at, feeds, order = parse.byte_places(text), parse.line_feeds(text), 0
                for spans, _ in _read(text, language, feeds, threshold):
                    for kind, name, heading, parent, a, b, first, last in spans:
                        yield path, held, order, kind, at[a], at[b], first, last, name, heading, parent, text[a:b]
                        order += 1

        return parse.in_batches(rows(), _NODES, "content")

    own = files.select("file_path", "content", X.file_type(F.col("file_path")).alias("language"), "content_hash").mapInArrow(read, parse.ddl(_NODES))
    start, end, zero = F.col("start_byte"), F.col("end_byte"), F.lit(0).cast("long")
    return own.withColumns(
        {
            "id": X.handle_id(F.col("file_path"), F.col("node_type"), start, end),
            "preview": X.preview(F.col("content"), zero, end - start),
            "token_count": F.floor((end - start) / 4).cast("int"),
            "name_lower": F.lower("name"),
            "parent_name_lower": F.lower("parent_name"),
            "metadata": X.metadata_json(F.col("node_type"), F.col("name"), F.col("heading"), F.col("parent_name")),
            "norm_text": X.norm(F.col("content")),
        }
    ).select(*NODE)


def refs(files: DataFrame, threshold: int = 1_000_000) -> DataFrame:
    """References of files(file_path, content), each with source_id, the smallest of the nodes() of its file around it; no shuffle."""

    def read(batches):
        def rows():
            for path, text, language in parse.each_file(batches):
                if not text:
                    continue
                at, feeds = parse.byte_places(text), parse.line_feeds(text)
                for spans, found in _read(text, language, feeds, threshold):
                    ids: dict = {None: None}
                    for row, j in zip(parse.placed(text, at, feeds, found), _around([(r.start, r.end) for r in found], spans), strict=True):
                        if j not in ids:
                            key = f"{path}:{spans[j][0]}:{at[spans[j][_START]]}-{at[spans[j][_END]]}"
                            ids[j] = "h" + hashlib.sha256(key.encode("utf-8", "surrogatepass")).hexdigest()[:24]
                        yield path, *row, ids[j]

        return parse.in_batches(rows(), _REFS)

    own = parse.code(files).mapInArrow(read, parse.ddl(_REFS))
    return own.select("file_path", "name", F.lower("name").alias("name_lower"), *list(_REFS)[2:])


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and references of files."""
    return nodes(files), refs(files)


def write(index: Snapshots, n: DataFrame, r: DataFrame | None, replaced: DataFrame | None = None) -> int:
    """Nodes, references and postings in one commit, those of replaced(file_path) dying; returns the generation.

    Postings are made of the nodes as they are stored, so that n is made once.
    """
    settings = index.settings() or {"buckets": postings.BUCKETS, "parts": PARTS}
    part = F.pmod(F.crc32("file_path"), F.lit(settings["parts"])).cast("int").alias("part")
    tables = {"nodes": n.select("*", part), "postings": ("nodes", lambda written: postings.postings(written, settings["buckets"]))}
    if r is not None:
        tables["refs"] = r
    layouts = {"nodes": {"partition": "part", "order": ["part", "file_path", "node_ord"]}, "postings": postings.layout(), "refs": {}}
    return index.commit(tables, replaced, layouts, settings)


def update(files: DataFrame, stored: DataFrame, index: Snapshots, now: int, ttl: int = 3600) -> DataFrame:
    """Indexes what of files is new or changed since stored into nodes, refs and postings; returns what was done.

    Rows of the same files are replaced; files of which there are no more keep theirs until they are invalidated. Nodes are
    written to the shared folder first, as three tables are made of them.
    """
    planned = lifecycle.plan_index(files, stored, now, ttl)
    changed = planned.filter("action = 'index'").drop("action")
    n = written(nodes(changed))
    write(index, n, refs(changed), changed.select("file_path"))
    return planned


def invalidate(index: Snapshots, glob: str | None = None) -> int:
    """Drops the files that fit, or all, from nodes, refs and postings; returns how many there were."""
    files = index.read("nodes").select("file_path").distinct()
    gone = written(files if glob is None else files.filter(X.glob_match(F.col("file_path"), glob)))
    n = gone.count()
    if n:
        index.drop(gone)
    return n
