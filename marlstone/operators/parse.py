"""Files to nodes and references: lines and chunks in Spark, blocks of markdown and code read file by file in Arrow batches."""

from __future__ import annotations

import array
import bisect
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import exprs as X
from marlstone.operators import blocks, lexer, scopes

CODE_LANGUAGES = lexer.LANGUAGES
#: Bytes of the line around a reference that are shown.
REFERENCE_PREVIEW = 200


def _starts(texts: pd.Series) -> pd.Series:
    """Byte offsets of the lines of each text."""
    ends = (np.flatnonzero(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) == 10) + 1 if t is not None else None for t in texts)
    return pd.Series([None if e is None else np.concatenate(([0], e)) for e in ends])


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """file_path, line (from 1), text, start_byte, end_byte of every line, the line feed not counted; no shuffle."""
    starts = F.pandas_udf(_starts, "array<long>")(F.col("content"))
    parts = files.select("file_path", *keep, F.split("content", "\n").alias("_lines"), starts.alias("_starts"))
    each = parts.select("file_path", *keep, F.posexplode(F.arrays_zip("_lines", "_starts")).alias("line", "_z"))
    rows = each.select("file_path", *keep, (F.col("line") + 1).alias("line"), F.col("_z._lines").alias("text"), F.col("_z._starts").alias("start_byte"))
    return rows.withColumn("end_byte", F.col("start_byte") + F.octet_length("text"))


def chunks(files: DataFrame, chunk_lines: int = 50, overlap: int = 10, threshold: int = 1_000_000) -> DataFrame:
    """Windows of lines of files longer than threshold bytes; each shorter one, if not empty, is one chunk."""
    step = max(chunk_lines - overlap, 1)
    n = F.size(F.split("content", "\n")) - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    big = files.filter(F.octet_length("content") > threshold).withColumn("n", n)
    at = F.col("line") - 1
    first = F.greatest(F.ceil((at - chunk_lines + 1) / F.lit(step)), F.lit(0))
    held = lines(big, "n").filter("line <= n").withColumn("k", F.explode(F.sequence(first, F.floor(at / F.lit(step)))))
    long = (
        held.groupBy("file_path", "k")
        .agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.min("line").cast("int").alias("line_start"), F.max("line").cast("int").alias("line_end"))
        .drop("k")
    )
    short = files.filter((F.octet_length("content") <= threshold) & (F.length("content") > 0)).select(
        "file_path", F.lit(0).cast("long").alias("start_byte"), F.octet_length("content").cast("long").alias("end_byte"), F.lit(1).alias("line_start"), n.alias("line_end")
    )
    every = long.unionByName(short)
    return every.withColumn("id", X.handle_id(F.col("file_path"), F.lit(7), F.col("start_byte"), F.col("end_byte")))


#: Rows, and characters of their texts, of a batch that goes from Python to Spark, and files that are taken out of one at a time.
BATCH_ROWS, BATCH_CHARACTERS, FILES_AT_ONCE = 4_096, 2_000_000, 64
#: Characters from which on places of a text are kept as plain numbers.
LARGE = 100_000


def _numbers(values: np.ndarray, large: bool):
    return array.array("q", values.astype(np.int64).tobytes()) if large else values.tolist()


def byte_places(text: str):
    """The byte that each character starts at, and the end."""
    if text.isascii():
        return range(len(text) + 1)
    sizes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(np.add(1, sizes > 0x7F, dtype=np.int64) + (sizes > 0x7FF) + (sizes > 0xFFFF), out=places[1:])
    return _numbers(places, len(text) > LARGE)


def line_feeds(text: str):
    """The places of the line feeds of a text, in characters."""
    if len(text) <= LARGE:
        return [m.start() for m in re.finditer("\n", text)]
    if text.isascii():
        return _numbers(np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10), True)
    return _numbers(np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10), True)


def in_batches(rows, kinds: dict, text: str | None = None):
    """Rows, tuples of kinds, as Arrow batches of bounded size; text names the column that may be long."""
    import pyarrow as pa

    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    names, own = list(kinds), [types[k] for k in kinds.values()]
    long = names.index(text) if text else -1
    held: list[tuple] = []
    characters = 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held, strict=True), own, strict=True)], names=names)
    for row in rows:
        held.append(row)
        if long >= 0:
            characters += len(row[long] or "")
        if len(held) >= BATCH_ROWS or characters >= BATCH_CHARACTERS:
            yield out()
            held, characters = [], 0
    if held:
        yield out()


def each_file(batches):
    """The rows of Arrow batches, few of them being Python's at a time."""
    for batch in batches:
        step = max(1, min(FILES_AT_ONCE, 2 * BATCH_CHARACTERS * batch.num_rows // max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, step).columns), strict=True)


def ddl(kinds: dict) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in kinds.items())


_SPAN = "node_type: int, name: string, heading: string, parent_name: string, start_byte: long, end_byte: long, line_start: int, line_end: int"


def _blocks(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        at = byte_places(text or "")
        out.append([(b.node_type, None, b.heading, None, at[b.start], at[b.end], b.line_start, b.line_end) for b in blocks.blocks(text)] if text else [])
    return pd.Series(out)


def markdown(files: DataFrame) -> DataFrame:
    """Sections (a heading to the next one of any level), code blocks and paragraphs of files(file_path, content), see blocks.

    A file is read in one place, without a shuffle. The heading of a code block is the language that its fence names.
    """
    own = files.select("file_path", F.explode(F.pandas_udf(_blocks, f"array<struct<{_SPAN}>>")("content")).alias("r"))
    return own.select("file_path", *(f"r.{c}" for c in ("node_type", "start_byte", "end_byte", "line_start", "line_end", "heading")))


_DECLARED = {
    "file_path": "string", "node_type": "int", "name": "string", "heading": "string", "parent_name": "string",
    "start_byte": "long", "end_byte": "long", "line_start": "int", "line_end": "int",
}
_REFERRED = {
    "file_path": "string", "name": "string", "qualifier": "string", "ref_type": "string",
    "start_byte": "long", "end_byte": "long", "line_start": "int", "line_end": "int", "preview": "string",
}


def _declared(batches):
    def rows():
        for path, text, language in each_file(batches):
            if not text:
                continue
            at, feeds = byte_places(text), line_feeds(text)
            line = lambda place: bisect.bisect_left(feeds, place) + 1  # noqa: B023, E731
            for s in scopes.pieces(text, language):
                for d in scopes.declared(s):
                    yield path, d.node_type, d.name, d.heading, d.parent, at[d.start], at[d.end], line(d.start), line(d.end)

    return in_batches(rows(), _DECLARED)


def code(files: DataFrame) -> DataFrame:
    language = X.file_type(F.col("file_path"))
    return files.select("file_path", "content", language.alias("language")).filter(F.col("language").isin(*CODE_LANGUAGES))


def declarations(files: DataFrame) -> DataFrame:
    """Functions, methods, classes and the like of source files(file_path, content), with the class or type they are in, see scopes.

    A file is read in one place, without a shuffle. Methods of Go have the type of their receiver; a module of Rust has a
    heading, no name. Null and empty files have none.
    """
    own = code(files).mapInArrow(_declared, ddl(_DECLARED))
    return own.select("file_path", "node_type", "name", "heading", "parent_name", "start_byte", "end_byte", "line_start", "line_end")


_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")


def shown_lines(text: str, feeds, first: int, last: int) -> str:
    """The lines around a reference, the first and the last of them being given, in one line."""
    head, stop = feeds[first - 1] + 1 if first else 0, feeds[last] if last < len(feeds) else len(text)
    whole = text[head : min(stop, head + REFERENCE_PREVIEW + 1)].encode("utf-8", "surrogatepass")
    shown = _WHITE.sub(" ", whole[:REFERENCE_PREVIEW].decode("utf-8", "ignore")).strip(" ")
    return shown + ("..." if len(whole) > REFERENCE_PREVIEW else "")


def placed(text: str, at, feeds, found: list, previews: bool = True):
    """References as rows: name, qualifier, ref_type, span in bytes, lines, and the text of these if previews are asked for."""
    for name, qualifier, a, b, kind in found:
        first = bisect.bisect_left(feeds, a)
        last = bisect.bisect_left(feeds, b, first)
        yield name, qualifier, kind, at[a], at[b], first + 1, last + 1, shown_lines(text, feeds, first, last) if previews else None


def references(files: DataFrame, previews: bool = True) -> DataFrame:
    """Calls and imported names of source files(file_path, content): name, qualifier, ref_type, span, lines and the text of these.

    A file is read in one place, without a shuffle. A call reaches to its closing parenthesis; its qualifier is all that stands
    before the last name. Null and empty files have none. Without previews, there is no such column.
    """

    def read(batches):
        def rows():
            for path, text, language in each_file(batches):
                if text:
                    at, feeds = byte_places(text), line_feeds(text)
                    for s in scopes.pieces(text, language):
                        for row in placed(text, at, feeds, scopes.referred(s), previews):
                            yield path, *row

        return in_batches(rows(), _REFERRED)

    own = code(files).mapInArrow(read, ddl(_REFERRED))
    shown = ("qualifier", "ref_type", "start_byte", "end_byte", "line_start", "line_end", *(["preview"] if previews else []))
    return own.select("file_path", "name", F.lower("name").alias("name_lower"), *shown)
