"""Leaf searches over nodes: full text, symbols, sections, children, files. Each returns its matches in (file_path, node_ord) order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import exprs as X

ORDER = ("file_path", "node_ord")
HANDLE = ("id", "file_path", "node_type", "token_count", "preview", "node_ord")


def first(found: DataFrame, limit: int | None) -> DataFrame:
    return found if limit is None else found.orderBy(*ORDER).limit(limit)


def words_of(literal: str) -> list[str]:
    """The tokens of a literal."""
    import unicodedata

    plain = "".join(X.PLAIN[X.ACCENTED.index(c)] if c in X.ACCENTED else c for c in literal.lower())
    return ["".join(c) for c in _runs(plain, lambda c: unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co")]


def phrases(asked: str) -> list[list[str]] | None:
    """The phrases, as tokens, that must all occur: one of each word, or one of all if asked has any of " ( ) - * < >.

    None, as nothing can be found, where there is no token in asked or in one of its words.
    """
    parts = [asked] if re.search(r'["()\-*<>]', asked) else asked.split()
    found = [words_of(p) for p in parts]
    return found if found and all(found) else None


def _runs(text, inside):
    run = []
    for c in text:
        if inside(c):
            run.append(c)
        elif run:
            yield run
            run = []
    if run:
        yield run


def matches(text: Column, asked: str, stored: bool = False) -> Column:
    """Whether text (lower-cased, or stored tokens) holds all phrases() of asked."""
    out = F.lit(True)
    for words in (wanted := phrases(asked)) or ():
        out = out & (F.contains(text, F.lit(f" {' '.join(words)} ")) if stored else text.rlike(X.token_pattern(words)))
    return out if wanted else F.lit(False)


def condition(nodes: DataFrame, *any_of: str, none_of: tuple[str, ...] = ()) -> Column:
    """Whether a row of nodes(content, ...) holds the terms of one of any_of and of none of none_of.

    Nodes of an index hold norm_text, their tokens, which is looked into instead.
    """
    stored = "norm_text" in nodes.columns
    text = F.col("norm_text") if stored else F.lower("content")
    hit = F.lit(False)
    for asked in any_of:
        hit = hit | matches(text, asked, stored)
    for asked in none_of:
        hit = hit & ~matches(text, asked, stored)
    return hit


def grep(nodes: DataFrame, *any_of: str, none_of: tuple[str, ...] = (), limit: int | None = 100) -> DataFrame:
    """The rows of nodes that fit condition(); one scan, whatever the number of terms."""
    return first(nodes.filter(condition(nodes, *any_of, none_of=none_of)), limit)


def in_files(found: DataFrame, glob: str, limit: int | None = 100) -> DataFrame:
    return first(found.filter(X.glob_match(F.col("file_path"), glob)), limit)


def files(of: DataFrame, glob: str) -> DataFrame:
    """A whole-file chunk for every file(file_path, content, token_count) whose path fits; no limit."""
    from marlstone.sources.adapters import whole_file_nodes

    return whole_file_nodes(of.filter(X.glob_match(F.col("file_path"), glob)))


def sections(nodes: DataFrame, heading: str, limit: int | None = 100) -> DataFrame:
    """Sections whose heading holds the text; % and _ of it match anything."""
    return first(nodes.filter((F.col("node_type") == 0) & F.lower("heading").like(f"%{heading.lower()}%")), limit)


def definition(nodes: DataFrame, symbol: str, limit: int | None = 100) -> DataFrame:
    return first(nodes.filter((F.col("name_lower") == symbol.lower()) & F.col("node_type").isin(*X.CODE_TYPES)), limit)


def code(nodes: DataFrame, symbol: str, limit: int | None = 100) -> DataFrame:
    """Code nodes of exactly that name, or, where there is none, those whose name has its terms."""
    own = nodes.filter(F.col("node_type").isin(*X.CODE_TYPES))
    exact = F.col("name_lower") == symbol.lower()
    either = own.filter(exact | matches(F.lower("name"), symbol)).withColumn("_exact", exact)
    some = either.agg(F.coalesce(F.bool_or("_exact"), F.lit(False)).alias("_some"))
    return first(either.join(F.broadcast(some)).filter(F.col("_exact") | ~F.col("_some")).drop("_exact", "_some"), limit)


def children(nodes: DataFrame, parent: str, symbol: str | None = None, limit: int | None = 100) -> DataFrame:
    found = nodes.filter(F.col("parent_name_lower") == parent.lower())
    return first(found if symbol is None else found.filter(F.col("name_lower") == symbol.lower()), limit)


def by_type(nodes: DataFrame, node_type: int, limit: int | None = 100) -> DataFrame:
    return first(nodes.filter(F.col("node_type") == node_type), limit)


def references(refs: DataFrame, nodes: DataFrame, symbol: str, limit: int | None = 100) -> DataFrame:
    """refs of the name with the type and span of the node they are in, if any; unknown kinds count as calls."""
    own = refs.filter(F.col("name_lower") == symbol.lower())
    source = nodes.select(F.col("id").alias("source_id"), F.col("node_type").alias("source_type"))
    shown = own.join(source, "source_id", "left").select(
        "file_path",
        "name",
        "qualifier",
        F.when(F.col("ref_type").isin("import", "type_ref"), F.col("ref_type")).otherwise("call").alias("ref_type"),
        "start_byte",
        "end_byte",
        F.coalesce("preview", F.lit("...")).alias("preview"),
        F.when(F.col("source_type").isNotNull(), F.col("source_id")).alias("source_id"),
        "source_type",
    )
    return shown if limit is None else shown.orderBy("file_path", "start_byte", "end_byte", "preview").limit(limit)


def reference_sources(refs: DataFrame, nodes: DataFrame, symbol: str, limit: int | None = 100) -> DataFrame:
    """Distinct nodes that hold a reference to the name."""
    own = refs.filter(F.col("name_lower") == symbol.lower()).select(F.col("source_id").alias("id"))
    return first(nodes.join(own, "id", "left_semi"), limit)


def enclosing(points: DataFrame, nodes: DataFrame, bucket: int = 4_096) -> DataFrame:
    """points(file_path, start_byte, end_byte, ...) with source_id, the smallest node around them, the first of equals, or null.

    Nodes of up to bucket bytes meet points by file and run of so many bytes, longer ones by file and a run of a power of 16
    times as many, so a point meets only nodes of its neighbourhood at each length, whatever the size of the file.
    """
    n = nodes.select("file_path", F.col("start_byte").alias("_a"), F.col("end_byte").alias("_b"), "node_ord", F.col("id").alias("_id"))
    size = F.greatest(F.col("_b") - F.col("_a"), F.lit(1))
    level = F.greatest(F.ceil(F.log2(size / F.lit(float(bucket))) / 4), F.lit(0)).cast("int")
    levels = range(8)
    wide = lambda k: F.pow(F.lit(16.0), k) * F.lit(float(bucket))
    run = lambda at, k: F.floor(at / wide(k)).cast("long")
    n = n.withColumn("_level", F.least(level, F.lit(len(levels) - 1)))
    n = n.withColumn("_run", F.explode(F.sequence(run(F.col("_a"), F.col("_level")), run(F.col("_b"), F.col("_level")))))
    keys = ["file_path", "start_byte", "end_byte"]
    asked = points.select(*keys).distinct()
    places = F.array(*(F.struct(F.lit(k).alias("_level"), run(F.col("start_byte"), F.lit(k)).alias("_run")) for k in levels))
    inside = asked.select(*keys, F.inline(places)).join(n, ["file_path", "_level", "_run"]).filter("_a <= start_byte AND end_byte <= _b")
    best = inside.groupBy(*keys).agg(F.min_by("_id", F.struct(F.col("_b") - F.col("_a"), "node_ord")).alias("source_id"))
    return points.join(best, keys, "left")
