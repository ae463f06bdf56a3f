"""Scans of file trees, and working-copy status as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import exprs as X
from marlstone.sources import ignores

# Names that a scan leaves out by default.
IGNORED = (
    ".git",
    ".marlstone",
    "node_modules",
    "target",
    "__pycache__",
    ".venv",
    "venv",
    "*.min.js",
    "*.min.css",
    ".DS_Store",
    "*.lock",
    "package-lock.json",
    "Cargo.lock",
)


def scan(spark: SparkSession, root: str, glob: str = "**/*", ignored: tuple[str, ...] = IGNORED, rules: bool = True) -> DataFrame:
    """Files below root whose relative path fits glob: file_path, content, content_hash, mtime, token_count.

    Files that are no UTF-8 are left out, and those that the tree's own ignore files leave out, unless rules is false. Hidden
    files are not listed by Spark's readers.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^/*{base.lstrip('/')}/", "")
    found = raw.select(
        path.alias("file_path"), "content", F.unix_timestamp("modificationTime").alias("mtime")
    ).filter(X.glob_match(F.col("file_path"), glob))
    for name in ignored:
        found = found.filter(~(X.glob_match(F.col("file_path"), f"**/{name}") | X.glob_match(F.col("file_path"), f"**/{name}/**")))
    if rules:
        known = ignores.read_rules(spark, root)
        if known.count():
            found = found.join(ignores.ignored(found.select("file_path"), known), "file_path", "left_anti")
    text = F.col("content").cast("string")
    return found.filter(F.is_valid_utf8(text)).select(
        "file_path", text.alias("content"), F.sha2("content", 256).alias("content_hash"), "mtime", X.token_count(text).alias("token_count")
    )


def head_commit(root: str) -> str | None:
    """The commit that is checked out at root on the driver's disk; none if there is none."""
    import subprocess

    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=30)
    except OSError:
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def save_fingerprint(dirty: DataFrame, path: str) -> None:
    """The fingerprint of dirty, kept as a one-row table for changed_since()."""
    fingerprint(dirty).write.mode("overwrite").parquet(path)


def dirty_files(status: Column) -> Column:
    """Array of (path, status) in the NUL-separated porcelain v2 output of git status."""
    records = F.filter(F.split(status, "\0"), lambda r: r != "")
    # a renamed entry is followed by its old path, which has no record type
    kind = lambda r: F.substring(r, 1, 2)
    code = lambda r: F.substring(r, 3, 2)
    name = (
        lambda r: F.when(kind(r) == "? ", "added")
        .when(kind(r) == "u ", "unmerged")
        .when(kind(r) == "2 ", "renamed")
        .when(F.contains(code(r), F.lit("D")), "deleted")
        .when(F.contains(code(r), F.lit("A")), "added")
        .otherwise("modified")
    )
    path = (
        lambda r: F.when(kind(r) == "? ", F.substring(r, F.lit(3), F.length(r)))
        .when(kind(r) == "1 ", F.regexp_extract(r, r"^1(?: [^ ]*){7} (.*)$", 1))
        .when(kind(r) == "2 ", F.regexp_extract(r, r"^2(?: [^ ]*){8} (.*)$", 1))
        .otherwise(F.regexp_extract(r, r"^u(?: [^ ]*){9} (.*)$", 1))
    )
    own = F.filter(records, lambda r: kind(r).isin("1 ", "2 ", "u ", "? "))
    return F.transform(own, lambda r: F.struct(path(r).alias("path"), name(r).alias("status")))


def fingerprint(dirty: DataFrame) -> DataFrame:
    """One row: SHA-256 of dirty(path, mtime), by levels.

    Paths fall into 65,536 buckets by the first four hex digits of their own SHA-256; a bucket's digest is of its sorted
    path:mtime lines, the whole one of the buckets' numbers and digests in order. So a bucket, not the table, is held at once.
    """
    line = F.concat_ws(":", "path", F.concat(F.col("mtime").cast("string"), F.lit("\n")))
    bucket = F.conv(F.substring(F.sha2("path", 256), 1, 4), 16, 10).cast("int")
    lines = dirty.select(bucket.alias("bucket"), line.alias("line"))
    each = lines.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("digest"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda b: F.concat(b["bucket"].cast("string"), F.lit(":"), b["digest"], F.lit("\n")))
    return each.agg(F.sha2(F.array_join(shown, ""), 256).alias("fingerprint"))


def changed_since(dirty: DataFrame, saved: DataFrame) -> DataFrame:
    """One row: the fingerprint of dirty, and whether it differs from that of the one-row table saved(fingerprint), or that is empty."""
    old = saved.agg(F.max("fingerprint").alias("_old"))
    now = fingerprint(dirty).join(F.broadcast(old))
    return now.select("fingerprint", (~F.coalesce(F.col("fingerprint") == F.col("_old"), F.lit(False))).alias("changed"))
