"""Ignore rules of a file tree: a table of rules by folder, matched to paths by joins.

A rule belongs to the folder of its file. Of all rules that match a path the last one decides, those of deeper folders after
those above; an exclamation mark takes a match back. What lies in an ignored folder is ignored, whatever its own rules say.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "base string, place long, pattern string, negated boolean, folders_only boolean"
#: Folders below each other that are looked through for rule files; rows up to which rules are broadcast.
DEEPEST, BROADCAST_RULES = 64, 100_000


def pattern_regex(pattern: str) -> str:
    """A regex for the paths, relative to a rule's folder, that its pattern means."""
    anchored = "/" in pattern.rstrip("/")[:-1] or pattern.startswith("/")
    body, out, k = pattern.strip("/"), [], 0
    while k < len(body):
        c = body[k]
        if body.startswith("**/", k) and (k == 0 or body[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 2
        elif body[k:] == "**" and k and body[k - 1] == "/":
            out.append(".+")
            k += 1
        elif c == "*":
            while body[k + 1 : k + 2] == "*":
                k += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := body.find("]", k + 2)) > 0:
            inner = body[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[{'^/' + inner[1:] if inner[0] in '!^' else inner}]")
            k = end
        elif c == "\\" and k + 1 < len(body):
            k += 1
            out.append(re.escape(body[k]))
        else:
            out.append(re.escape(c))
        k += 1
    return f"(?s)^{'' if anchored else '(?:.*/)?'}{''.join(out)}$"


def rules_of(base: str, text: str, first: int = 0) -> list[tuple]:
    """Rows RULES of the text of a rule file in the folder base ('' for the root)."""
    out = []
    for k, line in enumerate(text.splitlines()):
        line = re.sub(r"(?<!\\) +$", "", line.removesuffix("\r"))
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
        if line.strip("/"):
            out.append((base, first + k, pattern_regex(line), negated, line.endswith("/")))
    return out


def read_rules(spark: SparkSession, root: str, name: str = ".gitignore") -> DataFrame:
    """The rules of all files of that name below root, and of root's .git/info/exclude, which come first.

    Spark's readers leave hidden files out, so the driver reads them, level by level; there are as many as the tree has rule files.
    """
    jvm = spark._jvm.org.apache.hadoop
    fs = jvm.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(jvm.fs.Path(root)).toUri().getPath().rstrip("/")
    rows = []

    def read(path, base, first):
        stream = fs.open(path)
        rows.extend(rules_of(base, spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"), first))
        stream.close()

    exclude = jvm.fs.Path(f"{root}/.git/info/exclude")
    if fs.exists(exclude):
        read(exclude, "", -1_000_000)
    for depth in range(DEEPEST):
        for status in fs.globStatus(jvm.fs.Path(f"{root}{'/*' * depth}/{name}")) or []:
            path = status.getPath()
            base = path.getParent().toUri().getPath()[len(top) :].strip("/")
            if not base.startswith(".git"):
                read(path, base, 0)
        if not any(s.isDirectory() for s in fs.globStatus(jvm.fs.Path(f"{root}{'/*' * (depth + 1)}")) or []):
            break
    return spark.createDataFrame(rows, RULES)


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """file_path of the rows of paths(file_path) that rules leave out, each once.

    Each folder above a path, and the path itself, meets the rules of the folders above it; null paths match nothing.
    """
    few = rules.count() <= BROADCAST_RULES
    parts = F.split("file_path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("entry"), (k < F.size(parts)).alias("folder")))
    each = paths.filter("file_path IS NOT NULL AND file_path <> ''").select("file_path").distinct().select("file_path", F.inline(upto))
    entries = each.select("entry", "folder").distinct()
    own = F.split("entry", "/")
    bases = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda k: F.array_join(F.slice(own, 1, k), "/"))
    asked = entries.select("entry", "folder", F.explode(bases).alias("base"))
    met = asked.join(F.broadcast(rules) if few else rules, "base")
    inner = F.when(F.col("base") == "", F.col("entry")).otherwise(F.substring(F.col("entry"), F.length("base") + 2, F.length("entry")))
    hits = met.filter((F.col("folder") | ~F.col("folders_only")) & F.regexp(inner, F.col("pattern")))
    # deeper folders' rules come after those above, and in a file the later ones
    last = F.max_by("negated", F.struct(F.length("base"), "place"))
    out = hits.groupBy("entry", "folder").agg(last.alias("negated")).filter("NOT negated").select("entry", "folder")
    return each.join(out, ["entry", "folder"], "left_semi").select("file_path").distinct()
