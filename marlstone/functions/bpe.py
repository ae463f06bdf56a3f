"""Token counts by byte-pair merging over a vocabulary of ranks."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marlstone.functions import exprs as X

# Fixed value: how a text is split before its parts are merged.
PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
#: Bytes of a rank file that is sent to all executors at most; characters of a text that are merged at once.
MOST_BYTES, PIECE = 64_000_000, 1_000_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks by token of a file of lines "base64 rank", which all executors need; raises beyond MOST_BYTES."""
    rows = spark.read.text(path)
    size = rows.agg(F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("n")).first().n
    if size > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than {MOST_BYTES}")
    pairs = (r.value.split(" ") for r in rows.filter("value <> ''").collect())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def pieces(text: str):
    """text in parts of about PIECE characters, cut before a line where there is one, so that hardly a merge is lost."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind("\n", at + 1, at + PIECE), text.rfind(" ", at + 1, at + PIECE))
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def counter(spark: SparkSession, ranks: dict[bytes, int] | None, pattern: str = PATTERN, special: dict[str, int] | None = None):
    """A function of a text column to its number of tokens; bytes / 4 where there are no ranks. Null texts have none (null)."""
    if not ranks:
        return X.token_count
    held = spark.sparkContext.broadcast((ranks, pattern, special or {}))

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        known, split, extra = held.value
        encoding = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=known, special_tokens=extra)
        one = lambda t: sum(len(encoding.encode(p, allowed_special="all", disallowed_special=())) for p in pieces(t))
        return pd.Series([None if t is None else one(t) for t in texts], dtype="Int32")

    return count
