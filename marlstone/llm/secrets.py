"""Secret scans with corpus-wide ownership frequency.

Each text is scanned once for base kinds (assign, access, hex) and for further candidates (KINDS). Candidate values are
hashed; the distinct (value, owner, repository) triples of the whole corpus tell values that many owners share, such as keys
copied out of a manual, from those of one owner, which look live. Base spans are always reported; further candidates are
reported as spans only if they look live.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, fits, map_text, packed, spread_join

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Further candidates: kind, a string that a text must hold, pattern, group of the value.
_MORE = (
    # to the line that ends the key, or, where that is missing, over all lines that look like a part of one
    (
        "pem", "PRIVATE KEY",
        re.compile(
            r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
            r"|(?:[ \t]*(?:[A-Za-z][A-Za-z-]*: [^\n]*|[A-Za-z0-9+/=]{20,}|[A-Za-z0-9+/]+==?|)[ \t\r]*\n)*(?:[A-Za-z0-9+/=]{20,}|[A-Za-z0-9+/=]+\Z)?)"
        ),
        0,
    ),
    ("hosting", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), 0),
    ("github_pat", "github_pat_", re.compile(r"\bgithub_pat_[A-Za-z0-9_]{22,}"), 0),
    ("gitlab", "glpat-", re.compile(r"\bglpat-[A-Za-z0-9_-]{20,}"), 0),
    ("google", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}"), 0),
    ("stripe", "_live_", re.compile(r"\b[prs]k_live_[A-Za-z0-9]{16,}"), 0),
    ("npm", "npm_", re.compile(r"\bnpm_[A-Za-z0-9]{36,}"), 0),
    ("chat", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"), 0),
    ("url", "://", re.compile(r"://[^\s/:@]++:([^\s/:@]{3,}+)@"), 1),
    ("named", "_key", re.compile(r"""(?:\b|(?<=_))(?:access|private|secret|account)_key["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", re.ASCII | re.IGNORECASE), 1),
    ("bearer", "earer ", re.compile(r"\b[Bb]earer ([A-Za-z0-9+/_.=-]{16,})"), 1),
)
_SCHEME = re.compile(r"\b[a-z][a-z0-9+.-]+")
_SCHEME_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *(k for k, *_ in _MORE))


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _with_schemes(text: str, found):
    """Matches from "://" on, led by their schemes; no letter is in two schemes or two matches, so the work is linear."""
    for kind, start, end, value in found:
        at = start
        while at and text[at - 1] in _SCHEME_LETTERS:
            at -= 1
        if m := _SCHEME.search(text, at, start):
            yield kind, m.start(), end, value


def candidates_of(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), base kinds first; offsets are code points, the end exclusive."""
    if not text:
        return []
    found = [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    for kind, must, pattern, group in _MORE:
        if must in text or kind == "named" and must in text.lower():
            more = ((kind, *m.span(), m[group]) for m in pattern.finditer(text))
            found += _with_schemes(text, more) if kind == "url" else more
    return found


def _joined(spans) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in order)


def _scanned(texts):
    rows = [candidates_of(t) for t in texts]
    base = [[c for c in row if c[0] in BASE] for row in rows]
    return [
        *[[sum(c[0] == kind for c in row) for row in base] for kind in BASE],
        [_joined(row) for row in base],
        [
            [
                {"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "bits": _entropy(v)}
                for k, a, b, v in row
            ]
            for row in rows
        ],
    ]


_FIELDS = (
    "n_assign long, n_access long, n_hex long, base string, "
    "candidates array<struct<kind: string, start: long, end: long, hash: string, bits: double>>"
)


def ownership(candidates: DataFrame, min_owners: int) -> DataFrame:
    """hash, n_owners, n_repositories, example of candidates(hash, owner, repository)."""
    triples = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = triples.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories")
    ).withColumn("example", F.col("n_owners") >= min_owners)


def _scan(docs: DataFrame, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    named = docs.select(
        *dict.fromkeys(("doc_id", *keep)),
        F.coalesce(F.regexp_extract(F.col(source).cast("string"), "^([^/]*)", 1), F.lit("")).alias("owner"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("repository"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("text").alias("_body"),
    )
    carry = list(dict.fromkeys(("doc_id", *keep, "owner", "repository", "_row")))
    return map_text(named, carry, "_body", _scanned, _FIELDS)


def scan(docs: DataFrame, source: str = "source", min_owners: int = 3, min_bits: float = 2.5, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per row of docs(doc_id, text, source): counts and spans of base kinds, all spans, live and example counts, and
    the most owners and repositories that one of its candidates has.

    The repository is the whole source and the owner its part before the first slash. A value of min_owners owners or more is
    an example. Further candidates become spans if they are no example and have min_bits of entropy a character; those, and
    base candidates that are no example, are live. Null and empty texts have no spans; a null source is one owner; repeated
    rows are reported each; further columns are ignored.
    """
    rows = cut(_scan(docs, source))
    each = rows.select("_row", "owner", "repository", F.explode("candidates").alias("c")).select(
        "_row", "owner", "repository", "c.*"
    )
    # most values have one owner and one repository, and need no join
    common = cut(ownership(each, min_owners).filter("n_repositories > 1"))
    if fits(common, broadcast_rows):
        known = each.join(F.broadcast(common), "hash", "left")
    else:
        known = spread_join(cut(each), common, "hash", "_row", "left")
    example = F.coalesce("example", F.lit(False))
    shown = F.col("kind").isin(*BASE) | (~example & (F.col("bits") >= min_bits))
    judged = known.groupBy("_row").agg(
        F.count_if(~example & shown).alias("n_live"),
        F.count_if(example).alias("n_example"),
        F.max(F.coalesce("n_owners", F.lit(1))).alias("n_owners"),
        F.max(F.coalesce("n_repositories", F.lit(1))).alias("n_repositories"),
        F.collect_list(
            F.when(shown, F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order"), "end", "kind"))
        ).alias("found"),
    )
    spans = F.array_join(
        F.transform(F.array_sort("found"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    return rows.join(judged, "_row", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base",
        F.coalesce(spans, F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce("n_owners", F.lit(0)).alias("n_owners"),
        F.coalesce("n_repositories", F.lit(0)).alias("n_repositories"),
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example", "n_owners", "n_repositories"
    )


def _redacted(text: str | None, spans) -> str | None:
    if text is None or not spans:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        parts += [text[at:start], f"[{kind} removed]"]
        at = end
    return "".join([*parts, text[at:]])


def _merged(found) -> list[tuple[str, int, int]]:
    """Overlapping spans as one, under the kind of the first."""
    out: list[list] = []
    for kind, a, b, *_ in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))):
        if out and a < out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([kind, a, b])
    return [tuple(x) for x in out]


def redact(
    docs: DataFrame, source: str = "source", min_owners: int = 3, min_bits: float = 2.5, broadcast_rows: int = 200_000
) -> DataFrame:
    """docs with every live-looking secret of its text replaced by "[kind removed]"; examples stay. All columns stay.

    Null and empty texts stay as they are; a null source is one owner; repeated rows are each redacted; an empty table gives no
    rows. Values of many owners are broadcast where they are few; otherwise the verdicts are joined to the documents' candidates.
    """
    seen = _scan(docs, source).select("owner", "repository", F.explode("candidates.hash").alias("hash"))
    examples = cut(ownership(seen, min_owners).filter("example").select("hash"))
    columns = docs.columns
    if fits(examples, broadcast_rows):
        held = docs.sparkSession.sparkContext.broadcast(frozenset(r.hash for r in examples.toLocalIterator()))

        def live(texts):
            out = []
            for t in texts:
                kept = []
                for c in candidates_of(t):
                    h = hashlib.sha256(c[3].encode("utf-8", "surrogatepass")).hexdigest()
                    if h not in held.value and (c[0] in BASE or _entropy(c[3]) >= min_bits):
                        kept.append(c)
                out.append(_redacted(t, _merged(kept)))
            return [out]

        rest = [c for c in columns if c != "text"]
        return map_text(docs, rest, "text", live, "text string").select(*columns)
    rows = cut(_scan(packed(docs, source), source, ("text", "_doc")))
    each = rows.select("_row", F.explode("candidates").alias("c")).select("_row", "c.*")
    found = spread_join(cut(each), examples.withColumn("_example", F.lit(True)), "hash", "_row", "left").filter("_example IS NULL")
    kept = found.filter(F.col("kind").isin(*BASE) | (F.col("bits") >= min_bits))
    by_row = kept.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("spans"))
    order = rows.select("_row", "text", "_doc").join(by_row, "_row", "left")
    order = order.withColumn("order", F.when(F.col("spans").isNotNull(), F.to_json(F.struct("text", "spans"))))

    def apply(orders):
        out = []
        for o in orders:
            o = json.loads(o) if o else None
            out.append(_redacted(o["text"], _merged((s["kind"], s["start"], s["end"]) for s in o["spans"])) if o else None)
        return [out]

    done = map_text(order, ["_doc"], "order", apply, "new string")
    return done.select(*(F.coalesce("new", "_doc.text").alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in columns))
