"""Column builders: terms, ids, previews, token counts, globs, decay. All stay inside Spark expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node types by number, and those that name code.
NODE_TYPES = ("section", "code_block", "paragraph", "function", "class", "struct", "method", "chunk")
CODE_TYPES = (3, 4, 5, 6)


def _folds() -> tuple[str, str]:
    """Accented letters up to U+1EFF and the letters below their accents."""
    pairs = [
        (chr(c), d[0])
        for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
        if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()


def tokens(text: Column) -> Column:
    """Full-text tokens: runs of letters, numbers and private-use characters, lower-cased, without accents."""
    folded = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def norm(text: Column) -> Column:
    """Tokens with a space before and after each, so a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def token_pattern(words: list[str]) -> str:
    """Regex that finds these tokens, one after another, in lower-cased text: norm() without the work of making it."""
    letter, other = r"[\p{L}\p{N}\p{Co}]", r"[^\p{L}\p{N}\p{Co}]"
    alike: dict[str, str] = {}
    for accented, plain in zip(ACCENTED, PLAIN, strict=True):
        alike[plain] = alike.get(plain, "") + accented
    forms = ["".join(f"[{c}{alike[c]}]" if c in alike else re.escape(c) for c in w) for w in words]
    return f"(?<!{letter}){f'{other}+'.join(forms)}(?!{letter})"


def split_terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters, numbers and underscores, in order of first use."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != ""))


def terms_of(text: str) -> list[str]:
    """split_terms() of a literal."""
    return list(dict.fromkeys(t for t in re.split(r"[^\w]+", text.lower()) if t))


def handle_id(path: Column, node_type: Column, start: Column, end: Column) -> Column:
    key = F.concat_ws(":", path, node_type.cast("string"), F.concat_ws("-", start.cast("string"), end.cast("string")))
    return F.concat(F.lit("h"), F.substring(F.sha2(key, 256), 1, 24))


def raw_id(handle: Column) -> Column:
    """24 hex digits of a handle id with or without its h; null for anything else."""
    bare = F.regexp_replace(handle, "^h", "")
    return F.when(bare.rlike("^[0-9a-f]{24}$"), bare)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes start to end of text, cut inwards to whole characters."""
    part = F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))
    shown = F.make_valid_utf8(part.cast("string"))
    cut = F.octet_length(text) > end
    whole = F.when(cut, F.regexp_replace(shown, "�+$", "")).otherwise(shown)
    return F.when(start > 0, F.regexp_replace(whole, "^�+", "")).otherwise(whole)


def preview(text: Column, start: Column, end: Column, most: int = 100) -> Column:
    """First bytes of a node, white space collapsed, with dots if there are more."""
    shown = byte_slice(text, start, F.least(end, start + most))
    return F.concat(F.trim(F.regexp_replace(shown, r"\s+", " ")), F.when(end - start > most, "...").otherwise(""))


def token_count(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("int")


def line_of(text: Column, byte: Column) -> Column:
    """1-based line that a byte is in."""
    before = F.substring(F.encode(text, "UTF-8"), F.lit(1), byte.cast("int"))
    return F.size(F.split(F.make_valid_utf8(before.cast("string")), "\n")).cast("int")


def file_type(path: Column) -> Column:
    """Language by file extension."""
    known = {
        "md": "markdown", "markdown": "markdown", "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript",
        "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript",
        "cts": "typescript", "go": "go",
    }
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), ext), F.lit("other"))


def glob_regex(glob: str) -> str:
    """Of a glob in which stars and question marks match slashes too, with {a,b} and [..]."""
    out, depth, k = [], 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 2
        elif c == "*":
            while k + 1 < len(glob) and glob[k + 1] == "*":
                k += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]")
            k = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        k += 1
    return f"^{''.join(out)}$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(f"(?s){glob_regex(glob)}")


def decay(age: Column, half_life_days: float) -> Column:
    return F.exp(-F.greatest(age, F.lit(0)) * F.log(F.lit(2.0)) / F.lit(max(half_life_days * 86_400.0, 1.0)))


def humane_age(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(seconds, F.lit(" seconds ago")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit(" minutes ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600), F.lit(" hours ago")))
        .otherwise(F.concat(F.floor(seconds / 86400), F.lit(" days ago")))
    )


def duration_seconds(text: str, default: int = 3600) -> int:
    """Of 30s, 5m, 1h or 2d; default for anything else."""
    m = re.fullmatch(r"(\d+)([smhd])", text.strip())
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]] if m else default


def metadata_json(node_type: Column, name: Column, heading: Column, parent: Column) -> Column:
    """What a node is, as JSON: its kind, and of name, heading and parent those that it has."""
    kinds = F.array(*map(F.lit, NODE_TYPES))
    return F.to_json(F.struct(F.element_at(kinds, node_type + 1).alias("kind"), name.alias("name"), heading.alias("heading"), parent.alias("parent")))


def metadata_of(text: Column) -> Column:
    """metadata_json() read back, as a struct."""
    return F.from_json(text, "kind string, name string, heading string, parent string")
