"""Fill-in-middle transformation by escaped marker injection, in Spark expressions only.

A text is cut into units, a word with the white space before it, or white space at the end. The delimiter and the escape
character are escaped inside the text, one regular expression puts a delimiter after every unit, and the delimiters are
counted. A document draws two of the places between units; substring_index takes the parts before, between and behind them,
and the parts are unescaped and put together behind their markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands after every unit, and the character that escapes it; neither is white space, so escaping moves no unit's border.
DELIMITER, ESCAPE = "\x01", "\x02"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _until(text: Column, delimiter: str, count) -> Column:
    """substring_index with a count from a column."""
    return F.call_function("substring_index", text, F.lit(delimiter), count if isinstance(count, Column) else F.lit(count))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the digest of seed and doc_id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, fim_percent: int = 50, spm_percent: int = 80, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, n (units), form, prefix, middle, suffix (null if plain), output.

    Of all documents fim_percent are transformed, and of those spm_percent give the suffix first (form spm), the others the
    prefix (psm). A text stays plain where it is empty or holds a marker, as its output could not be read back. Null texts are
    empty. The draws depend on seed and doc_id only, so repeated rows come out alike. Further columns are ignored unless named
    in keep; an empty table gives no rows.
    """
    carry = list(dict.fromkeys(("doc_id", *keep)))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*carry, text.alias("_text"), h1.alias("_h1"), h2.alias("_h2"), h3.alias("_h3"), h4.alias("_h4"))
    held = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("_text", F.lit(marker))
    plain = (F.col("_text") == "") | held | (F.col("_h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    marked = rows.select("*", form.alias("form"), F.regexp_replace(escape(F.col("_text")), f"({UNIT})", f"$1{DELIMITER}").alias("_marked"))
    counted = marked.select("*", (F.length("_marked") - F.length(F.replace("_marked", F.lit(DELIMITER)))).alias("_n"))
    first, second = F.col("_h1") % (F.col("_n") + 1), F.col("_h2") % (F.col("_n") + 1)
    placed = counted.select("*", F.least(first, second).cast("int").alias("_a"), F.greatest(first, second).cast("int").alias("_b"))
    # the k-th unit from the left ends with the k-th delimiter; from the right, the last delimiter has nothing behind it
    left = _until(F.col("_marked"), DELIMITER, F.col("_b"))
    cut = placed.select(
        *carry, "form", "_text", "_n",
        F.when(F.col("form") != "plain", _until(left, DELIMITER, F.col("_a"))).alias("_prefix"),
        F.when(F.col("form") != "plain", _until(left, DELIMITER, F.col("_a") - F.col("_b"))).alias("_middle"),
        F.when(F.col("form") != "plain", _until(F.col("_marked"), DELIMITER, F.col("_b") - F.col("_n") - 1)).alias("_suffix"),
    )
    part = lambda name: unescape(F.replace(name, F.lit(DELIMITER))).alias(name[1:])
    parts = cut.select(*carry, "form", "_text", "_n", part("_prefix"), part("_middle"), part("_suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    return parts.select(*carry, F.col("_n").cast("long").alias("n"), "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that transform() made output of; no text with a marker was transformed, so each marker stands once."""
    before = lambda marker: _until(output, marker, 1)
    behind = lambda marker: _until(output, marker, -1)
    prefix_psm, suffix_psm = _until(behind(PREFIX), SUFFIX, 1), _until(behind(SUFFIX), MIDDLE, 1)
    suffix_spm, prefix_spm = _until(before(PREFIX), SUFFIX, -1), _until(behind(PREFIX), MIDDLE, 1)
    middle = behind(MIDDLE)
    return (
        F.when(form == "psm", F.concat(prefix_psm, middle, suffix_psm))
        .when(form == "spm", F.concat(prefix_spm, middle, suffix_spm))
        .otherwise(output)
    )


def digests(made: DataFrame) -> DataFrame:
    return made.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
