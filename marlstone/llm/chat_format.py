"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role merged into a block by array
slices, and the pieces concatenated. The output keeps the boundaries of merged turns, so it reads back exactly.

Template: ``<|im_start|>role\\n text (<|im_sep|> text)* <|im_end|>\\n`` for each block. Inside roles and texts a backslash
is put after every ``<`` that ``|`` or a backslash follows, so no control string can occur there; roles also write a line
feed as ``<|nl|>``, the only control string allowed in the role line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP, NEWLINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(?=[|\\])", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(?=[|\\])", "<")


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, text): conv_id, segments, formatted.

    segments: array of (text, loss) whose texts concatenate to formatted; loss marks what the model is trained on.
    Turns sort by turn (null first), then role, then text, so ties and repeated rows have one defined order. Null roles and
    texts count as empty. Rows of a null conv_id form one conversation of their own. Other columns are ignored; an empty
    table gives no rows.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    starts = sorted_turns.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: (i == 0) | (F.col("turns")[i].role != F.col("turns")[F.greatest(i - 1, F.lit(0))].role),
        ),
    )
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.col("turns")[s].role.alias("role"),
            F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s).alias("turns"),
        ),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    shown = lambda role: F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))

    def pieces(block: Column) -> Column:
        trained = block.role.isin(*loss_roles)
        texts = F.flatten(
            F.transform(
                block.turns,
                lambda t, i: F.when(i == 0, F.array(piece(escape(t.text), trained))).otherwise(
                    F.array(piece(F.lit(SEP), F.lit(False)), piece(escape(t.text), trained))
                ),
            )
        )
        return F.concat(
            F.array(piece(F.concat(F.lit(START), shown(block.role), F.lit("\n")), F.lit(False))),
            texts,
            F.array(piece(F.lit(END + "\n"), F.lit(False))),
        )

    return starts.select(
        "conv_id", F.flatten(F.transform(blocks, pieces)).alias("segments")
    ).select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role, text) parsed from formatted, loss_text: the unescaped text under the mask."""
    body = F.transform(
        F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != ""),
        lambda b: F.substring(b, F.lit(1), F.length(b) - len(END) - 1),
    )

    def of_block(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = unescape(F.replace(head, F.lit(NEWLINE), F.lit("\n")))
        return F.transform(
            F.split(F.substring(b, F.length(head) + 2, F.length(b)), r"<\|im_sep\|>"),
            lambda text: F.struct(role.alias("role"), unescape(text).alias("text")),
        )

    masked = F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text))
    return formatted.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(body, of_block)).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
