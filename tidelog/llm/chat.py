"""Chat formatting with Spark expressions only: rows of turns become one marked string each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEPARATE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
SEGMENTS = "array<struct<piece:string,loss:boolean>>"


def escape(text: Column) -> Column:
    r"""Make control strings in a text harmless: a backslash is doubled, then <| becomes <\|."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As for texts; a line break, which ends the role in the template, becomes <\n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_chats(rows: DataFrame) -> DataFrame:
    r"""(conv_id, formatted, segments) for every conv_id among ``rows`` (conv_id, turn, role, text).

    Turns are sorted by turn, then role and text where turns tie. Adjacent turns of one role share one
    block, <|im_start|>role\ntext<|im_sep|>text<|im_end|>\n, so nothing of a turn is lost by merging.
    ``segments`` cuts ``formatted`` into pieces; loss is true for the texts of the assistant.

    A null role or text is empty; a null turn comes first; rows with a null conv_id are one
    conversation. Repeated rows are turns of their own. An empty table gives no rows. Other columns are
    not read. One conversation is one string of the result, so its rows do meet in one task.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    with_starts = sorted_turns.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(
                F.slice(F.col("turns"), s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                lambda t: t["text"],
            ).alias("texts"),
        ),
    )
    piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))
    no = F.lit(False)
    of_block = lambda b: F.concat(
        F.array(piece(F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit("\n")), no)),
        F.flatten(
            F.transform(
                b["texts"],
                lambda x, i: F.array(
                    piece(F.when(i > 0, F.lit(SEPARATE)).otherwise(F.lit("")), no),
                    piece(escape(x), b["role"] == "assistant"),
                ),
            )
        ),
        F.array(piece(F.lit(CLOSE), no)),
    )
    segments = F.flatten(F.transform("blocks", of_block)).cast(SEGMENTS)
    return (
        with_starts.withColumn("blocks", blocks)
        .select("conv_id", segments.alias("segments"))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments")
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array of role and text, loss_text) parsed from ``formatted`` and its loss mask."""
    quoted = CLOSE.replace("|", r"\|")
    blocks = F.filter(F.split("formatted", quoted), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape_role(F.substring(head, len(OPEN) + 1, F.length(head)))
        body = F.substring(block, F.length(head) + 2, F.length(block))
        return F.transform(
            F.split(body, SEPARATE.replace("|", r"\|")), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))
        )

    return chats.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.array_join(
            F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"])), ""
        ).alias("loss_text"),
    )
