"""Chat formatting in Spark expressions only: sort collected turn structs, merge adjacent turns of a role, concatenate.

Template, one block for each run of turns of the same role:

    user       [INST]text[/INST]
    assistant  <s>text</s>              what stands between these marks is under the loss mask
    other      [ROLE]role[:]text[/ROLE]

and [TURN] between the turns of a run. A mark inside a text or role is escaped by a backslash after its first
character, and one more is added to those that already stand there, so that reading back takes exactly one away.

A conversation's rows are put in order by turn, then role, then text (nulls count as empty), so ties are settled by
what they hold; repeated rows are repeated turns. The output is one string for each conversation, which bounds what
a task gathers: a conversation must fit in a row. A null conv_id is a conversation too; an empty table gives an empty
result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks consist of: a first character, backslashes of the escape, and the rest.
MARK_HEAD = r"([\[<])"
MARK_REST = r"(/?(?:INST|ROLE|TURN|:)\]|/?s>)"
BLOCK = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\]"
USER, ASSISTANT = "user", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, MARK_HEAD + r"(\\*)" + MARK_REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, MARK_HEAD + r"\\(\\*)" + MARK_REST, "$1$2$3")


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id and formatted."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    t = F.col("t")

    def opening(x: Column) -> Column:
        return F.when(x["role"] == USER, "[INST]").when(x["role"] == ASSISTANT, "<s>").otherwise(F.concat(F.lit("[ROLE]"), escape(x["role"]), F.lit("[:]")))

    def closing(x: Column) -> Column:
        return F.when(x["role"] == USER, "[/INST]").when(x["role"] == ASSISTANT, "</s>").otherwise("[/ROLE]")

    def piece(x: Column, i: Column) -> Column:
        joins = (i > 0) & (F.get(t, i - 1)["role"] == x["role"])
        goes_on = (i < F.size(t) - 1) & (F.get(t, i + 1)["role"] == x["role"])
        return F.concat(F.when(joins, "[TURN]").otherwise(opening(x)), escape(x["text"]), F.when(goes_on, "").otherwise(closing(x)))

    return rows.select("conv_id", F.array_join(F.transform(t, piece), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and formatted -> with turns (array of role, text, masked), unescaped; masked: under the loss mask."""

    def turns_of(block: Column) -> Column:
        user, assistant = block.startswith("[INST]"), block.startswith("<s>")
        inner = F.when(user, block.substr(F.lit(7), F.length(block) - 13)).when(assistant, block.substr(F.lit(4), F.length(block) - 7)).otherwise(block.substr(F.lit(7), F.length(block) - 13))
        at = F.instr(inner, "[:]")
        role = F.when(user, USER).when(assistant, ASSISTANT).otherwise(unescape(inner.substr(F.lit(1), at - 1)))
        body = F.when(user | assistant, inner).otherwise(inner.substr(at + 3, F.length(inner)))
        return F.transform(F.split(body, r"\[TURN\]", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"), assistant.alias("masked")))

    blocks = F.regexp_extract_all("formatted", F.lit(BLOCK), F.lit(0))
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns_of)))


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns, from what is read back out of the formatted strings."""
    back = read_back(formatted)
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["masked"]), lambda x: x["text"]), "")
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
