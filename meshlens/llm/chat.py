r"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

An example is ``<s>`` and, for each turn up to its target, ``[INST]role[/INST]text</s>``; only the target's text is under the
loss mask, all turns before it are context. Roles and texts are escaped so that no control string can come from
them: a backslash is doubled, and ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` get a backslash after their first character.
Undoing this gives the very text back, and cutting an example at its control strings the very turns.

Turns are escaped and written where they lie; one shuffle by conversation orders them, and a running window joins each
prefix. An example is one row, so a conversation must fit in one; its examples together hold the square of
its turns, which is what the method asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain

BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"


def escaped(text: Column) -> Column:
    """``text`` without control strings, reversibly; null is empty."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, "<(/?s>)", r"<\\$1"), r"\[(/?INST\])", r"[\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """Examples (conv_id, example, text, loss_start, loss_end, whole) of conversations with the columns conv_id, turn, role, text.

    ``loss_start`` and ``loss_end`` bound the trainable code points of ``text``. Examples are numbered from 0 in the order
    of their targets. ``whole`` marks the one that holds all turns; where no target is last, one more example without
    trainable text has them, so that every turn is written. Null roles and texts are empty; turns go by number, null ones
    first, equal ones by role, text; repeated turns all count; a null conv_id is one conversation; an empty table gives no example.
    """
    rows = plain(conversations, "conv_id", "turn", "role", "text")
    body = escaped(F.col("text"))
    turns = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("raw"),
        F.concat(F.lit(HEAD), escaped(F.col("role")), F.lit(BODY), body, F.lit(END)).alias("written"), F.length(body).alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "raw")
    prefix = F.array_join(F.collect_list("written").over(order.rowsBetween(Window.unboundedPreceding, 0)), "")
    hit = F.col("role") == target
    numbered = turns.select(
        "conv_id", hit.alias("hit"), "size", F.lead(F.lit(1)).over(order).isNull().alias("whole"),
        (F.sum(hit.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - hit.cast("long")).alias("example"),
        F.when(hit | F.lead(F.lit(1)).over(order).isNull(), F.concat(F.lit(BEGIN), prefix)).alias("text"),
    ).where("hit OR whole")
    stop = F.length("text") - len(END)
    return numbered.select(
        "conv_id", "example", "text", F.when(F.col("hit"), stop - F.col("size")).cast("long").alias("loss_start"),
        F.when(F.col("hit"), stop).cast("long").alias("loss_end"), "whole",
    )


def turns_of(text: Column) -> Column:
    """The (role, text) pairs of an example, read back from it."""
    parts = F.split(F.substring(text, F.lit(len(BEGIN) + 1), F.length(text) - len(BEGIN)), END)
    cut = lambda x, i: unescaped(F.split(F.substring(x, F.lit(len(HEAD) + 1), F.length(x)), r"\[/INST\]")[i])
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.struct(cut(x, 0).alias("role"), cut(x, 1).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """What a reader finds in ``examples``: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation.

    Turns come from the example with all of them, trainable texts from the masks of all examples, in order. ``formatted_chars`` are
    the code points of all examples of the conversation.
    """
    back = turns_of(F.col("text"))
    said = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescaped(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    read = examples.select(
        "conv_id", F.when(F.col("whole"), F.size(back)).alias("n"), F.when(F.col("whole"), F.sha2(said, 256)).alias("turns"),
        F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("loss"))).alias("loss"), F.length("text").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("turns").alias("turns_sha256"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["loss"]), "").alias("_loss"),
    )
    return whole.select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def sql() -> str:
    """DuckDB's SQL for ``digests`` of all conversations and of conversation -1, from the rows themselves."""
    esc = r"regexp_replace(regexp_replace(replace({}, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"
    own = len(HEAD + BODY + END)
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
w AS (SELECT *, {len(BEGIN)} + sum(length({esc.format('role')}) + length({esc.format('text')}) + {own}) OVER o AS size, lead(1) OVER o IS NULL AS ended
 FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(size) FILTER (role = 'assistant' OR ended) AS BIGINT) AS formatted_chars FROM w GROUP BY conv_id"""
