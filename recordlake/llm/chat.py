"""Chat formatting: one training example for every assistant turn.

A turn is written ``### role: text</turn>`` and a line feed.  Inside roles and texts
the signs that the template is made of are written as two: backslash as ``\\b``,
``#`` as ``\\h``, ``<`` as ``\\l``, and in roles ``:`` as ``\\c``; so a control
string never stands in a text, and reading back is exact.

Contract of edge cases: a null role or text is empty; turns are ordered by turn
number (null first), then role, then text, so ties and repeated rows have one
order and are all kept; rows without a conversation id are one conversation; a
conversation that does not end with an assistant turn has one more example, with
all its turns and nothing trainable; an empty table has no examples.  An example
holds its whole context, so it is as long as the conversation up to its reply.
Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>\n"


def _escaped(sql: str, role: bool = False) -> str:
    out = f"replace(replace(replace({sql}, '\\\\', '\\\\b'), '#', '\\\\h'), '<', '\\\\l')"
    return f"replace({out}, ':', '\\\\c')" if role else out


def unescape(sql: str) -> str:
    """SQL that reads an escaped role or text back."""
    return (
        f"replace(replace(replace(replace({sql}, '\\\\c', ':'), '\\\\l', '<'), '\\\\h', '#'), '\\\\b', '\\\\')"
    )


def chat_examples(
    turns: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """conv_id, example_no, is_last, formatted, loss_start, loss_length (code points, from 0).

    Each turn of ``trained_role`` is expanded to all turns before it and itself, of
    which only its own text is trainable.  One shuffle, by conversation.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("__t"))
    head = f"concat('### ', {_escaped('t.role', role=True)}, ': ')"
    parts = f"transform(__t, t -> struct(t.role AS role, {head} AS head, {_escaped('t.text')} AS body))"
    ordered = ordered.select("conv_id", F.expr(parts).alias("__p"))
    trained = F.expr("filter(sequence(1, size(__p)), i -> __p[i - 1].role = :role)".replace(":role", f"'{trained_role}'"))
    tail = F.expr("IF(size(__ends) = 0 OR element_at(__ends, -1) < size(__p), concat(__ends, array(size(__p))), __ends)")
    examples = ordered.withColumn("__ends", trained).withColumn("__all", tail)
    examples = examples.select("conv_id", "__p", "__ends", F.posexplode("__all").alias("example_no", "__end"))
    is_trained = F.expr("example_no < size(__ends)")
    context = "array_join(transform(slice(__p, 1, __end - 1), t -> concat(t.head, t.body, '</turn>\n')), '')"
    return (
        examples.withColumn("__reply", F.expr("__p[__end - 1]"))
        .withColumn("__before", F.expr(f"concat({context}, __reply.head)"))
        .select(
            "conv_id",
            "example_no",
            F.expr("__end = size(__p)").alias("is_last"),
            F.expr("concat(__before, __reply.body, '</turn>\n')").alias("formatted"),
            F.expr("CAST(length(__before) AS BIGINT)").alias("loss_start"),
            F.when(is_trained, F.expr("CAST(length(__reply.body) AS BIGINT)")).otherwise(F.lit(0)).alias("loss_length"),
        )
    )


def read_turns(formatted: str) -> str:
    """SQL for the (role, text) structs that a formatted text holds."""
    blocks = f"transform(split({formatted}, '</turn>\n', -1), b -> substring(b, 5))"
    filled = f"slice({blocks}, 1, greatest(size({blocks}) - 1, 0))"
    cut = "instr(b, ': ')"
    role, text = unescape(f"substring(b, 1, {cut} - 1)"), unescape(f"substring(b, {cut} + 2)")
    return f"transform({filled}, b -> struct({role} AS role, {text} AS text))"


def conversation_digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the examples' texts and masks alone.

    Examples of a conversation already lie together, so nothing is shuffled again.
    """
    loss = unescape("substring(formatted, CAST(loss_start + 1 AS INT), CAST(loss_length AS INT))")
    turns = read_turns("formatted")
    said = f"array_join(transform({turns}, t -> concat(t.role, '\n', t.text, '\n')), '')"
    each = examples.select(
        "conv_id",
        "example_no",
        F.expr(loss).alias("loss"),
        F.expr("CAST(length(formatted) AS BIGINT)").alias("chars"),
        F.expr(f"IF(is_last, CAST(size({turns}) AS BIGINT), NULL)").alias("n_turns"),
        F.expr(f"IF(is_last, sha2({said}, 256), NULL)").alias("turns_sha256"),
    )
    return (
        each.groupBy("conv_id")
        .agg(
            F.max("n_turns").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            F.array_sort(F.collect_list(F.struct("example_no", "loss"))).alias("__losses"),
            F.sum("chars").alias("formatted_chars"),
        )
        .withColumn("__loss", F.expr("array_join(transform(__losses, x -> x.loss), '')"))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.expr("CAST(length(__loss) AS BIGINT)").alias("loss_chars"),
            F.sha2("__loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
