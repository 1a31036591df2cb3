"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every trainable turn becomes its own example: all turns before it as context and only that reply under the loss mask. A conversation that
does not end with a trainable turn gets one more example without a mask, so that no turn is lost.

Template: ``### <role>: <text></turn>`` and a newline for each turn. Inside roles and texts ``\\``, ``#`` and ``<`` are written ``\\b``, ``\\h``
and ``\\l`` (and ``:`` in roles ``\\c``), so no control string can occur in them and reading back is exact.

Defined results: a null role or text counts as empty; turns are ordered by (turn, role, text), nulls first, and repeated rows stay;
conversations with a null id form one conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Control strings of the template and the escapes of the characters that they are made of.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = {"\\": "\\b", "#": "\\h", "<": "\\l"}
ROLE_ESCAPES = ESCAPES | {":": "\\c"}


def escape(text: Column, table: dict[str, str] = ESCAPES) -> Column:
    for k, v in table.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def unescape(text: Column) -> Column:
    for k, v in reversed(ROLE_ESCAPES.items()):
        text = F.replace(text, F.lit(v), F.lit(k))
    return text


def format_examples(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """conv_id, position (of the last turn, from 1), whole (last example of its conversation), text, mask_start and mask_chars (code points; 0 chars: nothing is trained)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn(
        "part", F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(SEP), escape(F.col("text")), F.lit(CLOSE))
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    told = turns.select(
        "conv_id",
        F.row_number().over(order).alias("position"),
        F.lead(F.lit(False), 1, True).over(order).alias("whole"),
        (F.col("role") == trainable).alias("trained"),
        F.length(escape(F.col("text"))).alias("n"),
        F.collect_list("part").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("parts"),
    ).where("trained or whole")
    full = F.array_join("parts", "")
    return told.select("conv_id", "position", "whole", full.alias("text"), "trained", "n").select(
        "conv_id",
        "position",
        "whole",
        "text",
        (F.length("text") - F.col("n") - len(CLOSE) + 1).alias("mask_start"),
        F.when(F.col("trained"), F.col("n")).otherwise(0).alias("mask_chars"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    head = len(OPEN)
    pieces = F.filter(F.split(text, CLOSE), lambda x: x != "")

    def turn(piece: Column) -> Column:
        at = F.instr(piece, SEP)
        return F.struct(
            unescape(F.substring(piece, F.lit(head + 1), at - F.lit(head + 1))).alias("role"),
            unescape(F.substring(piece, at + len(SEP), F.length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation with what its examples hold: all turns from the whole one, and the text under each loss mask, once and in order."""
    masked = unescape(F.substring("text", F.col("mask_start"), F.col("mask_chars")))
    rows = examples.select(
        "conv_id",
        F.when(F.col("whole"), F.col("text")).alias("all"),
        F.when(F.col("mask_chars") > 0, F.struct("position", masked.alias("loss"))).alias("loss"),
        F.length("text").cast("long").alias("n"),
    )
    per = rows.groupBy("conv_id").agg(F.max("all").alias("all"), F.array_sort(F.collect_list("loss")).alias("loss"), F.sum("n").alias("formatted_chars"))
    return per.select("conv_id", read_turns(F.col("all")).alias("turns"), F.array_join("loss.loss", "").alias("loss"), "formatted_chars")


def op2_chat_prefix_targets(spark, sf_dir: str) -> DataFrame:
    """Digest of the formatted conversations, with conversation -7, whose texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    back = read_back(format_examples(table.unionByName(own)))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The same digests from the plain rows. The template adds 13 characters a turn beside role and text, and one for each escaped character.
OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT *, 14 + length(role) + length(text)
    + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS n FROM t),
w AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    lead(1) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR last))::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""
