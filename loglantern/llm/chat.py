r"""Operator 5: conversations as one marked text each, in Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn (then role,
then text). Neighbours of one role share a block:

    <|turn|>role<|text|>first text<|next|>next text<|end|>

In roles and texts a backslash follows each ``<``, ``[`` and ``\``. So no control string
of this or another usual template (``<s>``, ``</s>``, ``[INST]``, ``<|...|>``) stands in
them, and taking those backslashes away gives the text back. ``loss_runs`` has, for each
marker and text in order, its code points and whether the loss counts them: the texts of
the assistant, nothing else.

Defined cases: null text and null role count as empty; null turns come first; turns that
are equal stay apart, each as often as it occurs; a null conv_id is a conversation of its
own; of no rows comes none; other columns do not matter. One conversation is one output
row, so its turns meet in one task; all steps there are linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.common import pick, table

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
LOSS_ROLE = "assistant"

#: Before and after a marker. Texts hold no ``<|``, so nothing else is split.
_BORDERS = r"(?=<\|)|(?<=<\|(?:turn|text|next|end)\|>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_runs: array of (chars, loss), in order."""
    sorted_turns = (
        pick(turns, "conv_id", "turn", "role", "text")
        .select("conv_id", F.struct("turn", _empty(F.col("role")).alias("role"), _empty(F.col("text")).alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    t = F.col("turns")

    def parts(turn: Column, i: Column) -> Column:
        """The pieces of one turn: the block opens and closes where the role changes."""
        opens = ~turn["role"].eqNullSafe(F.get(t, i - 1)["role"])
        closes = ~turn["role"].eqNullSafe(F.get(t, i + 1)["role"])

        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        no = F.lit(False)
        head = F.array(piece(F.lit(TURN), no), piece(escaped(turn["role"]), no), piece(F.lit(TEXT), no))
        body = F.array(piece(escaped(turn["text"]), turn["role"] == LOSS_ROLE))
        tail = F.array(piece(F.lit(END), no))
        none = F.filter(tail, lambda _: no)
        return F.concat(F.when(opens, head).otherwise(F.array(piece(F.lit(NEXT), no))), body, F.when(closes, tail).otherwise(none))

    pieces = sorted_turns.select("conv_id", F.filter(F.flatten(F.transform(t, parts)), lambda p: p["text"] != "").alias("pieces"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.char_length(p["text"]).cast("long").alias("chars"), p["loss"].alias("loss"))).alias("loss_runs"),
    )


def read_chat(chats: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text), loss_texts: the texts under the mask.

    Fails where the runs of the mask do not fit the pieces of the text.
    """
    pieces = chats.select("conv_id", "formatted", "loss_runs", F.filter(F.split("formatted", _BORDERS), lambda p: p != "").alias("pieces"))
    paired = F.arrays_zip(F.col("pieces").alias("text"), F.col("loss_runs").alias("run"))
    checked = F.transform(
        paired,
        lambda p: F.when(F.char_length(p["text"]).cast("long").eqNullSafe(p["run"]["chars"]), p["text"]).otherwise(
            F.raise_error(F.lit("the loss mask does not fit the text"))
        ),
    )
    blocks = F.filter(F.split("formatted", F.lit("<\\|turn\\|>")), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = unescaped(F.substring_index(block, TEXT, 1))
        body = F.substring_index(F.substring_index(block, TEXT, -1), END, 1)
        return F.transform(F.split(body, r"<\|next\|>"), lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))

    loss = F.filter("texts", lambda _, i: F.get("loss_runs", i)["loss"])
    return pieces.withColumn("texts", checked).select(
        "conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.transform(loss, unescaped).alias("loss_texts")
    )


def _guard(spark: SparkSession) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit(said).alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(_guard(spark))
    read = read_chat(format_chat(rows))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), F.array_join(told, "").alias("told"), F.array_join("loss_texts", "").alias("loss")).select(
        "conv_id",
        "n_turns",
        F.sha2("told", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_length(text: str) -> str:
    """Code points after escaping."""
    return f"(2 * length({text}) - length(regexp_replace({text}, '[<\\[\\\\]', '', 'g')))"


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c
), p AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256,
       CAST(sum({_sql_length("text")} + CASE WHEN before IS NULL OR before <> role
            THEN {len(TURN + TEXT + END)} + {_sql_length("role")} ELSE {len(NEXT)} END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
