"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with
all turns before it as context and only its reply trainable.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` per turn. Inside roles and texts a backslash is doubled
and ``<|`` is written ``<\\|``, so no control string of the template can occur there; newlines in roles are
written ``\\n``. A conversation that does not end in a reply gets one more example, with nothing trainable,
for the turns after its last reply, so the output holds every turn. Null roles and texts count as empty; a null conversation id
is an id of its own; turns of equal number are ordered by role and text; an empty table gives an empty
result; further columns are ignored; equal turns are all kept. One conversation is one row here, as each example holds its context whole: texts may be of
any length, but the examples' total is quadratic in a conversation's replies, as the method has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(text: Column, role: bool = False) -> Column:
    """The inverse of ``escaped``: pieces between doubled backslashes are read apart."""

    def piece(x: Column) -> Column:
        out = F.replace(x, F.lit("<\\|"), F.lit("<|"))
        return F.replace(out, F.lit("\\n"), F.lit("\n")) if role else out

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def expand(turns: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), formatted, loss_start, loss_end (code points; equal: nothing trainable), last."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    shown = convs.select(
        "conv_id",
        F.transform("t", lambda t: F.concat(F.lit(START), escaped(t["role"], True), F.lit("\n"), escaped(t["text"]), F.lit(END))).alias("shown"),
        F.filter(F.transform("t", lambda t, i: F.when((t["role"] == TARGET) | (i == F.size("t") - 1), i)), lambda i: i.isNotNull()).alias("ends"),
        F.transform("t", lambda t: F.when(t["role"] == TARGET, F.length(escaped(t["text"]))).otherwise(0)).alias("reply"),
    )
    each = shown.select("conv_id", "shown", "reply", F.size("ends").alias("n"), F.posexplode("ends").alias("example", "i"))
    whole = each.select("conv_id", "example", F.array_join(F.slice("shown", 1, F.col("i") + 1), "").alias("formatted"), F.col("reply")[F.col("i")].alias("_r"), (F.col("example") == F.col("n") - 1).alias("last"))
    end = F.length("formatted") - len(END)
    return whole.select("conv_id", F.col("example").cast("int"), "formatted", (end - F.col("_r")).alias("loss_start"), end.alias("loss_end"), "last")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, parsed from the formatted examples alone: turns (role, text) and the trained text."""
    taught = F.struct("example", unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("s"))
    by = examples.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("formatted"))).alias("_whole"),
        F.sort_array(F.collect_list(taught)).alias("_taught"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    parts = F.transform(F.array_compact(F.transform(F.split("_whole", r"<\|im_end\|>\n"), lambda s: F.when(s != "", F.substring(s, len(START) + 1, 2**30)))), lambda s: F.struct(unescaped(F.substring_index(s, "\n", 1), True).alias("role"), unescaped(F.substring(s, F.locate("\n", s) + 1, F.length(s))).alias("text")))
    return by.select("conv_id", parts.alias("turns"), F.array_join(F.transform("_taught", lambda x: x["s"]), "").alias("trained"), F.col("formatted_chars").cast("long"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, TARGET, hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(expand(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
r AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
             + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 12 + 11) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
