"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are context, only that reply is trainable.
Turns after the last reply (or a conversation without a reply) go to one more example with an empty loss mask, so that no
turn is lost. Output rows carry the real text and the loss span in code points.

Template: ``<|role:NAME:|>\\n`` TEXT ``<|end|>\\n``. Texts and roles are escaped reversibly: every backslash is doubled, then
a backslash is put after the first character of each control string (``<|``, ``|>``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``).

Defined cases: null text and null role are empty; turns of equal number are ordered by role, then text; repeated rows are
turns of their own; rows of a null conv_id form one conversation with a null id; an empty table gives no rows; other
columns are ignored. A conversation is read by one task: its text has to be one value for the output anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import empty_text, let

#: Zero-width places inside control strings where the escape goes.
_INSIDE_CONTROL = r"(?<=<)(?=\||/?s>)|(?<=\|)(?=>)|(?<=\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _INSIDE_CONTROL, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|role:"), escape(turn["role"]), F.lit(":|>\n"), escape(turn["text"]), F.lit("<|end|>\n"))


def expand(conversations: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_len): loss_start is 0-based, both in code points; loss_len 0 and
    is_tail true for the example without a trainable reply."""
    turns = conversations.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), empty_text(F.col("role")).alias("role"), empty_text(F.col("text")).alias("text")).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    cut = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.element_at("turns", k)["role"] == reply_role)
    grouped = grouped.select("conv_id", "turns", F.transform("turns", _render).alias("parts"), cut.alias("replies"))
    n = F.size("parts")
    ends = F.when(F.coalesce(F.array_max("replies"), F.lit(0)) == n, F.col("replies")).otherwise(F.concat("replies", F.array(n)))
    rows = grouped.select("conv_id", "turns", "parts", F.posexplode(ends).alias("example", "upto"))
    is_tail = F.element_at("turns", F.col("upto"))["role"] != reply_role
    prefix = F.array_join(F.slice("parts", F.lit(1), F.col("upto") - F.when(is_tail, 0).otherwise(1)), "")
    rows = rows.select(
        "conv_id", "example", is_tail.alias("is_tail"), prefix.alias("prefix"),
        F.when(is_tail, "").otherwise(F.concat(F.lit("<|role:"), escape(F.lit(reply_role)), F.lit(":|>\n"))).alias("head"),
        F.when(is_tail, "").otherwise(escape(F.element_at("turns", F.col("upto"))["text"])).alias("reply"),
    )
    return rows.select(
        "conv_id", "example", "is_tail",
        F.concat("prefix", "head", "reply", F.when(F.col("is_tail"), "").otherwise("<|end|>\n")).alias("formatted"),
        (F.length("prefix") + F.length("head")).alias("loss_start"), F.length("reply").alias("loss_len"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example. Escaped texts hold no ``<|``, so splitting there is exact."""
    pieces = F.filter(F.split(formatted, r"<\|", -1), lambda p: p.startswith("role:"))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^role:(.*?):\|>\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^role:.*?:\|>\n", "")).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read from the examples: the turns of the longest one, and the texts under all loss masks."""
    per = examples.withColumn("loss", F.expr("substring(formatted, loss_start + 1, loss_len)"))
    per = per.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
    )
    loss = F.array_join(F.transform("losses", lambda x: unescape(x["loss"])), "")
    text = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        let(read_back(F.col("whole")), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.sha2(text(t).cast("binary"), 256).alias("sha"))).alias("turns"),
        let(loss, lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x.cast("binary"), 256).alias("sha"))).alias("loss"),
        "formatted_chars",
    ).select(
        "conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"),
        F.col("loss.n").alias("loss_chars"), F.col("loss.sha").alias("loss_sha256"), "formatted_chars",
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose two texts are control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    length(role) + length(text) + 19 + length(role || text) - length(replace(role || text, '\', ''))
    + len(regexp_extract_all(role || chr(1) || text, '<(?:\||/?s>)')) + len(regexp_extract_all(role || chr(1) || text, '\|>')) + len(regexp_extract_all(role || chr(1) || text, '\[/?INST\]')) AS size
  FROM c),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto, max(k) OVER (PARTITION BY conv_id) AS last FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = last)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import read_table

    return digest(expand(with_probe(spark, read_table(spark, sf_dir, "conversations"))))
