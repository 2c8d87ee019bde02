"""Chat formatting with Spark expressions only.

A conversation's turns are collected, sorted, adjacent turns of one role are
merged under one header with a mark between, and all is concatenated:

    <s>[INST] user text [/INST] assistant text </s>

with `<<SYS>> text <</SYS>>` for system turns, `[ROLE name] text [/ROLE]` for
others, and `[NEXT]` between merged turns. Control strings inside texts are
escaped reversibly: a `<`, `[` that would begin one becomes `%3C`, `%5B`, and a
`%` before `25`, `3C` or `5B` becomes `%25`. Reading back cuts the output at its
marks, so it depends on nothing but the output.

The loss mask covers what assistants said: all texts of assistant blocks, each
once and in order, without marks.

Cases: a null text counts as empty, a null role as the empty role, a null
conv_id is a conversation of its own; turns are ordered by turn (nulls first),
then role, then text, so ties and repeated rows have one order and all stay;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a text must not hold unescaped.
CONTROL = r"(?=/?s>|<SYS>>|</SYS>>)", r"(?=/?INST\]|NEXT\]|ROLE |/ROLE\])"
NEXT = " [NEXT] "
ESCAPED = "%(?=25|3C|5B)"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, ESCAPED, "%25")
    text = F.regexp_replace(text, "<" + CONTROL[0], "%3C")
    return F.regexp_replace(text, r"\[" + CONTROL[1], "%5B")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%3C"), F.lit("<")), F.lit("%5B"), F.lit("[")), F.lit("%25"), F.lit("%"))


def _block(role: Column, body: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST] ")))
        .when(role == "assistant", F.concat(body, F.lit(" </s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>> "), body, F.lit(" <</SYS>> ")))
        .otherwise(F.concat(F.lit("[ROLE "), F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D")), F.lit("] "), body, F.lit(" [/ROLE] ")))
    )


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted): one string per conversation."""
    rows = turns.select(F.col(conv).alias("c"), F.struct(F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x")).alias("v"))
    sides = rows.groupBy("c").agg(F.array_sort(F.collect_list("v")).alias("v"))
    said = F.transform("v", lambda v: F.struct(v["r"].alias("r"), escape(v["x"]).alias("x")))
    # A turn opens a block if the one before has another role; the blocks are the runs between openings.
    opens = F.filter(F.sequence(F.lit(0), F.size("v") - 1), lambda i: (i == 0) | (F.get("v", i)["r"] != F.get("v", F.greatest(i - 1, F.lit(0)))["r"]))
    sides = sides.withColumn("s", said).withColumn("o", opens)

    def block(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("o", i + 1), F.size("s"))
        run = F.slice("s", start + 1, end - start)
        return _block(F.get("s", start)["r"], F.array_join(F.transform(run, lambda v: v["x"]), NEXT))

    body = F.array_join(F.transform("o", block), "")
    return sides.select(F.col("c").alias(conv), F.concat(F.lit("<s>"), body).alias("formatted"))


#: One block of the output: exactly one of the groups user, system, role and other, assistant takes part.
_BLOCKS = r"(?s)\[INST\] .*? \[/INST\] |<<SYS>> .*? <</SYS>> |\[ROLE [^\]]*\] .*? \[/ROLE\] |.*? </s>"


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, formatted, turns array<struct<role, text>>, loss): what the output alone says."""

    def turns_of(block: Column) -> Column:
        user, system, other = block.startswith("[INST] "), block.startswith("<<SYS>> "), block.startswith("[ROLE ")
        name = F.regexp_extract(block, r"^\[ROLE ([^\]]*)\] ", 1)
        role = F.when(user, "user").when(system, "system").when(other, F.replace(F.replace(name, F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%"))).otherwise("assistant")
        head = F.when(user, 7).when(system, 8).when(other, F.length(name) + 8).otherwise(0)
        tail = F.when(user, 9).when(system, 10).when(other, 9).otherwise(5)
        body = F.substring(block, head + 1, F.length(block) - head - tail)
        return F.transform(F.split(body, r" \[NEXT\] "), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    body = F.substring("formatted", F.lit(4), F.length("formatted"))
    out = formatted.withColumn("blocks", F.regexp_extract_all(body, F.lit(_BLOCKS), F.lit(0)))
    out = out.withColumn("turns", F.flatten(F.transform("blocks", turns_of)))
    return out.select(conv, "formatted", "turns", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "").alias("loss"))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    from .common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = read_back(format_chats(turns.unionByName(more)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    length(text) + 2 * length(regexp_extract_all(text, '<(/?s>|<SYS>>|</SYS>>)|\[(/?INST\]|NEXT\]|ROLE |/ROLE\])|%(25|3C|5B)')) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, n + CASE WHEN before IS NOT DISTINCT FROM role THEN 8
    WHEN role = 'user' THEN 16 WHEN role = 'assistant' THEN 5 WHEN role = 'system' THEN 18 ELSE 17 + length(replace(replace(role, '%', '%25'), ']', '%5D')) END AS m FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(m) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
