"""Preference formatting: a common prompt once, and two masked completions.

The turns that a chosen and a rejected conversation share from the start are the prompt; what follows in each is its
completion. Loss falls on the text of assistant turns in completions, and their end marks; headers and other roles are masked. All
of it is array functions inside a row; a conversation is one row, as a rendered example is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def conversation_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`conv_id, turns`: each conversation's turns in order as array of (turn, role, text).

    Rows with a null id belong to no conversation and are left out; repeated rows count once; turns of one number are
    ordered by role and text; a null turn comes first, a null role is "", a null text "".
    """
    row = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns.filter(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_set(row)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two arrays share from the start, by role and text; nulls, also null turns, are equal to nulls alone."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"]) & (F.get(a, i).isNull() == F.get(b, i).isNull()),
    )
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def rendered(turns: Column) -> Column:
    """Turns as text; a null role or text is empty, a null turn has both null."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), _given(t["role"]), F.lit(MIDDLE), _given(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column, trained: str = "assistant") -> Column:
    """Character spans [start, stop) of the rendered turns on which loss falls: texts of the trained role with their end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + len(HEAD) + F.length(_given(t["role"])) + len(MIDDLE)
        stop = begin + F.length(_given(t["text"])) + len(END)
        span = F.struct(begin.cast("int").alias("start"), stop.cast("int").alias("stop"))
        return F.struct(stop.cast("int").alias("at"), F.when(t["role"].eqNullSafe(F.lit(trained)), F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with `n_prefix, prompt, chosen_completion, rejected_completion, chosen_loss, rejected_loss` for two columns of turn arrays.

    A null array is an empty conversation. Equal conversations give a prompt of all turns and two empty completions
    (`n_prefix` is then both lengths); one that continues the other gives an empty completion on the shorter side. Other
    columns stay; those with the names of results are replaced.
    """
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    a, b = F.coalesce(F.col(chosen), empty), F.coalesce(F.col(rejected), empty)
    out = pairs.withColumn("n_prefix", common_turns(a, b)).withColumn("prompt", rendered(F.slice(a, F.lit(1), F.col("n_prefix"))))
    for name, turns in (("chosen", a), ("rejected", b)):
        rest = F.slice(turns, F.col("n_prefix") + 1, F.greatest(F.size(turns) - F.col("n_prefix"), F.lit(0)))
        out = out.withColumn(f"{name}_completion", rendered(rest)).withColumn(f"{name}_loss", loss_spans(rest))
    return out


def reply_pairs(turns: DataFrame) -> DataFrame:
    """`conv_id, chosen, rejected`: every conversation, against itself with one reply exchanged for the last reply of the neighbour (id with the last bit turned).

    Of a conversation's n assistant turns the one numbered conv_id mod n (from 0) is exchanged, so pairs part at all
    depths and go on behind. Without an assistant turn, or where the neighbour is missing or has none, the rejected side is null.
    """
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    convs = conversation_turns(turns).withColumn("replies", replies)
    convs = convs.withColumn("at", F.when(F.size("replies") > 0, F.get("replies", F.pmod(F.col("conv_id"), F.greatest(F.size("replies"), F.lit(1))).cast("int"))))
    other = convs.filter("at IS NOT NULL").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.get("turns", F.array_max("replies"))["text"].alias("reply"))
    swapped = F.transform("turns", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == F.col("at"), F.col("reply")).otherwise(t["text"]).alias("text")))
    rejected = F.when(F.col("at").isNotNull() & F.col("reply").isNotNull(), swapped)
    return convs.join(other, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def spans_text(spans: Column) -> Column:
    """Spans as one text: "start-stop" with commas between."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"))), ",")


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, completions and loss masks of every conversation's pair."""
    out = format_preferences(reply_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.select(
        "conv_id", F.col("n_prefix").cast("long").alias("n_prefix"), "prompt", "chosen_completion", "rejected_completion",
        spans_text(F.col("chosen_loss")).alias("chosen_mask"), spans_text(F.col("rejected_loss")).alias("rejected_mask"),
    )


OP2_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
a AS (SELECT conv_id, pos, text, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE role = 'assistant'),
r AS (SELECT conv_id, max(pos) FILTER (WHERE k = ((conv_id % n) + n) % n) AS at_pos, arg_max(text, pos) AS reply FROM a GROUP BY conv_id),
p AS (SELECT c.conv_id, x.at_pos, y.reply, x.at_pos IS NOT NULL AND y.reply IS NOT NULL AS paired FROM (SELECT DISTINCT conv_id FROM t) c LEFT JOIN r x ON x.conv_id = c.conv_id LEFT JOIN r y ON y.conv_id = xor(c.conv_id, 1::BIGINT)),
s AS (SELECT t.conv_id, t.pos, t.role, t.text AS chosen, CASE WHEN paired THEN CASE WHEN t.pos = at_pos THEN reply ELSE t.text END END AS rejected, paired FROM t JOIN p USING (conv_id)),
d AS (SELECT conv_id, CASE WHEN bool_and(paired) THEN coalesce(min(pos) FILTER (WHERE chosen <> rejected) - 1, max(pos)) ELSE 0 END AS n_prefix FROM s GROUP BY conv_id),
x AS (SELECT s.*, d.n_prefix, '<|' || role || '|>' || chr(10) || chosen || '<|end|>' || chr(10) AS c, '<|' || role || '|>' || chr(10) || rejected || '<|end|>' || chr(10) AS j FROM s JOIN d USING (conv_id)),
o AS (SELECT *, sum(CASE WHEN pos > n_prefix THEN length(c) ELSE 0 END) OVER w - length(c) AS co, sum(CASE WHEN pos > n_prefix THEN length(j) ELSE 0 END) OVER w - length(j) AS jo FROM x
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT conv_id, n_prefix, coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE pos <= n_prefix), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE pos > n_prefix), '') AS chosen_completion, coalesce(string_agg(j, '' ORDER BY pos) FILTER (WHERE pos > n_prefix), '') AS rejected_completion,
  coalesce(string_agg((co + length(role) + 5)::BIGINT || '-' || (co + length(c))::BIGINT, ',' ORDER BY pos) FILTER (WHERE pos > n_prefix AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((jo + length(role) + 5)::BIGINT || '-' || (jo + length(j))::BIGINT, ',' ORDER BY pos) FILTER (WHERE pos > n_prefix AND role = 'assistant' AND paired), '') AS rejected_mask
FROM o GROUP BY conv_id, n_prefix
"""
