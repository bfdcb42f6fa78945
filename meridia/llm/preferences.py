"""Preference formatting: chosen and rejected conversations with one shared prompt and masked completions.

DataFrame functions only.  The turns of a conversation become one ordered array; the longest common
turn prefix is where the zipped arrays first differ.  The prefix is rendered once as the prompt, what is
left of either side as its completion, with the character ranges of the completion that train: the text and
end mark of assistant turns, not headers and not other roles.

Defined results: turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have
one order; a null role is rendered as ``unknown``, a null text as an empty one, and neither differs
from itself; a pair with one side only keeps it, the other completion is empty and the prompt too; rows
with a null pair id are one pair; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINED = "assistant"


def conversations_of(turns: DataFrame, key: str, name: str) -> DataFrame:
    """One row a conversation: its turns as an array of (role, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("r"), F.col("text").alias("t"))), _turn_order)
    shown = F.transform(ordered, lambda x: F.struct(F.coalesce(x["r"], F.lit("unknown")).alias("role"), F.coalesce(x["t"], F.lit("")).alias("text")))
    return turns.groupBy(F.col(key).alias("pair_id")).agg(shown.alias(name))


def _turn_order(a: Column, b: Column) -> Column:
    def by(x: Column, y: Column, then: Column) -> Column:
        return F.when(x.eqNullSafe(y), then).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)

    return by(a["turn"], b["turn"], by(a["r"], b["r"], by(a["t"], b["t"], F.lit(0))))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_header(x), _body(x))), "")


def trained_ranges(turns: Column) -> Column:
    """Character ranges [start, end) of the rendered turns that train."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("ranges"))

    def step(state: Column, turn: Column) -> Column:
        first = state["at"] + F.length(_header(turn))
        last = first + F.length(_body(turn))
        grown = F.when(turn["role"] == TRAINED, F.array_append(state["ranges"], F.struct(first.alias("start"), last.alias("end")))).otherwise(state["ranges"])
        return F.struct(last.alias("at"), grown.alias("ranges"))

    return F.aggregate(turns, start, step, lambda s: s["ranges"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """From turns (pair_id, turn, role, text) of both sides, one row a pair."""
    a, b = conversations_of(chosen, "pair_id", "chosen"), conversations_of(rejected, "pair_id", "rejected").withColumnRenamed("pair_id", "__id")
    both = a.join(b, a["pair_id"].eqNullSafe(b["__id"]), "full_outer")
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = both.select(F.coalesce("pair_id", "__id").alias("pair_id"), F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", 1, F.greatest(shorter, F.lit(1))), F.slice("rejected", 1, F.greatest(shorter, F.lit(1))), lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False)
    both = both.withColumn("n_prompt", F.when(differs > 0, differs - 1).otherwise(shorter).cast("int"))
    left = {side: F.slice(side, F.col("n_prompt") + 1, F.greatest(F.size(side) - F.col("n_prompt"), F.lit(0))) for side in ("chosen", "rejected")}
    both = both.select("pair_id", "n_prompt", F.slice("chosen", 1, F.col("n_prompt")).alias("prefix"), *[c.alias(k) for k, c in left.items()])
    return both.select(
        "pair_id",
        F.col("n_prompt").alias("n_prompt_turns"),
        F.size("chosen").alias("n_chosen_turns"),
        F.size("rejected").alias("n_rejected_turns"),
        render(F.col("prefix")).alias("prompt"),
        render(F.col("chosen")).alias("chosen"),
        trained_ranges(F.col("chosen")).alias("chosen_mask"),
        render(F.col("rejected")).alias("rejected"),
        trained_ranges(F.col("rejected")).alias("rejected_mask"),
    )


def reply_swaps(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations: each is chosen over itself with its last assistant turn
    taken from the conversation next to it (ids 2k and 2k + 1); without such a reply the turn is left out."""
    own = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = own.where(F.col("role") == TRAINED).groupBy("pair_id").agg(F.max("turn").alias("last"))
    reply = own.join(last, "pair_id").where((F.col("role") == TRAINED) & (F.col("turn") == F.col("last")))
    reply = reply.groupBy("pair_id").agg(F.max("text").alias("reply"), F.first("last").alias("last"))
    other = reply.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("reply").alias("other"))
    swaps = reply.join(other, "pair_id").select("pair_id", F.col("last").alias("turn"), F.lit(TRAINED).alias("role"), F.col("other").alias("text"))
    kept = own.join(last.withColumnRenamed("pair_id", "__id"), own["pair_id"].eqNullSafe(F.col("__id")), "left")
    kept = kept.where(F.col("last").isNull() | ~((F.col("turn") == F.col("last")) & (F.col("role") == TRAINED)).eqNullSafe(True))
    return own, kept.select("pair_id", "turn", "role", "text").unionByName(swaps)


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = reply_swaps(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = format_preferences(chosen, rejected)
    spans = {k: F.array_join(F.transform(k, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",") for k in ("chosen_mask", "rejected_mask")}
    return out.withColumns(spans).withColumnRenamed("pair_id", "conv_id")


ORACLE_SQL = """
WITH own AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
lastt AS (SELECT conv_id, max(turn) AS last FROM own WHERE role = 'assistant' GROUP BY 1),
reply AS (SELECT conv_id, any_value(last) AS last, max(text) AS reply FROM own JOIN lastt USING (conv_id)
          WHERE role = 'assistant' AND turn = last GROUP BY 1),
rej AS (
  SELECT o.conv_id, turn, role, text FROM own o LEFT JOIN lastt USING (conv_id)
  WHERE last IS NULL OR NOT (role = 'assistant' AND turn = last)
  UNION ALL
  SELECT a.conv_id, a.last, 'assistant', b.reply FROM reply a JOIN reply b ON b.conv_id = xor(a.conv_id, 1)),
sides AS (
  SELECT 'c' AS side, conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM own
  UNION ALL
  SELECT 'r', conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) FROM rej),
firstdiff AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
         coalesce(min(CASE WHEN c.role IS NULL OR r.role IS NULL OR c.role <> r.role OR c.text <> r.text THEN coalesce(c.i, r.i) END) - 1,
                  count(*)) AS n
  FROM (SELECT * FROM sides WHERE side = 'c') c FULL JOIN (SELECT * FROM sides WHERE side = 'r') r
       ON c.conv_id = r.conv_id AND c.i = r.i GROUP BY 1),
piece AS (
  SELECT side, conv_id, i, n, role, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body,
         sum(CASE WHEN i > n THEN length('<|' || role || '|>' || chr(10)) + length(text || '<|end|>' || chr(10)) ELSE 0 END)
           OVER (PARTITION BY side, conv_id ORDER BY i) AS upto
  FROM sides JOIN firstdiff USING (conv_id)),
agg AS (
  SELECT side, conv_id, any_value(n) AS n, count(*) AS k,
         coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt,
         coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE i > n), '') AS completion,
         coalesce(string_agg((upto - length(body)) || '-' || upto, ',' ORDER BY i) FILTER (WHERE i > n AND role = 'assistant'), '') AS mask
  FROM piece GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.n AS INTEGER) AS n_prompt_turns, CAST(coalesce(c.k - f.n, 0) AS INTEGER) AS n_chosen_turns,
       CAST(coalesce(r.k - f.n, 0) AS INTEGER) AS n_rejected_turns, coalesce(c.prompt, '') AS prompt,
       coalesce(c.completion, '') AS chosen, coalesce(c.mask, '') AS chosen_mask,
       coalesce(r.completion, '') AS rejected, coalesce(r.mask, '') AS rejected_mask
FROM firstdiff f LEFT JOIN agg c ON c.side = 'c' AND c.conv_id = f.conv_id LEFT JOIN agg r ON r.side = 'r' AND r.conv_id = f.conv_id
"""
