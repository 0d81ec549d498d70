"""Chat formatting: preference pairs.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as
the prompt; what follows in each is its completion. A mask marks, in code points of the
completion, the assistant's text with its closing marker; role headers and the turns of
others are not trained on.

A conversation is one record (its turns meet in one row, which is what a formatted example
is); pairs are made without comparing all conversations of a group: every conversation that
opens with another one's turn is paired with the group's first conversation, found by a
minimum with partial aggregation.

Rows: a null conversation id is dropped; turns are ordered by turn, role and text, repeated
ones stay; null role or text reads as empty; equal conversations give a pair with empty
completions; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import saved

END = "<|end|>\n"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv, and turns as (role, text) in order."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.filter(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return grouped.select("conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    shorter = F.least(F.size(a), F.size(b))
    apart = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.when(shorter == 0, 0).otherwise(F.coalesce(F.array_min(apart), shorter))


def _header(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def masks(turns: Column) -> Column:
    """start:end of the assistant's part of each of its turns in the rendered text, comma-joined."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_header(t))
        end = start + F.length(t["text"]) + len(END)
        span = F.concat(F.when(acc["out"] == "", "").otherwise(","), start, F.lit(":"), end)
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, empty, step, lambda acc: acc["out"])


def formatted(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen and rejected as arrays of turns) as prompt, completions and masks."""
    n = F.col("n_common")
    tail = lambda c: F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    return pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected"))).select(
        "pair_id", n.cast("bigint").alias("n_common"), rendered(F.slice("chosen", 1, n)).alias("prompt"),
        rendered(tail("chosen")).alias("chosen"), rendered(tail("rejected")).alias("rejected"),
        masks(tail("chosen")).alias("chosen_mask"), masks(tail("rejected")).alias("rejected_mask"))


def stale_reply_pairs(convs: DataFrame) -> DataFrame:
    """Each conversation up to its last assistant turn, against the same with its earlier reply given again.

    Conversations with fewer than two assistant turns give no pair.
    """
    at = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get(F.col("turns"), i)["role"] == "assistant")
    rows = convs.withColumn("at", at).filter(F.size("at") >= 2)
    last, before = F.element_at("at", -1), F.element_at("at", -2)
    chosen = F.slice("turns", 1, last + 1)
    return rows.select(F.concat(F.lit("stale:"), F.col("conv")).alias("pair_id"), chosen.alias("chosen"),
                       F.concat(F.slice("turns", 1, last), F.array(F.get(F.col("turns"), before))).alias("rejected"))


def shared_opening_pairs(convs: DataFrame) -> DataFrame:
    """The first conversation (by id) of those that open alike as chosen, against each other one."""
    opening = convs.withColumn("opening", F.sha2(F.to_json(F.get("turns", F.lit(0))), 256))
    first = opening.groupBy("opening").agg(F.min("conv").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = saved(first.select("opening", "first"), "openings")  # so that the join below can split an opening that many share
    others = opening.join(first, "opening").filter("conv <> first").select("conv", "first", F.col("turns").alias("rejected"))
    return others.join(convs.select(F.col("conv").alias("first"), F.col("turns").alias("chosen")), "first").select(
        F.concat(F.lit("opening:"), F.col("first"), F.lit(":"), F.col("conv")).alias("pair_id"), "chosen", "rejected")


def preference_rows(turns: DataFrame) -> DataFrame:
    """Both kinds of pairs of a table of turns, formatted."""
    convs = saved(conversations(turns), "conversations")
    return formatted(stale_reply_pairs(convs).unionByName(shared_opening_pairs(convs)))


_RENDER = "list_aggregate(list_transform({t}, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), 'string_agg', '')"
_MASK = """coalesce(list_aggregate(list_filter(list_transform(range(len({t})), lambda i:
  CASE WHEN {t}[i + 1].role = 'assistant' THEN
    CAST(coalesce(list_sum(list_transform({t}[1:i], lambda x: length(x.role) + length(x.text) + 13)), 0) + length({t}[i + 1].role) + 5 AS BIGINT) || ':' ||
    CAST(coalesce(list_sum(list_transform({t}[1:(i + 1)], lambda x: length(x.role) + length(x.text) + 13)), 0) AS BIGINT) END),
  lambda s: s IS NOT NULL), 'string_agg', ','), '')"""
SQL = """
WITH convs AS (
  SELECT conv_id AS conv, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), marked AS (
  SELECT conv, turns, list_filter(range(len(turns)), lambda i: turns[i + 1].role = 'assistant') AS spots FROM convs
), stale AS (
  SELECT 'stale:' || conv AS pair_id, turns[1:(spots[-1] + 1)] AS chosen, list_concat(turns[1:spots[-1]], [turns[spots[-2] + 1]]) AS rejected
  FROM marked WHERE len(spots) >= 2
), firsts AS (
  SELECT turns[1] AS opening, MIN(conv) AS first FROM convs GROUP BY turns[1] HAVING COUNT(*) > 1
), shared AS (
  SELECT 'opening:' || f.first || ':' || c.conv AS pair_id, a.turns AS chosen, c.turns AS rejected
  FROM firsts f JOIN convs c ON c.turns[1] = f.opening AND c.conv <> f.first JOIN convs a ON a.conv = f.first
), pairs AS (SELECT * FROM stale UNION ALL SELECT * FROM shared), cut AS (
  SELECT *, coalesce(list_min(list_filter(range(least(len(chosen), len(rejected))), lambda i: chosen[i + 1] IS DISTINCT FROM rejected[i + 1])),
                     least(len(chosen), len(rejected))) AS n_common FROM pairs
), tails AS (
  SELECT pair_id, n_common, chosen[1:n_common] AS p, chosen[(n_common + 1):] AS c, rejected[(n_common + 1):] AS r FROM cut
)
SELECT pair_id, CAST(n_common AS BIGINT) AS n_common, """ + ", ".join(
    f"coalesce({_RENDER.format(t=t)}, '') AS {n}" for t, n in (("p", "prompt"), ("c", "chosen"), ("r", "rejected"))) + ", " + ", ".join(
    f"{_MASK.format(t=t)} AS {n}" for t, n in (("c", "chosen_mask"), ("r", "rejected_mask"))) + " FROM tails\n"
