"""Chat formatting: preference pairs with one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import table

#: Around a turn: before its role, between role and text, after its text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"
#: The role whose text a completion's mask covers.
LEARNED = "assistant"


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns): a conversation's distinct turns in order of number, role and text."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    return conversations.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv")).agg(
        F.array_sort(F.collect_set(turn)).alias("turns")
    )


def _render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def _mask(turns: Column) -> Column:
    """start:end of the learned text in the rendered turns, comma-joined; end marks are learned too."""
    around = len(OPEN) + len(MIDDLE)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + around + F.length(t["role"])
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.concat(F.when(acc["spans"] == "", "").otherwise(","), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == LEARNED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def preference_pairs(conversations: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per row of ``pairs`` (chosen_id, rejected_id) whose conversations both exist:
    chosen_id, rejected_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask.

    The prompt is the longest common prefix of turns, equal in role and text, rendered once; the
    completions are the rendered turns after it. Masks list ``start:end`` character ranges of a
    completion to learn from: the assistant's texts with their closing mark.

    Turns stand in order of their number; rows that repeat a turn exactly count once, others with
    the same number follow in order of role and text, null numbers first. Null roles and texts are
    empty ones; rows without conversation id are in no conversation. Conversations that are equal
    give empty completions and masks; a pair of one conversation with itself likewise. Pairs with
    a null id, or one that no row has, give no row; repeated pairs give repeated rows. Empty
    tables give an empty one; other columns are not read. A conversation is one training text, so
    its turns meet in one row; conversations never do, however many begin alike.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    left = turns.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("c"))
    right = turns.select(F.col("conv").alias("rejected_id"), F.col("turns").alias("r"))
    return _formatted(pairs.select("chosen_id", "rejected_id").join(left, "chosen_id").join(right, "rejected_id"))


def continuations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", block: int = 1024) -> DataFrame:
    """One row per conversation, for tables that hold no preferences: the conversation is chosen, and
    rejected is its beginning, continued with another one's answer; columns of ``preference_pairs``.

    An answer is the last turn of the assistant and all after it; the beginning is what stands before
    (all turns where the assistant says nothing). The answer comes from the next conversation with
    the same beginning, so rejected is that conversation itself; where none begins alike, from the next
    conversation. Next is by id, in a ring, within ``block`` ids, so no window holds more than that
    many, however many conversations begin alike. A conversation alone in its block gets no
    answer and a null rejected_id: rejected is then its bare beginning. Beginnings are compared by
    the SHA-256 of their rendering. Nulls, repeats, ties and empty tables are as in ``preference_pairs``.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == LEARNED, i)))
    split = turns.withColumn("k", F.coalesce(last, F.size("turns")).cast("int"))
    ids = split.select("conv", F.floor(F.col("conv") / block).alias("block"), F.sha2(_render(F.slice("turns", F.lit(1), F.col("k"))), 256).alias("begin"))

    def following(*keys: str) -> Column:
        ring = Window.partitionBy(*keys)
        after = F.coalesce(F.lead("conv").over(ring.orderBy("conv")), F.min("conv").over(ring))
        return F.nullif(after, F.col("conv"))

    donors = ids.select("conv", F.coalesce(following("block", "begin"), following("block")).alias("rejected_id"))
    chosen = split.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("c"), F.slice("turns", F.lit(1), F.col("k")).alias("begin"))
    answers = split.select(F.col("conv").alias("rejected_id"), F.slice("turns", F.col("k") + 1, F.size("turns")).alias("answer"))
    # answers travel to ids, then to the conversations, whose own texts stay where they were put together
    answered = donors.withColumnRenamed("conv", "chosen_id").join(answers, "rejected_id", "left")
    both = chosen.join(answered, "chosen_id")
    return _formatted(both.withColumn("r", F.when(F.col("answer").isNull(), F.col("begin")).otherwise(F.concat("begin", "answer"))))


def _formatted(both: DataFrame) -> DataFrame:
    """Rows (chosen_id, rejected_id, c, r) of two lists of turns, as prompt, completions and masks."""
    said = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    same = F.zip_with(F.transform("c", said), F.transform("r", said), lambda x, y: x.eqNullSafe(y))
    apart = F.array_position(same, F.lit(False))
    n = F.when(apart > 0, apart - 1).otherwise(F.size("c")).cast("int")
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0)))
    both = both.withColumn("n_prefix", n)
    both = both.select("chosen_id", "rejected_id", "n_prefix", F.slice("c", F.lit(1), F.col("n_prefix")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select(
        "chosen_id", "rejected_id", "n_prefix", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    )


def op6_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuations(table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH u AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, '<|' || role || e'|>\n' || text || e'\n' AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM u),
n AS (SELECT conv_id, max(pos) AS n, coalesce(max(pos) FILTER (role = 'assistant') - 1, max(pos)) AS k FROM t GROUP BY 1),
h AS (SELECT conv_id, k, floor(conv_id / 1024) AS b, coalesce(string_agg(s, '' ORDER BY pos) FILTER (pos <= k), '') AS h FROM t JOIN n USING (conv_id) GROUP BY conv_id, k),
o AS (SELECT conv_id AS c, k, coalesce(
        nullif(coalesce(lead(conv_id) OVER (PARTITION BY b, h ORDER BY conv_id), min(conv_id) OVER (PARTITION BY b, h)), conv_id),
        nullif(coalesce(lead(conv_id) OVER (PARTITION BY b ORDER BY conv_id), min(conv_id) OVER (PARTITION BY b)), conv_id)) AS r FROM h),
e AS (SELECT c, pos, role, text, s, true AS own FROM o JOIN t ON t.conv_id = c
      UNION ALL SELECT c, pos, role, text, s, false FROM o JOIN t ON t.conv_id = c AND pos <= k
      UNION ALL SELECT c, o.k + t.pos - n.k, role, text, s, false FROM o JOIN n ON n.conv_id = r JOIN t ON t.conv_id = r AND t.pos > n.k),
d AS (SELECT x.c, min(x.pos) AS first FROM (FROM e WHERE own) x LEFT JOIN (FROM e WHERE NOT own) y ON y.c = x.c AND y.pos = x.pos
      WHERE y.pos IS NULL OR x.role <> y.role OR x.text <> y.text GROUP BY ALL),
l AS (SELECT o.c, o.r, coalesce(d.first - 1, n.n) AS k FROM o JOIN n ON n.conv_id = o.c LEFT JOIN d USING (c)),
f AS (SELECT l.r, l.k, e.*, coalesce(sum(length(s)) FILTER (pos > l.k) OVER (PARTITION BY c, own ORDER BY pos), 0) AS upto FROM l JOIN e USING (c)),
g AS (SELECT *, CASE WHEN role = 'assistant' AND pos > k THEN (upto - length(text) - 1) || ':' || upto END AS span FROM f)
SELECT c AS chosen_id, r AS rejected_id, CAST(k AS INTEGER) AS n_prefix,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (pos <= k AND own), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (pos > k AND own), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (pos > k AND NOT own), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (own), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (NOT own), '') AS rejected_mask
FROM g GROUP BY c, r, k
"""
