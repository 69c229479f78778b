"""Preference formatting: one shared prompt and two masked completions for a pair of conversations.

Native: DataFrame functions only.  The turns of a chosen and a rejected
conversation are put in order and compared; their longest common prefix of
turns (equal role and text) is rendered once as the prompt, what follows in
either becomes its completion.  A mask lists the spans of a completion that
count in training, as ``start:end`` in code points, comma-joined: the text and
end mark of assistant turns.  Role marks and other roles' turns are masked.

One shuffle brings a pair's turns together; a row holds one pair, as each
conversation has to fit a training example anyway.  The shuffle key is the
pair, so a first turn or a whole conversation that many pairs share puts no
weight on one task.

Cases: null role or text counts as empty; equal turn numbers are ordered by
role, then text; repeated turns stay; a conversation without partner gives a
row whose other side is null and whose prompt is empty; identical
conversations give a full prompt and two empty completions; a turn without
conversation id belongs to no conversation and gives a row of its own (null
pair_id, status ``unpaired``), never joined with another; role marks inside a
text are broken by a blank so they can't end a turn; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
END = "<|end|>"


def mark(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def said(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(mark(t), said(t))), "")


def mask(turns: Column) -> Column:
    """Spans of trained text in :func:`render` of the same turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(mark(t))
        end = begin + F.length(said(t))
        span = F.concat(begin.cast("string"), F.lit(":"), (end - 1).cast("string"))
        spans = F.when(t["role"] == TRAINED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two arrays share."""
    both = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, both), F.slice(b, 1, both), lambda x, y: x == y)
    first = F.array_position(pairs, False)
    return F.when(first == 0, both).otherwise(first - 1).cast("int")


def format_pairs(sides: DataFrame) -> DataFrame:
    """Formats pairs.

    ``sides`` has a row for each turn: pair_id, side (0 chosen, 1 rejected), conv_id, turn, role, text.
    """
    rows = sides.select(
        "pair_id", "side", "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    turn = F.struct("side", "turn", "role", "text")
    known = rows.where("pair_id is not null")
    grouped = known.groupBy("pair_id").agg(
        F.min(F.when(F.col("side") == 0, F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"),
        F.sort_array(F.collect_list(turn)).alias("turns"),
    )
    none = F.lit(None).cast(rows.schema["conv_id"].dataType)
    alone = rows.where("pair_id is null").select("pair_id", none.alias("chosen_id"), none.alias("rejected_id"), F.array(turn).alias("turns"))
    grouped = grouped.union(alone)
    own = lambda k: F.transform(
        F.filter("turns", lambda t: t["side"] == k),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
    )
    split = grouped.select("pair_id", "chosen_id", "rejected_id", own(0).alias("c"), own(1).alias("r"))
    counted = split.withColumn("n_prompt_turns", common_prefix(F.col("c"), F.col("r")))
    rest = lambda k: F.slice(k, F.col("n_prompt_turns") + 1, F.size(k))
    cut = counted.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns",
        F.size("c").alias("n_c"), F.size("r").alias("n_r"),
        F.slice("c", F.lit(1), F.col("n_prompt_turns")).alias("p"),
        rest("c").alias("c"),
        rest("r").alias("r"),
    )
    given = lambda k, x: F.when(F.col(f"n_{k}") > 0, x(F.col(k)))
    return cut.select(
        "pair_id", "chosen_id", "rejected_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        render(F.col("p")).alias("prompt"),
        given("c", render).alias("chosen"), given("c", mask).alias("chosen_mask"),
        given("r", render).alias("rejected"), given("r", mask).alias("rejected_mask"),
        F.when((F.col("n_c") == 0) | (F.col("n_r") == 0), "unpaired")
        .when((F.size("c") == 0) & (F.size("r") == 0), "identical")
        .otherwise("pair").alias("status"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Sides for a table of alternating conversations: 2k is chosen over 2k + 1."""
    return conversations.select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.coalesce(F.pmod("conv_id", F.lit(2)), F.lit(0)).cast("int").alias("side"),
        "conv_id", "turn", "role", "text",
    )


SQL = """
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY grp, side ORDER BY turn, role, text) AS pos
  FROM (SELECT coalesce(floor(conv_id / 2)::BIGINT::VARCHAR, 'row ' || row_number() OVER ()) AS grp,
               floor(conv_id / 2)::BIGINT AS pair_id, coalesce((conv_id % 2 + 2) % 2, 0) AS side, conv_id, turn,
               coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
        FROM conversations)
), ids AS (
  SELECT grp, any_value(pair_id) AS pair_id,
         min(conv_id) FILTER (side = 0) AS chosen_id, min(conv_id) FILTER (side = 1) AS rejected_id,
         count(*) FILTER (side = 0) AS n_c, count(*) FILTER (side = 1) AS n_r
  FROM t GROUP BY grp
), m AS (
  SELECT coalesce(c.grp, r.grp) AS grp, min(coalesce(c.pos, r.pos)) AS pos
  FROM (SELECT * FROM t WHERE side = 0) c FULL JOIN (SELECT * FROM t WHERE side = 1) r
    ON c.grp = r.grp AND c.pos = r.pos
  WHERE c.pos IS NULL OR r.pos IS NULL OR c.role <> r.role OR c.text <> r.text
  GROUP BY 1
), x AS (
  SELECT t.*, coalesce(m.pos, least(n_c, n_r) + 1) - 1 AS n, '<|' || role || '|>' || chr(10) AS mark,
         text || '<|end|>' || chr(10) AS said
  FROM t JOIN ids USING (grp) LEFT JOIN m USING (grp)
), y AS (
  SELECT *, (sum(length(mark) + length(said)) OVER (PARTITION BY grp, side, pos > n ORDER BY pos))::BIGINT AS until FROM x
), s AS (
  SELECT grp, any_value(n) AS n,
    coalesce(string_agg(mark || said, '' ORDER BY pos) FILTER (side = 0 AND pos <= n), '') AS prompt,
    coalesce(string_agg(mark || said, '' ORDER BY pos) FILTER (side = 0 AND pos > n), '') AS c,
    coalesce(string_agg(mark || said, '' ORDER BY pos) FILTER (side = 1 AND pos > n), '') AS r,
    coalesce(string_agg((until - length(said)) || ':' || (until - 1), ',' ORDER BY pos)
      FILTER (side = 0 AND pos > n AND role = 'assistant'), '') AS cm,
    coalesce(string_agg((until - length(said)) || ':' || (until - 1), ',' ORDER BY pos)
      FILTER (side = 1 AND pos > n AND role = 'assistant'), '') AS rm
  FROM y GROUP BY grp
)
SELECT pair_id, chosen_id, rejected_id, n::BIGINT AS n_prompt_turns, prompt,
       CASE WHEN n_c > 0 THEN c END AS chosen, CASE WHEN n_c > 0 THEN cm END AS chosen_mask,
       CASE WHEN n_r > 0 THEN r END AS rejected, CASE WHEN n_r > 0 THEN rm END AS rejected_mask,
       CASE WHEN n_c = 0 OR n_r = 0 THEN 'unpaired' WHEN c = '' AND r = '' THEN 'identical' ELSE 'pair' END AS status
FROM s JOIN ids USING (grp)
"""
