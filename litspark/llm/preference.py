"""Preference formatting, in DataFrame expressions only.

A pair has a chosen and a rejected conversation. Their longest common prefix of
turns is rendered once as the prompt; what follows on each side is rendered as
that side's completion, with a mask that marks the assistant's words.

Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. A mask is a run-
length string over the rendered characters, ``"12:0,40:1"``: the first 12 are
not learned, the next 40 are. In completions an assistant turn's text and end
mark are learned, its header and all other turns are not; a prompt is not
learned at all.

The prefix ends at the smallest turn where the sides differ, found by a grouped
minimum; a conversation is never collected whole. Output rows cover at most
``BLOCK_TURNS`` turn numbers, so an ordinary pair has one prompt and two
completion rows, and a conversation without end has many.

Defined cases: rows without pair, side or turn are ignored; of several rows for
one turn the smallest (role, text) is used; a null role is ``unknown``, a null
text empty; template marks inside a text are broken by a space; sides that agree
to the end give a prompt only; a side that ends first has no completion rows;
empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turn(role: Column, text: Column) -> Column:
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    return F.struct(F.coalesce(role, F.lit("unknown")).alias("role"), safe.alias("text"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """``turns(pair_id, side, turn, role, text)``, side ``chosen`` or ``rejected`` →
    (pair_id, part, block, text, mask), part ``prompt``, ``chosen`` or ``rejected``."""
    given = turns.where("pair_id IS NOT NULL AND turn IS NOT NULL").select(
        "pair_id", F.col("turn").cast("long").alias("turn"), "side", _turn(F.col("role"), F.col("text")).alias("said"))
    cells = given.groupBy("pair_id", "turn").agg(*[
        F.min(F.when(F.col("side") == side, F.col("said"))).alias(side) for side in ("chosen", "rejected")])
    same = F.col("chosen").eqNullSafe(F.col("rejected"))
    ends = cells.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("differs"))
    common_turn = F.col("differs").isNull() | (F.col("turn") < F.col("differs"))
    part = lambda name, said: F.struct(F.lit(name).alias("part"), F.col(said).alias("said"))
    rows = cells.join(ends, "pair_id").select("pair_id", "turn", F.explode(
        F.when(common_turn, F.array(part("prompt", "chosen"))).otherwise(
            F.array(part("chosen", "chosen"), part("rejected", "rejected")))).alias("p")
        ).select("pair_id", "turn", "p.part", "p.said").where("said IS NOT NULL")
    header = F.concat(F.lit(OPEN), F.col("said.role"), F.lit("\n"))
    body = F.concat(F.col("said.text"), F.lit(CLOSE))
    learned = (F.col("part") != "prompt") & (F.col("said.role") == "assistant")
    mask = F.when(learned, F.concat(F.length(header), F.lit(":0,"), F.length(body), F.lit(":1"))).otherwise(
        F.concat(F.length(header) + F.length(body), F.lit(":0")))
    rendered = F.struct("turn", F.concat(header, body).alias("text"), mask.alias("mask"))
    blocks = rows.groupBy("pair_id", "part", F.floor(F.col("turn") / BLOCK_TURNS).alias("block")).agg(
        F.array_sort(F.collect_list(rendered)).alias("turns"))
    return blocks.select("pair_id", "part", "block", F.array_join("turns.text", "").alias("text"),
                         F.array_join("turns.mask", ",").alias("mask"))


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs of a plain conversation table (conv_id, turn, role, text): the
    chosen side is the conversation up to its last assistant turn, the rejected side
    repeats the assistant's reply before that one there instead (an empty reply if
    there is none). Conversations without an assistant turn form no pair."""
    turns = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ends = turns.where("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("end"))
    upto = turns.join(ends, "pair_id").where("turn <= end")
    stale = upto.groupBy("pair_id").agg(
        F.max("end").alias("turn"), F.max(F.when((F.col("role") == "assistant") & (F.col("turn") < F.col("end")),
                                                 F.struct("turn", "text")))["text"].alias("text"))
    sides = F.when(F.col("turn") < F.col("end"), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen")))
    kept = upto.select("pair_id", F.explode(sides).alias("side"), "turn", "role", "text")
    return kept.unionByName(stale.select("pair_id", F.lit("rejected").alias("side"), "turn", F.lit("assistant").alias("role"),
                                         "text"))


#: The registered query in DuckDB SQL (conversations without repeated turns).
ORACLE_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
e AS (SELECT pair_id, max(turn) AS stop FROM t WHERE role = 'assistant' GROUP BY 1),
p AS (SELECT t.pair_id, arg_max(text, turn) AS text FROM t JOIN e USING (pair_id)
      WHERE role = 'assistant' AND turn < stop GROUP BY 1),
s AS (SELECT t.pair_id, 'chosen' AS side, turn, role, text FROM t JOIN e USING (pair_id) WHERE turn <= stop
      UNION ALL SELECT t.pair_id, 'rejected', turn, role, text FROM t JOIN e USING (pair_id) WHERE turn < stop
      UNION ALL SELECT e.pair_id, 'rejected', stop, 'assistant', p.text FROM e LEFT JOIN p USING (pair_id)),
r AS (SELECT pair_id, side, turn, coalesce(role, 'unknown') AS role,
             replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM s),
d AS (SELECT pair_id, min(turn) AS differs FROM
      (SELECT pair_id, turn FROM r GROUP BY pair_id, turn, role, text HAVING count(*) = 1) GROUP BY 1),
m AS (SELECT r.*, CASE WHEN differs IS NULL OR turn < differs THEN 'prompt' ELSE side END AS part
      FROM r LEFT JOIN d USING (pair_id)),
x AS (SELECT *, '{OPEN}' || role || chr(10) AS header, text || '{CLOSE.strip()}' || chr(10) AS body FROM m
      WHERE part <> 'prompt' OR side = 'chosen')
SELECT pair_id, part, CAST(floor(turn / {BLOCK_TURNS}.0) AS BIGINT) AS block,
       string_agg(header || body, '' ORDER BY turn) AS text,
       string_agg(CASE WHEN part <> 'prompt' AND role = 'assistant'
                       THEN length(header) || ':0,' || length(body) || ':1'
                       ELSE (length(header) + length(body)) || ':0' END, ',' ORDER BY turn) AS mask
FROM x GROUP BY 1, 2, 3
"""
