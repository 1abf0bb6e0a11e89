"""Chat formatting with cumulative-snapshot collapse.

Logs often hold the same conversation many times, each snapshot a few turns longer. Turns get a position in
their conversation (order: turn, role, text), and a prefix hash rolls over the positions: the XOR of
two 64-bit hashes of (position, role, text) up to there. A conversation whose whole hash is the prefix hash
of a longer one goes, by an anti-join; of equal ones, the smallest conv_id stays. What stays is rendered.

A long conversation is cut into blocks of `BLOCK` turn numbers: counts and hashes are summed per block
first, so that no task sees all turns of one. Null roles and texts are empty; rows without conv_id are no
conversation; a null turn comes first; repeated rows are turns of their own. Rendering is one string per
conversation, that must fit a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import common as C

BLOCK = 4096
TURN = "<|{role}|>\n{text}\n"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, block, pos (from 0), role, text, and the rolling hashes h1, h2 of the prefix that ends there."""
    t = turns.where("conv_id is not null").select(
        "conv_id", F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK).alias("block")
    )
    counts = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    by_block = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("conv_id", "block", F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("base"))
    inner = Window.partitionBy("conv_id", "block").orderBy(F.col("t").asc_nulls_first(), "role", "text")
    placed = t.join(base, ["conv_id", "block"]).withColumn("pos", F.row_number().over(inner) - 1 + F.col("base"))
    hashed = placed.withColumn("a", F.xxhash64("pos", "role", "text")).withColumn("b", F.xxhash64("text", "role", "pos", F.lit(17)))
    whole = hashed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carried = whole.select("conv_id", "block", *[F.coalesce(F.bit_xor(x).over(by_block), F.lit(0)).alias(f"{x}0") for x in "ab"])
    run = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.withColumn("ra", F.bit_xor("a").over(run)).withColumn("rb", F.bit_xor("b").over(run))
    return rolled.join(carried, ["conv_id", "block"]).select(
        "conv_id", "block", F.col("pos").cast("long").alias("pos"), "role", "text", F.col("ra").bitwiseXOR(F.col("a0")).alias("h1"), F.col("rb").bitwiseXOR(F.col("b0")).alias("h2")
    )


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, conv_id and n_turns of the conversations that stay)."""
    p = C.written(prefixes(turns))
    ends = p.groupBy("conv_id").agg(F.max_by(F.struct("h1", "h2"), "pos").alias("h"), (F.max("pos") + 1).alias("n_turns")).select("conv_id", "n_turns", "h.h1", "h.h2")
    # a prefix hash that is not its conversation's end: a longer conversation begins so
    starts = p.join(ends.select("conv_id", "n_turns"), "conv_id").where("pos + 1 < n_turns").select((F.col("pos") + 1).alias("n_turns"), "h1", "h2").distinct()
    first = ends.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return p, first.join(starts, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and chat (all turns in TURN's form) of the maximal conversations."""
    head, tail = TURN.split("{role}")
    middle, end = tail.split("{text}")
    p, stay = maximal(turns)
    line = F.concat(F.lit(head), "role", F.lit(middle), "text", F.lit(end))
    blocks = p.join(stay, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("s")).select("conv_id", "block", F.array_join("s.line", "").alias("piece"))
    chats = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("s")).select("conv_id", F.array_join("s.piece", "").alias("chat"))
    return stay.join(chats, "conv_id").select("conv_id", "n_turns", "chat")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, pos + 1 AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         list({'r': role, 'x': text}) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS head
  FROM t),
ends AS (SELECT conv_id, n_turns, head FROM p WHERE n = n_turns),
first AS (SELECT min(conv_id) AS conv_id, n_turns, head FROM ends GROUP BY n_turns, head),
stay AS (SELECT conv_id, n_turns FROM first WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.n_turns AND p.n = first.n_turns AND p.head = first.head))
SELECT s.conv_id, s.n_turns::BIGINT AS n_turns, string_agg(t.line, '' ORDER BY t.pos) AS chat
FROM stay s JOIN t USING (conv_id) GROUP BY s.conv_id, s.n_turns
"""
