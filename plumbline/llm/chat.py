"""Chat formatting: cumulative snapshots of a conversation collapse to the longest, which is then rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ._store import stored

#: Turns of a conversation are numbered and hashed in blocks of so many turn values, so that one task holds one block of a long conversation at most.
BLOCK = 1024
_LAST = (1 << 62) - 1
_HASH = ["_h0", "_h1", "_h2", "_h3"]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Each turn with its position from 1, the number of turns, and a hash of all turns up to it: sums of the 32-bit halves of two hashes of position, role and text."""
    t = turns.select(
        F.col("conv_id").alias("_c"), F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"), F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(_LAST)).alias("_block")
    )
    key = F.coalesce(F.col("_c").cast("string"), F.lit("")), F.col("_c").isNull()
    t = t.withColumns({"_k": key[0], "_null": key[1]})
    own, upto = W.partitionBy("_k", "_null"), W.partitionBy("_k", "_null").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("_k", "_null", "_block").orderBy(F.col("_turn").asc_nulls_last(), "_role", "_text")
    names = ["_k", "_null", "_block"]
    counts = t.groupBy(*names).count().select(*names, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_skip"), F.sum("count").over(own).alias("_n"))
    t = t.withColumn("_rn", F.row_number().over(inside)).join(counts, names).withColumn("_pos", F.col("_skip") + F.col("_rn"))
    one, two = F.xxhash64("_pos", "_role", "_text"), F.xxhash64(F.lit(1), "_text", "_role", "_pos")
    halves = {"_h0": F.shiftrightunsigned(one, 32), "_h1": one.bitwiseAND(F.lit(0xFFFFFFFF)), "_h2": F.shiftrightunsigned(two, 32), "_h3": two.bitwiseAND(F.lit(0xFFFFFFFF))}
    t = t.withColumns(halves)
    sums = t.groupBy(*names).agg(*[F.sum(c).alias(f"{c}b") for c in halves]).select(*names, *[F.coalesce(F.sum(f"{c}b").over(upto), F.lit(0)).alias(f"{c}b") for c in halves])
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    return t.withColumns({c: F.sum(c).over(so_far) for c in halves}).join(sums, names).withColumns({c: F.col(c) + F.col(f"{c}b") for c in halves})


def format_chats(turns: DataFrame, template: str = "<|{role}|>\n{text}<|end|>\n") -> DataFrame:
    """The turns of maximal conversations, rendered: conv_id, position (from 1), n_turns, role, rendered.

    A conversation goes if all its turns (role and text, in order of turn) begin
    a longer one, or equal another one with a smaller conv_id. Turns stay rows,
    so no conversation has to fit in one; `render` joins those that do. Null
    turn: after all others. Null role or text: empty. Null conv_id: one
    conversation. Turns of one number: ordered by role, then text, those of one
    conversation in one task. Very long texts are never joined unless `render`
    does it; repeated turns count as often as they stand. No rows: no rows.
    Other columns are left out.
    """
    t = stored(prefix_hashes(turns).select("_c", "_k", "_null", "_pos", "_n", *_HASH, "_role", "_text"))
    same = ["_pos", *_HASH]
    longest = t.where(F.col("_pos") == F.col("_n")).groupBy(*same).agg(F.min(F.struct("_null", "_c", "_k")).alias("_kept"))
    inner = t.where(F.col("_pos") < F.col("_n")).select(*same).distinct()
    kept = longest.join(inner, same, "left_anti").select(F.col("_kept._k").alias("_k"), F.col("_kept._null").alias("_null"))
    pieces: list = []
    for i, part in enumerate(template.replace("{role}", "\0role\0").replace("{text}", "\0text\0").split("\0")):
        pieces.append(F.lit(part) if i % 2 == 0 else F.col(f"_{part}"))
    return t.join(kept, ["_k", "_null"], "left_semi").select(F.col("_c").alias("conv_id"), F.col("_pos").cast("long").alias("position"), F.col("_n").cast("long").alias("n_turns"), F.col("_role").alias("role"), F.concat(*pieces).alias("rendered"))


def render(rows: DataFrame) -> DataFrame:
    """One text for each conversation; for conversations that fit in a row."""
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "rendered"))), lambda x: x["rendered"]), "").alias("text"))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, ''))),
p AS (
  SELECT *, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY position) AS prefix FROM t),
longest AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE position = n_turns GROUP BY prefix),
kept AS (SELECT l.conv_id FROM longest l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.position < p.n_turns AND p.prefix = l.prefix))
SELECT conv_id, position, n_turns, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
FROM t WHERE conv_id IN (SELECT conv_id FROM kept)
"""
