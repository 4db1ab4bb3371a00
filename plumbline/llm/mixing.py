"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ._store import stored

WORD = r"[^\x20\x09-\x0D]+"
#: A table of so many sources at most is broadcast (about 200 bytes each); beyond it, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def _near(table: DataFrame, n: int) -> DataFrame:
    """A table with a row for each of `n` sources, broadcast if they are few."""
    return F.broadcast(table) if n <= BROADCAST_SOURCES else table


def targets(sizes: DataFrame, weights: Sequence[float], epochs: float) -> DataFrame:
    """(_source, _total) to (…, _target): shares of the sum by weight, none above epochs times its total.

    Sources take the weights in turn, by code point, null last. In the order of
    cap / weight, the sources that are capped come first; the level is the
    largest `rest / rest of weights` that its own source can take.
    """
    by_name, by_ratio = W.orderBy(F.col("_source").asc_nulls_last()), W.orderBy("_ratio", F.col("_source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("_weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.lit(float(epochs)) * F.col("_total"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_rest", F.sum("_total").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest_weight", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_own", F.col("_rest") / F.col("_rest_weight"))
        .withColumn("_level", F.max(F.when(F.col("_own") <= F.col("_ratio"), F.col("_own"))).over(everything))
        .select("_source", "_total", F.coalesce(F.least("_cap", F.col("_level") * F.col("_weight")), F.col("_cap")).alias("_target"))
    )


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 3, seed: int = 0, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with how many words of each the mix takes.

    Adds size, source_size, target and taken (columns of these names are
    replaced). Every document of a source comes whole `floor(target / size of
    the source)` times; the rest is filled with one more copy of documents in
    the order of a seeded hash of key and text, up to the last document that ends
    below the target, and one more copy of the document that comes nearest to
    what is then missing (of equally near ones that with the smallest hash). The
    hash space is cut into 4096 ranges summed before the shuffle, so only one
    range of a source is ever sorted in one task.

    Null text: size 0. Null source: a source of its own, after all others.
    Null key: the text alone is hashed. Rows equal in key and text share a hash;
    of those at the edge as many are taken as fit, in any order, for they differ
    in nothing that is mixed. Very long texts are rows like others. No rows: no
    rows.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))) if key else F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(text), F.lit(""))))
    counted = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    hashes = stored(docs.select(F.col(source).alias("_source"), hashed.alias("_h"), counted.alias("_size")).groupBy("_source", "_h").agg(F.count("*").alias("_n"), F.min("_size").alias("_size")))
    plan, n = _plan(hashes, weights, epochs)

    # the columns of the documents travel as one, apart from those of the plan
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("_own"), docs[source].alias("_s"), counted.alias("_size"), hashed.alias("_h")).join(_near(plan, n), F.col("_s").eqNullSafe(F.col("_source"))).drop("_s")
    part = (F.col("_h") == F.col("_edge")) | (F.col("_h") == F.col("_one"))
    take = F.when(F.col("_h") == F.col("_edge"), F.col("_edge_take")).otherwise(1)
    of = F.when(F.col("_h") == F.col("_edge"), F.col("_edge_n")).otherwise(F.col("_one_n"))
    rows = rows.withColumns({"_take": F.when(part, take).when(F.col("_h") <= F.col("_cut"), 1).otherwise(0), "_of": F.when(part, of).otherwise(1)})
    split = (F.col("_take") > 0) & (F.col("_take") < F.col("_of"))
    result = lambda d, more: d.select("_own.*", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * (F.col("_whole") + more)).cast("long").alias("taken"))
    out = result(rows.where(~split), F.least("_take", F.lit(1)))
    edge_split, one_split = (F.col("_edge_take") > 0) & (F.col("_edge_take") < F.col("_edge_n")), F.col("_one_n") > 1
    if plan.where(F.coalesce(edge_split, F.lit(False)) | F.coalesce(one_split, F.lit(False))).isEmpty():
        return out
    # equal rows of which some are taken: numbered by the task that wrote them, then within it
    tied = stored(rows.where(split).withColumn("_id", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_id", 33))
    group = ["_source", "_h"]
    before = W.partitionBy(*group).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    skip = tied.groupBy(*group, "_task").count().select(F.col("_source").alias("_s"), F.col("_h").alias("_h1"), F.col("_task").alias("_t"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_skip"))
    number = F.row_number().over(W.partitionBy(*group, "_task").orderBy("_id")) + F.col("_skip")
    numbered = tied.join(skip, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_h1")) & (F.col("_task") == F.col("_t"))).withColumn("_number", number)
    return out.unionByName(result(numbered, F.when(F.col("_number") <= F.col("_take"), 1).otherwise(0)))


def _plan(hashes: DataFrame, weights: Sequence[float], epochs: float) -> tuple[DataFrame, int]:
    """One row for each source, stored, and their number: its size, target, whole copies, the last hash that comes once more whole, and two hashes of which some rows come once more: that at the edge (_edge_take of _edge_n rows) and that of the nearest document (one of _one_n rows)."""
    words_ = F.col("_n") * F.col("_size")
    hashes = hashes.withColumn("_bucket", F.substring("_h", 1, 3))
    parts = stored(hashes.groupBy("_source", "_bucket").agg(F.sum(words_).alias("_part")))
    n = parts.select("_source").distinct().count()
    goal = targets(parts.groupBy("_source").agg(F.sum("_part").alias("_total")), weights, epochs)
    goal = stored(goal.withColumn("_whole", F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(F.lit(0))).withColumn("_fill", F.col("_target") - F.col("_whole") * F.col("_total")))

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    running = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        parts.withColumn("_before", F.coalesce(F.sum("_part").over(running), F.lit(0)))
        .join(_near(goal.select(F.col("_source").alias("_s"), "_fill"), n), same("_source", "_s"))
        .where((F.col("_fill") > F.col("_before")) & (F.col("_fill") <= F.col("_before") + F.col("_part")))
        .select("_s", F.col("_bucket").alias("_b"), "_before", "_fill")
    )
    inside = W.partitionBy("_s").orderBy("_h").rowsBetween(W.unboundedPreceding, 0)
    whole, over = F.col("_end") <= F.col("_fill"), F.col("_end") > F.col("_fill")
    fits = F.floor((F.col("_fill") - F.col("_end") + words_) / F.col("_size"))
    cut = (
        hashes.join(_near(edge, n), same("_source", "_s") & (F.col("_bucket") == F.col("_b")))
        .withColumn("_end", F.col("_before") + F.sum(words_).over(inside))
        .withColumns({"_fits": F.when(over, fits), "_start": F.when(over, F.col("_end") - words_)})
        .groupBy("_s")
        .agg(
            F.max(F.when(whole, F.col("_h"))).alias("_last"), F.first("_b").alias("_b"), F.max(F.when(whole, F.col("_end"))).alias("_upto"), F.first("_before").alias("_before"),
            F.min(F.when(over, F.struct("_h", "_fits", "_n", "_size", "_start"))).alias("_x"),
        )
        .select("_s", F.coalesce("_last", "_b").alias("_cut"), F.col("_x._h").alias("_edge"), F.col("_x._fits").alias("_edge_take"), F.col("_x._n").alias("_edge_n"), F.coalesce(F.col("_x._start") + F.col("_x._fits") * F.col("_x._size"), "_upto", "_before").alias("_upto"))
    )
    plan = goal.join(_near(cut, n), same("_source", "_s"), "left").drop("_s").withColumn("_gap", F.when(F.col("_cut").isNotNull(), F.col("_fill") - F.col("_upto")).otherwise(F.lit(0.0))).withColumn("_cut", F.coalesce("_cut", F.lit("")))
    plan = stored(plan)
    off = F.abs(F.col("_gap") - F.col("_size"))
    last = (
        hashes.select("_source", "_h", "_n", "_size")
        .join(_near(plan.where("_gap > 0").select(F.col("_source").alias("_s"), "_cut", "_gap"), n), same("_source", "_s") & (F.col("_h") > F.col("_cut")) & (off < F.col("_gap")))
        .groupBy("_s")
        .agg(F.min(F.struct(off.alias("off"), "_h", "_n")).alias("_x"))
        .select("_s", F.col("_x._h").alias("_one"), F.col("_x._n").alias("_one_n"))
    )
    plan = plan.join(_near(last, n), same("_source", "_s"), "left").drop("_s")
    both = F.coalesce(F.col("_one") == F.col("_edge"), F.lit(False))
    plan = plan.select(
        "_source", "_total", "_target", "_whole", "_cut", "_edge", "_edge_n", (F.col("_edge_take") + both.cast("int")).alias("_edge_take"), F.when(~both, F.col("_one")).alias("_one"), F.when(~both, F.col("_one_n")).alias("_one_n")
    )
    return stored(plan), n


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(3 AS DOUBLE) * total AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (
  SELECT *, (CAST(sum(total) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS own
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, coalesce(least(cap, max(CASE WHEN own <= ratio THEN own END) OVER () * weight), cap) AS target FROM l),
p AS (SELECT source, total, target, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS whole FROM g),
c AS (
  SELECT d.*, p.total, p.target, p.whole, p.target - p.whole * p.total AS fill, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
f AS (SELECT *, fill > 0 AND upto <= fill AS inside, fill - coalesce(max(CASE WHEN upto <= fill THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY source, NOT inside AND abs(gap - size) < gap ORDER BY abs(gap - size), h) = 1 AND NOT inside AND abs(gap - size) < gap AS one FROM f)
SELECT doc_id, size, total AS source_size, target, CAST(size * (whole + CASE WHEN inside OR one THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
