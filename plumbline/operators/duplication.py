"""How much of each unit is copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .attribution import innermost


def duplicated_lines(clones: DataFrame) -> DataFrame:
    """Distinct (file, line) of both sides of clones."""
    return lines_of(clones.select(F.col("file_a").alias("file"), F.col("start_line_a").alias("start_line"), F.col("end_line_a").alias("end_line")).unionAll(clones.select("file_b", "start_line_b", "end_line_b")))


def lines_of(spans: DataFrame) -> DataFrame:
    """Distinct (file, line) of spans (file, start_line, end_line)."""
    return spans.distinct().select("file", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()


def duplication(clones: DataFrame, units: DataFrame) -> DataFrame:
    """(id, pct): a row for each unit but modules. Lines belong to the innermost unit; the whole span divides, lines of nested units too; lines of one id count together."""
    return share(duplicated_lines(clones), units)


def share(copied: DataFrame, units: DataFrame) -> DataFrame:
    """As duplication, of the (file, line) that are copied."""
    spans = units.where("kind <> 'Module'").select("id", "file", "start_line", "end_line")
    lines = innermost(copied, spans).groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("n"))
    span = F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)) + 1
    return spans.join(lines, "id", "left").select("id", (F.coalesce("n", F.lit(0)) * 100.0 / span).alias("pct"))


def duplication_distribution(pct: DataFrame) -> DataFrame:
    """Units with any, rounded; `raw` orders them."""
    return pct.where("pct > 0").select(F.lit("duplication_pct").alias("metric"), "id", F.round("pct").cast("bigint").alias("value"), F.col("pct").alias("raw"))


def duplication_summary(pct: DataFrame, clones: DataFrame) -> DataFrame:
    """One row: max, mean of those over 0, nearest-rank p90 of all, and the number of clones."""
    n = clones.agg(F.count("*").alias("clone_count"))
    s = pct.agg(F.coalesce(F.max("pct"), F.lit(0.0)).alias("max"), F.coalesce(F.avg(F.when(F.col("pct") > 0, F.col("pct"))), F.lit(0.0)).alias("mean"), F.coalesce(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY pct)"), F.lit(0.0)).alias("p90"))
    return s.withColumn("_one", F.lit(1)).join(n.withColumn("_one", F.lit(1)), "_one").drop("_one")


def whole_files(tokens: DataFrame) -> DataFrame:
    """A unit `<path>::all` for each file, from line 1 to that of its last token."""
    return tokens.groupBy("file").agg(F.max("line").alias("end_line")).select(F.concat("file", F.lit("::all")).alias("id"), "file", F.lit(1).cast("bigint").alias("start_line"), F.col("end_line").cast("bigint"), F.lit("Function").alias("kind"))
