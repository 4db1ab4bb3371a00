"""Lines to the innermost unit that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Lines are met with units by blocks of so many lines, so that a huge file is not one task.
BLOCK = 4096


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line) of `points` with `owner`: the id of the shortest of `spans` (id, file, start_line, end_line) that holds the line, ties by id. Lines outside all go."""
    div = lambda c: F.floor(F.col(c) / BLOCK)
    s = spans.where("end_line >= start_line").select("id", "file", "start_line", "end_line", F.explode(F.sequence(div("start_line"), div("end_line"))).alias("_b"))
    p = points.select("file", "line").distinct().withColumn("_b", div("line"))
    held = p.join(s, ["file", "_b"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return held.groupBy("file", "line").agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), F.col("id"))).alias("owner"))
