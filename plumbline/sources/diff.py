"""Unified diffs as changed line ranges of the new side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def parse(diffs: DataFrame) -> DataFrame:
    """(file, whole_file, start_line, end_line) from (input, content).

    A hunk +c,d gives c to c + d - 1; without d, d is 1; a pure deletion gives
    the lines on either side of it, line 1 alone at the top. Deleted files go.
    """
    lines = diffs.select("input", F.posexplode(F.split("content", "\r?\n")).alias("at", "line"))
    header = F.when(F.col("line").startswith("+++ "), F.when(F.col("line").startswith("+++ b/"), F.substr("line", F.lit(7))).otherwise(F.lit("")))
    lines = lines.withColumn("file", F.last(header, ignorenulls=True).over(W.partitionBy("input").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    plus = r"^@@ (?:[^+ ][^ ]* )*\+(\d+)(?:,(\d+))?(?: |$)"
    hunks = lines.where((F.col("file") != "") & F.col("line").rlike(plus))
    c = F.regexp_extract("line", plus, 1).cast("bigint")
    d = F.when(F.regexp_extract("line", plus, 2) == "", F.lit(1)).otherwise(F.expr(f"try_cast(regexp_extract(line, r'{plus}', 2) AS bigint)"))
    start = F.when(d == 0, F.greatest(c, F.lit(1))).otherwise(c)
    end = F.when(d == 0, c + 1).otherwise(c + d - 1)
    return hunks.select("file", F.lit(False).alias("whole_file"), start.alias("start_line"), end.alias("end_line"))
