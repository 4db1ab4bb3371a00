"""LCOV coverage reports."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from plumbline.functions.names import normalised, within


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(input, content) of report files."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("input"), F.col("value").alias("content"))


def readable(paths: list[str], root: str) -> tuple[list[str], list[str]]:
    """Report files, relative ones below the root, and a warning for each that cannot be read."""
    good, bad = [], []
    for p in paths:
        if "://" in p:
            good.append(p)
            continue
        own = os.path.join(root, p)
        try:
            with open(own, encoding="utf-8") as f:
                f.read(1)
            good.append(Path(own).resolve().as_uri())
        except (OSError, UnicodeDecodeError) as e:
            bad.append(f"skipped --cov {own}: {e}")
    return good, bad


def parse(reports: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """cov_lines (file, line, hits) and cov_branches (file, line, taken), one row for each record.

    A record belongs to the last SF before it, up to end_of_record. Records that
    are not well formed go; a taken that is no number is 0. A third field of DA
    is ignored. Relative files are resolved against the root.
    """
    lines = reports.select("input", F.posexplode(F.split("content", "\r?\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    tag, rest = F.substring_index("line", ":", 1), F.when(F.instr("line", ":") > 0, F.substr("line", F.instr("line", ":") + 1))
    lines = lines.withColumns({"tag": F.when(rest.isNotNull(), tag), "rest": rest})
    file = normalised(F.col("rest"), root) if root else F.col("rest")
    mark = F.when(F.col("line") == "end_of_record", F.lit("")).when(F.col("tag") == "SF", file)
    lines = lines.withColumn("file", F.last(mark, ignorenulls=True).over(W.partitionBy("input").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    found = lines.where((F.col("file") != "") & F.col("tag").isin("DA", "BRDA")).withColumn("part", F.split("rest", ","))
    number = lambda i: F.when(F.get("part", F.lit(i)).rlike(r"^\+?[0-9]+$"), F.least(F.col("part")[i].cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint"))
    da = found.where("tag = 'DA'").select("file", number(0).alias("line"), number(1).alias("hits")).where("line is not null and hits is not null")
    brda = found.where("tag = 'BRDA' and size(part) >= 4").select("file", number(0).alias("line"), F.coalesce(number(3), F.lit(0)).cast("bigint").alias("taken")).where("line is not null")
    return da, brda


def below(cov: tuple[DataFrame, DataFrame], *roots: str) -> tuple[DataFrame, DataFrame]:
    """Lines and branches with files relative to the project, as its units have them. roots: names of one folder, as links give it several."""
    return tuple(x.withColumn("file", within("file", *roots)) for x in cov)
