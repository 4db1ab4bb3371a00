"""Line and branch coverage of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .attribution import innermost
from .complexity import FUNCTIONS

#: Hit counts are unsigned 64-bit numbers that stop at their maximum; here they stop at that of a signed one.
TOP = (1 << 63) - 1


def merge_lines(lines: DataFrame) -> DataFrame:
    """Hits of a line over all records and files of input."""
    total = F.sum(F.col("hits").cast("decimal(38,0)"))
    return lines.groupBy("file", "line").agg(F.least(total, F.lit(TOP).cast("decimal(38,0)")).cast("bigint").alias("hits"))


def coverage(units: DataFrame, lines: DataFrame, branches: DataFrame) -> DataFrame:
    """(id, total, hit, line_cov, uncov_branches, matched) of each function and method. Lines and branches belong to the innermost one; without data line_cov is 0."""
    spans = units.where(F.col("kind").isin(*FUNCTIONS)).select("id", "file", "start_line", "end_line")
    merged = merge_lines(lines)
    owners = innermost(merged.select("file", "line").unionAll(branches.select("file", "line")), spans)
    own = merged.join(owners, ["file", "line"]).groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("total"), F.count_if(F.col("hits") > 0).alias("hit"))
    cold = branches.join(owners, ["file", "line"]).groupBy(F.col("owner").alias("id")).agg(F.count_if(F.col("taken") == 0).alias("uncov"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = spans.select("id").distinct().join(own, "id", "left").join(cold, "id", "left")
    return out.select("id", zero("total").alias("total"), zero("hit").alias("hit"), F.when(F.col("total") > 0, F.floor(F.col("hit") * 100 / F.col("total"))).otherwise(0).cast("bigint").alias("line_cov"), zero("uncov").alias("uncov_branches"))


def coverage_distribution(covered: DataFrame, has_branches: bool = True) -> DataFrame:
    line = covered.select(F.lit("line_cov").alias("metric"), "id", F.col("line_cov").alias("value"))
    return line.unionAll(covered.select(F.lit("uncov_branches"), "id", "uncov_branches")) if has_branches else line


def counters(units: DataFrame, lines: DataFrame, branches: DataFrame) -> DataFrame:
    """One row: units_analyzed, units_without_data, lcov_files_total, lcov_files_matched, has_branches."""
    covered = coverage(units, lines, branches).agg(F.count("*").alias("units_analyzed"), F.count_if(F.col("total") == 0).alias("units_without_data"))
    files = lines.select("file").unionAll(branches.select("file")).distinct()
    sources = units.where(F.col("kind").isin(*FUNCTIONS)).select("file").distinct().withColumn("own", F.lit(1))
    matched = files.join(sources, "file", "left").agg(F.count("*").alias("lcov_files_total"), F.count("own").alias("lcov_files_matched"))
    any_branch = branches.agg((F.count("*") > 0).alias("has_branches"))
    one = lambda d: d.withColumn("_one", F.lit(1))
    return one(covered).join(one(matched), "_one").join(one(any_branch), "_one").drop("_one")


def warnings(counted: DataFrame) -> DataFrame:
    """(warning): no file of the report is a source, or half of the units have no data; and no branch records."""
    none = (F.col("units_analyzed") > 0) & (F.col("lcov_files_total") > 0) & (F.col("lcov_files_matched") == 0)
    half = (F.col("units_analyzed") > 0) & (F.col("units_without_data") * 2 >= F.col("units_analyzed"))
    first = F.when(none, F.lit("no_file_matches")).when(half, F.lit("units_without_data"))
    return counted.select(F.explode(F.filter(F.array(first, F.when(~F.col("has_branches"), F.lit("no_branch_records"))), lambda x: x.isNotNull())).alias("warning"))
