"""Size, parameters and complexity of functions and methods; lines of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .distribution import long_form

FUNCTIONS = ("Function", "Method")
COMPLEXITY = {"function_size": "size", "params": "params", "cyclomatic": "cyclomatic", "cognitive": "cognitive", "max_scope": "max_scope"}


def complexity(units: DataFrame) -> DataFrame:
    """One row for each id of a function or method; the last unit loaded counts where an id repeats."""
    f = units.where(F.col("kind").isin(*FUNCTIONS)).select(
        "id",
        "unit_ord",
        (F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)) + 1).alias("size"),
        "params",
        (F.col("branches") + 1).alias("cyclomatic"),
        F.col("cognitive_complexity").alias("cognitive"),
        F.col("max_scope_lines").alias("max_scope"),
    )
    values = ["size", "params", "cyclomatic", "cognitive", "max_scope"]
    return f.groupBy("id").agg(F.max_by(F.struct(*values), "unit_ord").alias("x")).select("id", *[F.col(f"x.{v}").alias(v) for v in values])


def complexity_distribution(units: DataFrame) -> DataFrame:
    return long_form(complexity(units), COMPLEXITY)


def file_loc(units: DataFrame) -> DataFrame:
    """Lines of each file: the last line of its units."""
    return units.groupBy(F.col("file").alias("id")).agg(F.max("end_line").alias("value")).select(F.lit("file_loc").alias("metric"), "id", "value")
