"""What a change touches: metrics are computed over everything, then shown for that alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.store import stored

from .distribution import summary

#: Lines of a block.
LINES = 4096


def union_changes(ranges: DataFrame, untracked: DataFrame) -> DataFrame:
    """Changed ranges (file, whole_file, start_line, end_line) with untracked files, which are changed as a whole."""
    whole = untracked.select("file", F.lit(True).alias("whole_file"), F.lit(None).cast("bigint").alias("start_line"), F.lit(None).cast("bigint").alias("end_line"))
    return ranges.join(untracked.select("file").distinct(), "file", "left_anti").unionByName(whole)


def changed_units(units: DataFrame, changed: DataFrame) -> DataFrame:
    """Units whose span a changed line falls in. Spans meet changes by file and by block of lines, so a huge file is no single task."""
    whole = changed.where("whole_file").select("file").distinct()
    span = ["file", "start_line", "end_line"]
    block = lambda lo, hi: F.explode(F.sequence(F.floor(F.least(lo, hi) / LINES), F.floor(F.greatest(lo, hi) / LINES))).alias("_block")
    spans = units.select(*span).distinct()
    lines = changed.where("not whole_file").select("file", F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), block("start_line", "end_line"))
    touch = ["file", "_block"]
    meet = spans.select(*span, block("start_line", "end_line")).join(lines, touch).where((F.col("_s") <= F.col("end_line")) & (F.col("start_line") <= F.col("_e")))
    hit = meet.select(*span).unionAll(units.join(whole, "file", "left_semi").select(*span)).distinct()
    return units.join(hit, span, "left_semi")


def with_parents(ids: DataFrame, units: DataFrame) -> DataFrame:
    """`ids` (id, source file) with the parents of their units, and theirs, within one source file. Each generation is written once."""
    links = stored(units.where("parent is not null").select("id", "file", "parent").distinct())
    known = fresh = stored(ids.select("id", "file").distinct())
    while True:
        fresh = stored(fresh.join(links, ["id", "file"]).select(F.col("parent").alias("id"), "file").distinct().join(known, ["id", "file"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionAll(fresh)


def display_scope(units: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id) of units in scope, and (file) of touched files."""
    ids = with_parents(changed_units(units, changed).select("id", "file"), units).select("id").distinct()
    files = units.select("file").join(changed.select("file").distinct(), "file", "left_semi").distinct()
    return ids, files


def retain(distribution: DataFrame, ids: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a distribution in scope; file_loc by file."""
    keys = ids.select("id", F.lit(False).alias("by_file")).unionAll(files.select("file", F.lit(True)))
    d = distribution.withColumn("by_file", F.col("metric") == "file_loc")
    return d.join(keys, ["id", "by_file"], "left_semi").drop("by_file")


def scoped_summary(distribution: DataFrame, ids: DataFrame, files: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Summary of what is in scope; of duplication from its rounded values."""
    return summary(retain(distribution, ids, files).select("metric", "id", "value"), metrics)


def describe(mode: str, units: int = 0, files: int = 0, detail: str = "") -> str:
    if mode == "whole-project":
        return "whole project"
    if mode in ("path", "symbol"):
        return f"{mode} {detail}"
    what = "uncommitted changes" if mode == "uncommitted" else f"branch diff vs {detail}"
    return f"{what} ({units} unit{'' if units == 1 else 's'} in {files} file{'' if files == 1 else 's'})"
