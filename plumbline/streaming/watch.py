"""A cache folder as a stream of units: each batch replaces the files that it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.schemas import CACHE


def unit_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """(source_path, cached_at, unit) of entries as they are written."""
    entries = spark.readStream.schema(CACHE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("maxFilesPerTrigger", per_batch).json(folder)
    return entries.select("source_path", "cached_at", F.explode("units").alias("unit"))


def lines_by_file(stream: DataFrame) -> DataFrame:
    """Last line and number of units of each file and generation, kept up to date."""
    return stream.groupBy("source_path", "cached_at").agg(F.max("unit.span.end_line").alias("lines"), F.count("*").alias("units"))
