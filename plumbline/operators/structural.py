"""Fan-in, fan-out, density and hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.config import Config
from plumbline.functions.buckets import bucket, severity


def fan(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) for every unit and every end of an edge, zeros kept; one pass over the ends."""
    ends = units.select("id", F.lit(0).alias("i"), F.lit(0).alias("o"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))).unionByName(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def fan_distribution(fans: DataFrame, metric: str) -> DataFrame:
    return fans.select(F.lit(metric).alias("metric"), "id", F.col(metric).alias("value"))


def fan_summary(fans: DataFrame) -> DataFrame:
    """One row: maximum and mean of both."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return fans.agg(*[zero(f(c)).alias(f"{c}_{n}") for c in ("fan_in", "fan_out") for n, f in (("max", F.max), ("mean", F.avg))])


def dag_density(units: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and edges by (nodes - 1); 0 for one node or none. Rows count, not ids."""
    both = units.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    s = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))
    return s.withColumn("dag_density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") - 1)).otherwise(F.lit(0.0)))


def hubs(fans: DataFrame, config: Config = Config()) -> DataFrame:
    return fans.where((F.col("fan_in") >= config.hub_min_fan_in) & (F.col("fan_out") >= config.hub_min_fan_out))


def bucketed_summary(units: DataFrame, edges: DataFrame, config: Config = Config()) -> DataFrame:
    """(name, value, bucket) of density and of both fans' maximum and mean."""
    t = config.thresholds
    density = dag_density(units, edges).select(F.explode(F.array(F.struct(F.lit("dag_density").alias("name"), F.col("dag_density").alias("value"), bucket(severity("dag_density", t["dag_density"])).alias("bucket")))).alias("x"))
    s = fan_summary(fan(units, edges))
    parts = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), bucket(severity(c, t[c])).alias("bucket")) for c in ("fan_in_max", "fan_in_mean", "fan_out_max", "fan_out_mean")]
    return density.unionAll(s.select(F.explode(F.array(*parts)).alias("x"))).select("x.*")
