"""Long tables of (metric, id, value), their summaries and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.config import LOWER_IS_WORSE


def long_form(wide: DataFrame, metrics: dict[str, str], key: str = "id") -> DataFrame:
    """One row for each metric of each unit. metrics: name to column."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("bigint").alias("value")) for m, c in metrics.items()])
    return wide.select(F.col(key).alias("id"), F.explode(pairs).alias("x")).select("x.metric", "id", "x.value")


def summary(distribution: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """metric, n, max, mean, p90 (nearest rank, at 0.1 where lower is worse), total; a row of zeros for a metric without values."""
    base = distribution.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    low = F.lit(False) if not set(metrics) & LOWER_IS_WORSE else F.first("metric").isin(*LOWER_IS_WORSE)
    found = distribution.groupBy("metric").agg(F.count("*").alias("n"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.when(low, p(0.1)).otherwise(p(0.9)).cast("bigint").alias("p90"), F.sum("value").alias("total"))
    zero = {"n": 0, "max": 0, "mean": 0.0, "p90": 0, "total": 0}
    return base.join(found, "metric", "left").fillna(zero)


def ranked(distribution: DataFrame, order="value") -> DataFrame:
    """Adds dist_rank: worst first within the metric, ties by id."""
    v = F.col(order) if isinstance(order, str) else order
    worst = F.when(F.col("metric").isin(*LOWER_IS_WORSE), v).otherwise(-v)
    return distribution.withColumn("dist_rank", F.row_number().over(W.partitionBy("metric").orderBy(worst, "id")).cast("bigint"))


def top(distribution: DataFrame, metric: str, n: int = 10, over: int = 0, filter_first: bool = True) -> DataFrame:
    """The first n of a metric over a value; or the first n, of which those over it stay."""
    d = distribution.where(F.col("metric") == metric)
    keep = F.col("value") > over
    order = [F.desc("value"), "id"]
    return d.where(keep).orderBy(*order).limit(n) if filter_first else d.orderBy(*order).limit(n).where(keep)
