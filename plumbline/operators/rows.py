"""Report rows: bucket, suppression, ranking and the global cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.config import BORING, COLLECTED, Config, LOWER_IS_WORSE, SHOWN
from plumbline.functions.buckets import bucket, severity_of, severity_size, shown_value



def _place(names) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), F.col("metric")).cast("int")


def worst(distribution: DataFrame) -> Column:
    """Ascending from the worst value of a metric; by the unrounded value where there is one."""
    v = F.coalesce("raw", F.col("value").cast("double")) if "raw" in distribution.columns else F.col("value").cast("double")
    return F.when(F.col("metric").isin(*LOWER_IS_WORSE), v).otherwise(-v)


def score(distribution: DataFrame, fans: DataFrame, config: Config = Config(), symbol: str | None = None) -> DataFrame:
    """Rows (metric, symbol, value, bucket, severity, collect_ord, worst) that are worth showing; worst orders them within a metric, then symbol.

    fan_out is hidden for delegators, params for wide signatures (cyclomatic and
    cognitive both under fair), cyclomatic for dispatchers (cognitive under
    fair), fan_in for all but hubs; for one symbol nothing of that is. Values
    that are looked up count 0 where missing, whatever is disabled.
    """
    d = distribution.withColumn("worst", worst(distribution))
    looked = d.where(F.col("metric").isin("cyclomatic", "cognitive")).groupBy("id").agg(F.max(F.when(F.col("metric") == "cyclomatic", F.col("value"))).alias("_cyc"), F.max(F.when(F.col("metric") == "cognitive", F.col("value"))).alias("_cog"))
    f = fans.select("id", F.col("fan_in").alias("_in"), F.col("fan_out").alias("_out"))
    if symbol is not None:
        d = d.where(F.col("id") == symbol)
    d = d.where(~F.col("metric").isin(*config.disabled_metrics)) if config.disabled_metrics else d
    d = d.join(looked, "id", "left").join(f, "id", "left").fillna(0, ["_cyc", "_cog", "_in", "_out"])
    v, m = F.col("value"), F.col("metric")
    dull = reduce(lambda acc, x: acc | ((m == x[0]) & ((v >= x[1]) if x[0] in LOWER_IS_WORSE else (v <= x[1]))), [x for x in BORING.items() if x[0] != "function_size"], F.lit(False))
    dull |= (m == "function_size") & (v <= BORING["function_size"]) & (F.col("_in") != 1)
    shallow = F.col("_cog") < config.by_name("cognitive").fair
    simple = shallow & (F.col("_cyc") < config.by_name("cyclomatic").fair)
    hub = (F.col("_in") >= config.hub_min_fan_in) & (F.col("_out") >= config.hub_min_fan_out)
    hidden = (m.isin("fan_out", "params") & simple) | ((m == "cyclomatic") & shallow) | ((m == "fan_in") & ~hub)
    d = d.where(~dull) if symbol is not None else d.where(~dull & ~hidden)
    level = F.when(m == "function_size", severity_size(v, "_in", config.function_size)).otherwise(severity_of(m, v, config, [x for x in SHOWN if x != "function_size"]))
    return d.select("metric", F.col("id").alias("symbol"), shown_value(m, v).alias("value"), bucket(level).alias("bucket"), level.alias("severity"), _place(COLLECTED).alias("collect_ord"), "worst")


def without_ignored(rows: DataFrame, ignores: DataFrame) -> DataFrame:
    """ignores: (symbol, metric)."""
    return rows.join(ignores.select("symbol", "metric").distinct(), ["symbol", "metric"], "left_anti")


def top_rows(rows: DataFrame, k: int) -> DataFrame:
    """The k worst rows of all metrics together (all, if negative), with shown_ord: grouped by metric in the order of display, worst first."""
    order = [F.desc("severity"), "collect_ord", "worst", "symbol"]
    chosen = rows if k < 0 else rows.orderBy(*order).limit(k)
    return chosen.withColumn("metric_ord", _place(SHOWN)).orderBy("metric_ord", *order)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds shown_ord, from 1, to rows that a cut has bounded."""
    return rows.withColumn("shown_ord", F.row_number().over(W.orderBy("metric_ord", F.desc("severity"), "collect_ord", "worst", "symbol")).cast("bigint"))


def symbol_values(distribution: DataFrame, fans: DataFrame, symbol: str, config: Config = Config()) -> DataFrame:
    """(metric, value, bucket): every value of one symbol, dull ones too."""
    d = distribution.where((F.col("id") == symbol) & ~F.col("metric").isin(*config.disabled_metrics, "")).join(fans.select("id", "fan_in"), "id", "left")
    level = F.when(F.col("metric") == "function_size", severity_size("value", "fan_in", config.function_size)).otherwise(severity_of("metric", "value", config, [x for x in SHOWN if x != "function_size"]))
    return d.select("metric", "value", bucket(level).alias("bucket"))
