"""Severity buckets as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.config import BUCKETS, Config, LOWER_IS_WORSE, Thresholds, TwoSided


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity(value, t: Thresholds) -> Column:
    """0 to 4; higher values are worse."""
    v = _col(value)
    return F.when(v < t.excellent, 0).when(v < t.good, 1).when(v < t.fair, 2).when(v < t.poor, 3).otherwise(4)


def severity_low(value, t: Thresholds) -> Column:
    """0 to 4; lower values are worse."""
    v = _col(value)
    return F.when(v >= t.excellent, 0).when(v >= t.good, 1).when(v >= t.fair, 2).when(v >= t.poor, 3).otherwise(4)


def severity_two_sided(value, t: TwoSided) -> Column:
    return F.greatest(severity_low(value, t.low), severity(value, t.high))


def severity_size(value, fan_in, t: TwoSided) -> Column:
    """The low side counts for units with a single caller only."""
    return F.when(F.coalesce(_col(fan_in), F.lit(0)) == 1, severity_two_sided(value, t)).otherwise(severity(value, t.high))


def severity_of(metric, value, config: Config, names) -> Column:
    """By the metric of each row (function_size: high side)."""
    out = None
    for name in names:
        s = (severity_low if name in LOWER_IS_WORSE else severity)(value, config.by_name(name))
        out = F.when(_col(metric) == name, s) if out is None else out.when(_col(metric) == name, s)
    return out


def bucket(level) -> Column:
    return F.element_at(F.array(*map(F.lit, BUCKETS)), _col(level) + 1)


def shown_value(metric, value) -> Column:
    return F.when(_col(metric) == "line_cov", F.concat(_col(value).cast("string"), F.lit("%"))).otherwise(_col(value).cast("string"))


def display(value, label, mode: str, integer: bool = False) -> Column:
    """A value with its bucket, by display mode: value, label or both."""
    v = _col(value).cast("bigint").cast("string") if integer else F.format_string("%.3f", _col(value).cast("double"))
    return {"value": v, "label": _col(label), "both": F.concat(v, F.lit(" ("), _col(label), F.lit(")"))}[mode]
