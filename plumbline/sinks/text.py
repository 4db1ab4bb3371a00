"""Text summaries of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators import distribution, structural

# Values over which a unit is listed.
OVER = {"function_size": 0, "params": 0, "cyclomatic": 1, "cognitive": 1, "max_scope": 0, "methods_per_struct": 0, "lcom": 1, "file_loc": 0}


def _list(title: str, rows: DataFrame) -> list[str]:
    return [title, *(f"  {r['value']:>6}  {r['id']}" for r in rows.collect())]


def structural_summary(units: DataFrame, edges: DataFrame) -> str:
    """Density, then the first ten of both fans; of those ten, zeros are left out."""
    d, fans = structural.dag_density(units, edges).first(), structural.fan(units, edges)
    out = [f"nodes {d['nodes']}, edges {d['edges']}, density {d['dag_density']:.3f}"]
    for m in ("fan_in", "fan_out"):
        out += _list(m, distribution.top(structural.fan_distribution(fans, m), m, 10, 0, filter_first=False))
    return "\n".join(out)


def metric_summary(dist: DataFrame, metrics: tuple[str, ...]) -> str:
    """Maximum, mean and p90 of each metric, and its first ten over the value from which they count."""
    sums = {r["metric"]: r for r in distribution.summary(dist, metrics).collect()}
    out: list[str] = []
    for m in metrics:
        s = sums[m]
        out += [f"{m}: max {s['max']}, mean {s['mean']:.2f}, p90 {s['p90']}", *_list("", distribution.top(dist, m, 10, OVER.get(m, 0)))[1:]]
    return "\n".join(out)
