"""Reports: rows, JSON, listings and source text."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.config import METRICS, Config, LOWER_IS_WORSE, SHOWN
from plumbline.functions.buckets import bucket, severity_of, severity_size
from plumbline.functions.names import in_path
from plumbline.operators import calls, clones, complexity, coverage, distribution, duplication, rows, scope, structs, structural
from plumbline.store import stored

# What each metric measures.
DESCRIPTIONS = {
    "dag_density": "Edges of the call graph for each node.",
    "fan_in": "Units that call this one.",
    "fan_out": "Calls of this unit to others; hidden for delegators, which are simple inside.",
    "function_size": "Lines of a function. Too many are bad; too few only for a function with a single caller.",
    "params": "Parameters of a function; hidden for wide signatures of simple functions.",
    "cyclomatic": "Branches of a function and one; hidden for dispatchers, whose branches do not nest.",
    "cognitive": "Branches of a function, weighed by how deep they nest.",
    "max_scope": "Lines of the largest block of a function.",
    "methods_per_struct": "Methods of a type.",
    "lcom": "Groups of methods of a type that share neither fields nor calls.",
    "file_loc": "Lines of a file.",
    "duplication_pct": "Share of a unit's lines that stand elsewhere too.",
    "line_cov": "Share of a function's lines that ran. Lower is worse.",
    "uncov_branches": "Branches of a function that never ran.",
}
KINDS = {"function": "Function", "fn": "Function", "method": "Method", "struct": "Struct", "module": "Module", "mod": "Module"}


def kind_of(name: str) -> str:
    found = KINDS.get(name.lower())
    if not found:
        raise ValueError(f"unknown kind {name!r}; one of function, method, struct, module")
    return found


def list_units(units: DataFrame, kind: str | None = None, path: str | None = None) -> DataFrame:
    if kind:
        units = units.where(F.col("kind") == kind_of(kind))
    return units.where(in_path("file", path)) if path else units


def source_lines(units: DataFrame, files: DataFrame) -> DataFrame:
    """The lines of each unit. files: (file, content)."""
    lines = F.split("content", "\n")
    n = F.least(F.col("end_line"), F.size(lines)) - F.col("start_line") + 1
    return units.join(files, "file").withColumn("source", F.array_join(F.slice(lines, F.col("start_line").cast("int"), F.greatest(n, F.lit(0)).cast("int")), "\n"))


def catalog(spark: SparkSession, config: Config = Config()) -> DataFrame:
    """(metric, worse, boundaries, disabled): one row for each metric."""
    found = [(m, "lower" if m in LOWER_IS_WORSE else "higher", *(float(getattr(config.by_name(m), b)) for b in ("excellent", "good", "fair", "poor")), config.is_disabled(m)) for m in METRICS]
    return spark.createDataFrame(found, "metric string, worse string, excellent double, good double, fair double, poor double, disabled boolean")


def describe_metric(metric: str, config: Config = Config()) -> str:
    """Name, description and boundaries, in the direction of the metric."""
    if metric not in DESCRIPTIONS:
        raise ValueError(f"unknown metric {metric!r}")
    sides = [("low side (single caller)", config.function_size.low, True), ("high side", config.function_size.high, False)] if metric == "function_size" else [("", config.by_name(metric), metric in LOWER_IS_WORSE)]
    out = [metric + ("  (disabled)" if config.is_disabled(metric) else ""), "  " + DESCRIPTIONS[metric]]
    for name, t, low in sides:
        out += [name] * bool(name) + [f"  {b:<10} {'>=' if low else '<'} {getattr(t, b):g}" for b in ("excellent", "good", "fair", "poor")] + [f"  critical   {'<' if low else '>='} {t.poor:g}"]
    return "\n".join(out)


def entries(dist: DataFrame, units: DataFrame, config: Config = Config(), fans: DataFrame | None = None) -> DataFrame:
    """(id, value, bucket, file, start_line, end_line) of one or more distributions; ids that are no unit have no place."""
    level = severity_of("metric", "value", config, [m for m in SHOWN if m != "function_size"])
    if fans is not None:
        dist = dist.join(fans.select("id", "fan_in"), "id", "left")
        level = F.when(F.col("metric") == "function_size", severity_size("value", "fan_in", config.function_size)).otherwise(level)
    places = units.groupBy("id").agg(F.max_by(F.struct("file", "start_line", "end_line"), "unit_ord").alias("at"))
    return dist.join(places, "id", "left").select("id", "value", bucket(level).alias("bucket"), "at.file", "at.start_line", "at.end_line")


def counters(units: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: units, partial_units, edges, files."""
    both = units.select(F.lit(1).alias("u"), F.col("partial").cast("int").alias("p"), F.lit(0).alias("e"), "file").unionAll(edges.select(F.lit(0), F.lit(0), F.lit(1), F.lit(None).cast("string")))
    return both.agg(F.coalesce(F.sum("u"), F.lit(0)).alias("units"), F.coalesce(F.sum("p"), F.lit(0)).alias("partial_units"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"), F.countDistinct("file").alias("files"))


@dataclass
class Report:
    """A check of a code base, as lazy tables."""

    units: DataFrame
    edges: DataFrame
    fans: DataFrame
    distributions: DataFrame
    config: Config
    pct: DataFrame | None = None
    clones: DataFrame | None = None
    covered: DataFrame | None = None
    scope: str = "whole project"
    mode: str = "whole-project"
    warnings: tuple[str, ...] = ()

    def rows(self, k: int = 10, ignores: DataFrame | None = None, symbol: str | None = None) -> DataFrame:
        found = rows.score(self.distributions, self.fans, self.config, symbol)
        if ignores is not None:
            found = rows.without_ignored(found, ignores)
        return found if symbol is not None else rows.top_rows(found, k)

    def tsv(self, k: int = 10, ignores: DataFrame | None = None, symbol: str | None = None) -> str:
        found = self.rows(k, ignores, symbol).select("metric", "symbol", "value", "bucket").collect()
        return "\n".join([f"scope: {self.scope}", "metric\tsymbol\tvalue\tbucket", *("\t".join(r) for r in found)])

    def table(self, k: int = 10, ignores: DataFrame | None = None) -> str:
        lines = [x.split("\t") for x in self.tsv(k, ignores).split("\n")]
        width = [max(len(r[i]) for r in lines[1:]) for i in range(4)]
        return "\n".join([lines[0][0], *("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in lines[1:])])

    def json(self) -> str:
        """Counts, and for each metric its summary and entries, worst first; disabled metrics are left out, and groups that they empty."""
        c = counters(self.units, self.edges).first()
        metrics: dict = {}
        where = {"fan_in": (None, "fan_in"), "fan_out": (None, "fan_out"), "file_loc": (None, "file_loc"), "duplication_pct": (None, "duplication"), "function_size": ("complexity", "size"), "params": ("complexity", "params"), "cyclomatic": ("complexity", "cyclomatic"), "cognitive": ("complexity", "cognitive"), "max_scope": ("complexity", "max_scope"), "methods_per_struct": ("struct", "methods_per_struct"), "lcom": ("struct", "lcom"), "line_cov": ("coverage", "line_cov"), "uncov_branches": ("coverage", "uncov_branches")}
        density = structural.dag_density(self.units, self.edges).first()["dag_density"]
        if not self.config.is_disabled("dag_density"):
            metrics["dag_density"] = {"value": density}
        d = self.distributions
        sums = {r["metric"]: r for r in distribution.summary(d.select("metric", "id", "value"), tuple(where)).collect()}
        for m, (group, name) in where.items():
            if self.config.is_disabled(m) or m in ("line_cov", "uncov_branches") and self.covered is None:
                continue
            own = d.where(F.col("metric") == m)
            order = own.select("id", rows.worst(own).alias("worst"))
            e = entries(own, self.units, self.config, self.fans).join(order, "id").orderBy("worst", "id").drop("worst")
            block = {"max": sums[m]["max"], "mean": sums[m]["mean"], "p90": sums[m]["p90"], "distribution": [r.asDict() for r in e.toLocalIterator()]}
            if m == "duplication_pct" and self.pct is not None:
                block |= duplication.duplication_summary(self.pct, self.clones).first().asDict()
            (metrics.setdefault(group, {}) if group else metrics)[name] = block
        return json.dumps({"scope": {"mode": self.mode, "description": self.scope}, "files": {"extracted": c["files"]}, "units": c["units"], "partial_units": c["partial_units"], "edges": c["edges"], "metrics": metrics}, indent=2)


# What is said of coverage that looks wrong.
HAZARDS = {
    "no_file_matches": "the report names {lcov_files_total} file(s), none of which is an analyzed source: are its SF paths those of sources below the root?",
    "units_without_data": "{units_without_data}/{units_analyzed} analyzed units had no coverage data: is the report old or incomplete?",
    "no_branch_records": "the report has no BRDA records: uncov_branches is left out",
}


def check(units: DataFrame, tokens: DataFrame | None = None, config: Config = Config(), cov: tuple[DataFrame, DataFrame] | None = None, changed: DataFrame | None = None, mode: str = "", detail: str = "") -> Report:
    """All metrics of units and tokens. Those of a change are computed over everything and then shown for what it touches.

    mode: what is checked, as the scope line says it: whole-project, path,
    symbol, uncommitted or branch-diff; detail: the path, symbol or base.
    """
    edges = stored(calls.edges(calls.unit_calls(units), units))
    fan = stored(structural.fan(units, edges))
    parts = [complexity.complexity_distribution(units), structural.fan_distribution(fan, "fan_in"), structural.fan_distribution(fan, "fan_out"), structs.methods_per_struct(units), structs.lcom4(units), complexity.file_loc(units)]
    found = pct = covered = None
    said: tuple[str, ...] = ()
    if cov is not None and not {"line_cov", "uncov_branches"} <= config.disabled_metrics:
        covered = stored(coverage.coverage(units, *cov))
        parts.append(coverage.coverage_distribution(covered, not cov[1].isEmpty()))
        counted = stored(coverage.counters(units, *cov))
        numbers = counted.first().asDict()
        said = tuple(HAZARDS[r["warning"]].format(**numbers) for r in coverage.warnings(counted).collect())
    d = reduce(DataFrame.unionByName, parts).withColumn("raw", F.col("value").cast("double"))
    if tokens is not None and not config.is_disabled("duplication_pct"):
        found = stored(clones.find_clones(tokens, config.min_tokens))
        pct = stored(duplication.duplication(found, units))
        d = d.unionByName(duplication.duplication_distribution(pct))
    d = stored(d)
    mode = mode or ("uncommitted" if changed is not None else "whole-project")
    text = scope.describe(mode, detail=detail)
    if changed is not None:
        ids, files = scope.display_scope(units, changed)
        d, fan = scope.retain(d, ids, files), fan.join(ids, "id", "left_semi")
        text = scope.describe(mode, ids.count(), files.count(), detail)
    return Report(units, edges, fan, d, config, pct, found, covered, text, mode, said)
