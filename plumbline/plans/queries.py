"""One query for each operator, over the adapters of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.config import METRICS, SHOWN, Config, LOWER_IS_WORSE
from plumbline.functions.buckets import bucket, severity_low, severity_of, severity_size
from plumbline.operators import calls, clones, complexity, coverage, distribution, duplication, rows, scope, structs, structural
from plumbline.plans import source_queries
from plumbline.plans.adapters import Tables
from plumbline.plans.duck import SCOPED
from plumbline.plans.report import catalog
from plumbline.sources import diff, lcov
from plumbline.store import stored

K = 50
CONFIG = Config()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.code, calls.edges(t.calls, t.code)


def fans(t: Tables) -> DataFrame:
    """Written once: rows look it up several times, and the units below it too."""
    t.methods = stored(t.methods)
    return stored(structural.fan(*graph(t)))


def all_distributions(t: Tables, fan: DataFrame, config: Config = CONFIG, symbol: str | None = None) -> DataFrame:
    """Clones are the expensive pass: left out where their metric is disabled, or where the one symbol asked for is no unit whose lines they count for."""
    wanted = not config.is_disabled("duplication_pct") and (symbol is None or not t.blocks.where((F.col("id") == symbol) & (F.col("kind") != "Module")).isEmpty())
    covered = coverage.coverage(t.nested, t.lines, t.branches)
    parts = [complexity.complexity_distribution(t.code), structural.fan_distribution(fan, "fan_in"), structural.fan_distribution(fan, "fan_out"), structs.methods_per_struct(t.code), structs.lcom4(t.cohesion), complexity.file_loc(t.code), coverage.coverage_distribution(covered)]
    plain = reduce(DataFrame.unionByName, parts).withColumn("raw", F.col("value").cast("double"))
    if wanted:
        pct = duplication.share(duplication.lines_of(clones.clones_of(t.sequences, K, None, True)), t.blocks)
        plain = plain.unionByName(duplication.duplication_distribution(pct))
    return stored(plain if symbol is None else plain.where(F.col("id") == symbol))


def code_distributions(t: Tables, fan: DataFrame) -> DataFrame:
    parts = [complexity.complexity_distribution(t.code), structural.fan_distribution(fan, "fan_in"), structural.fan_distribution(fan, "fan_out")]
    return stored(reduce(DataFrame.unionByName, parts))


SHORT = ("metric", "symbol", "value", "bucket", "severity")


def code_rows(t: Tables, metric: str, config: Config = CONFIG) -> DataFrame:
    fan = fans(t)
    d = code_distributions(t, fan)
    return rows.score(d, fan, config).where(F.col("metric") == metric).select(*SHORT)


@query
def units_complexity_long(t):
    return complexity.complexity_distribution(t.code)


@query
def distribution_summary(t):
    return distribution.summary(complexity.complexity_distribution(t.code), tuple(complexity.COMPLEXITY))


@query
def severity_buckets(t):
    d = complexity.complexity_distribution(t.code)
    return d.groupBy("metric", bucket(severity_of("metric", "value", CONFIG, tuple(complexity.COMPLEXITY))).alias("bucket")).agg(F.count("*").alias("n"))


@query
def severity_buckets_asc(t):
    return coverage.coverage(t.nested, t.lines, t.branches).select("id", "line_cov", severity_low("line_cov", CONFIG.by_name("line_cov")).alias("severity"))


@query
def size_two_sided(t):
    c = complexity.complexity(t.code).join(fans(t), "id", "left")
    return c.select("id", "size", "fan_in", severity_size("size", "fan_in", CONFIG.function_size).alias("severity"))


@query
def call_name_index(t):
    return calls.name_index(t.code)


def _with_crate(t: Tables) -> DataFrame:
    return t.calls.withColumn("crate", calls.crate_of("id"))


@query
def call_exact(t):
    return calls.exact_calls(t.calls, t.code)


@query
def call_same_file(t):
    return calls.same_file_calls(t.calls, t.code)


@query
def call_name_pick(t):
    return calls.pick(_with_crate(t), calls.name_index(t.code), F.col("call"), "by_name").drop("crate")


@query
def call_method_pick(t):
    return calls.pick(_with_crate(t), calls.name_index(t.code), calls.method_key(), "by_method").drop("crate")


@query
def call_path_pick(t):
    return calls.path_calls(_with_crate(t), calls.name_index(t.code)).drop("crate")


@query
def calls_resolved(t):
    return calls.resolve(t.calls, t.code).select("id", "file", "call", "target", "how")


@query
def edges_resolved(t):
    return graph(t)[1]


@query
def fan_in_dist(t):
    return structural.fan_distribution(fans(t), "fan_in")


@query
def fan_out_dist(t):
    return structural.fan_distribution(fans(t), "fan_out")


@query
def fan_summary(t):
    return structural.fan_summary(fans(t))


@query
def dag_density(t):
    return structural.dag_density(*graph(t))


@query
def hubs(t):
    return structural.hubs(fans(t), CONFIG)


@query
def structural_buckets(t):
    return structural.bucketed_summary(*graph(t), CONFIG)


@query
def methods_per_struct(t):
    return structs.methods_per_struct(t.code)


@query
def lcom4(t):
    return structs.lcom4(t.cohesion)


@query
def lcom4_large(t):
    """Grouped as structs of many methods are."""
    return structs.lcom4(t.cohesion, fold=4)


@query
def file_loc(t):
    return complexity.file_loc(t.code)


@query
def file_loc_summary(t):
    return distribution.summary(complexity.file_loc(t.code), ("file_loc",))


@query
def token_stream(t):
    return t.tokens.select("file", "pos", "value", "line")


@query
def kgram_windows(t):
    return clones.windows(t.tokens, K).groupBy("file").agg(F.count("*").alias("windows"), F.countDistinct("gram").alias("grams"))


@query
def kgram_buckets(t):
    return clones.buckets(clones.windows(t.tokens, K)).groupBy("places").agg(F.count("*").alias("buckets"))


@query
def clone_candidates(t):
    return clones.candidates(clones.starts(t.sequences, K)[0], K)


@query
def clones_maximal(t):
    return clones.maximal(*clones.starts(t.sequences, K), K, None)


@query
def clones_unsubsumed(t):
    return clones.clones_of(t.sequences, K)


@query
def duplication_pct(t):
    return duplication.duplication(clones.clones_of(t.sequences, K), t.blocks)


@query
def duplication_summary(t):
    found = clones.clones_of(t.sequences, K)
    return duplication.duplication_summary(duplication.duplication(found, t.blocks), found)


def _reports(t: Tables) -> DataFrame:
    """The coverage adapter as LCOV text: one report for each file."""
    da = t.lines.select("file", F.concat(F.lit("DA:"), "line", F.lit(","), "hits").alias("r"))
    brda = t.branches.select("file", F.concat(F.lit("BRDA:"), "line", F.lit(",0,0,"), "taken").alias("r"))
    return da.unionAll(brda).groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("r")), "\n").alias("body")).select(F.col("file").alias("input"), F.concat(F.lit("TN:\nSF:"), "file", F.lit("\n"), "body", F.lit("\nend_of_record\nDA:1,1\n")).alias("content"))


@query
def lcov_parse(t):
    lines, branches = lcov.parse(_reports(t))
    return lines.select(F.lit("DA").alias("kind"), "file", "line", F.col("hits").alias("n")).unionAll(branches.select(F.lit("BRDA"), "file", "line", "taken"))


@query
def lcov_merge(t):
    lines = lcov.parse(_reports(t))[0]
    return coverage.merge_lines(lines.unionAll(lines))


@query
def line_cov(t):
    return coverage.coverage_distribution(coverage.coverage(t.nested, t.lines, t.branches)).where("metric = 'line_cov'")


@query
def uncov_branches(t):
    return coverage.coverage_distribution(coverage.coverage(t.nested, t.lines, t.branches)).where("metric = 'uncov_branches'")


@query
def coverage_counters(t):
    return coverage.counters(t.nested, t.lines, t.branches)


@query
def coverage_warnings(t):
    """Of the report as it is, of one with a quarter of the files, and of one of other files without branches."""
    moved = lambda d: d.withColumn("file", F.concat(F.lit("elsewhere/"), "file"))
    few = lambda d: d.where(F.regexp_extract("file", "u([0-9]+)", 1).cast("long") % 4 == 0)
    found = {"as it is": (t.lines, t.branches), "a quarter": (few(t.lines), few(t.branches)), "elsewhere": (moved(t.lines), t.branches.limit(0))}
    return reduce(DataFrame.unionAll, [coverage.warnings(coverage.counters(t.nested, *cov)).select(F.lit(name).alias("report"), "warning") for name, cov in found.items()])


@query
def diff_parse(t):
    """The change adapter as diff text, parsed back: one diff for each file."""
    hunk = t.changed.select("file", "start_line", F.concat(F.lit("@@ -1,0 +"), "start_line", F.lit(","), F.col("end_line") - F.col("start_line") + 1, F.lit(" @@ fn x()\n+y")).alias("h"))
    text = hunk.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("h")), "\n").alias("b")).select(F.col("file").alias("input"), F.concat(F.lit("--- a/x\n+++ b/"), "file", F.lit("\n"), "b", F.lit("\n+++ /dev/null\n@@ -1 +1 @@")).alias("content"))
    return diff.parse(text)


@query
def changed_units(t):
    return scope.changed_units(t.code, t.changed).select("id", "file").distinct()


@query
def scope_closure(t):
    return scope.display_scope(t.code, t.changed)[0]


@query
def scoped_summary(t):
    fan = fans(t)
    d = code_distributions(t, fan).unionByName(structs.methods_per_struct(t.code)).unionByName(complexity.file_loc(t.code))
    return scope.scoped_summary(d, *scope.display_scope(t.code, t.changed), SCOPED)


@query
def delegator_rows(t):
    return code_rows(t, "fan_out")


@query
def dispatcher_rows(t):
    return code_rows(t, "cyclomatic")


@query
def wide_signature_rows(t):
    return code_rows(t, "params")


@query
def hub_rows(t):
    return code_rows(t, "fan_in")


@query
def ignores_filtered(t):
    fan = fans(t)
    d = structs.methods_per_struct(t.code).unionByName(structs.lcom4(t.cohesion))
    c = t.table("customer").where("c_custkey % 5 = 0")
    ignored = c.select(F.concat(F.lit("crate"), "c_nationkey", F.lit("::cust::C"), "c_custkey").alias("symbol"), F.when(F.col("c_custkey") % 2 == 0, "lcom").otherwise("methods_per_struct").alias("metric"))
    return rows.without_ignored(rows.score(d, fan, CONFIG), ignored).select(*SHORT)


@query
def disabled_pruned(t):
    fan = fans(t)
    config = Config(disabled_metrics=frozenset({"cyclomatic", "file_loc", "duplication_pct"}))
    return rows.score(all_distributions(t, fan, config), fan, config).select(*SHORT)


@query
def metric_rows_all(t):
    fan = fans(t)
    return rows.score(all_distributions(t, fan), fan, CONFIG).select(*SHORT)


@query
def metric_rows_topk(t):
    fan = fans(t)
    return rows.numbered(rows.top_rows(rows.score(all_distributions(t, fan), fan, CONFIG), 10)).select("metric", "symbol", "value", "bucket", "shown_ord")


@query
def flagship_topk(t):
    """Which functions are worst? Complexity and coupling, ranked over all metrics together."""
    fan = fans(t)
    return rows.numbered(rows.top_rows(rows.score(code_distributions(t, fan), fan, CONFIG), 10)).select("metric", "symbol", "value", "bucket", "shown_ord")


def _last_method(t: Tables) -> str:
    return t.methods.agg(F.max("id")).first()[0]


@query
def symbol_rows(t):
    fan = fans(t)
    symbol = _last_method(t)
    return rows.score(all_distributions(t, fan, symbol=symbol), fan, CONFIG, symbol=symbol).select(*SHORT)


@query
def symbol_values(t):
    fan = fans(t)
    symbol = _last_method(t)
    return rows.symbol_values(all_distributions(t, fan, symbol=symbol), fan, symbol, CONFIG)


@query
def symbol_source(t):
    from plumbline.plans.report import source_lines

    docs = t.table("documents").select(F.concat(F.lit("doc"), "doc_id").alias("file"), F.col("text").alias("content"))
    units = docs.where(F.size(F.split("content", "\n")) >= 2).select("file", F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    return source_lines(units, docs).select("file", "source")


@query
def ls_units(t):
    from plumbline.plans.report import list_units

    return list_units(t.code, kind="struct", path="src/n7.rs").select("id", "kind", "file", "start_line", "end_line")


@query
def json_entries(t):
    from plumbline.plans.report import entries

    return entries(structs.methods_per_struct(t.code), t.code, CONFIG)


@query
def report_counters(t):
    from plumbline.plans.report import counters

    units, edges = graph(t)
    return counters(units.withColumn("partial", F.lit(False)), edges)


@query
def metric_catalog(t):
    return catalog(t.spark, CONFIG)


QUERIES |= source_queries.QUERIES
__all__ = ["LOWER_IS_WORSE", "METRICS", "QUERIES", "SHOWN"]
