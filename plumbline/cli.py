"""Command line: check, ls, get, metrics and ignore."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

from plumbline.config import IGNORABLE, METRICS
from plumbline.extract.tables import READERS, source_units, tokenize
from plumbline.functions.names import in_path, language
from plumbline.plans import report
from plumbline.sinks.writers import Timing, listing
from plumbline.sources import caches, files, git, lcov
from plumbline.store import stored

FOLDER = ".plumbline"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("--root")
    p.add_argument("--cache", help="folder with unit JSON and token files of other extractors")
    p.add_argument("--generation", type=int, help="leave out what the cache has from before this time")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check")
    c.add_argument("target", nargs="?")
    c.add_argument("-A", "--all", action="store_true")
    c.add_argument("-k", type=int, default=10)
    c.add_argument("--json", action="store_true")
    c.add_argument("--pretty", action="store_true")
    c.add_argument("--cov", action="append", default=[])
    c.add_argument("--filter", help="folder that units have to lie in; in a diff, changed ones")
    c.add_argument("--timing", action="store_true")
    ls = sub.add_parser("ls")
    ls.add_argument("path", nargs="?")
    ls.add_argument("--kind")
    ls.add_argument("--json", action="store_true")
    sub.add_parser("get").add_argument("symbol")
    m = sub.add_parser("metrics").add_subparsers(dest="what", required=True)
    m.add_parser("ls")
    m.add_parser("get").add_argument("name")
    i = sub.add_parser("ignore")
    i.add_argument("symbol", nargs="?")
    i.add_argument("metric", nargs="?")
    i.add_argument("--remove", action="store_true")
    return p


def load(spark: SparkSession, root: str, cache: str | None, generation: int | None = None):
    """Units and tokens of the project, from its source; a cache adds those of other languages."""
    paths = [p for lang in files.EXTENSIONS if files.has_language(root, lang) for p in files.sources(root, lang)]
    source = files.read(spark, root, paths)
    units = source_units(source, int(time.time()), files.rust_crates(root))
    tokens = tokenize(source)
    if cache:
        other = ~F.coalesce(language("file").isin(*READERS), F.lit(False))
        units = units.unionByName(caches.read_units(spark, cache, generation).where(other))
        tokens = tokens.select("file", "pos", "value", "line", "col").unionByName(caches.read_tokens(spark, cache, generation).drop("cached_at").where(other))
    return stored(units), tokens, source


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    root = files.project_root(".", FOLDER, args.root)
    folder = os.path.join(root, FOLDER)
    config = caches.load_config(folder)
    if args.command == "metrics":
        print("\n".join(m + ("  (disabled)" if config.is_disabled(m) else "") + f"\n  {report.DESCRIPTIONS[m]}\n" for m in METRICS) if args.what == "ls" else report.describe_metric(args.name, config))
        return 0
    ignores = caches.Ignores(folder)
    if args.command == "ignore":
        if args.metric and args.metric not in IGNORABLE:
            print(f"cannot ignore {args.metric}", file=sys.stderr)
            return 1
        if args.symbol and args.remove:
            return 0 if ignores.remove(args.symbol, args.metric) else 1
        if args.symbol and args.metric:
            os.makedirs(folder, exist_ok=True)
            ignores.add(args.symbol, args.metric)
        else:
            print("\n".join(f"{s}\t{', '.join(m)}" for s, m in ignores.listed()))
        return 0
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    timing = Timing()
    with timing.span("extract"):
        units, tokens, source = load(spark, root, args.cache, args.generation)
    if args.command == "ls":
        found = report.list_units(units, args.kind, args.path)
        print(json.dumps([r.asDict() for r in found.select("id", "kind", "file", "start_line", "end_line").collect()]) if args.json else "\n".join(r["line"] for r in listing(found).collect()))
        return 0
    if args.command == "get":
        one = report.source_lines(units.where(F.col("id") == args.symbol), source.withColumnRenamed("path", "file")).select("source").first()
        print(one["source"] if one else f"no unit {args.symbol}", file=sys.stdout if one else sys.stderr)
        return 0 if one else 1
    kind, name = files.classify_target(args.target, root) if args.target else ("", "")
    changed, mode, detail = None, kind if name != "." else "", name
    if not args.target and not args.all:
        state = git.working_state(root)
        changed = git.changes(spark, root, state) if state.mode != "whole-project" else None
        mode, detail = state.mode, state.base or ""
    if kind == "path" and name != ".":
        units = units.where(in_path("file", name))
    if args.filter:
        folder = files.folder_below(args.filter, root)
        if changed is not None:
            changed = changed.where(in_path("file", folder)) if folder else changed
        elif folder:
            units = units.where(in_path("file", folder))
    reports, skipped = lcov.readable(args.cov, root)
    cov = lcov.below(lcov.parse(lcov.read(spark, reports), root), root, os.path.abspath(args.root or root)) if reports else None
    with timing.span("compute_metrics"):
        r = report.check(units, tokens, config, cov, changed, mode, detail)
    for text in (*skipped, *r.warnings):
        print(f"warning: {text}", file=sys.stderr)
    if kind == "symbol":
        if units.where(F.col("id") == name).isEmpty():
            print(f"no unit {name}", file=sys.stderr)
            return 1
        print(json.dumps({"symbol": name, "metrics": {x["metric"]: {"value": x["value"], "bucket": x["bucket"]} for x in report.rows.symbol_values(r.distributions, r.fans, name, config).collect()}}, indent=2) if args.json else r.tsv(symbol=name, ignores=ignores.table(spark)))
    else:
        print(r.json() if args.json else r.table(args.k, ignores.table(spark)) if args.pretty else r.tsv(args.k, ignores.table(spark)))
    partial = units.where("partial").count()
    if partial:
        print(f"warning: {partial} unit(s) were extracted in part", file=sys.stderr)
    if args.timing:
        print("\n".join(timing.lines()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
