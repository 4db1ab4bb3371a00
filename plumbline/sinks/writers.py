"""Caches and listings."""

from __future__ import annotations

import json
import os
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.names import truncated
from plumbline.sources.caches import encode_tokens, to_entries


def write_units(units: DataFrame, path: str) -> None:
    """As Parquet by language and generation, which later reads prune by."""
    from plumbline.functions.names import language

    units.withColumn("lang", F.coalesce(language("file"), F.lit("other"))).write.partitionBy("lang", "cached_at").mode("append").parquet(path)


def _place(folder: str, source: str, suffix: str) -> str:
    path = os.path.join(folder, source.lstrip("/") + suffix)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def write_entries(units: DataFrame, folder: str) -> int:
    """One JSON document for each source file, for other tools: mirrored names in a local folder, written one by one by the driver."""
    n = 0
    for r in to_entries(units).toLocalIterator():
        with open(_place(folder, r["source_path"], ".json"), "w") as f:
            f.write(r["json"])
        n += 1
    return n


def write_tokens(tokens: DataFrame, folder: str, cached_at: int) -> int:
    """One token file for each source file, for other tools."""
    per = tokens.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "line", "col"))).alias("t"))
    n = 0
    for r in per.toLocalIterator():
        with open(_place(folder, r["file"], ".tokens"), "wb") as f:
            f.write(encode_tokens(r["file"], cached_at, [(t["value"], t["line"], t["col"]) for t in r["t"]]))
        n += 1
    return n


def graph_json(units: DataFrame, edges: DataFrame) -> str:
    """Units and edges as one document, for graphs that fit the driver."""
    rows = lambda d: [json.loads(x) for x in d.toJSON().toLocalIterator()]
    return json.dumps({"units": rows(units), "edges": rows(edges)})


def graph_from_json(spark, text: str, units_schema: str) -> tuple[DataFrame, DataFrame]:
    found = json.loads(text)
    lines = lambda k: spark.createDataFrame([(json.dumps(x),) for x in found[k]], "v string")
    read = lambda k, schema: lines(k).select(F.from_json("v", schema).alias("x")).select("x.*")
    return read("units", units_schema), read("edges", "src string, dst string, kind string")


def listing(units: DataFrame, width: int = 60) -> DataFrame:
    """A line of text for each unit: id, kind and place in columns."""
    return units.orderBy("file", "start_line", "id").select(F.concat(F.rpad(truncated("id", width), width, " "), F.lit("  "), F.rpad("kind", 8, " "), F.lit("  "), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("line"))


class Timing:
    """Wall-clock seconds of named phases."""

    def __init__(self):
        self.spans: dict[str, float] = {}

    @contextmanager
    def span(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.spans[name] = self.spans.get(name, 0.0) + time.perf_counter() - began

    def lines(self) -> list[str]:
        return [f"{k}: {v:.3f}s" for k, v in self.spans.items()]
