"""Interchange formats: unit JSON by source file, binary token files, configuration and ignore lists."""

from __future__ import annotations

import json
import os
import struct

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.config import Config
from plumbline.extract.tables import with_order
from plumbline.schemas import CACHE
from plumbline.ship import ship


def read_units(spark: SparkSession, folder: str, generation: int | None = None) -> DataFrame:
    """Units of all JSON entries below a folder; a file that cannot be read fails. Fields that older writers lack are 0, false or empty; entries before a generation go."""
    entries = spark.read.schema(CACHE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "FAILFAST").json(folder)
    if generation is not None:
        entries = entries.where(F.col("cached_at") >= generation)
    u = entries.select("source_path", "cached_at", F.posexplode("units").alias("_at", "u"))
    zero = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0)).cast("bigint").alias(c)
    out = u.select("source_path", "cached_at", "_at", "u.id", "u.kind", "u.file", *[F.col(f"u.span.{c}").alias(c) for c in ("start_line", "start_col", "end_line", "end_col")], *[f"u.{c}" for c in ("reads", "writes", "calls", "tags", "parent")], *map(zero, ("params", "branches", "max_scope_lines", "cognitive_complexity")), F.coalesce("u.partial", F.lit(False)).alias("partial"))
    return with_order(out, "_at").drop("_at")


def entry(units: DataFrame, source: str) -> DataFrame:
    return units.where(F.col("source_path") == source)


def to_entries(units: DataFrame) -> DataFrame:
    """(source_path, json): one pretty document for each source file."""
    span = F.struct("start_line", "start_col", "end_line", "end_col")
    unit = F.struct("unit_ord", F.struct("id", "kind", "file", span.alias("span"), "reads", "writes", "calls", "tags", "params", "branches", "max_scope_lines", "parent", "cognitive_complexity", "partial").alias("u"))
    rows = units.groupBy("source_path", "cached_at").agg(F.transform(F.array_sort(F.collect_list(unit)), lambda x: x["u"]).alias("units"))
    return rows.select("source_path", F.to_json(F.struct("source_path", "units", "cached_at"), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def encode_tokens(path: str, cached_at: int, tokens: list[tuple[str, int, int]]) -> bytes:
    """Little-endian: path, generation, dictionary of values, then (index, line, column) of each token."""
    name = path.encode()
    index = {v: i for i, v in enumerate(dict.fromkeys(t[0] for t in tokens))}
    if len(index) > 0xFFFF:
        raise ValueError("too many distinct values")
    out = [struct.pack("<I", len(name)), name, struct.pack("<QI", cached_at, len(index))]
    for v in index:
        raw = v.encode()
        out += [struct.pack("<H", len(raw)), raw]
    out.append(struct.pack("<I", len(tokens)))
    out += [struct.pack("<HIH", index[v], line, col) for v, line, col in tokens]
    return b"".join(out)


def decode_tokens(data: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """Raises ValueError for a file that is cut short or has an index out of range."""
    try:
        (n,) = struct.unpack_from("<I", data)
        at = 4 + n
        if at > len(data):
            raise ValueError("cut short")
        path = data[4:at].decode()
        cached, count = struct.unpack_from("<QI", data, at)
        at += 12
        values = []
        for _ in range(count):
            (size,) = struct.unpack_from("<H", data, at)
            if at + 2 + size > len(data):
                raise ValueError("cut short")
            values.append(data[at + 2 : at + 2 + size].decode())
            at += 2 + size
        (total,) = struct.unpack_from("<I", data, at)
        found = [struct.unpack_from("<HIH", data, at + 4 + 8 * i) for i in range(total)]
        return path, cached, [(values[i], line, col) for i, line, col in found]
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise ValueError(f"not a token file: {e}") from e


def read_tokens(spark: SparkSession, folder: str, generation: int | None = None) -> DataFrame:
    """Tokens (file, pos, value, line, col, cached_at) of all token files below a folder; files that cannot be read give none."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                try:
                    path, cached, tokens = decode_tokens(content.as_py())
                except ValueError:
                    continue
                if tokens:
                    value, line, col = zip(*tokens, strict=True)
                    n = len(tokens)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int64()), pa.array(value), pa.array(line, pa.int64()), pa.array(col, pa.int64()), pa.array([cached] * n, pa.int64())], names=["file", "pos", "value", "line", "col", "cached_at"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tokens").load(folder).select("content")
    found = files.mapInArrow(run, "file string, pos bigint, value string, line bigint, col bigint, cached_at bigint")
    return found if generation is None else found.where(F.col("cached_at") >= generation)


def load_config(folder: str) -> Config:
    """config.yaml of the tool's folder at the root; defaults without one."""
    path = os.path.join(folder, "config.yaml")
    if not os.path.exists(path):
        return Config()
    with open(path) as f:
        return Config.parse(yaml.safe_load(f))


class Ignores:
    """Symbols with metrics that are not reported, in ignores.json."""

    def __init__(self, folder: str):
        self.path = os.path.join(folder, "ignores.json")
        self.found: dict[str, list[str]] = {}
        if os.path.exists(self.path):
            with open(self.path) as f:
                self.found = {k: sorted(set(v)) for k, v in (json.load(f).get("ignores") or {}).items()}

    def add(self, symbol: str, metric: str) -> None:
        self.found[symbol] = sorted({*self.found.get(symbol, ()), metric})
        self._write()

    def remove(self, symbol: str, metric: str | None = None) -> bool:
        had = symbol in self.found and (metric is None or metric in self.found[symbol])
        if had:
            left = [m for m in self.found.pop(symbol) if metric is not None and m != metric]
            if left:
                self.found[symbol] = left
            self._write()
        return had

    def listed(self) -> list[tuple[str, list[str]]]:
        return sorted(self.found.items())

    def is_ignored(self, symbol: str, metric: str) -> bool:
        return metric in self.found.get(symbol, ())

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, m) for s, ms in self.listed() for m in ms], "symbol string, metric string")

    def _write(self) -> None:
        if not self.found:
            if os.path.exists(self.path):
                os.remove(self.path)
            return
        with open(self.path, "w") as f:
            json.dump({"version": 1, "ignores": dict(self.listed())}, f, indent=2)
