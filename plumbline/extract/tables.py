"""Source files to units and tokens, file by file within the tasks that read them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.names import language
from plumbline.ship import ship

_UNIT = "id string, kind string, file string, start_line bigint, start_col bigint, end_line bigint, end_col bigint, reads array<string>, writes array<string>, calls array<string>, tags array<string>, params bigint, branches bigint, max_scope_lines bigint, parent string, cognitive_complexity bigint, partial boolean"


#: Languages whose units are read from source here, and the module that does.
READERS = {"python": "python_units", "typescript": "typescript_units", "go": "go_units", "rust": "rust_units"}


def source_units(files: DataFrame, cached_at: int = 0, crates: dict[str, str] | None = None) -> DataFrame:
    """Units of source files (path, content) in the languages of READERS. crates: Rust packages by folder."""
    ship(files.sparkSession)

    def run(batches):
        from importlib import import_module

        readers = {k: import_module(f"plumbline.extract.{m}").units for k, m in READERS.items()}
        for batch in batches:
            rows = [u | {"at": i} for p, c, k in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True) for i, u in enumerate(readers[k](c or "", p, *[crates] * (k == "rust")))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow())

    source = files.select("path", "content", language("path").alias("lang")).where(F.col("lang").isin(*READERS))
    found = source.mapInArrow(run, f"{_UNIT}, at bigint")
    found = with_order(found.withColumn("source_path", F.col("file")), "at").drop("at").withColumn("cached_at", F.lit(cached_at).cast("bigint"))
    return qualify_test_crates(found)


def python_units(files: DataFrame, cached_at: int = 0) -> DataFrame:
    return source_units(files.where(language("path") == "python"), cached_at)


def with_order(units: DataFrame, at: str) -> DataFrame:
    """unit_ord: a text that sorts by the path of the source file, then by place in it; no file has to be numbered."""
    return units.withColumn("unit_ord", F.concat("source_path", F.lit("\u0001"), F.lpad(F.col(at).cast("string"), 20, "0")))


def _arrow() -> pa.Schema:
    text, number = pa.string(), pa.int64()
    many = {"reads", "writes", "calls", "tags"}
    kinds = {"partial": pa.bool_()}
    names = [x.split()[0] for x in _UNIT.split(", ")]
    words = {"id", "kind", "file", "parent"}
    return pa.schema([(n, kinds.get(n, pa.list_(text) if n in many else text if n in words else number)) for n in names] + [("at", number)])


def tokenize(files: DataFrame) -> DataFrame:
    """Tokens (file, pos, value, line, col) of source files (path, content) in the languages that have a lexer."""
    ship(files.sparkSession)

    def run(batches):
        from plumbline.extract.lexers import LEXERS

        for batch in batches:
            for path, content, lang in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                found = list(LEXERS[lang].tokens(content or ""))
                if found:
                    value, line, col = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(range(len(found)), pa.int64()), pa.array(value), pa.array(line, pa.int64()), pa.array(col, pa.int64())], names=["file", "pos", "value", "line", "col"])

    source = files.select("path", "content", language("path").alias("lang")).where("lang is not null")
    return source.mapInArrow(run, "file string, pos bigint, value string, line bigint, col bigint")


def qualify_test_crates(units: DataFrame) -> DataFrame:
    """Ids, parents and calls of Rust tests, benches and examples, which are crates of their own, start with package and kind."""
    path = r"([^/]+)/(tests|benches|examples)/([^/]+)\.rs$"
    package = F.replace(F.regexp_extract("source_path", path, 1), F.lit("-"), F.lit("_"))
    prefix = F.concat(package, F.lit("::"), F.regexp_extract("source_path", path, 2), F.lit("::"))
    stem = F.regexp_extract("source_path", path, 3)
    own = lambda x: F.when((stem != "") & ((x == stem) | F.startswith(x, F.concat(stem, F.lit("::")))), F.concat(prefix, x)).otherwise(x)
    return units.withColumns({"id": own(F.col("id")), "parent": own(F.col("parent")), "calls": F.transform("calls", own)})
