"""Schemas of the tables that operators take and give."""

from __future__ import annotations

SPAN = "start_line bigint, start_col bigint, end_line bigint, end_col bigint"
#: One row for each code unit. unit_ord: place in the order of loading (path of the cache file, then place in it); a number or any other type that sorts so.
UNITS = f"unit_ord bigint, id string, kind string, file string, {SPAN}, reads array<string>, writes array<string>, calls array<string>, tags array<string>, params bigint, branches bigint, max_scope_lines bigint, parent string, cognitive_complexity bigint, partial boolean, source_path string, cached_at bigint"
EDGES = "src string, dst string, kind string"
TOKENS = "file string, pos bigint, value string, line bigint, col bigint"
CLONES = "file_a string, start_line_a bigint, end_line_a bigint, file_b string, start_line_b bigint, end_line_b bigint, token_count bigint"
DISTRIBUTION = "metric string, id string, value bigint"
CHANGED = "file string, whole_file boolean, start_line bigint, end_line bigint"
KINDS = ("Function", "Method", "Struct", "Module")
#: One cache file: the units of one source file, as JSON.
CACHE = (
    "source_path string, cached_at bigint, units array<struct<id string, kind string, file string, span struct<start_line bigint, start_col bigint, end_line bigint, end_col bigint>, reads array<string>, writes array<string>, calls array<string>, tags array<string>, params bigint, branches bigint, max_scope_lines bigint, parent string, cognitive_complexity bigint, partial boolean>>"
)
