"""Queries of the extractors, caches and scalar rules, over source text that is made of the driver's parts; with their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.extract.tables import source_units, tokenize
from plumbline.functions import buckets, names
from plumbline.operators import calls, distribution
from plumbline.plans.adapters import Tables
from plumbline.schemas import CACHE
from plumbline.sinks.writers import listing
from plumbline.sources import caches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: One file for each part p: a class with two methods, and a function of n parameters and b conditions that calls the other of s.
TEMPLATES = {
    "python": """class K{p}:
    def put(self, v):
        self.f{f} = v

    def take(self, w):
        if w:
            for i in w:
                if i:
                    return self.f{f}
        return helper{p}(w)


def helper{p}({params}):
    t = 0
{ifs}    return t
""",
    "typescript": """export class K{p} {
  f{f}: number = 0;
  put(v: number) {
    this.f{f} = v;
  }
  take(w: number) {
    if (w) {
      for (const i of w) {
        if (i) {
          return this.f{f};
        }
      }
    }
    return helper{p}(w);
  }
}

export function helper{p}({params}) {
  let t = 0;
{ifs}  return t;
}
""",
    "rust": """pub struct K{p} {
    f{f}: u32,
}

impl K{p} {
    pub fn put(&mut self, v: u32) {
        self.f{f} = v;
    }

    pub fn take(&self, w: u32) -> u32 {
        if w > 0 {
            for i in 0..w {
                if i > 0 {
                    return self.f{f};
                }
            }
        }
        helper{p}(w)
    }
}

pub fn helper{p}({params}) -> u32 {
    let mut t = 0;
{ifs}    t
}
""",
    "go": """package shop

type K{p} struct {
	f{f} int
}

func (k *K{p}) Put(v int) {
	k.f{f} = v
}

func (k *K{p}) Take(w int) int {
	if w > 0 {
		for i := 0; i < w; i++ {
			if i > 0 {
				return k.f{f}
			}
		}
	}
	return helper{p}(w)
}

func helper{p}({params}) int {
	t := 0
{ifs}	return t
}
""",
}
#: A condition, a parameter, the file, and where things stand: (first, last) line of class, put, take and helper without conditions, lines of a condition, largest block of take and of a condition.
SHAPES = {
    "python": ("    if a0:\n        t = other{s}(t)\n", "a{i}", "pkg/m{p}.py", ((1, 10), (2, 3), (5, 10), (13, 15)), 2, (4, 2)),
    "typescript": ("  if (a0) {\n    t = other{s}(t);\n  }\n", "a{i}: number", "src/m{p}.ts", ((1, 16), (3, 5), (6, 15), (18, 21)), 3, (7, 3)),
    "rust": ("    if a0 > 0 {\n        t = other{s}(t);\n    }\n", "a{i}: u32", "shop/src/m{p}.rs", ((1, 3), (6, 8), (10, 19), (22, 25)), 3, (7, 3)),
    "go": ("\tif a0 > 0 {\n\t\tt = other{s}(t)\n\t}\n", "a{i} int", "shop/m{p}.go", ((3, 5), (7, 9), (11, 20), (22, 25)), 3, (7, 3)),
}
#: Ids of class, put, take and helper.
IDS = {
    "python": ("pkg.m{p}::K{p}", "pkg.m{p}::K{p}.put", "pkg.m{p}::K{p}.take", "pkg.m{p}::helper{p}"),
    "typescript": ("src/m{p}.ts::K{p}", "src/m{p}.ts::K{p}::put", "src/m{p}.ts::K{p}::take", "src/m{p}.ts::helper{p}"),
    "rust": ("shop::m{p}::K{p}", "shop::m{p}::K{p}::put", "shop::m{p}::K{p}::take", "shop::m{p}::helper{p}"),
    "go": ("shop/m{p}.go::K{p}", "shop/m{p}.go::K{p}::Put", "shop/m{p}.go::K{p}::Take", "shop/m{p}.go::helper{p}"),
}
#: Fields as a receiver's are written, and the words of the templates that are no names. Go's semicolons are no tokens.
FIELD = {"python": "f{f}", "typescript": "f{f}", "rust": "f{f}", "go": "self.f{f}"}
WORDS = {
    "python": "class def if for in return",
    "typescript": "export class this if for of const return function let",
    "rust": "pub struct impl fn mut let if for in return",
    "go": "package type struct func if for return",
}
#: p, f, s, n and b of a part.
NUMBERS = {"p": "p_partkey", "f": "p_partkey % 3", "s": "p_partkey % 10", "n": "1 + p_partkey % 4", "b": "p_partkey % 5"}


def _pieces(text: str) -> list[str]:
    """Text and names of placeholders in turn."""
    return re.split(r"\{([a-z]+)\}", text)


def _spark_text(text: str, **more) -> F.Column:
    found = {k: F.expr(v).cast("string") for k, v in NUMBERS.items()} | more
    return F.concat(*[found[x] if i % 2 else F.lit(x) for i, x in enumerate(_pieces(text))])


def _sql_text(text: str, **more: str) -> str:
    found = {k: f"CAST({v} AS VARCHAR)" for k, v in NUMBERS.items()} | more
    quote = lambda x: " || chr(10) || ".join("'" + y + "'" for y in x.replace("'", "''").split("\n"))
    return " || ".join(found[x] if i % 2 else quote(x) for i, x in enumerate(_pieces(text)))


def _sources(t: Tables, lang: str) -> DataFrame:
    """(path, content) of one file for each part."""
    condition, parameter, path, *_ = SHAPES[lang]
    params = F.array_join(F.transform(F.sequence(F.lit(0), F.expr(f"CAST({NUMBERS['n']} AS INT)") - 1), lambda i: F.concat(*[i.cast("string") if k % 2 else F.lit(x) for k, x in enumerate(_pieces(parameter))])), ", ")
    ifs = F.repeat(_spark_text(condition), F.expr(f"CAST({NUMBERS['b']} AS INT)"))
    return t.table("part").select(_spark_text(path).alias("path"), _spark_text(TEMPLATES[lang], params=params, ifs=ifs).alias("content"))


def _source_sql(lang: str) -> str:
    condition, parameter, path, *_ = SHAPES[lang]
    params = f"array_to_string(list_transform(range({NUMBERS['n']}), lambda i: {_sql_text(parameter, i='i')}), ', ')"
    ifs = f"repeat({_sql_text(condition)}, {NUMBERS['b']})"
    return f"SELECT {_sql_text(path)} AS file, {_sql_text(TEMPLATES[lang], params=params, ifs=ifs)} AS content FROM part"


def _units(t: Tables, lang: str) -> DataFrame:
    return source_units(_sources(t, lang), 7, {"shop": "shop"})


def _unit_sql(lang: str) -> str:
    """Every unit with all that is known of it from the template."""
    *_, path, lines, per, (block, small) = SHAPES[lang]
    n, b = NUMBERS["n"], NUMBERS["b"]
    ids = [_sql_text(x) for x in IDS[lang]]
    none = "CAST([] AS VARCHAR[])"
    field, own, other = (f"[{_sql_text(x)}]" for x in (FIELD[lang], "helper{p}", "other{s}"))
    rows = [
        ("Struct", ids[0], "NULL", "0", "0", "0", "0", none, none, none, "0"),
        ("Method", ids[1], ids[0], "1", "0", "0", "0", none, field, none, "0"),
        ("Method", ids[2], ids[0], "1", "3", "6", str(block), field, none, own, "0"),
        ("Function", ids[3], "NULL", n, b, b, f"CASE WHEN {b} > 0 THEN {small} ELSE 0 END", none, none, f"CASE WHEN {b} > 0 THEN {other} ELSE {none} END", f"{per} * ({b})"),
    ]
    columns = "kind id parent params branches cognitive max_scope reads writes calls".split()
    whole = {"params", "branches", "cognitive", "max_scope"}
    one = lambda r, at: "SELECT " + ", ".join(f"CAST({x} AS BIGINT) AS {c}" if c in whole else f"'{x}' AS kind" if c == "kind" else f"CAST({x} AS VARCHAR) AS parent" if c == "parent" else f"{x} AS {c}" for c, x in zip(columns, r)) + f", {_sql_text(path)} AS file, CAST({at[0]} AS BIGINT) AS start_line, CAST({at[1]} + {r[-1]} AS BIGINT) AS end_line FROM part"
    return " UNION ALL ".join(one(r, at) for r, at in zip(rows, lines))


def _add(name: str, build: Callable[[Tables], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    ORACLES[name] = sql


MEASURES = {"branches": "branches", "cognitive": "cognitive_complexity", "max_scope": "max_scope_lines"}
NAMED = {"python": "py", "typescript": "ts", "rust": "rust", "go": "go"}
for _lang, _short in NAMED.items():
    _all = _unit_sql(_lang)
    _add(f"{_short}_units", lambda t, k=_lang: _units(t, k).select("id", "kind", "file", "start_line", "end_line", "params", "parent"), f"SELECT id, kind, file, start_line, end_line, params, parent FROM ({_all})")
    for _m, _column in MEASURES.items():
        _add(f"{_short}_{_m}", lambda t, k=_lang, m=_m, c=_column: _units(t, k).select("id", F.col(c).alias(m)), f"SELECT id, {_m} FROM ({_all})")
    _add(f"{_short}_calls", lambda t, k=_lang: calls.unit_calls(_units(t, k)), f"SELECT id, file, unnest(calls) AS call FROM ({_all})")
    _add(
        f"{_short}_fields",
        lambda t, k=_lang: _units(t, k).select("id", F.explode("reads").alias("field"), F.lit("read").alias("access")).unionAll(_units(t, k).select("id", F.explode("writes"), F.lit("write"))),
        f"SELECT id, unnest(reads) AS field, 'read' AS access FROM ({_all}) UNION ALL SELECT id, unnest(writes), 'write' FROM ({_all})",
    )
    _other = "[^A-Za-z0-9_\\s;]" if _lang == "go" else "[^A-Za-z0-9_\\s]"
    _word = "'^(" + "|".join(WORDS[_lang].split()) + ")$'"
    _add(
        f"{_short}_tokens",
        lambda t, k=_lang: tokenize(_sources(t, k)).groupBy("file", "line").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "$ID").alias("names"), F.count_if(F.col("value") == "$LIT").alias("literals"), F.min("col").alias("first_col")),
        f"""
SELECT file, CAST(line AS BIGINT) AS line, CAST(len(v) AS BIGINT) AS n, CAST(len(list_filter(v, lambda x: regexp_matches(x, '^[A-Za-z_]') AND NOT regexp_matches(x, {_word}))) AS BIGINT) AS names,
       CAST(len(list_filter(v, lambda x: regexp_matches(x, '^[0-9]'))) AS BIGINT) AS literals, CAST(len(x) - len(ltrim(x, ' ' || chr(9))) AS BIGINT) AS first_col
FROM (SELECT file, line, x, regexp_extract_all(x, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|:=|\\+\\+|->|\\.\\.|{_other}') AS v
      FROM (SELECT file, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS line FROM (SELECT file, string_split(content, chr(10)) AS l FROM ({_source_sql(_lang)})))) WHERE len(v) > 0""",
    )

IGNORED = "a{p} = 1\n# tool:ignore-start\nb = 2\nc = 3\n# tool:ignore-end\nd = 4\n"
_add(
    "ignore_regions",
    lambda t: tokenize(t.table("part").select(_spark_text("m{p}.py").alias("path"), _spark_text(IGNORED).alias("content"))).groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("last_line")),
    f"SELECT {_sql_text('m{p}.py')} AS file, CAST(6 AS BIGINT) AS n, CAST(6 AS BIGINT) AS last_line FROM part",
)
TEST_CRATE = "fn helper() {}\nfn run{p}() {\n    helper();\n}\n"
_add(
    "rust_test_crates",
    lambda t: source_units(t.table("part").select(_spark_text("my-shop/tests/t{p}.rs").alias("path"), _spark_text(TEST_CRATE).alias("content")), 7, {"my-shop": "my-shop"}).select("id", "file", "kind"),
    f"SELECT {_sql_text('my_shop::tests::t{p}::helper')} AS id, {_sql_text('my-shop/tests/t{p}.rs')} AS file, 'Function' AS kind FROM part UNION ALL SELECT {_sql_text('my_shop::tests::t{p}::run{p}')}, {_sql_text('my-shop/tests/t{p}.rs')}, 'Function' FROM part",
)
_py = _unit_sql("python")


def _from_cache(t: Tables) -> DataFrame:
    """Units written as cache entries and read back."""
    entry = F.from_json("json", CACHE).alias("e")
    return caches.to_entries(_units(t, "python")).select(entry).select("e.source_path", "e.cached_at", F.explode("e.units").alias("u")).select("source_path", "cached_at", "u.id", "u.kind", "u.span.start_line", "u.params", F.size("u.calls").cast("long").alias("n_calls"))


_add("unit_cache", _from_cache, f"SELECT file AS source_path, CAST(7 AS BIGINT) AS cached_at, id, kind, start_line, params, CAST(len(calls) AS BIGINT) AS n_calls FROM ({_py})")


def _token_files(t: Tables) -> DataFrame:
    """Tokens written as token files and read back, those of before generation 50 left out."""
    import pyarrow as pa

    def encode(table):
        rows = table.sort_by("pos").to_pylist()
        return pa.table({"data": pa.array([caches.encode_tokens(rows[0]["file"], rows[0]["stamp"], [(r["value"], r["line"], r["col"]) for r in rows])], pa.binary())})

    def decode(batches):
        for batch in batches:
            for x in batch.column(0):
                path, stamp, found = caches.decode_tokens(x.as_py())
                yield pa.RecordBatch.from_pydict({"file": [path], "stamp": [stamp], "n": [len(found)], "last_line": [found[-1][1]], "distinct_values": [len({v for v, _, _ in found})]})

    stamp = F.regexp_extract("file", "([0-9]+)", 1).cast("long") % 100
    files = tokenize(_sources(t, "go")).withColumn("stamp", stamp).groupBy("file").applyInArrow(encode, "data binary")
    return files.mapInArrow(decode, "file string, stamp long, n long, last_line long, distinct_values long").where("stamp >= 50")


_add("token_files", _token_files, f"""
SELECT file, p % 100 AS stamp, n, CAST(25 + 3 * (p % 5) AS BIGINT) AS last_line, distinct_values
FROM (SELECT file, CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) AS p, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT CASE WHEN regexp_matches(v, '^[0-9]') THEN '$LIT' WHEN regexp_matches(v, '^[A-Za-z_]') AND NOT regexp_matches(v, '^({"|".join(WORDS["go"].split())})$') THEN '$ID' ELSE v END) AS BIGINT) AS distinct_values
      FROM (SELECT file, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|:=|\\+\\+|->|\\.\\.|[^A-Za-z0-9_\\s;]')) AS v FROM ({_source_sql("go")})) GROUP BY file) WHERE p % 100 >= 50""")  # fmt: skip
_add(
    "ls_listing",
    lambda t: listing(_units(t, "python"), 16),
    f"SELECT rpad(CASE WHEN len(id) > 16 THEN id[:13] || '...' ELSE id END, 16, ' ') || '  ' || rpad(kind, 8, ' ') || '  ' || file || ':' || start_line || '-' || end_line AS line FROM ({_py})",
)
_add(
    "graph_merge",
    lambda t: calls.merge(*[(_units(t, k).select("id", "kind"), _units(t, k).select(F.col("id").alias("src"), F.col("file").alias("dst"))) for k in ("python", "go")])[0],
    f"SELECT id, kind FROM ({_py}) UNION ALL SELECT id, kind FROM ({_unit_sql('go')})",
)
_scalar = lambda name, column, sql, source="part": _add(name, lambda t: t.table(source).select("p_partkey", column().alias("value")), f"SELECT p_partkey, {sql} AS value FROM {source}")
_path = lambda: _spark_text("src/d{f}/m{p}.")
_scalar("file_language", lambda: names.language(F.concat(_path(), F.element_at(F.array(*map(F.lit, ("rs", "tsx", "pyi", "go", "txt"))), F.expr("CAST(p_partkey % 5 + 1 AS INT)")))), "CASE p_partkey % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'go' END")
_scalar("cache_paths", lambda: names.cache_path(F.concat(_path(), F.lit("ts")), ".tokens"), f"{_sql_text('src/d{f}/m{p}.ts.tokens')}")
_scalar("truncated_names", lambda: names.truncated(_spark_text("crate::module{p}::function"), 18), f"CASE WHEN len({_sql_text('crate::module{p}::function')}) > 18 THEN ({_sql_text('crate::module{p}::function')})[:15] || '...' END")
_scalar("normalised_paths", lambda: names.within(_spark_text("lib/./x{f}/../d{s}//m{p}.rs"), "/work/app", "/alias/app"), _sql_text("lib/d{s}/m{p}.rs"))
_scalar("paths_below_links", lambda: names.within(F.concat(F.when(F.expr("p_partkey % 2 = 0"), F.lit("/alias/app/")).otherwise(F.lit("/else/")), _spark_text("m{p}.rs")), "/work/app", "/alias/app"), f"CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '/else/' END || {_sql_text('m{p}.rs')}")
_scalar("python_modules", lambda: names.python_module(F.concat(_spark_text("pkg/d{f}/m{p}"), F.when(F.expr("p_partkey % 2 = 0"), F.lit("/__init__.py")).otherwise(F.lit(".pyi")))), _sql_text("pkg.d{f}.m{p}"))
_scalar("simple_names", lambda: names.simple_name(_spark_text("crate{f}::obj{s}.name{p}")), _sql_text("name{p}"))
_scalar("go_targets", lambda: names.relative_target(F.concat(F.when(F.expr("p_partkey % 2 = 0"), F.lit("/mod/")).otherwise(F.lit("/other/")), _spark_text("m{p}.go::F")), "/mod"), f"CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '/other/' END || {_sql_text('m{p}.go::F')}")
_scalar("test_crate_ids", lambda: names.test_crate_qualified(_spark_text("t{p}::run"), "my_shop", "tests"), _sql_text("my_shop::tests::t{p}::run"))
_scalar("displayed_values", lambda: F.concat_ws("|", *[buckets.display(F.expr("p_size"), F.lit("good"), m, integer=True) for m in ("value", "label", "both")]), "p_size || '|good|' || p_size || ' (good)'")


def _parts(t: Tables) -> DataFrame:
    """A distribution of each direction."""
    return t.table("part").select(F.explode(F.array(F.lit("params"), F.lit("line_cov"))).alias("metric"), _spark_text("u{p}").alias("id"), F.col("p_size").cast("long").alias("value"))


_dist = f"SELECT unnest(['params', 'line_cov']) AS metric, {_sql_text('u{p}')} AS id, CAST(p_size AS BIGINT) AS value FROM part"
_add("ranked_both_ways", lambda t: distribution.ranked(_parts(t)), f"SELECT metric, id, value, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'line_cov' THEN value ELSE -value END, id) AS dist_rank FROM ({_dist})")
_add("summary_first_ten", lambda t: distribution.top(_parts(t), "params", 10, 3), f"SELECT metric, id, value FROM ({_dist}) WHERE metric = 'params' AND value > 3 ORDER BY value DESC, id LIMIT 10")
_add("duplication_ranked", lambda t: distribution.ranked(_parts(t).where("metric = 'params'").select(F.lit("duplication_pct").alias("metric"), "id", "value", (F.col("value") / 7).alias("raw")), "raw").select("metric", "id", "value", "dist_rank"), f"SELECT 'duplication_pct' AS metric, id, value, row_number() OVER (ORDER BY -value, id) AS dist_rank FROM ({_dist}) WHERE metric = 'params'")
