"""The same results in DuckDB SQL, to check the Spark plans against. Fragments stand in braces and come as CTEs."""

from __future__ import annotations

import re

from plumbline.config import BUCKETS, COLLECTED, Config, LOWER_IS_WORSE, METRICS, SHOWN, Thresholds
from plumbline.plans.adapters import DUCK

K = 50
CONFIG = Config()


def _desc(v: str, t: Thresholds) -> str:
    return f"(CASE WHEN {v} < {t.excellent} THEN 0 WHEN {v} < {t.good} THEN 1 WHEN {v} < {t.fair} THEN 2 WHEN {v} < {t.poor} THEN 3 ELSE 4 END)"


def _asc(v: str, t: Thresholds) -> str:
    return f"(CASE WHEN {v} >= {t.excellent} THEN 0 WHEN {v} >= {t.good} THEN 1 WHEN {v} >= {t.fair} THEN 2 WHEN {v} >= {t.poor} THEN 3 ELSE 4 END)"


def _level(m: str = "metric", v: str = "value", fan_in: str = "fan_in") -> str:
    size = CONFIG.function_size
    cases = [f"WHEN {m} = 'function_size' THEN CASE WHEN coalesce({fan_in}, 0) = 1 THEN greatest({_asc(v, size.low)}, {_desc(v, size.high)}) ELSE {_desc(v, size.high)} END"]
    cases += [f"WHEN {m} = '{x}' THEN {(_asc if x in LOWER_IS_WORSE else _desc)(v, CONFIG.by_name(x))}" for x in SHOWN if x != "function_size"]
    return f"CAST(CASE {' '.join(cases)} END AS INTEGER)"


def _bucket(level: str) -> str:
    return "CASE " + level + " " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BUCKETS)) + " END"


def _place(names) -> str:
    return "CASE metric " + " ".join(f"WHEN '{n}' THEN {i + 1}" for i, n in enumerate(names)) + " END"


def _summary(source: str, metrics) -> str:
    low = ", ".join(f"'{m}'" for m in sorted(LOWER_IS_WORSE))
    names = ", ".join(f"('{m}')" for m in metrics)
    return f"""
SELECT m.metric, coalesce(n, 0) AS n, coalesce(mx, 0) AS max, coalesce(mean, 0) AS mean, coalesce(p90, 0) AS p90, CAST(coalesce(total, 0) AS BIGINT) AS total
FROM (VALUES {names}) AS m(metric) LEFT JOIN (
  SELECT metric, count(*) AS n, max(value) AS mx, avg(value) AS mean, sum(value) AS total, max(CASE WHEN rn = CASE WHEN metric IN ({low}) THEN (n1 + 9) // 10 ELSE (9 * n1 + 9) // 10 END THEN value END) AS p90
  FROM (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY metric) AS n1 FROM {source}) GROUP BY metric) s USING (metric)
"""


LOCAL = "CASE WHEN strpos({0}, '::') > 0 THEN substr({0}, strpos({0}, '::') + 2) END"
_local = LOCAL.format("id")
_short = f"CASE WHEN strpos({_local}, '::') > 0 THEN list_last(string_split({_local}, '::')) END"


def _pick(key: str, name: str) -> str:
    return f"""
SELECT id, call, file, crate, {name} FROM (
  SELECT c.id, c.call, c.file, c.crate, i.id AS {name}, row_number() OVER (PARTITION BY c.id, c.file, c.call
    ORDER BY CASE WHEN starts_with(i.id, c.file) THEN 0 WHEN split_part(i.id, '::', 1) = c.crate THEN 1 ELSE 2 END, i.unit_ord, i.key_ord) AS rn
  FROM {{x_calls}} c LEFT JOIN {{x_index}} i ON i.key = {key}) WHERE rn = 1
"""


def _looked(dist: str) -> str:
    """A distribution with the rank of each value and what rows look up: cyclomatic and cognitive complexity and fans."""
    return f"""
SELECT d.metric, d.id, d.value, dist_rank, coalesce(cy.value, 0) AS cyc, coalesce(co.value, 0) AS cog, coalesce(f.fan_in, 0) AS fan_in, coalesce(f.fan_out, 0) AS fan_out
FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'line_cov' THEN raw ELSE -raw END, id) AS dist_rank FROM {{{dist}}}) d
LEFT JOIN (SELECT id, value FROM {{x_complexity}} WHERE metric = 'cyclomatic') cy ON cy.id = d.id
LEFT JOIN (SELECT id, value FROM {{x_complexity}} WHERE metric = 'cognitive') co ON co.id = d.id
LEFT JOIN {{x_fan}} f ON f.id = d.id"""


def _scored(looked: str) -> str:
    return f"""
SELECT metric, id AS symbol, CASE WHEN metric = 'line_cov' THEN value || '%' ELSE CAST(value AS VARCHAR) END AS value, {_bucket(_level())} AS bucket, {_level()} AS severity, {_place(COLLECTED)} AS collect_ord, dist_rank,
       (metric IN ('fan_out', 'params') AND cyc < 20 AND cog < 15) OR (metric = 'cyclomatic' AND cog < 15) OR (metric = 'fan_in' AND NOT (fan_in >= 10 AND fan_out >= 3)) AS hidden
FROM {{{looked}}} WHERE NOT CASE metric WHEN 'line_cov' THEN value >= 100 WHEN 'cognitive' THEN value <= 1 WHEN 'cyclomatic' THEN value <= 1 WHEN 'function_size' THEN value <= 1 AND fan_in <> 1 WHEN 'fan_in' THEN false ELSE value <= 0 END"""


FRAGMENTS = DUCK | {
    "x_units": """
SELECT unit_key AS unit_ord, id, 'Method' AS kind, file, start_line, end_line, params, branches, cognitive_complexity, max_scope_lines, parent FROM {a_methods}
UNION ALL SELECT 1099511627776 + unit_key, id, 'Function', file, 1, 1, 0, 0, 0, 0, NULL FROM {a_functions}
UNION ALL SELECT 2199023255552, id, 'Struct', file, start_line, end_line, 0, 0, 0, 0, split_part(id, '::', 1) FROM {a_structs}""",
    "x_cx": "SELECT id, end_line - start_line + 1 AS size, params, branches + 1 AS cyclomatic, cognitive_complexity AS cognitive, max_scope_lines AS max_scope FROM {x_units} WHERE kind IN ('Function', 'Method')",
    "x_complexity": " UNION ALL ".join(f"SELECT '{m}' AS metric, id, CAST({c} AS BIGINT) AS value FROM {{x_cx}}" for m, c in (("function_size", "size"), ("params", "params"), ("cyclomatic", "cyclomatic"), ("cognitive", "cognitive"), ("max_scope", "max_scope"))),
    "x_index": f"""
SELECT key, id, unit_ord, key_ord FROM (
  SELECT id AS key, id, unit_ord, 0 AS key_ord FROM {{x_units}}
  UNION ALL SELECT {_local}, id, unit_ord, 1 FROM {{x_units}}
  UNION ALL SELECT {_short}, id, unit_ord, 2 FROM {{x_units}}
  UNION ALL SELECT nullif({_short}, ''), id, unit_ord, 3 FROM {{x_units}}) WHERE key IS NOT NULL""",
    "x_calls": "SELECT id, file, call, split_part(id, '::', 1) AS crate FROM {a_calls}",
    "x_exact": "SELECT c.*, u.id AS exact FROM {x_calls} c LEFT JOIN (SELECT DISTINCT id FROM {x_units}) u ON u.id = c.call",
    "x_same": "SELECT c.*, u.id AS same_file FROM {x_calls} c LEFT JOIN (SELECT DISTINCT id FROM {x_units}) u ON u.id = c.file || '::' || c.call",
    "x_name": _pick("c.call", "by_name"),
    "x_method": _pick("CASE WHEN contains(c.call, '.') THEN list_last(string_split(c.call, '.')) END", "by_method"),
    "x_path": f"""
SELECT c.id, c.call, c.file, c.crate, CASE WHEN count(i.id) = 1 THEN min(i.id) END AS by_path
FROM {{x_calls}} c LEFT JOIN {{x_index}} i ON i.key = {LOCAL.format("c.call")} AND split_part(i.id, '::', 1) = c.crate GROUP BY ALL""",
    "x_resolved": """
SELECT e.id, e.call, e.file, coalesce(e.exact, s.same_file, n.by_name, m.by_method, p.by_path) AS target,
       CASE WHEN e.exact IS NOT NULL THEN 'exact' WHEN s.same_file IS NOT NULL THEN 'same_file' WHEN n.by_name IS NOT NULL THEN 'name' WHEN m.by_method IS NOT NULL THEN 'method' WHEN p.by_path IS NOT NULL THEN 'path' END AS how
FROM {x_exact} e JOIN {x_same} s USING (id, file, call) JOIN {x_name} n USING (id, file, call) JOIN {x_method} m USING (id, file, call) JOIN {x_path} p USING (id, file, call)""",
    "x_edges": "SELECT id AS src, target AS dst FROM {x_resolved} WHERE target IS NOT NULL AND target <> id",
    "x_fan": """
SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (
  SELECT id, 0 AS i, 0 AS o FROM {x_units} UNION ALL SELECT dst, 1, 0 FROM {x_edges} UNION ALL SELECT src, 0, 1 FROM {x_edges}) GROUP BY id""",
    "x_mps": "SELECT id, CAST(sum(n) AS BIGINT) AS value FROM (SELECT id, 0 AS n FROM {x_units} WHERE kind = 'Struct' UNION ALL SELECT parent, 1 FROM {x_units} WHERE kind = 'Method') GROUP BY id",
    "x_link": "SELECT DISTINCT a.id AS a, b.id AS b FROM {a_fields} a JOIN {a_fields} b ON a.parent = b.parent AND a.field = b.field UNION SELECT s.id, m.id FROM {a_siblings} s JOIN {a_methods} m ON m.unit_key = s.before UNION SELECT m.id, s.id FROM {a_siblings} s JOIN {a_methods} m ON m.unit_key = s.before",
    "x_reach": "SELECT id AS a, id AS b FROM {a_methods} UNION SELECT r.a, l.b FROM x_reach r JOIN {x_link} l ON r.b = l.a",
    "x_lcom": "SELECT parent AS id, CAST(count(DISTINCT least_id) AS BIGINT) AS value FROM (SELECT m.parent, m.id, min(r.b) AS least_id FROM {a_methods} m JOIN {x_reach} r ON r.a = m.id GROUP BY ALL) GROUP BY parent",
    "x_loc": "SELECT file AS id, max(end_line) AS value FROM {x_units} GROUP BY file",
    "x_lists": "SELECT file, list(value ORDER BY pos) AS t, list(line ORDER BY pos) AS l FROM {b_tokens} GROUP BY file",
    "x_grams": f"SELECT file, pos, md5(array_to_string(t[pos + 1:pos + {K}], chr(1))) AS gram, CASE WHEN pos > 0 THEN t[pos] END AS prev FROM (SELECT file, t, unnest(range(len(t) - {K} + 1)) AS pos FROM {{x_lists}} WHERE len(t) >= {K})",
    "x_buckets": "SELECT gram, count(*) AS places FROM {x_grams} GROUP BY gram HAVING count(*) >= 2",
    "x_candidates": f"""
SELECT a.file AS file_a, a.pos AS pos_a, b.file AS file_b, b.pos AS pos_b
FROM {{x_grams}} a JOIN {{x_grams}} b ON a.gram = b.gram JOIN {{x_buckets}} k ON k.gram = a.gram
WHERE places <= 200 AND (a.file < b.file OR a.file = b.file AND a.pos + {K} <= b.pos) AND (a.prev IS NULL OR b.prev IS NULL OR a.prev <> b.prev)""",
    "x_maximal": """
SELECT file_a, la[pos_a + 1] AS start_line_a, la[pos_a + n] AS end_line_a, file_b, lb[pos_b + 1] AS start_line_b, lb[pos_b + n] AS end_line_b, CAST(n AS BIGINT) AS token_count
FROM (SELECT *, coalesce(list_position(list_transform(list_zip(ta[pos_a + 1:pos_a + room], tb[pos_b + 1:pos_b + room]), lambda z: z[1] <> z[2]), true) - 1, room) AS n
      FROM (SELECT c.*, a.t AS ta, b.t AS tb, a.l AS la, b.l AS lb, least(len(a.t) - pos_a, len(b.t) - pos_b, CASE WHEN file_a = file_b THEN pos_b - pos_a ELSE 2147483647 END) AS room
            FROM {x_candidates} c JOIN {x_lists} a ON a.file = file_a JOIN {x_lists} b ON b.file = file_b))""",
    "x_clones": """
SELECT * FROM (SELECT file_a, start_line_a, end_line_a, file_b, start_line_b, end_line_b, max(token_count) AS token_count FROM {x_maximal} GROUP BY ALL) c
WHERE NOT EXISTS (SELECT 1 FROM {x_maximal} o WHERE o.file_a = c.file_a AND o.file_b = c.file_b
  AND c.start_line_a >= o.start_line_a AND c.end_line_a <= o.end_line_a AND c.start_line_b >= o.start_line_b AND c.end_line_b <= o.end_line_b
  AND (c.start_line_a <> o.start_line_a OR c.end_line_a <> o.end_line_a OR c.start_line_b <> o.start_line_b OR c.end_line_b <> o.end_line_b))""",
    "x_dup_lines": "SELECT DISTINCT file, unnest(range(s, e + 1)) AS line FROM (SELECT file_a AS file, start_line_a AS s, end_line_a AS e FROM {x_clones} UNION ALL SELECT file_b, start_line_b, end_line_b FROM {x_clones})",
    "x_pct": """
SELECT file || '::all' AS id, coalesce(n, 0) * 100.0::DOUBLE / lines AS pct FROM (SELECT file, max(line) AS lines FROM {b_tokens} GROUP BY file) f LEFT JOIN (SELECT file, count(*) AS n FROM {x_dup_lines} JOIN {x_last} USING (file) WHERE (line - 1) // 5 % 2 = 1 OR last <= 5 GROUP BY file) d USING (file)
UNION ALL SELECT file || '::b' || k, coalesce(n, 0) * 100.0::DOUBLE / 5 FROM (SELECT DISTINCT file, (line - 1) // 5 AS k FROM {b_tokens} WHERE (line - 1) // 5 % 2 = 0) f LEFT JOIN (SELECT file, (line - 1) // 5 AS k, count(*) AS n FROM {x_dup_lines} JOIN {x_last} USING (file) WHERE last > 5 GROUP BY ALL) d USING (file, k)""",
    "x_last": "SELECT file, max(line) AS last FROM {b_tokens} GROUP BY file",
    "x_owner": """
SELECT file, line, arg_min(id, (len, id)) AS owner FROM (
  SELECT p.file, p.line, u.id, {'a': u.end_line - u.start_line, 'b': u.id} AS k, u.end_line - u.start_line AS len FROM (SELECT file, line FROM {c_lines} UNION SELECT file, line FROM {c_branches}) p
  JOIN {c_units} u ON u.file = p.file AND p.line BETWEEN u.start_line AND u.end_line) GROUP BY file, line""",
    "x_cov": """
SELECT u.id, coalesce(total, 0) AS total, coalesce(hit, 0) AS hit, CASE WHEN total > 0 THEN hit * 100 // total ELSE 0 END AS line_cov, coalesce(uncov, 0) AS uncov_branches
FROM (SELECT DISTINCT id FROM {c_units}) u
LEFT JOIN (SELECT owner AS id, count(*) AS total, count(*) FILTER (hits > 0) AS hit FROM {c_lines} JOIN {x_owner} USING (file, line) GROUP BY owner) l USING (id)
LEFT JOIN (SELECT owner AS id, count(*) FILTER (taken = 0) AS uncov FROM {c_branches} JOIN {x_owner} USING (file, line) GROUP BY owner) b USING (id)""",
    "x_code_dist": "SELECT metric, id, value, CAST(value AS DOUBLE) AS raw FROM {x_complexity} UNION ALL SELECT 'fan_in', id, fan_in, fan_in FROM {x_fan} UNION ALL SELECT 'fan_out', id, fan_out, fan_out FROM {x_fan}",
    "x_code_looked": _looked("x_code_dist"),
    "x_code_scored": _scored("x_code_looked"),
    "x_code_rows": "SELECT metric, symbol, value, bucket, severity, collect_ord, dist_rank FROM {x_code_scored} WHERE NOT hidden",
    "x_dist": " UNION ALL ".join(
        [
            "SELECT metric, id, value, raw FROM {x_code_dist}",
            "SELECT 'methods_per_struct', id, value, value FROM {x_mps}",
            "SELECT 'lcom', id, value, value FROM {x_lcom}",
            "SELECT 'file_loc', id, value, value FROM {x_loc}",
            "SELECT 'duplication_pct', id, CAST(round(pct) AS BIGINT), pct FROM {x_pct} WHERE pct > 0",
            "SELECT 'line_cov', id, line_cov, line_cov FROM {x_cov}",
            "SELECT 'uncov_branches', id, uncov_branches, uncov_branches FROM {x_cov}",
        ]
    ),
    "x_looked": _looked("x_dist"),
    "x_scored": _scored("x_looked"),
    "x_rows": "SELECT metric, symbol, value, bucket, severity, collect_ord, dist_rank FROM {x_scored} WHERE NOT hidden",
    "x_ignored": "SELECT concat('crate', c_nationkey, '::cust::C', c_custkey) AS symbol, CASE c_custkey % 2 WHEN 0 THEN 'lcom' ELSE 'methods_per_struct' END AS metric FROM customer WHERE c_custkey % 5 = 0",
    "x_changed": "SELECT DISTINCT u.id, u.file, u.parent FROM {x_units} u JOIN {d_changed} c ON c.file = u.file AND c.start_line <= u.end_line AND u.start_line <= c.end_line",
    "x_scope": "SELECT DISTINCT id FROM (SELECT id FROM {x_changed} UNION ALL SELECT parent FROM {x_changed} WHERE parent IS NOT NULL UNION ALL SELECT u.parent FROM {x_units} u JOIN {x_changed} c ON u.id = c.parent AND u.file = c.file WHERE u.parent IS NOT NULL)",
    "x_scoped": "SELECT metric, id, value FROM {x_dist} WHERE metric IN ('fan_in', 'fan_out', 'function_size', 'params', 'cyclomatic', 'cognitive', 'max_scope', 'methods_per_struct') AND id IN (SELECT id FROM {x_scope}) OR metric = 'file_loc' AND id IN (SELECT file FROM {x_units} WHERE file IN (SELECT file FROM {d_changed}))",
}
FRAGMENTS["x_owner"] = """
SELECT file, line, id AS owner FROM (
  SELECT p.file, p.line, u.id, row_number() OVER (PARTITION BY p.file, p.line ORDER BY u.end_line - u.start_line, u.id) AS rn
  FROM (SELECT file, line FROM {c_lines} UNION SELECT file, line FROM {c_branches}) p
  JOIN {c_units} u ON u.file = p.file AND p.line BETWEEN u.start_line AND u.end_line) WHERE rn = 1"""
#: Clones that begin with windows at any number of places, and what is made of them: the same fragments without that limit, named w_ for x_.
WHOLE = ("x_candidates", "x_maximal", "x_clones", "x_dup_lines", "x_pct", "x_dist", "x_looked", "x_scored", "x_rows")
FRAGMENTS |= {"w" + n[1:]: re.sub(r"\{x(_\w+)\}", lambda m: "{w" + m[1] + "}" if "x" + m[1] in WHOLE else m[0], FRAGMENTS[n].replace("places <= 200 AND ", "")) for n in WHOLE}
SCOPED = ("fan_in", "fan_out", "function_size", "params", "cyclomatic", "cognitive", "max_scope", "methods_per_struct", "file_loc")


def sql(body: str) -> str:
    """`body` with the fragments that it names as CTEs before it."""
    need: list[str] = []
    bare = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in FRAGMENTS and name not in need:
                visit(FRAGMENTS[name])
                need.append(name)

    visit(body)
    if not need:
        return bare(body)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({bare(FRAGMENTS[n])})" for n in need) + "\n" + bare(body)


def catalog_sql() -> str:
    def row(m: str) -> str:
        t = CONFIG.by_name(m)
        return f"('{m}', '{'lower' if m in LOWER_IS_WORSE else 'higher'}', {t.excellent}::DOUBLE, {t.good}::DOUBLE, {t.fair}::DOUBLE, {t.poor}::DOUBLE, false)"

    return f"SELECT * FROM (VALUES {', '.join(map(row, METRICS))}) AS c(metric, worse, excellent, good, fair, poor, disabled)"


_rows, _code_rows = (f"SELECT metric, symbol, value, bucket, severity FROM {{{t}}}" for t in ("x_rows", "x_code_rows"))
ORACLES = {
    "units_complexity_long": sql("SELECT metric, id, value FROM {x_complexity}"),
    "distribution_summary": sql(_summary("{x_complexity}", ("function_size", "params", "cyclomatic", "cognitive", "max_scope"))),
    "severity_buckets": sql(f"SELECT metric, {_bucket(_level(fan_in='0'))} AS bucket, count(*) AS n FROM {{x_complexity}} GROUP BY ALL"),
    "severity_buckets_asc": sql(f"SELECT id, line_cov, {_asc('line_cov', CONFIG.by_name('line_cov'))} AS severity FROM {{x_cov}}"),
    "size_two_sided": sql(f"SELECT c.id, c.size, f.fan_in, {_level(chr(39) + 'function_size' + chr(39), 'c.size', 'f.fan_in')} AS severity FROM {{x_cx}} c LEFT JOIN {{x_fan}} f USING (id)"),
    "call_name_index": sql("SELECT key, id, unit_ord, key_ord FROM {x_index}"),
    "call_exact": sql("SELECT id, file, call, exact FROM {x_exact}"),
    "call_same_file": sql("SELECT id, file, call, same_file FROM {x_same}"),
    "call_name_pick": sql("SELECT id, file, call, by_name FROM {x_name}"),
    "call_method_pick": sql("SELECT id, file, call, by_method FROM {x_method}"),
    "call_path_pick": sql("SELECT id, file, call, by_path FROM {x_path}"),
    "calls_resolved": sql("SELECT id, file, call, target, how FROM {x_resolved}"),
    "edges_resolved": sql("SELECT src, dst, 'Calls' AS kind FROM {x_edges}"),
    "fan_in_dist": sql("SELECT 'fan_in' AS metric, id, fan_in AS value FROM {x_fan}"),
    "fan_out_dist": sql("SELECT 'fan_out' AS metric, id, fan_out AS value FROM {x_fan}"),
    "fan_summary": sql("SELECT max(fan_in) AS fan_in_max, avg(fan_in) AS fan_in_mean, max(fan_out) AS fan_out_max, avg(fan_out) AS fan_out_mean FROM {x_fan}"),
    "dag_density": sql("SELECT n AS nodes, e AS edges, e / (n - 1) AS dag_density FROM (SELECT (SELECT count(*) FROM {x_units}) AS n, (SELECT count(*) FROM {x_edges}) AS e)"),
    "hubs": sql("SELECT id, fan_in, fan_out FROM {x_fan} WHERE fan_in >= 10 AND fan_out >= 3"),
    "methods_per_struct": sql("SELECT 'methods_per_struct' AS metric, id, value FROM {x_mps}"),
    "lcom4": sql("SELECT 'lcom' AS metric, id, value FROM {x_lcom}"),
    "lcom4_large": sql("SELECT 'lcom' AS metric, id, value FROM {x_lcom}"),
    "file_loc": sql("SELECT 'file_loc' AS metric, id, value FROM {x_loc}"),
    "file_loc_summary": sql(_summary("(SELECT 'file_loc' AS metric, value FROM {x_loc})", ("file_loc",))),
    "token_stream": sql("SELECT file, pos, value, line FROM {b_tokens}"),
    "kgram_windows": sql("SELECT file, count(*) AS windows, count(DISTINCT gram) AS grams FROM {x_grams} GROUP BY file"),
    "kgram_buckets": sql("SELECT places, count(*) AS buckets FROM {x_buckets} GROUP BY places"),
    "clone_candidates": sql("SELECT file_a, pos_a, file_b, pos_b FROM {x_candidates}"),
    "clones_maximal": sql("SELECT * FROM {w_maximal}"),
    "clones_unsubsumed": sql("SELECT * FROM {x_clones}"),
    "duplication_pct": sql("SELECT id, pct FROM {x_pct}"),
    "duplication_summary": sql("""
SELECT max(pct) AS max, coalesce(avg(pct) FILTER (pct > 0), 0) AS mean, max(CASE WHEN rn = (9 * n + 9) // 10 THEN pct END) AS p90, (SELECT count(*) FROM {x_clones}) AS clone_count
FROM (SELECT pct, row_number() OVER (ORDER BY pct) AS rn, count(*) OVER () AS n FROM {x_pct})"""),
    "lcov_parse": sql("SELECT 'DA' AS kind, file, line, hits AS n FROM {c_lines} UNION ALL SELECT 'BRDA', file, line, taken FROM {c_branches}"),
    "lcov_merge": sql("SELECT file, line, 2 * hits AS hits FROM {c_lines}"),
    "line_cov": sql("SELECT 'line_cov' AS metric, id, line_cov AS value FROM {x_cov}"),
    "uncov_branches": sql("SELECT 'uncov_branches' AS metric, id, uncov_branches AS value FROM {x_cov}"),
    "coverage_counters": sql("SELECT (SELECT count(*) FROM {x_cov}) AS units_analyzed, (SELECT count(*) FILTER (total = 0) FROM {x_cov}) AS units_without_data, (SELECT count(DISTINCT file) FROM {c_lines}) AS lcov_files_total, (SELECT count(DISTINCT file) FROM {c_lines} WHERE file IN (SELECT file FROM {c_units})) AS lcov_files_matched, true AS has_branches"),
    "coverage_warnings": sql("""
SELECT 'as it is' AS report, 'units_without_data' AS warning FROM (SELECT count(*) AS n, count(*) FILTER (total = 0) AS m FROM {x_cov}) WHERE 2 * m >= n
UNION ALL SELECT 'a quarter', 'units_without_data' FROM (SELECT count(*) AS n, count(*) FILTER (total = 0 OR CAST(regexp_extract(id, '^u([0-9]+)', 1) AS BIGINT) % 4 <> 0) AS m FROM {x_cov}) WHERE 2 * m >= n
UNION ALL SELECT 'elsewhere', unnest(['no_file_matches', 'no_branch_records']) FROM (SELECT count(*) AS n FROM {c_lines}) WHERE n > 0"""),
    "diff_parse": sql("SELECT file, false AS whole_file, start_line, CASE WHEN end_line < start_line THEN start_line + 1 ELSE end_line END AS end_line FROM {d_changed}"),
    "changed_units": sql("SELECT id, file FROM {x_changed}"),
    "scope_closure": sql("SELECT id FROM {x_scope}"),
    "scoped_summary": sql(_summary("{x_scoped}", SCOPED)),
    "delegator_rows": sql(_code_rows + " WHERE metric = 'fan_out'"),
    "dispatcher_rows": sql(_code_rows + " WHERE metric = 'cyclomatic'"),
    "wide_signature_rows": sql(_code_rows + " WHERE metric = 'params'"),
    "hub_rows": sql(_code_rows + " WHERE metric = 'fan_in'"),
    "ignores_filtered": sql(_rows + " r WHERE metric IN ('lcom', 'methods_per_struct') AND NOT EXISTS (SELECT 1 FROM {x_ignored} i WHERE i.symbol = r.symbol AND i.metric = r.metric)"),
    "disabled_pruned": sql(_rows + " WHERE metric NOT IN ('cyclomatic', 'file_loc', 'duplication_pct')"),
    "metric_rows_all": sql(_rows.replace("{x_rows}", "{w_rows}")),
    "metric_rows_topk": sql(f"""
SELECT metric, symbol, value, bucket, row_number() OVER (ORDER BY {_place(SHOWN)}, severity DESC, collect_ord, dist_rank) AS shown_ord
FROM (SELECT * FROM {{w_rows}} ORDER BY severity DESC, collect_ord, dist_rank LIMIT 10)"""),
    "flagship_topk": sql(f"""
SELECT metric, symbol, value, bucket, row_number() OVER (ORDER BY {_place(SHOWN)}, severity DESC, collect_ord, dist_rank) AS shown_ord
FROM (SELECT * FROM {{x_code_rows}} ORDER BY severity DESC, collect_ord, dist_rank LIMIT 10)"""),
    "symbol_rows": sql("SELECT metric, symbol, value, bucket, severity FROM {x_scored} WHERE symbol = (SELECT max(id) FROM {a_methods})"),
    "symbol_values": sql(f"SELECT metric, value, {_bucket(_level())} AS bucket FROM {{x_looked}} WHERE id = (SELECT max(id) FROM {{a_methods}})"),
    "symbol_source": "SELECT 'doc' || doc_id AS file, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS source FROM documents WHERE len(string_split(text, chr(10))) >= 2",
    "ls_units": sql("SELECT id, kind, file, start_line, end_line FROM {x_units} WHERE kind = 'Struct' AND file = 'src/n7.rs'"),
    "json_entries": sql(f"SELECT d.id, d.value, {_bucket(_level('d.metric', 'd.value', '0'))} AS bucket, u.file, u.start_line, u.end_line FROM {{x_dist}} d LEFT JOIN {{x_units}} u USING (id) WHERE d.metric = 'methods_per_struct'"),
    "report_counters": sql("SELECT (SELECT count(*) FROM {x_units}) AS units, CAST(0 AS BIGINT) AS partial_units, (SELECT count(*) FROM {x_edges}) AS edges, (SELECT count(DISTINCT file) FROM {x_units}) AS files"),
    "structural_buckets": sql("SELECT name, value, CASE " + " ".join(f"WHEN name = '{n}' THEN {_bucket(_desc('value', CONFIG.thresholds[n]))}" for n in ("dag_density", "fan_in_max", "fan_in_mean", "fan_out_max", "fan_out_mean")) + """ END AS bucket FROM (
SELECT 'dag_density' AS name, (SELECT count(*) FROM {x_edges}) / ((SELECT count(*) FROM {x_units}) - 1) AS value
UNION ALL SELECT 'fan_in_max', max(fan_in) FROM {x_fan} UNION ALL SELECT 'fan_in_mean', avg(fan_in) FROM {x_fan} UNION ALL SELECT 'fan_out_max', max(fan_out) FROM {x_fan} UNION ALL SELECT 'fan_out_mean', avg(fan_out) FROM {x_fan})"""),
    "metric_catalog": catalog_sql(),
}
