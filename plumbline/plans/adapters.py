"""The driver's tables as units, calls, tokens, coverage and changes.

The SQL is the same text for Spark and DuckDB; tables stand in braces.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.store import stored

METHODS = """
SELECT concat('crate', c_nationkey, '::cust::C', c_custkey, '::O', o_orderkey) AS id,
       concat('crate', c_nationkey, '::cust::C', c_custkey) AS parent,
       concat('src/n', c_nationkey, '.rs') AS file,
       CAST(n AS BIGINT) AS params, CAST(br AS BIGINT) AS branches,
       CAST(cog AS BIGINT) AS cognitive_complexity, CAST(ms AS BIGINT) AS max_scope_lines,
       CAST(1 + coalesce(sum(sz) OVER w, 0) AS BIGINT) AS start_line,
       CAST(sz + coalesce(sum(sz) OVER w, 0) AS BIGINT) AS end_line,
       o_orderkey AS unit_key
FROM {orders}
JOIN {customer} ON o_custkey = c_custkey
JOIN (SELECT l_orderkey, count(*) AS n, sum(l_linenumber) AS br,
             sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS cog,
             CAST(max(l_quantity) AS BIGINT) AS ms, CAST(sum(l_quantity) AS BIGINT) AS sz
      FROM {lineitem} GROUP BY l_orderkey) li ON l_orderkey = o_orderkey
WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
STRUCTS = "SELECT parent AS id, file, min(start_line) AS start_line, max(end_line) AS end_line FROM {a_methods} GROUP BY parent, file"
FUNCTIONS = """
SELECT concat('crate', p_partkey % 25, CASE WHEN p_partkey < 10025 THEN '::util::P' ELSE concat('::util', CAST(floor(p_partkey / 10025) AS BIGINT), '::P') END, p_partkey % 401) AS id,
       concat('src/util', p_partkey % 25, '.rs') AS file, p_partkey AS unit_key
FROM {part}
UNION ALL
SELECT concat('src/n', n_nationkey, '.rs::P', n_nationkey * 7), concat('src/n', n_nationkey, '.rs'),
       CAST(1000000 + n_nationkey AS BIGINT) FROM {nation}
"""
CALLS = """
SELECT DISTINCT m.id AS id, m.file AS file,
       CASE l_linenumber % 4
         WHEN 0 THEN concat('P', l_partkey % 401)
         WHEN 1 THEN concat('util::P', l_partkey % 401)
         WHEN 2 THEN concat('crate', (l_partkey + l_suppkey % 2) % 25, '::util::P', l_partkey % 401)
         ELSE concat('obj.P', l_partkey % 401) END AS call
FROM {a_methods} m JOIN {lineitem} ON l_orderkey = m.unit_key
UNION
SELECT f.id, f.file, concat('P', (f.unit_key * 7 + j.n_nationkey) % 401) FROM {a_functions} f CROSS JOIN {nation} j WHERE j.n_nationkey < 4 AND f.unit_key < 1000000
"""
#: Every third method calls the one before it of the same parent.
SIBLINGS = """
SELECT id, parent, concat('self.O', before) AS call, before
FROM (SELECT id, parent, unit_key, lag(unit_key) OVER (PARTITION BY parent ORDER BY unit_key) AS before FROM {a_methods}) s
WHERE before IS NOT NULL AND unit_key % 3 = 0
"""
FIELDS = """
SELECT DISTINCT m.id AS id, m.parent AS parent, concat('f', l_suppkey % 40) AS field,
       CASE WHEN l_returnflag = 'N' THEN 'write' ELSE 'read' END AS access
FROM {a_methods} m JOIN {lineitem} ON l_orderkey = m.unit_key
"""
NESTED = """
SELECT concat('u', user_id) AS id, concat('src/u', user_id, '.rs') AS file, CAST(1 AS BIGINT) AS start_line, CAST(720 AS BIGINT) AS end_line
FROM (SELECT DISTINCT user_id FROM {events}) u
UNION ALL
SELECT concat('u', user_id, '::d', d), concat('src/u', user_id, '.rs'), CAST(d * 24 + 1 AS BIGINT), CAST(d * 24 + 24 AS BIGINT)
FROM (SELECT DISTINCT user_id, CAST(day(ts) - 1 AS BIGINT) AS d FROM {events} WHERE day(ts) % 2 = 0) x
UNION ALL
SELECT concat('u', user_id, '::d', d, '::shift'), concat('src/u', user_id, '.rs'), CAST(d * 24 + 9 AS BIGINT), CAST(d * 24 + 17 AS BIGINT)
FROM (SELECT DISTINCT user_id, CAST(day(ts) - 1 AS BIGINT) AS d FROM {events} WHERE day(ts) % 4 = 0) y
"""
LINES = """
SELECT concat('src/u', user_id, '.rs') AS file, CAST((day(ts) - 1) * 24 + hour(ts) + 1 AS BIGINT) AS line,
       CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS hits
FROM {events} GROUP BY 1, 2
"""
BRANCHES = """
SELECT concat('src/u', user_id, '.rs') AS file, CAST((day(ts) - 1) * 24 + hour(ts) + 1 AS BIGINT) AS line,
       CAST(CASE WHEN event_type = 'signup' THEN floor(value) ELSE 0 END AS BIGINT) AS taken
FROM {events} WHERE event_type IN ('signup', 'error')
"""
CHANGED = """
SELECT m.file AS file, m.start_line + 1 AS start_line, least(m.start_line + 3, m.end_line) AS end_line
FROM {a_methods} m JOIN {orders} ON o_orderkey = m.unit_key
WHERE o_orderdate >= TIMESTAMP '1998-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-10-15 00:00:00'
"""
#: Words of letters, digits and underscores, and other characters one by one.
TOKEN = r"([A-Za-z0-9_]+|[^A-Za-z0-9_\s])"
#: For DuckDB: each adapter in terms of the tables and of the adapters before it.
DUCK_TOKENS = r"""
SELECT concat('doc', doc_id) AS file, row_number() OVER (PARTITION BY doc_id ORDER BY line, col) - 1 AS pos, value, line, col
FROM (SELECT doc_id, line, unnest(v) AS value, unnest(range(len(v))) AS col
      FROM (SELECT doc_id, line, regexp_extract_all(t, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]') AS v
            FROM (SELECT doc_id, unnest(s) AS t, unnest(range(1, len(s) + 1)) AS line
                  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {documents}))))
"""
DUCK = {"a_methods": METHODS, "a_structs": STRUCTS, "a_functions": FUNCTIONS, "a_calls": CALLS, "a_siblings": SIBLINGS, "a_fields": FIELDS, "c_units": NESTED, "c_lines": LINES, "c_branches": BRANCHES, "d_changed": CHANGED, "b_tokens": DUCK_TOKENS}


class Tables:
    """Adapters over the tables of a folder; each is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        for name in ("orders", "customer", "lineitem", "part", "nation", "events"):
            if "{" + name + "}" in text:
                frames[name] = self.table(name)
        return self.spark.sql(text, **frames)

    @cached_property
    def methods(self) -> DataFrame:
        return self.sql(METHODS)

    @cached_property
    def structs(self) -> DataFrame:
        return self.sql(STRUCTS, a_methods=self.methods)

    @cached_property
    def functions(self) -> DataFrame:
        return self.sql(FUNCTIONS)

    @cached_property
    def calls(self) -> DataFrame:
        return self.sql(CALLS, a_methods=self.methods, a_functions=self.functions)

    @cached_property
    def siblings(self) -> DataFrame:
        return self.sql(SIBLINGS, a_methods=self.methods)

    @cached_property
    def fields(self) -> DataFrame:
        return self.sql(FIELDS, a_methods=self.methods)

    @cached_property
    def code(self) -> DataFrame:
        """Methods, structs and functions as units, in the order of loading: methods and functions by key, structs after; calls and fields are left out."""
        zero = F.lit(0).cast("bigint")
        m = self.methods.select(F.col("unit_key").alias("unit_ord"), "id", F.lit("Method").alias("kind"), "file", "start_line", "end_line", "params", "branches", "cognitive_complexity", "max_scope_lines", "parent")
        f = self.functions.select((F.lit(1 << 40) + F.col("unit_key")).alias("unit_ord"), "id", F.lit("Function").alias("kind"), "file", F.lit(1).cast("bigint").alias("start_line"), F.lit(1).cast("bigint").alias("end_line"), zero.alias("params"), zero.alias("branches"), zero.alias("cognitive_complexity"), zero.alias("max_scope_lines"), F.lit(None).cast("string").alias("parent"))
        s = self.structs.select(F.lit(1 << 41).alias("unit_ord"), "id", F.lit("Struct").alias("kind"), "file", "start_line", "end_line", zero.alias("params"), zero.alias("branches"), zero.alias("cognitive_complexity"), zero.alias("max_scope_lines"), F.substring_index("id", "::", 1).alias("parent"))
        return m.unionByName(f).unionByName(s)

    @cached_property
    def cohesion(self) -> DataFrame:
        """Methods with their reads, writes and sibling calls."""
        none = F.array().cast("array<string>")
        per = self.fields.groupBy("id", "parent").agg(F.collect_list(F.when(F.col("access") == "read", F.col("field"))).alias("reads"), F.collect_list(F.when(F.col("access") == "write", F.col("field"))).alias("writes"))
        m = self.methods.select("id", "parent", F.col("unit_key").alias("unit_ord"), F.lit("Method").alias("kind"))
        called = self.siblings.select("id", F.array("call").alias("calls"))
        return m.join(per, ["id", "parent"], "left").join(called, "id", "left").withColumns({"reads": F.coalesce("reads", none), "writes": F.coalesce("writes", none), "calls": F.coalesce("calls", none)})

    @cached_property
    def tokens(self) -> DataFrame:
        lines = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "t"))
        toks = lines.select("doc_id", (F.col("l") + 1).cast("bigint").alias("line"), F.posexplode(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(1))).alias("col", "value"))
        from pyspark.sql import Window as W

        return toks.select(F.concat(F.lit("doc"), "doc_id").alias("file"), (F.row_number().over(W.partitionBy("doc_id").orderBy("line", "col")) - 1).cast("bigint").alias("pos"), "value", "line", F.col("col").cast("bigint").alias("col"))

    @cached_property
    def sequences(self) -> DataFrame:
        """The tokens as clones are looked for in: (file, h, l), made of whole texts, without an exchange of tokens; only texts that share a doc_id meet."""
        docs = self.table("documents").where("doc_id is not null and text is not null").select(F.concat(F.lit("doc"), "doc_id").alias("file"), "text")
        several = stored(docs.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select("file"))
        lines = F.transform(F.split("text", "\n"), lambda t, i: F.transform(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(1)), lambda v, j: F.struct((i + 1).cast("bigint").alias("line"), j.alias("col"), F.hash(v).alias("h"))))
        alone = docs.join(several, "file", "left_anti") if not several.isEmpty() else docs
        out = alone.select("file", F.flatten(lines).alias("t"))
        if alone is not docs:
            out = out.unionAll(docs.join(several, "file").groupBy("file").agg(F.array_sort(F.flatten(F.collect_list(F.flatten(lines)))).alias("t")))
        return out.select("file", F.col("t.h").alias("h"), F.col("t.line").alias("l"))

    @cached_property
    def blocks(self) -> DataFrame:
        """Units of the documents: each as a whole, every other five lines of it, and a module that nothing is counted for."""
        from plumbline.operators.duplication import whole_files

        whole = whole_files(self.tokens)
        block = F.floor((F.col("line") - 1) / 5)
        parts = self.tokens.select("file", block.alias("k")).distinct().where("k % 2 = 0")
        parts = parts.select(F.concat("file", F.lit("::b"), "k").alias("id"), "file", (F.col("k") * 5 + 1).alias("start_line"), (F.col("k") * 5 + 5).alias("end_line"), F.lit("Function").alias("kind"))
        modules = whole.select(F.concat("file", F.lit("::mod")).alias("id"), "file", F.col("start_line") + 1, "end_line", F.lit("Module").alias("kind"))
        return whole.unionByName(parts).unionAll(modules)

    @cached_property
    def nested(self) -> DataFrame:
        return self.sql(NESTED).withColumn("kind", F.lit("Function"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.sql(LINES)

    @cached_property
    def branches(self) -> DataFrame:
        return self.sql(BRANCHES)

    @cached_property
    def changed(self) -> DataFrame:
        return self.sql(CHANGED, a_methods=self.methods).withColumn("whole_file", F.lit(False))


