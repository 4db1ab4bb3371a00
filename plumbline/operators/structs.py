"""Methods of structs and their cohesion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.names import simple_name
from plumbline.store import stored

from .components import components

#: Structs of so many methods at most are folded within a row; larger ones are grouped by joins.
FOLD = 512


def methods_per_struct(units: DataFrame) -> DataFrame:
    """Methods of each struct, and of each parent that is no struct unit; structs without methods count 0."""
    rows = units.where("kind = 'Struct'").select("id", F.lit(0).alias("n")).unionAll(units.where("kind = 'Method' and parent is not null").select("parent", F.lit(1)))
    return rows.groupBy("id").agg(F.sum("n").alias("value")).select(F.lit("methods_per_struct").alias("metric"), "id", "value")


def method_links(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parent, i): methods numbered within their parent; and (parent, a, b): those that share a field or call each other by simple name."""
    m = units.where("kind = 'Method' and parent is not null").select("parent", "id", "unit_ord", "reads", "writes", "calls")
    m = m.withColumn("i", F.row_number().over(W.partitionBy("parent").orderBy("unit_ord", "id")) - 1)
    fields = m.select("parent", "i", F.explode(F.concat("reads", "writes")).alias("field"))
    shared = fields.withColumn("a", F.min("i").over(W.partitionBy("parent", "field"))).select("parent", "a", F.col("i").alias("b")).where("a <> b")
    names = m.groupBy("parent", simple_name(F.col("id")).alias("name")).agg(F.max("i").alias("a"))
    called = m.select("parent", F.col("i").alias("b"), F.explode("calls").alias("call")).withColumn("name", simple_name(F.col("call")))
    calls = called.join(names, ["parent", "name"]).select("parent", "a", "b").where("a <> b")
    return m.select("parent", "i"), shared.unionAll(calls).distinct()


def lcom4(units: DataFrame, fold: int = FOLD) -> DataFrame:
    """Connected groups of the methods of each parent; parents without methods have no row. Structs of more than `fold` methods are grouped by joins."""
    methods, links = method_links(units)
    methods, links = stored(methods), stored(links)
    sizes = methods.groupBy("parent").agg(F.count("*").cast("int").alias("n"))
    small, large = sizes.where(F.col("n") <= fold), sizes.where(F.col("n") > fold)
    # links of large structs never meet in one row
    near = links.join(large.select("parent"), "parent", "left_anti")
    grouped = near.groupBy("parent").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))).alias("links"))
    small = small.join(grouped, "parent", "left")
    label = F.aggregate(
        F.coalesce("links", F.array().cast("array<struct<a:int,b:int>>")),
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda acc, e: F.transform(acc, lambda x: F.when(x == F.element_at(acc, e["a"] + 1), F.element_at(acc, e["b"] + 1)).otherwise(x)),
    )
    out = small.select(F.col("parent").alias("id"), F.size(F.array_distinct(label)).cast("bigint").alias("value"))
    if not large.isEmpty():
        out = out.unionAll(_in_stars(large, links.join(large.select("parent"), "parent", "left_semi")))
    return out.select(F.lit("lcom").alias("metric"), "id", "value")


def _in_stars(sizes: DataFrame, links: DataFrame) -> DataFrame:
    """Groups of large structs: their methods less those that hang on another one."""
    node = lambda i: F.struct("parent", F.col(i).alias("i"))
    hung = components(links.select(node("a").alias("a"), node("b").alias("b"))).groupBy(F.col("node.parent").alias("parent")).agg(F.count("*").alias("hung"))
    return sizes.join(hung, "parent", "left").select(F.col("parent").alias("id"), (F.col("n") - F.coalesce("hung", F.lit(0))).cast("bigint").alias("value"))
