"""Resolution of call strings to unit ids.

A call is an id as it stands, else one of the caller's file, else a name of the
index, else the method after its last dot, else its path without the first
part. Names of the index have candidates; one in the caller's file comes before
one in its crate, and that before any other; among equals the first loaded.

The index is reduced to its first candidate for each name, for each name and
crate and for each name and file before any call meets it, so that a name with
many candidates and many callers costs no more than the sum of both.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.names import crate_of, local_name, short_name
from plumbline.store import stored


def name_index(units: DataFrame) -> DataFrame:
    """(key, id, unit_ord, key_ord). The short name of a nested unit stands twice, which makes it ambiguous as the tail of a path."""
    short = short_name("id")
    keys = F.array(F.col("id"), local_name("id"), short, F.when(short != "", short))
    return units.select("id", "unit_ord", F.posexplode(keys).alias("key_ord", "key")).where("key is not null").select("key", "id", "unit_ord", "key_ord")


def _first(by: list[str], rows: DataFrame) -> DataFrame:
    return rows.groupBy(*by).agg(F.min_by("id", F.struct("unit_ord", "key_ord")).alias("first"), F.count("*").alias("entries"))


def in_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows with each file whose path begins their id. Ids are cut at the lengths that paths have, of which there are few."""
    lengths = sorted(r[0] for r in files.select(F.length("file")).distinct().collect() if r[0])
    if not lengths:
        return index.withColumn("file", F.lit(None).cast("string")).limit(0)
    ids = index.select("id").distinct()
    cut = ids.select("id", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.col("n") <= F.length("id")).select("id", F.substr("id", F.lit(1), F.col("n")).alias("file"))
    pairs = cut.join(files.select("file").distinct(), "file", "left_semi")
    return index.join(pairs, "id")


def method_key() -> Column:
    return F.when(F.instr("call", ".") > 0, F.substring_index("call", ".", -1))


def path_key() -> Column:
    return local_name("call")


def exact_calls(calls: DataFrame, units: DataFrame) -> DataFrame:
    """Calls with a column exact: the id that they are, or null."""
    asked = calls.select("call").distinct()
    ids = units.select(F.col("id").alias("exact")).join(asked, F.col("exact") == F.col("call"), "left_semi").distinct()
    return calls.join(ids, F.col("call") == F.col("exact"), "left")


def same_file_calls(calls: DataFrame, units: DataFrame) -> DataFrame:
    asked = calls.select(F.concat("file", F.lit("::"), "call").alias("_asked")).distinct()
    ids = units.select(F.col("id").alias("same_file")).join(asked, F.col("same_file") == F.col("_asked"), "left_semi").distinct()
    return calls.join(ids, F.concat("file", F.lit("::"), "call") == F.col("same_file"), "left")


class Reduced(NamedTuple):
    """First candidates of the index by name and file, by name and crate, and by name."""

    by_file: DataFrame
    by_crate: DataFrame
    by_key: DataFrame


def reduced(index: DataFrame, calls: DataFrame) -> Reduced:
    """Written once: both kinds of names are picked from it."""
    index = stored(index.withColumn("crate", crate_of("id")))
    by_file = _first(["key", "file"], in_files(index, calls.select("file"))).select(F.col("key").alias("_kf"), F.col("file").alias("_f"), F.col("first").alias("_in_file"))
    by_crate = _first(["key", "crate"], index).select(F.col("key").alias("_kc"), F.col("crate").alias("_c"), F.col("first").alias("_in_crate"), F.col("entries").alias("_in_crate_n"))
    by_key = _first(["key"], index).select(F.col("key").alias("_ka"), F.col("first").alias("_any"))
    return Reduced(stored(by_file), stored(by_crate), stored(by_key))


def pick(calls: DataFrame, index: DataFrame | Reduced, key: Column, name: str) -> DataFrame:
    """Adds the best candidate for a key: of the caller's file, of its crate, or any."""
    index = index if isinstance(index, Reduced) else reduced(index, calls)
    return (
        calls.withColumn("_key", key)
        .join(index.by_file, (F.col("_key") == F.col("_kf")) & (F.col("file") == F.col("_f")), "left")
        .join(index.by_crate.drop("_in_crate_n"), (F.col("_key") == F.col("_kc")) & (F.col("crate") == F.col("_c")), "left")
        .join(index.by_key, F.col("_key") == F.col("_ka"), "left")
        .withColumn(name, F.coalesce("_in_file", "_in_crate", "_any"))
        .drop("_key", "_kf", "_f", "_in_file", "_kc", "_c", "_in_crate", "_ka", "_any")
    )


def path_calls(calls: DataFrame, index: DataFrame | Reduced) -> DataFrame:
    """Adds by_path: the only index entry of the caller's crate for the call without its first part."""
    index = index if isinstance(index, Reduced) else reduced(index, calls)
    only = index.by_crate.where("_in_crate_n = 1").select(F.col("_kc").alias("_k"), "_c", F.col("_in_crate").alias("by_path"))
    return calls.withColumn("_key", path_key()).join(only, (F.col("_key") == F.col("_k")) & (F.col("crate") == F.col("_c")), "left").drop("_key", "_k", "_c")


def unit_calls(units: DataFrame) -> DataFrame:
    """(id, file, call): the calls of all units, as often as they stand."""
    return units.select("id", "file", F.explode("calls").alias("call"))


def asked_for(index: DataFrame, calls: DataFrame) -> DataFrame:
    """Index rows with a name that some call may go by. There are far fewer of these names than units."""
    keys = calls.select(F.explode(F.array(F.col("call"), method_key(), path_key())).alias("key")).where("key is not null").distinct()
    return index.join(stored(keys), "key", "left_semi")


def resolve(calls: DataFrame, units: DataFrame) -> DataFrame:
    """calls (id, file, call) with target and how it was found (exact, same_file, name, method, path; null: not).

    Equal calls of one file and crate are resolved once; only those that are no
    id reach the index, and only names that these ask for are in it.
    """
    calls = stored(calls.withColumn("crate", crate_of("id")))
    asked = stored(exact_calls(stored(calls.select("call", "file", "crate").distinct()), units))
    rest = asked.where("exact is null").drop("exact")
    index = reduced(asked_for(name_index(units), rest), rest)
    found = same_file_calls(rest, units)
    found = pick(found, index, F.col("call"), "by_name")
    found = pick(found, index, method_key(), "by_method")
    found = path_calls(found, index)
    order = {"same_file": "same_file", "by_name": "name", "by_method": "method", "by_path": "path"}
    how = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in order.items()])
    heuristic = found.select("call", "file", "crate", F.coalesce(*order).alias("target"), how.alias("how"))
    exact = asked.where("exact is not null").select("call", "file", "crate", F.col("exact").alias("target"), F.lit("exact").alias("how"))
    return calls.join(exact.unionByName(heuristic), ["call", "file", "crate"])


def edges(calls: DataFrame, units: DataFrame) -> DataFrame:
    """One edge for each call that resolves to another unit; two spellings of one target are two edges."""
    found = resolve(calls, units).where("target is not null and target <> id")
    return found.select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit("Calls").alias("kind"))


def merge(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Bag union of two graphs (units, edges)."""
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])
