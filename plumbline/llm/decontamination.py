"""Benchmark decontamination by winnowing.

The smallest k-gram hash of every sliding window is kept of test items and of
training texts. Both sides' fingerprints are tables that are joined; each hit is
extended to all windows of 13 words that hold it, and these are joined by a
128-bit hash of their words. A window of 13 words has one winnowing window of
its own, so no shared one is missed. Nothing of either side passes through the
driver: a benchmark may be as large as the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.ship import ship

from ._contents import content_hashes, keys_repeat, marked, spans_length, unused
from ._store import stored
from ._text import grams, mix, slices, sliding, words

#: Words of a window, and of a fingerprint's k-gram: WINDOW - GRAM + 1 k-grams make one winnowing window.
WINDOW, GRAM = 13, 6


def fingerprints(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are smallest in some winnowing window of one sequence of words; ties are all kept."""
    g = grams(h, gram)
    w = window - gram + 1
    if len(g) < w:
        return np.zeros(0, np.int64), g[:0]
    least = sliding(g, w)
    pad = np.zeros(w - 1, np.uint64)
    top = sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.flatnonzero(top == g)
    return at, g[at]


def _printer(lengths: list[int] | None):
    """Each text's content, words and fingerprints: for windows of these lengths, or, for test items, of its own (13 words, or all of a shorter item). A place is packed as 16 * position + length."""

    def run(batches):
        for batch in batches:
            for start, raw, off in slices(batch.column(1)):
                part = batch.slice(start, len(off) - 1)
                _, _, h, upto = words(raw, off)
                c = content_hashes(h, upto, raw, off)
                prints, places, n_prints = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [0]
                for i in range(len(off) - 1):
                    own, n_own = h[upto[i] : upto[i + 1]], 0
                    for n in [min(len(own), WINDOW)] if lengths is None else lengths:
                        if 0 < n <= len(own):
                            at, g = fingerprints(own, n, min(GRAM, n))
                            prints.append(mix(g + np.uint64(n)))
                            places.append(at * 16 + n)
                            n_own += len(at)
                    n_prints.append(n_own)
                cuts = pa.array(np.cumsum(n_prints).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (np.concatenate(prints).view(np.int64), np.concatenate(places))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in c], pa.binary()), pa.array(np.diff(upto)), *lists], names=["d", "c", "n_words", "prints", "places"])

    return run


def _prints(rows: DataFrame, lengths: list[int] | None) -> DataFrame:
    """`rows` (d, text) to (d, c, n_words, prints, places), stored."""
    return stored(rows.mapInArrow(_printer(lengths), f"d {rows.schema['d'].dataType.simpleString()}, c binary, n_words long, prints array<long>, places array<long>"))


def _spots(made: DataFrame) -> DataFrame:
    return made.select("c", F.inline(F.arrays_zip("prints", "places"))).withColumnsRenamed({"prints": "print", "places": "place"})


def _texts(batches):
    for batch in batches:
        for start, raw, off in slices(batch.column(0)):
            _, _, h, upto = words(raw, off)
            c = content_hashes(h, upto, raw, off)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in c], pa.binary()), batch.column(0).slice(start, len(off) - 1)], names=["c", "text"])


def _extended(batches):
    """All windows that hold a hit: their first word, length and 128-bit hash."""
    for batch in batches:
        names = batch.schema.names
        c, places = (batch.column(names.index(x)) for x in ("c", "places"))
        for start, raw, off in slices(batch.column(names.index("text"))):
            _, _, h, upto = words(raw, off)
            out = []
            for i in range(len(off) - 1):
                own = h[upto[i] : upto[i + 1]]
                place = places[start + i].values.to_numpy()
                for n in np.unique(place % 16).tolist():
                    at = place[place % 16 == n] // 16
                    reach = n - min(GRAM, n)
                    first = np.unique(np.add.outer(at, -np.arange(reach + 1)))
                    first = first[(first >= 0) & (first <= len(own) - n)]
                    both = [mix(grams(x, n)[first] + np.uint64(n)).view(np.int64) for x in (own, mix(own ^ np.uint64(0xA0761D6478BD642F)))]
                    out.append((np.full(len(first), start + i), first, np.full(len(first), n), *both))
            if out:
                row, first, n, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([c.take(pa.array(row)), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(a), pa.array(b)], names=["c", "first", "n", "w1", "w2"])


def _windows(rows: DataFrame, made: DataFrame, found: DataFrame) -> DataFrame:
    """(c, first, n, w1, w2): the windows of each content in `made` (of `rows`: d, text) that hold one of its `found` (c, place) fingerprints."""
    places = stored(found.groupBy("c").agg(F.collect_set("place").alias("places")))
    one = places.select("c").join(made.groupBy("c").agg(F.min("d").alias("_one")), "c").select("_one").distinct()
    texts = rows.join(one, rows["d"].eqNullSafe(one["_one"]), "left_semi").select("text").mapInArrow(_texts, "c binary, text string")
    return stored(texts.join(places, "c").mapInArrow(_extended, "c binary, first int, n int, w1 long, w2 long").distinct())


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(d, c, n_words, n_hit, items, unnamed) for each row of `docs`, given (d, text) of documents and of test items."""
    tests = _prints(items, None)
    lengths = sorted(r[0] for r in tests.select(F.least("n_words", F.lit(WINDOW))).distinct().collect() if r[0])  # WINDOW values at most
    made = _prints(docs, lengths)
    asked = stored(_spots(tests))
    # as small as the benchmark: Spark broadcasts it if its size is under the threshold, and sorts and merges otherwise
    hits = stored(_spots(made).join(asked.select("print").distinct(), "print"))
    theirs = _windows(items, tests, asked.join(hits.select("print").distinct(), "print").select("c", "place"))
    ours = _windows(docs, made, hits.select("c", "place"))

    windows = ["w1", "w2"]
    ours = stored(ours.join(theirs.select(*windows).distinct(), windows, "left_semi"))
    n_hit = ours.groupBy("c").agg(spans_length(F.collect_set(F.col("first").cast("long") * (1 << 31) + F.col("first") + F.col("n"))).alias("n_hit"))
    # windows that the same items hold are one class: a document that repeats an item meets it once
    owner = theirs.select(*windows, F.col("c").alias("i")).distinct()
    kind = ["a", "b", "k"]
    classes = stored(owner.groupBy(*windows).agg(F.bit_xor(F.xxhash64("i")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "i")).alias("b"), F.count("*").alias("k")))
    named = tests.select(F.col("c").alias("i"), F.col("d").alias("item")).distinct()
    held = classes.groupBy(*kind).agg(F.min(F.struct(*windows)).alias("w")).select(*kind, "w.*").join(owner, windows).join(named, "i").select(*kind, "item").distinct()
    per = ours.join(classes, windows).select("c", *kind).distinct().join(held, kind)
    listed = per.groupBy("c").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("int")).alias("unnamed"))
    result = stored(n_hit.join(listed, "c"))
    none = F.array().cast("array<string>")
    return made.select("d", "c", "n_words").join(result, "c", "left").select("d", "c", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("unnamed", F.lit(0)).alias("unnamed"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of `docs`: its key, n_words, n_hit (words in an occurrence of a window of an item), items (ids, as strings, sorted) and n_items; no other columns.

    Keys may be of any type, null or repeated. Null or empty texts have no
    words; items without words match nothing. Repeated items count by id; items
    without an id hit words and count as one item, which is not listed. Very
    long texts and ties between fingerprints lose nothing. No rows give no rows;
    with no items nothing is hit.
    """
    ship(docs.sparkSession)
    found = _found(*_sides(docs, benchmark, key, text, item_key, item_text))
    return found.select(F.col("d").alias(key), "n_words", "n_hit", "items", (F.size("items") + F.col("unnamed")).cast("long").alias("n_items"))


def _sides(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    return docs.select(F.col(key).alias("d"), F.col(text).alias("text")), benchmark.select(F.col(item_key).cast("string").alias("d"), F.col(item_text).alias("text"))


def judged(found: DataFrame) -> DataFrame:
    """Contaminated: hit at all, and in a twentieth of its words or more."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that are not contaminated, as they are. A row is known by its key, or, where keys repeat or are null, by key and content."""
    ship(docs.sparkSession)
    found = stored(judged(_found(*_sides(docs, benchmark, key, text, item_key, item_text))).select("d", "c", "contaminated"))
    bad = found.where("contaminated").select(F.col("d").alias("_d"), F.col("c").alias("_c")).distinct()
    if not keys_repeat(found):
        return docs.join(bad, docs[key] == bad["_d"], "left_anti")
    content = unused(docs, "_c1")
    rows = marked(docs, text, content)
    return rows.join(bad, rows[key].eqNullSafe(bad["_d"]) & (rows[content] == bad["_c"]), "left_anti").drop(content)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return judged(find_contamination(docs, items)).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dg AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) AS l WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN bw ON dg.n = bw.n AND dg.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
