"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.ship import ship

from ._components import components
from ._contents import content_hashes, keys_repeat, marked, unused
from ._store import stored
from ._text import ALNUM, grams, mix, slices, words

#: Words of a shingle, and the least weighted Jaccard similarity of near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of samples: a pair at 0.8 shares one of the twelve with probability 0.998.
BANDS, ROWS = 12, 4
#: A shingle is frequent if it makes up one in FREQUENT of all pairs of a document and a shingle, so there are FREQUENT at most; their document frequency is exact, rarer ones count as this frequent. CLASSES of hashes, summed first, tell which may be frequent, SEGMENT of them in a row.
FREQUENT, CLASSES, SEGMENT = 1 << 18, 1 << 20, 1 << 12
#: Leaders of a bucket in each round, and bytes of shingles of a block of what is left.
LEADERS, BLOCK = (1, 4), 4_000_000
_BITS = np.uint64(47)


def shingle_sets(h: np.ndarray, upto: np.ndarray, raw: np.ndarray, off: np.ndarray):
    """Distinct shingles of each document of a slice: (document, 32-bit hash, count), ordered by document and hash; a document with fewer words than a shingle has one, of all its words."""
    n = len(upto) - 1
    long = grams(h, SHINGLE)
    doc = np.repeat(np.arange(n), np.diff(upto))
    ok = doc[: len(long)] == doc[SHINGLE - 1 :] if len(long) else np.zeros(0, bool)
    keys, docs = [long[ok]], [doc[: len(long)][ok]]
    for i in np.flatnonzero((np.diff(upto) > 0) & (np.diff(upto) < SHINGLE)):
        keys.append(grams(h[upto[i] : upto[i + 1]], int(upto[i + 1] - upto[i])))
        docs.append(np.array([i]))
    key = (np.concatenate(docs).astype(np.uint64) << _BITS) | (np.concatenate(keys) & np.uint64(0xFFFFFFFF))
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> _BITS).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), tf


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal parts, by bisection of 1 - (1 + x) exp(-x)."""
    at, lo, hi = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        x = (lo + hi) / 2
        below = 1 - (1 + x) * np.exp(-x) < at
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return x


class Sampler:
    """Improved consistent weighted sampling.

    The random numbers of a shingle in each sample come from a 64-bit hash of
    both: r and c of Gamma(2, 1), c from two exponential numbers, and beta,
    uniform. A document's sample is the shingle of the least a and its step.
    """

    def __init__(self):
        parts = 1 << 16
        r = _gamma_quantiles(parts)
        self.r, self.inverse = r.astype(np.float32), (1 / r).astype(np.float32)
        self.exponential = -np.log((np.arange(parts) + 0.5) / parts).astype(np.float32)
        self.times = np.random.default_rng(20240607).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, shingle: np.ndarray, log_weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A hash for each document and band."""
        x = mix(shingle.astype(np.uint64) + np.uint64(0x1234567))
        name = x.astype(np.uint32)
        samples = np.empty((len(starts), BANDS * ROWS), np.uint32)
        # the bits of a, which is positive, in the upper half, shingle and step in the lower
        best = np.empty((len(x), 2), np.uint32)
        for k, m in enumerate(self.times):
            z = x * m
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xD6E8FEB86659FD93)
            field = z.view(np.uint16).reshape(-1, 4)
            i = field[:, 3]
            r, beta = self.r[i], field[:, 2].astype(np.float32)
            beta *= np.float32(1 / 65536)
            step = self.inverse[i]
            step *= log_weight
            step += beta
            np.floor(step, out=step)
            np.multiply(step.astype(np.int32).view(np.uint32), np.uint32(0x9E3779B1), out=best[:, 0])
            best[:, 0] += name
            step -= beta
            step += np.float32(1)
            step *= -r
            a = np.exp(step, out=step)
            a *= self.exponential[field[:, 1]] + self.exponential[field[:, 0]]
            best[:, 1] = a.view(np.uint32)
            samples[:, k] = np.minimum.reduceat(best.view(np.uint64)[:, 0], starts) & np.uint64(0xFFFFFFFF)
        out = np.empty((len(starts), BANDS), np.uint64)
        for b in range(BANDS):
            acc = np.full(len(starts), b + 1, np.uint64)
            for j in range(ROWS):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * ROWS + j])
            out[:, b] = acc
        return out.view(np.int64)


class Idf:
    """Damped IDF of shingles: 1 + ln((N + 1) / (df + 1)) / ln(FREQUENT), 1 at least.

    Damping keeps shingles of large groups of copies within a factor of about
    two of the others, so that an edit in a copy weighs no more there. `floor`
    is the least document frequency of a frequent shingle; at 1, and up to it
    in small tables, every frequency is exact.
    """

    def __init__(self, keys: np.ndarray, df: np.ndarray, n: int, floor: int):
        self.keys = keys
        weigh = lambda f: np.maximum(1, 1 + np.log((n + 1) / (f + 1)) / math.log(FREQUENT)).astype(np.float32)
        self.weights, self.rare = weigh(df), weigh(np.array(float(floor)))
        self.live = np.zeros(CLASSES, bool)
        self.live[keys & np.uint32(CLASSES - 1)] = True

    def of(self, shingle: np.ndarray) -> np.ndarray:
        out = np.full(len(shingle), self.rare, np.float32)
        at = np.flatnonzero(self.live[shingle & np.uint32(CLASSES - 1)])
        if len(at):
            own = shingle[at]
            k = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            same = self.keys[k] == own
            out[at[same]] = self.weights[k[same]]
        return out


def _sets(batches):
    """The number of documents and the distinct shingles of each, slice by slice."""
    for batch in batches:
        for _, raw, off in slices(batch.column(0)):
            _, _, h, upto = words(raw, off, ALNUM)
            yield len(off) - 1, shingle_sets(h, upto, raw, off)[1]


def _count_classes(batches):
    from pyspark import TaskContext

    df, n = np.zeros(CLASSES, np.uint32), 0
    for rows, shingles in _sets(batches):
        n += rows
        df += np.bincount(shingles & np.uint32(CLASSES - 1), minlength=CLASSES).astype(np.uint32)
    if n:
        parts = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in df.reshape(-1, SEGMENT)]
        k = TaskContext.get().partitionId() // 256
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([k] * len(parts), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([4] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["segment", "part", "n", "width", "df"])


def _add_classes(table: pa.Table) -> pa.Table:
    df = np.zeros(SEGMENT, np.uint64)
    for width, x in zip(table["width"].to_pylist(), table["df"], strict=True):
        df += np.frombuffer(pa.decompress(x.as_py(), width * SEGMENT, codec="zstd", asbytes=True), f"<u{width}")
    return pa.table({"segment": table["segment"].slice(0, 1), "part": pa.array([0], pa.int32()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "width": pa.array([8], pa.int32()), "df": pa.array([pa.compress(df.tobytes(), codec="zstd", asbytes=True)], pa.binary())})


def document_frequencies(docs: DataFrame, text: str) -> Idf:
    """Weights of the shingles of all documents; FREQUENT shingles and CLASSES sums at most come to the driver."""
    docs = docs.select(text)
    kind = "segment int, part int, n long, width int, df binary"
    # in two steps, so that no group is larger than some thousand rows
    sums = docs.mapInArrow(_count_classes, kind).groupBy("segment", "part").applyInArrow(_add_classes, kind).groupBy("segment").applyInArrow(_add_classes, kind)
    df, n = np.zeros(CLASSES, np.uint64), 0
    for r in sums.collect():
        n = r["n"]
        df[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(pa.decompress(r["df"], 8 * SEGMENT, codec="zstd", asbytes=True), np.uint64)
    floor = max(1, math.ceil(int(df.sum()) / FREQUENT))
    live = docs.sparkSession.sparkContext.broadcast(np.packbits(df >= floor))

    def count(batches):
        may, found, size = np.unpackbits(live.value).astype(bool), [], 0
        for _, shingles in _sets(batches):
            found.append(np.unique(shingles[may[shingles & np.uint32(CLASSES - 1)]], return_counts=True))
            size += len(found[-1][0])
            if size > 1_000_000:
                yield _summed(found)
                found, size = [], 0
        if size:
            yield _summed(found)

    rows = docs.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).toArrow().sort_by("shingle")
    return Idf(rows["shingle"].to_numpy().astype(np.uint32), rows["n"].to_numpy().astype(float), n, floor)


def _summed(found: list) -> pa.RecordBatch:
    keys, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    n = np.bincount(where, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n)], names=["shingle", "n"])


def weighted_jaccard(a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray, idf: Idf) -> float:
    """Of two sets of shingles (sorted hashes, counts)."""
    wa, wb = ta * idf.of(a).astype(float), tb * idf.of(b).astype(float)
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    same = b[at] == a if len(b) else np.zeros(len(a), bool)
    both = float(np.minimum(wa[same], wb[at[same]]).sum())
    whole = float(wa.sum() + wb.sum()) - both
    return both / whole if whole else 1.0


def _links(contents: DataFrame, docs: DataFrame, idf, key: str, text: str) -> DataFrame:
    """(node, root): the components of contents that are linked, for all nodes but the roots.

    Each bucket is led by its most central members, those that share most
    buckets with most others: one in the first round, some in the next. Members
    are held against the leaders of another component than their own; a bucket
    is settled when one component is left in it. In those that are not, members
    outside the largest component are held against all others, in blocks of a
    few megabytes.
    """
    spark = docs.sparkSession
    rows = contents.select("c", F.posexplode("bands").alias("band", "h"))
    crowded = rows.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
    left = stored(rows.join(crowded, ["band", "h"]))
    central = left.groupBy("c").agg(F.sum("n").alias("central"))
    left = stored(left.join(central, "c").select("band", "h", "c", "central", F.col("c").alias("root")))
    wanted = contents.join(left.select("c").distinct(), "c").select(F.col("d").alias(key))
    sets = stored(docs.select(key, text).join(wanted.distinct(), docs[key].eqNullSafe(wanted[key]), "left_semi").select(text).mapInArrow(_set_rows, "c binary, shingles binary, counts binary").dropDuplicates(["c"]))
    shared = spark.sparkContext.broadcast(idf)
    roots = left.select(F.col("c").alias("node"), "root").limit(0)
    found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for size in LEADERS:
        by = W.partitionBy("band", "h").orderBy(F.desc("central"), "c")
        leaders = left.withColumn("i", F.row_number().over(by)).where(F.col("i") <= size).select("band", "h", F.col("c").alias("lead"), F.col("root").alias("lead_root"))
        pairs = left.join(leaders, ["band", "h"]).where("root <> lead_root").select("c", "lead").distinct()
        both = pairs.join(sets, "c").select("c", "lead", F.col("shingles").alias("s1"), F.col("counts").alias("t1")).join(sets.select(F.col("c").alias("lead"), F.col("shingles").alias("s2"), F.col("counts").alias("t2")), "lead")
        good = both.mapInArrow(_verifier(shared), "c binary, lead binary").select(F.col("c").alias("a"), F.col("lead").alias("b"))
        found = stored(found.unionByName(good))
        roots = components(found)
        rest = left.join(leaders.select("band", "h", F.col("lead").alias("c")), ["band", "h", "c"], "left_anti").drop("root")
        rest = rest.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        left = stored(_unsettled(rest))
        if left.isEmpty():
            return roots
    return components(found.unionByName(_in_blocks(left, sets, shared)))


def _in_blocks(left: DataFrame, sets: DataFrame, shared) -> DataFrame:
    """(a, b): links between components of one bucket, as many as join them. Both sides of a bucket are dealt to blocks by their size."""
    bucket = ["band", "h"]
    members = stored(left.select(*bucket, "c", "root").join(sets, "c").withColumn("size", F.length("shingles") + F.length("counts")))
    largest = members.groupBy(*bucket, "root").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy(*bucket).agg(F.max(F.struct("n", "root")).alias("x"), F.sum("size").alias("all"), F.max_by("size", F.struct("n", "root")).alias("top"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    plan = largest.select(*bucket, F.col("x.root").alias("main"), F.greatest(F.lit(1), blocks(F.col("all"))).alias("m"), F.greatest(F.lit(1), blocks(F.col("all") - F.col("top"))).alias("s"))
    dealt = members.join(plan, bucket)
    at = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["c", "root", "shingles", "counts"]
    one = dealt.withColumn("i", at("m")).select(*bucket, "i", every("s").alias("j"), *columns)
    other = dealt.where("root <> main").withColumn("j", at("s")).select(*bucket, every("m").alias("i"), "j", *columns)
    group = [*bucket, "i", "j"]
    other = other.toDF(*[f"{x}_" for x in other.columns])
    return one.groupBy(*group).cogroup(other.groupBy(*[f"{x}_" for x in group])).applyInArrow(_block_links(shared), "a binary, b binary")


def _block_links(shared):
    def run(_, left, right):
        idf = shared.value
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while up.get(x, x) != x:
                x = up[x]
            return x

        def read(table):
            s = [np.frombuffer(x.as_py(), np.uint32) for x in table["shingles"]]
            t = [np.frombuffer(x.as_py(), np.uint32) if x.as_py() else None for x in table["counts"]]
            return table["c"].to_pylist(), table["root"].to_pylist(), s, [np.ones(len(a), np.uint32) if b is None else b for a, b in zip(s, t, strict=True)]

        out = []
        if left.num_rows and right.num_rows:
            c, root, s, t = read(left)
            every = np.concatenate(s)
            known, where = np.unique(every, return_inverse=True)
            weight = np.concatenate(t) * idf.of(every).astype(float)
            starts = np.append(0, np.cumsum([len(x) for x in s])[:-1])
            total = np.add.reduceat(weight, starts)
            own = np.zeros(len(known), weight.dtype)
            for c1, r1, s1, t1 in zip(*read(right.rename_columns([x.removesuffix("_") for x in right.column_names])), strict=True):
                w1 = t1 * idf.of(s1).astype(float)
                at = np.minimum(np.searchsorted(known, s1), len(known) - 1)
                same = known[at] == s1
                own[:] = 0
                own[at[same]] = w1[same]
                both = np.add.reduceat(np.minimum(weight, own[where]), starts)
                for k in np.flatnonzero(both >= SIMILARITY * (total + w1.sum() - both) * (1 - 1e-6)).tolist():
                    a, b = top(r1), top(root[k])
                    if a != b and weighted_jaccard(s1, t1, s[k], t[k], idf) >= SIMILARITY:
                        up[max(a, b)] = min(a, b)
                        out.append((c1, c[k]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    return run


def _unsettled(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several components."""
    several = members.groupBy("band", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "h")
    return members.join(several, ["band", "h"], "left_semi")


def _set_rows(batches):
    for batch in batches:
        for _, raw, off in slices(batch.column(0)):
            _, _, h, upto = words(raw, off, ALNUM)
            doc, shingle, tf = shingle_sets(h, upto, raw, off)
            c = content_hashes(h, upto, raw, off)
            cut = np.searchsorted(doc, np.arange(len(off)))
            tf = tf.astype(np.uint32)
            parts = [slice(cut[i], cut[i + 1]) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in c], pa.binary()), pa.array([shingle[p].tobytes() for p in parts], pa.binary()), pa.array([b"" if (tf[p] == 1).all() else tf[p].tobytes() for p in parts], pa.binary())], names=["c", "shingles", "counts"])


def _verifier(shared):
    def run(batches):
        idf = shared.value
        one = lambda s, t: (s := np.frombuffer(s, np.uint32), np.frombuffer(t, np.uint32) if t else np.ones(len(s), np.uint32))
        for batch in batches:
            s1, t1, s2, t2 = (batch.column(batch.schema.get_field_index(x)) for x in ("s1", "t1", "s2", "t2"))
            ok = pa.array([weighted_jaccard(*one(a.as_py(), b.as_py()), *one(c.as_py(), d.as_py()), idf) >= SIMILARITY for a, b, c, d in zip(s1, t1, s2, t2, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(x)).filter(ok) for x in ("c", "lead")], names=["c", "lead"])

    return run


def _sampled(shared, own: int):
    def run(batches):
        sampler, idf = Sampler(), shared.value
        for batch in batches:
            for start, raw, off in slices(batch.column(own)):
                _, _, h, upto = words(raw, off, ALNUM)
                doc, shingle, tf = shingle_sets(h, upto, raw, off)
                c = content_hashes(h, upto, raw, off)
                bands: list = [[]] * (len(off) - 1)
                if len(doc):
                    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    weight = np.log(tf.astype(np.float32) * idf.of(shingle))
                    for i, row in zip(doc[first].tolist(), sampler.bands(shingle, weight, first).tolist(), strict=True):
                        bands[i] = row
                part = batch.slice(start, len(off) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:own], pa.array([x.tobytes() for x in c], pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=[*batch.schema.names[:own], "c", "bands"])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: its key, class_id (the smallest key of its class) and class_size.

    Classes are the components of documents linked at a weighted Jaccard
    similarity of 0.8 or more of TF-IDF five-word shingles (lower-case words of
    letters and digits). Documents with the same words are one content, sampled
    once; only contents that share a band are compared. Fewer than five words
    make one shingle. Documents without words, null texts among them (as empty),
    are alike if their texts are equal. Null keys: class_id is null if no member
    has a key. Rows of one key and text are one class. Very long texts are
    sampled whole. Ties: among members that share as many buckets with others,
    the one with the smallest content hash leads, which changes no class that
    verification finds. Only these columns are returned. No rows: no rows.
    """
    spark = ship(docs.sparkSession)
    return _classes(docs, key, text, spark).select(F.col("d").alias(key), "class_id", "class_size")


def _classes(docs: DataFrame, key: str, text: str, spark) -> DataFrame:
    docs = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    idf = document_frequencies(docs, text)
    kind = docs.schema[key].dataType.simpleString()
    rows = stored(docs.select(F.col(key).alias("d"), text).mapInArrow(_sampled(spark.sparkContext.broadcast(idf), 1), f"d {kind}, c binary, bands array<long>"))
    contents = rows.groupBy("c").agg(F.min("d").alias("d"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    roots = _links(contents, docs, idf, key, text)
    named = contents.select("c", "d", "n").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    classes = named.groupBy("root").agg(F.min("d").alias("class_id"), F.sum("n").alias("class_size"))
    of = stored(named.select("c", "root").join(classes, "root").select("c", "root", "class_id", "class_size"))
    return rows.select("d", "c").join(of, "c")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without all but one of each class: that with the smallest key (of the smallest content, among equal keys)."""
    spark = ship(docs.sparkSession)
    found = _classes(docs, key, text, spark)
    first = found.groupBy("root").agg(F.min(F.struct("d", "c")).alias("x")).select(F.col("x.d").alias("_d"), F.col("x.c").alias("_c"))
    if not keys_repeat(found):
        return docs.join(first, docs[key] == first["_d"], "left_semi")
    # keys repeat or are null: a row is known by its key and content
    content, number = unused(docs, "_c1"), unused(docs, "_i")
    rows = marked(docs, text, content)
    kept = rows.join(first, rows[key].eqNullSafe(first["_d"]) & (rows[content] == first["_c"]))
    one = W.partitionBy(first["_d"], first["_c"]).orderBy(F.md5(F.coalesce(rows[text], F.lit(""))))
    return kept.select(*[rows[c] for c in docs.columns], F.row_number().over(one).alias(number)).where(F.col(number) == 1).drop(number)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
