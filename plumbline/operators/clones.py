"""Copy-paste detection: k-token windows, equal windows in pairs, maximal extension, subsumption by lines."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.ship import ship
from plumbline.store import release, stored

#: Windows that stand at more places than this are skipped, where no other limit (None: none) is given: with K places a window makes K * (K - 1) / 2 pairs.
MAX_PLACES = 200
#: Tokens by which a pair is extended in the first round.
FIRST = 128
#: Pairs within a file that are extended at once, about.
PAIRS = 1 << 18


def windows(tokens: DataFrame, k: int) -> DataFrame:
    """(file, pos, gram, prev): a hash of each k tokens in a row of a file, and of the token before (null at the start).

    Hashes of 2, 4, 8... tokens are made of two of half the length each; those
    that k is the sum of make a window. A row holds a few numbers at any k.
    """
    order = W.partitionBy("file").orderBy("pos")
    t = tokens.select("file", "pos", F.xxhash64("value").alias("h0"))
    t = t.withColumns({"prev": F.lag("h0").over(order), "last": F.lead("h0", k - 1).over(order)})
    names, at = ["h0"], 0
    while 2 << at <= k:
        t = t.withColumn(f"h{at + 1}", F.xxhash64(f"h{at}", F.lead(f"h{at}", 1 << at).over(order)))
        at += 1
        names.append(f"h{at}")
    parts, done = [], 0
    for i in range(at, -1, -1):
        if k >> i & 1:
            parts.append(F.lead(f"h{i}", done).over(order) if done else F.col(f"h{i}"))
            done += 1 << i
    t = t.withColumn("gram", F.xxhash64(*parts))
    return t.where("last is not null").select("file", "pos", "gram", "prev")


def buckets(grams: DataFrame) -> DataFrame:
    """(gram, places) of windows that stand at two places or more."""
    return grams.groupBy("gram").agg(F.count("*").alias("places")).where("places >= 2")


def candidates(grams: DataFrame, k: int, max_places: int = MAX_PLACES) -> DataFrame:
    """(file_a, pos_a, file_b, pos_b), the former first: equal windows that no longer match covers from one token earlier and that do not overlap in a file."""
    kept = grams.join(buckets(grams).where(F.col("places") <= max_places).select("gram"), "gram")
    a = kept.select("gram", F.col("file").alias("file_a"), F.col("pos").alias("pos_a"), F.col("prev").alias("prev_a"))
    b = kept.select("gram", F.col("file").alias("file_b"), F.col("pos").alias("pos_b"), F.col("prev").alias("prev_b"))
    ordered = (F.col("file_a") < F.col("file_b")) | ((F.col("file_a") == F.col("file_b")) & (F.col("pos_a") + k <= F.col("pos_b")))
    longer = F.coalesce(F.col("prev_a") == F.col("prev_b"), F.lit(False))
    return a.join(b, "gram").where(ordered & ~longer).select("file_a", "pos_a", "file_b", "pos_b")


def sequences(tokens: DataFrame) -> DataFrame:
    """(file, h, l): 32-bit hashes of the tokens of each file, and their lines, in order. Two tokens that differ pass for equal with a probability of 2^-32 a comparison."""
    found = tokens.where("file is not null").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", F.hash("value").alias("h"), "line"))).alias("t"))
    return found.select("file", F.col("t.h").alias("h"), F.col("t.line").alias("l"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n tokens in a row, made by doubling."""
    x = _mix(h.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    count = len(h) - n + 1
    out, done, size = np.zeros(count, np.uint64), 0, 1
    while done < n:
        if n & size:
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + x[done : done + count] + np.uint64(1))
            done += size
        if done < n:
            x = _mix(x[:-size] * np.uint64(0xD6E8FEB86659FD93) + x[size:])
            size *= 2
    return out


def _each(batch: pa.RecordBatch):
    """(row, file, hashes) of a batch."""
    h = batch.column(batch.schema.get_field_index("h"))
    for i, f in enumerate(batch.column(batch.schema.get_field_index("file")).to_pylist()):
        yield i, f, h[i].values.to_numpy()


def _anchors(k: int):
    """(g, ctx, edge, file, first, last): the least hash of half a window's length in each window, a hash of the tokens before it, whether the file starts among these, and the windows in a row that have it."""
    q = (k + 1) // 2
    w = k - q + 1

    def run(batches):
        for batch in batches:
            out: list = [[] for _ in range(6)]
            for _, f, h in _each(batch):
                if len(h) < k:
                    continue
                g = _runs(h, q)
                at = np.lib.stride_tricks.sliding_window_view(_mix(g), w).argmin(1) + np.arange(len(h) - k + 1)
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                p = at[first]
                before = _runs(h, w)[np.maximum(p - w, 0)]
                found = (g[p].view(np.int64), (before >> np.uint64(32)).astype(np.uint32).view(np.int32), p < w, [f] * len(p), first.astype(np.int32), np.append(first[1:], len(at)).astype(np.int32) - 1)
                for a, x in zip(out, found, strict=True):
                    a.append(x)
            if out[0]:
                files = pa.array([f for x in out[3] for f in x], pa.string())
                yield pa.RecordBatch.from_arrays([files if j == 3 else pa.array(np.concatenate(x)) for j, x in enumerate(out)], names=["g", "ctx", "edge", "file", "first", "last"])

    return run


def _windows_in(k: int):
    """(gram, file, pos, prev) of the windows in `ranges`."""

    def run(batches):
        for batch in batches:
            ranges = batch.column(batch.schema.get_field_index("ranges")).to_pylist()
            out: list = [[], [], [], []]
            for i, f, h in _each(batch):
                pos = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges[i]])
                out[0].append(_runs(h, k)[pos].view(np.int64))
                out[1] += [f] * len(pos)
                out[2].append(pos)
                out[3].append(h[np.maximum(pos - 1, 0)])
            if out[0]:
                pos = np.concatenate(out[2])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(out[1], pa.string()), pa.array(pos.astype(np.int64)), pa.array(np.concatenate(out[3]).astype(np.int32), mask=pos == 0)], names=["gram", "file", "pos", "prev"])

    return run


def starts(seqs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(file, pos, gram, prev) of all windows that a clone may begin with, each at all its places; and the sequences of their files.

    Equal windows have the same least hash of half their length. Where that
    stands once, or always after the same tokens, each window around it is the
    only one, or a longer match covers it from one token earlier everywhere.
    """
    ship(seqs.sparkSession)
    anchors = stored(seqs.select("file", "h").mapInArrow(_anchors(k), "g long, ctx int, edge boolean, file string, first int, last int"))
    many = anchors.groupBy("g").agg(F.count("*").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi"), F.max("edge").alias("edge")).where("n > 1 and (lo <> hi or edge)").select("g")
    ranges = stored(anchors.join(many, "g").groupBy("file").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))
    release(anchors)
    held = stored(seqs.join(ranges, "file").select("file", "h", "l", "ranges"))
    release(ranges)
    grams = stored(held.select("file", "h", "ranges").mapInArrow(_windows_in(k), "gram long, file string, pos long, prev int"))
    return grams.select("file", "pos", "gram", "prev"), held.drop("ranges")


def _meet(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, file, pos, prev, i, up) twice: joined by c, i and up, two places of one c meet once if other tokens stand before them, and not at all if the same.

    Places of a c are numbered by the token before them, the most frequent one
    first; the start of a file counts as a token of its own. The first number's
    meet all others; these meet each other by the highest bit in which their
    numbers differ. So the places of a window are sent a few times each, and
    nothing grows with the square of those after the same token.
    """
    kind = F.struct("prev", F.when(F.col("prev").isNull(), F.struct("file", "pos")).alias("own"))
    numbered = places.withColumn("kind", kind)
    sizes = numbered.groupBy("c", "kind").agg(F.count("*").alias("size"))
    all_of = W.partitionBy("c")
    numbers = sizes.select("c", "kind", F.row_number().over(all_of.orderBy(F.desc("size"), "kind")).alias("r"), F.count("*").over(all_of).alias("kinds")).where("kinds > 1")
    numbered = numbered.join(numbers, ["c", "kind"])
    # r - 2 of kinds - 1 numbers from 0; bit -1 stands for the first number against the rest
    bits = F.when((F.col("r") == 1) | (F.col("kinds") == 2), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(-1), F.length(F.bin(F.col("kinds") - 2)) - 1))
    dealt = numbered.withColumn("i", F.explode(bits)).withColumn("q", (F.col("r") - 2).cast("bigint"))
    dealt = dealt.withColumn("up", F.when(F.col("i") < 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftright(q, i + 1)")))
    dealt = dealt.withColumn("side", F.when(F.col("i") < 0, F.col("r") > 1).otherwise(F.expr("shiftright(q, i) & 1 = 1")))
    return tuple(dealt.where(side).select("c", "file", "pos", "prev", "i", "up") for side in (~F.col("side"), F.col("side")))


def maximal(grams: DataFrame, seqs: DataFrame, k: int, max_places: int | None = MAX_PLACES) -> DataFrame:
    """Clones that begin with equal windows of `grams`, extended while tokens are equal, within both files and, in one file, up to the other copy.

    Places meet by all that they are known to share, each with the tokens that
    follow: a block of them in each round, of eight times the length of that
    before. Only places that share the whole of a block with another go on.
    Pairs never meet tokens, and only those are made that no longer match covers.
    """
    fine = grams.groupBy("gram").agg(F.count("*").alias("n"), F.count("prev").alias("known"), F.min("prev").alias("lo"), F.max("prev").alias("hi"))
    fine = fine.where((F.col("n") >= 2) & ((F.col("lo") != F.col("hi")) | (F.col("known") < F.col("n"))))
    if max_places is not None:
        fine = fine.where(F.col("n") <= max_places)
    active = stored(grams.join(fine.select("gram"), "gram").select(F.col("gram").alias("c"), "file", "pos", "prev"))
    n, size, out = 0, max(FIRST, 2 * k), []
    while True:
        sides = []
        for s, dealt in zip("xy", _meet(active), strict=True):
            per = dealt.groupBy("file").agg(F.collect_list(F.struct("c", "pos", "prev", "i", "up")).alias("m"))
            here = per.join(seqs, "file").select("file", F.explode("m").alias("m"), "h", "l").select("file", "m.*", "h", "l")
            at = F.col("pos").cast("int")
            here = here.select("c", "i", "up", "file", "pos", "prev", F.element_at("l", at + 1).alias("line"), F.slice("h", at + n + 1, F.lit(size)).alias("h"), F.slice("l", at + (n or 1), F.lit(size + 1)).alias("l"))
            sides.append(here.select("c", "i", "up", *[F.col(x).alias(f"{x}_{s}") for x in ("file", "pos", "prev", "line", "h", "l")]))
        same = F.col("file_x") == F.col("file_y")
        apart = F.abs(F.col("pos_x") - F.col("pos_y"))
        both = sides[0].join(sides[1], ["c", "i", "up"]).where(~same | (apart >= max(k, n + 1))).withColumn("own", F.when(same, apart - n).otherwise(F.lit(size + 1)))
        both = both.withColumn("room", F.least(F.size("h_x"), F.size("h_y"), "own").cast("int"))
        cut = lambda s: F.slice(f"h_{s}", F.lit(1), F.col("room"))
        first = F.array_position(F.zip_with(cut("x"), cut("y"), lambda x, y: x == y), F.lit(False))
        both = both.withColumn("more", F.when(F.col("room") == 0, 0).when(first > 0, first - 1).otherwise(F.col("room")).cast("int"))
        end = {s: F.element_at(f"l_{s}", F.col("more") + (1 if n else 0)).alias("end_line") for s in "xy"}
        x, y = (F.struct(*[F.col(f"{c}_{s}").alias(c) for c in ("file", "pos", "prev", "line")], end[s]) for s in "xy")
        on = F.when((F.col("more") == size) & (F.col("own") > size), F.xxhash64("c", "h_x"))
        before = (F.col("file_x") < F.col("file_y")) | (same & (F.col("pos_x") < F.col("pos_y")))
        both = both.select(F.when(before, x).otherwise(y).alias("a"), F.when(before, y).otherwise(x).alias("b"), (F.col("more") + F.lit(n).cast("bigint")).alias("token_count"), on.alias("c"))
        ranges = [F.col(f"{s}.{c}").alias(f"{z}_{s}") for s in "ab" for c, z in (("file", "file"), ("line", "start_line"), ("end_line", "end_line"))]
        go = F.when(F.col("c").isNotNull(), F.struct("c", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("pos", "prev")])).alias("go")
        fresh = stored(both.select(*ranges, "token_count", go))
        out.append(fresh.where("go is null").drop("go"))
        release(active)
        going = fresh.where("go is not null")
        active = stored(reduce(DataFrame.unionAll, [going.select("go.c", F.col(f"file_{s}").alias("file"), F.col(f"go.pos_{s}").alias("pos"), F.col(f"go.prev_{s}").alias("prev")) for s in "ab"]).distinct())
        if active.isEmpty():
            return reduce(DataFrame.unionAll, out)
        n, size = n + size, size * 8


def unsubsumed(clones: DataFrame) -> DataFrame:
    """Clones whose lines lie in those of no other clone of the same two files; of equal ranges the one with most tokens."""
    spans = ["file_a", "file_b", "start_line_a", "end_line_a", "start_line_b", "end_line_b"]
    one = clones.groupBy(*spans).agg(F.max("token_count").alias("token_count"))
    o = one.select(*[F.col(c).alias(f"o_{c}") for c in spans])
    inside = (F.col("file_a") == F.col("o_file_a")) & (F.col("file_b") == F.col("o_file_b"))
    differs = F.lit(False)
    for s in ("a", "b"):
        inside &= (F.col(f"start_line_{s}") >= F.col(f"o_start_line_{s}")) & (F.col(f"end_line_{s}") <= F.col(f"o_end_line_{s}"))
        differs |= (F.col(f"start_line_{s}") != F.col(f"o_start_line_{s}")) | (F.col(f"end_line_{s}") != F.col(f"o_end_line_{s}"))
    kept = one.join(o, inside & differs, "left_anti")
    return kept.select("file_a", "start_line_a", "end_line_a", "file_b", "start_line_b", "end_line_b", "token_count")


def _repeats(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): the tokens of all clones within one file, a range for each side, some joined."""
    none = np.zeros(0, np.int64)
    if len(h) < 2 * k:
        return none, none
    g = _runs(h, k)
    order = np.argsort(g, kind="stable")
    prev = np.where(order > 0, h[np.maximum(order - 1, 0)].astype(np.int64), -(1 << 40))
    heads = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1]))
    tails = np.append(heads[1:], len(order))
    fine = (np.minimum.reduceat(prev, heads) != np.maximum.reduceat(prev, heads)) & (order[tails - 1] - order[heads] >= k)
    found, waiting, held = [(none, none)], [], 0
    for i, j in zip(heads[fine].tolist(), tails[fine].tolist(), strict=True):
        at = order[i:j]
        _, kind, sizes = np.unique(prev[i:j], return_inverse=True, return_counts=True)
        rank = np.argsort(np.argsort(-sizes, kind="stable"))[kind]
        for x in np.flatnonzero(rank):
            other = at[(rank < rank[x]) & (np.abs(at - at[x]) >= k)]
            waiting.append((np.minimum(other, at[x]), np.maximum(other, at[x])))
            held += len(other)
            if held >= PAIRS:
                found.append(_joined(*_extended(h, k, waiting)))
                waiting, held = [], 0
    if held:
        found.append(_joined(*_extended(h, k, waiting)))
    return _joined(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _extended(h: np.ndarray, k: int, pairs: list) -> tuple[np.ndarray, np.ndarray]:
    """Both sides of clones within a file that begin at `pairs`, whose first k tokens are equal: lengths grow by runs of doubled size, then of halved."""
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    room = np.minimum(len(h) - b, b - a)
    n = np.full(len(a), k, np.int64)

    def step(size, rows):
        rows = rows[n[rows] + size <= room[rows]]
        if len(rows):
            r = _runs(h, size)
            rows = rows[r[a[rows] + n[rows]] == r[b[rows] + n[rows]]]
            n[rows] += size
        return rows

    size, rows = 1, np.arange(len(a))
    while len(rows := step(size, rows)):
        size *= 2
    while size > 1:
        size //= 2
        step(size, np.arange(len(a)))
    return np.append(a, b), np.append(a + n, b + n) - 1


def _joined(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same places by ranges that do not overlap."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.append(True, first[1:] > last[:-1]))
    return first[new], last[np.append(new[1:], len(last)) - 1]


def _spans(names: tuple, each):
    """Rows of `each` (a row's number, hashes, lines) of a batch, with its file before the lines."""

    def run(batches):
        for batch in batches:
            lines, out = batch.column(batch.schema.get_field_index("l")), []
            for i, f, h in _each(batch):
                *more, first, last = each(batch, i, h)
                line = lines[i].values.to_numpy()
                if len(first):
                    out.append(([f] * len(first), *more, line[first], line[last]))
            if out:
                files, *numbers = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([f for x in files for f in x], pa.string()), *[pa.array(np.concatenate(x)) for x in numbers]], names=["file", *names, "start_line", "end_line"])

    return run


def covered(seqs: DataFrame, k: int) -> DataFrame:
    """(file, start_line, end_line): spans of lines that together are those of all clones of k tokens or more (two at least), however many places a window stands at.

    Nothing here is a pair of files. A window that stands in another file, too,
    lies in a clone, whose lines are those of its windows; so it is enough to know
    which windows stand in two files. Clones within a file end at their other
    copy: their pairs are looked at, file by file.
    """
    if k < 2:
        raise ValueError("windows of one token do not hold the lines between them")
    ship(seqs.sparkSession)
    seqs = stored(seqs)

    def within(batch, i, h):
        return _repeats(h, k)

    def windows_at(batch, i, h):
        pos = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in batch.column(batch.schema.get_field_index("ranges"))[i].as_py()])
        return _runs(h, k)[pos].view(np.int64), pos, pos + k - 1

    own = stored(seqs.mapInArrow(_spans((), within), "file string, start_line long, end_line long"))
    anchors = stored(seqs.select("file", "h").mapInArrow(_anchors(k), "g long, ctx int, edge boolean, file string, first int, last int").select("g", "file", "first", "last"))
    several = lambda d, key: d.groupBy(key).agg(F.min("file").alias("lo"), F.max("file").alias("hi")).where("lo <> hi").select(key)
    ranges = stored(anchors.join(several(anchors, "g"), "g").groupBy("file").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))
    release(anchors)
    grams = stored(seqs.join(ranges, "file").mapInArrow(_spans(("gram",), windows_at), "file string, gram long, start_line long, end_line long"))
    release(ranges, seqs)
    return own.unionAll(grams.join(several(grams, "gram"), "gram").select("file", "start_line", "end_line"))


def find_clones(tokens: DataFrame, k: int = 50, max_places: int | None = MAX_PLACES) -> DataFrame:
    """Clones of k tokens or more. Windows at more than `max_places` places begin none; None lifts that."""
    if k <= 0:
        raise ValueError("k must be positive")
    return clones_of(stored(sequences(tokens)), k, max_places)


def clones_of(seqs: DataFrame, k: int, max_places: int | None = MAX_PLACES, lines: bool = False) -> DataFrame:
    """As find_clones, of sequences; lines: only the lines of all clones (see covered), which needs no limit of places."""
    if lines:
        if max_places is not None:
            raise ValueError("lines are those of all clones")
        return covered(seqs, k)
    return unsubsumed(maximal(*starts(seqs, k), k, max_places))
