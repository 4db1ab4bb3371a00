"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of bigrams, of words and of any word at all are
mixed by weights that depend on how often the context was seen. The weights are
learned by expectation-maximisation on held-out counts: each training token is
taken out of the counts that predict it.

Texts are worked through in blocks of about a million tokens. A block sends each
of its distinct words and bigrams once, packed by ranges of their hash, gets the
counts over the whole corpus back, and scores its texts. Nothing that grows with
the corpus is broadcast or gathered: a range of hashes, like a block, fits in a
task, and the number of ranges follows the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.ship import ship

from ._store import release, release_part, stored
from ._text import NON_SPACE, mix, slices, words

#: Tokens of a block, and bytes of text for each range of hashes.
BLOCK_TOKENS, RANGE_BYTES = 1_000_000, 8_000_000
#: Bits of a hash that are kept of bigrams, below those of the range; words keep all 64.
PAIR_BITS = 40
#: Buckets of context frequency: unseen, then by powers of two. Rounds of expectation-maximisation.
BUCKETS, ROUNDS = 40, 60
END = np.uint64(0x656E64)


def _pack(sorted_keys: np.ndarray) -> bytes:
    """First key and differences, each in as few bytes as the largest needs."""
    if not len(sorted_keys):
        return b""
    steps = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : data[0]] = raw
    return np.cumsum(wide.view("<u8")[:, 0].astype(np.uint64), dtype=np.uint64)


def _small(n: np.ndarray) -> bytes:
    """Counts in 1, 2, 4 or 8 bytes each, first bytes first, compressed."""
    top = int(n.max()) if len(n) else 0
    size = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s) or s == 8)
    planes = n.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()
    return bytes([size]) + pa.compress(planes, codec="zstd", asbytes=True) + len(n).to_bytes(8, "little")


def _counts(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[-8:], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[1:-8], size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"<u{size}")[:, 0].astype(np.int64)


def _keys(vocabulary: np.ndarray, ids: np.ndarray, ranges: int):
    """Distinct keys of the words and the bigrams of a block, and where each word and token finds its own."""
    before = np.concatenate([[END], vocabulary[ids[:-1]]]) if len(ids) else vocabulary[:0]
    b = mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + vocabulary[ids]) >> np.uint64(64 - min(64, PAIR_BITS + ranges))
    return np.unique(vocabulary, return_inverse=True), np.unique(b, return_inverse=True)


def _tokenise(ranges: int, kind: pa.DataType):
    def block(number: int, h: list, lengths: list, train: list, ids: list):
        s, n = np.concatenate(h), np.concatenate(lengths)
        learn = np.concatenate(train)
        vocabulary, at, often = np.unique(s, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # frequent words get small numbers, which compress well
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vocabulary, at = vocabulary[order], rank[at]
        head = {"task": number, "ids": ids, "lengths": n.tolist(), "train": learn.tolist(), "stream": _small(at), "vocabulary": vocabulary.tobytes()}
        rows = [head | {"kind": -1, "range": 0, "keys": None, "counts": None}]
        token = np.repeat(learn, n)
        (w, wi), (b, bi) = _keys(vocabulary, at, ranges)
        for what, (keys, where, bits) in enumerate(((w, wi[at], 64), (b, bi, min(64, PAIR_BITS + ranges)))):
            counts = np.bincount(where, token, len(keys)).astype(np.int64)
            below = np.uint64(bits - ranges)
            cuts = np.append(np.searchsorted(keys, np.arange(1 << ranges, dtype=np.uint64) << below), len(keys))
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[r], cuts[r + 1])
                rows.append({"task": number, "kind": what, "range": r, "keys": _pack(keys[part] - (np.uint64(r) << below)), "counts": _small(counts[part])})
        return pa.RecordBatch.from_pylist(rows, schema=_schema(kind))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        h, lengths, train, ids, size = [], [], [], [], 0
        for batch in batches:
            for start, raw, off in slices(batch.column(2)):
                part = batch.slice(start, len(off) - 1)
                _, _, x, upto = words(raw, off, NON_SPACE)
                n = np.diff(upto)
                s = np.full(len(x) + len(n), END, np.uint64)
                s[np.arange(len(x)) + np.repeat(np.arange(len(n)), n)] = x
                h.append(s)
                lengths.append(n + 1)
                train.append(part.column(1).to_numpy(zero_copy_only=False))
                ids += part.column(0).to_pylist()
                size += len(s)
                if size >= BLOCK_TOKENS:
                    yield block(number, h, lengths, train, ids)
                    number += 1
                    h, lengths, train, ids, size = [], [], [], [], 0
        if h:
            yield block(number, h, lengths, train, ids)

    return run


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("task", pa.int64()), ("kind", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("stream", pa.binary()), ("vocabulary", pa.binary())])


def _totals(key, table):
    """Counts over all blocks of the keys of one range, for each block in the order of its own keys; last, how many tokens and words there are."""
    keys = [_unpack(x.as_py()) for x in table["keys"]]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate([_counts(x.as_py()) for x in table["counts"]]), len(every)).astype(np.int64)
    cuts = np.append(0, np.cumsum([len(k) for k in keys]))
    kind, r, n = key[0].as_py(), key[1].as_py(), len(keys)
    return pa.table(
        {
            "task": pa.array([*table["task"].to_pylist(), -1], pa.int64()), "kind": pa.array([kind] * (n + 1), pa.int32()), "range": pa.array([r] * (n + 1), pa.int32()),
            "totals": pa.array([*(_small(total[where[cuts[i] : cuts[i + 1]]]) for i in range(n)), None], pa.binary()),
            "n": pa.array([0] * n + [int(total.sum())], pa.int64()), "v": pa.array([0] * n + [int((total > 0).sum())], pa.int64()),
        }
    )


def _resolve(ranges: int, kind: pa.DataType):
    """A block and its counts to one row: for each token the counts of its bigram and of itself, and that of the end."""

    def run(_, left, right):
        names = ("ids", "lengths", "train", "pair", "word", "ends")
        kinds = (pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int64())
        rows = []
        if left.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            vocabulary, at = np.frombuffer(row["vocabulary"], np.uint64), _counts(row["stream"])
            (_, wi), (_, bi) = _keys(vocabulary, at, ranges)
            found: tuple[dict, dict] = ({}, {})
            for what, r, totals in zip(right["kind"].to_pylist(), right["range"].to_pylist(), right["totals"], strict=True):
                found[what][r] = _counts(totals.as_py())
            words_, pairs = (np.concatenate([x[r] for r in sorted(x)]) for x in found)
            per = words_[wi]
            rows.append({k: row[k] for k in names[:3]} | {"pair": _small(pairs[bi]), "word": _small(per[at]), "ends": int(per[np.flatnonzero(vocabulary == END)[0]])})
        return pa.Table.from_pylist(rows, schema=pa.schema(list(zip(names, kinds, strict=True))))

    return run


class Block:
    """For each token of a block the counts of its bigram, its context and itself."""

    def __init__(self, row: dict):
        self.ids, self.lengths, self.train = row["ids"], np.array(row["lengths"], np.int64), np.array(row["train"], bool)
        self.pair, self.word = _counts(row["pair"]), _counts(row["word"])
        self.context = np.append(row["ends"], self.word[:-1])


def _blocks(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0])


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0)).astype(np.int64)


def _histogram(batches):
    for x in _blocks(batches):
        learn = np.repeat(x.train, x.lengths)
        context, pair, word = x.context[learn] - 1, x.pair[learn] - 1, x.word[learn] - 1
        # quarter powers of two of both estimates; -1: no count is left
        q2 = np.where(pair > 0, np.round(4 * np.log2(np.maximum(context, 1) / np.maximum(pair, 1))), -1).astype(np.int64)
        q1 = np.where(word > 0, np.round(4 * np.log2(np.maximum(word, 1))), -1).astype(np.int64)
        cell, n = np.unique((_bucket(context) << 32) | ((q2 + 1) << 16) | (q1 + 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cell >> 32, ((cell >> 16) & 0xFFFF) - 1, (cell & 0xFFFF) - 1, n)], names=["bucket", "q2", "q1", "n"])


def mixture(cells, tokens: int, words_: int) -> np.ndarray:
    """Weights of bigram, word and uniform estimate for each bucket, by expectation-maximisation."""
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    weights[0] = [0, 0.9, 0.1]
    if not tokens:
        weights[:] = [0, 0, 1]
    bucket, q2, q1, n = (cells[k].to_numpy() for k in ("bucket", "q2", "q1", "n"))
    p = np.stack([np.where(q2 >= 0, 2.0 ** (-q2 / 4), 0), np.where(q1 >= 0, 2.0 ** (q1 / 4) / max(1, tokens - 1), 0), np.full(len(n), 1 / (words_ + 1))], 1)
    for b in np.unique(bucket).tolist():
        rows = bucket == b
        w, own, m = weights[b].copy(), p[rows], n[rows]
        for _ in range(ROUNDS):
            share = own * w
            share *= (m / share.sum(1))[:, None]
            w = share.sum(0) / m.sum()
        weights[b] = 0.999 * w + 0.001 * np.array([0, 0, 1])  # no word is ever impossible
    return weights


def _score(weights: np.ndarray, tokens: int, words_: int, kind: pa.DataType):
    def run(batches):
        names = ("d", "train", "n_tokens", "n_known", "base_score", "score")
        kinds = (kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        for x in _blocks(batches):
            w = weights[_bucket(x.context)]
            p = w[:, 0] * x.pair / np.maximum(x.context, 1) + w[:, 1] * x.word / max(1, tokens) + w[:, 2] / (words_ + 1)
            base = np.log10((x.word + 0.5) / (tokens + 0.5 * (words_ + 1)))
            first = np.append(0, np.cumsum(x.lengths)[:-1])
            sums = [np.add.reduceat(v, first) for v in ((x.word > 0).astype(np.int64), base, np.log10(p))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((x.ids, x.train, x.lengths, *sums), kinds, strict=True)], names=list(names))

    return run


def score_texts(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: key, train (whether the model learned from it), n_tokens, n_known, train_tokens, base_score and score (log10 of the probability of the text).

    Tokens are runs without white space, A-Z in lower case, then one end of
    text. A null or empty text has the end alone; null where `train` is null
    counts as false. With nothing to learn from, all estimates are uniform.
    Repeated rows count as often as they stand; keys may be of any type, null or
    repeated. A text is never cut: one longer than a block is a block of its
    own. Only the columns named here are returned. No rows: no rows.

    Words are counted by 64 bits of their hash, bigrams by 40 bits and those of
    the range, whose number follows the input: at any size one bigram in some
    800,000 at most shares its count with another.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("d"), F.coalesce(train, F.lit(False)).alias("t"), F.col(text).cast("string").alias("x"))
    size = rows.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    ranges = max(3, math.ceil(math.log2(max(1, size / RANGE_BYTES))))
    simple = rows.schema["d"].dataType.simpleString()
    kind = to_arrow_type(rows.schema["d"].dataType)
    fields = f"task long, kind int, range int, keys binary, counts binary, ids array<{simple}>, lengths array<long>, train array<boolean>, stream binary, vocabulary binary"
    made = stored(rows.mapInArrow(_tokenise(ranges, kind), fields).withColumn("part", F.when(F.col("kind") < 0, "text").otherwise("keys")), "part")
    totals = stored(made.where("part = 'keys'").select("kind", "range", "task", "keys", "counts").groupBy("kind", "range").applyInArrow(_totals, "task long, kind int, range int, totals binary, n long, v long"))
    release_part(made, "part=keys")
    sums = totals.where("task < 0 and kind = 0").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    blocks = made.where("part = 'text'").select("task", "ids", "lengths", "train", "stream", "vocabulary").groupBy("task")
    counts = totals.where("task >= 0").select("task", "kind", "range", "totals").groupBy("task")
    resolved = stored(blocks.cogroup(counts).applyInArrow(_resolve(ranges, kind), f"ids array<{simple}>, lengths array<long>, train array<boolean>, pair binary, word binary, ends long"))
    release(made, totals)
    cells = resolved.mapInArrow(_histogram, "bucket long, q2 long, q1 long, n long").groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toPandas()
    weights = mixture(cells, n, v)
    out = resolved.mapInArrow(_score(weights, n, v, kind), f"d {simple}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("d").alias(key), "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ~held).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
