"""What the operators share: hashes of contents, and columns that mark rows by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._text import ALNUM, mix, slices, words


def content_hashes(h: np.ndarray, upto: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of the sequence of words of each document; of its bytes, if it has no words."""
    n = len(upto) - 1
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(upto[:-1], np.diff(upto)).astype(np.uint64)
    out = np.empty((n, 2), np.int64)
    for j, salt in enumerate((0x51, 0xA7)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ mix(place * np.uint64(2) + np.uint64(salt))), out=total[1:])
        out[:, j] = mix((total[upto[1:]] - total[upto[:-1]]) + np.diff(upto).astype(np.uint64)).view(np.int64)
    for i in np.flatnonzero(np.diff(upto) == 0):
        a = raw[off[i] : off[i + 1]].astype(np.uint64)
        for j, salt in enumerate((0x51, 0xA7)):
            out[i, j] = mix(np.array([mix((a + np.uint64(1)) * mix(np.arange(len(a), dtype=np.uint64) + np.uint64(salt))).sum() + np.uint64(salt)], np.uint64)).view(np.int64)[0]
    return out


def unused(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have yet."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def marked(docs: DataFrame, text: str, name: str) -> DataFrame:
    """`docs` with a column of that name: the 16 bytes of each row's content."""
    position = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for start, raw, off in slices(batch.column(position)):
                _, _, h, upto = words(raw, off, ALNUM)
                part = batch.slice(start, len(off) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in content_hashes(h, upto, raw, off)], pa.binary())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` binary"]))


def keys_repeat(rows: DataFrame) -> bool:
    """Whether the keys `d` of these rows repeat or are null."""
    n = rows.agg(F.count("*").alias("n"), F.countDistinct("d").alias("k")).first()
    return n["n"] != n["k"]


def spans_length(spans: Column) -> Column:
    """Length of the union of intervals packed as start * 2^31 + end."""
    unit = F.lit(1 << 31)
    start = lambda x: F.floor(x / unit).cast("long")
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), (x % unit) - F.greatest(start(x), acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], x % unit).cast("long").alias("end"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step)["n"]
