"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Executors count the words and compute the features of a bounded sample of
labelled rows; trees and calibration are trained on these with numpy. Every text
is then scored whole, batch by batch, with no shuffle.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.ship import ship

from ._store import stored
from ._text import lower

# General English lexicons of abuse, each a list of words.
INSULTS = "airhead bastard bonehead bozo buffoon cheat clown coward cretin creep crook deadbeat degenerate dimwit dolt donkey dope dork douche dummy dunce dumbass fool fraud freak garbage halfwit hypocrite idiot idiots ignoramus imbecile jackass jerk knucklehead liar loser losers lunatic maggot moron morons nitwit numbskull oaf parasite pervert pig psycho punk rat retard scum scumbag simpleton sleaze slob sucker swine thug trash troll twit vermin weasel weirdo wimp worm wretch".split()
DEROGATORY = "abhorrent absurd abysmal appalling atrocious awful brainless clueless contemptible corrupt deplorable despicable detestable disgraceful disgusting dumb evil filthy foolish gross hideous hopeless horrible horrid idiotic ignorant incompetent inept insane laughable lazy lousy mindless miserable moronic nasty nauseating obnoxious pathetic repulsive revolting ridiculous rotten shameful shameless sick sickening spineless stupid terrible thick ugly useless vile wicked worthless".split()
PROFANITY = "arse ass asshole bitch bloody bollocks bugger bullshit crap cunt damn dick fuck fucked fucker fucking goddamn hell motherfucker piss prick shit shitty slut twat wank wanker whore".split()
THREATS = "attack beat bleed burn choke crush destroy die drown execute exterminate hang harm hate hated hurt kill killed murder punch shoot slap slaughter smash stab strangle suffer threaten wipe".split()
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur youre thou thee tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer ihr usted ustedes vosotros tus su".split())
#: Symbols and digits that stand for letters in disguised words.
LEET = {ord(a): b for a, b in zip("013457@$!|+*", "oieastasiit*", strict=True)}

WORD = re.compile(r"[^\x00-\x26\x28-\x2F\x3A-\x60\x7B-\x7F]+")
RAW = re.compile(r"[^\x20\x09-\x0D]+")
MIXED = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:[0-9@$!|+*._-]++[A-Za-z]++)+")
REPEAT = re.compile(r"([^\s0-9=_.\-*#])\1\1")
CAPITALS = re.compile(r"\b[A-Z]{2,}\b")
_KINDS = (frozenset(INSULTS), frozenset(DEROGATORY), frozenset(PROFANITY), frozenset(THREATS))

#: Labelled rows that the trees learn from at most, those with the smallest hash of doc_id.
SAMPLE = 8_000
#: Learned lexicon: words of so many labelled texts at least, and so many words at most.
LEXICON_TEXTS, LEXICON_WORDS = 5, 500
TREES, DEPTH, RATE, BINS, NEAR = 80, 3, 0.15, 64, 5
#: Folds of the calibration, and tasks that the labelled rows are dealt to.
FOLDS, TASKS = 3, 32


def telling(*lexicons: dict[str, float]) -> frozenset[str]:
    """All words that features look at."""
    return _ABUSE.union(SECOND_PERSON, *lexicons)


def features(text: str | None, *lexicons: dict[str, float], among: frozenset[str] | None = None) -> list[list[float]]:
    """Dense features of a whole text, once for each learned lexicon; a null text is empty. among: their `telling` words, where many texts follow."""
    text = text or ""
    found = WORD.findall(lower(text))
    n, chars = max(1, len(found)), max(1, len(text))
    known, second = [], []
    among = telling(*lexicons) if among is None else among
    spots = [(i, w) for i, w in enumerate(found) if w in among]
    for i, w in spots:
        if w in _ABUSE:
            known.append(i)
        elif w in SECOND_PERSON:
            second.append(i)
    marks = [[i for i, w in spots if w in learned] for learned in lexicons]
    hits = [sum(found[i] in kind for i in known) for kind in _KINDS]
    disguised = masked = 0
    for m in MIXED.finditer(text):
        masked += 1
        plain = lower(m[0]).translate(LEET)
        disguised += plain in _ABUSE or re.sub(r"[^a-z]", "", plain) in _ABUSE
    capitals = sum(map(len, CAPITALS.findall(text)))
    style = [capitals / chars, text.count("!") / chars, text.count("?") / chars, (text.count("*") + text.count("#") + text.count("$") + text.count("%") + text.count("@")) / chars, (text.count(",") + text.count(".") + text.count(";")) / chars]
    style += [float(disguised), masked / n, len(REPEAT.findall(text)) / n, chars / n]
    rows = []
    for mark, learned in zip(marks, lexicons, strict=True):
        abusive = sorted({*known, *mark})
        weights = [learned[found[i]] for i in mark]
        near = 0
        if second and abusive:
            at, spots = np.array(second), np.array(abusive)
            near = int((np.searchsorted(at, spots + NEAR, "right") > np.searchsorted(at, spots - NEAR)).sum())
        row = [math.log1p(len(found)), math.log1p(len(text))]
        for h in (*hits, len(mark)):
            row += [math.log1p(h), 100.0 * h / n]
        distinct = len({found[i] for i in abusive})
        weight = sum(weights)
        row += [weight, weight / n * 100, max(weights, default=0.0), float(distinct), 100.0 * distinct / math.sqrt(n), math.log1p(near), 100.0 * near / n, 100.0 * len(second) / n]
        rows.append(row + style)
    return rows


_ABUSE = frozenset().union(*_KINDS)
N_FEATURES = len(features("", {})[0])


def learn_lexicons(texts: DataFrame, size: int = LEXICON_WORDS) -> list[dict[str, float]]:
    """Words that mark toxic texts of (text, y, fold): log odds of the share of toxic texts that have the word, smoothed, where over 1; those of the largest odds, `size` at most. One lexicon of all folds but each, last one of all."""

    def distinct(batches):
        for batch in batches:
            for text, y, fold in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("text", "y", "fold")), strict=True):
                own = sorted(set(WORD.findall(lower(text.as_py() or ""))))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.repeat(y, len(own)).cast(pa.int32()), pa.repeat(fold, len(own)).cast(pa.int32())], names=["w", "y", "fold"])

    n = {(r["y"], r["fold"]): r["count"] for r in texts.groupBy("y", "fold").count().collect()}
    per = [F.sum(((F.col("y") == y) & (F.col("fold") == f)).cast("long")).alias(f"n{y}{f}") for y in (0, 1) for f in range(FOLDS)]
    counts = stored(texts.mapInArrow(distinct, "w string, y int, fold int").groupBy("w").agg(*per))
    out = []
    for left in (*range(FOLDS), None):
        folds = [f for f in range(FOLDS) if f != left]
        clean, toxic = (sum((F.col(f"n{y}{f}") for f in folds), F.lit(0)) for y in (0, 1))
        b, a = (max(1, sum(n.get((y, f), 0) for f in folds)) for y in (0, 1))
        odds = F.log((toxic + 0.5) / (a + 1)) - F.log((clean + 0.5) / (b + 1))
        rows = counts.where((toxic > 0) & (toxic + clean >= LEXICON_TEXTS)).select("w", odds.alias("odds")).where("odds > 1").orderBy(F.desc("odds"), "w").limit(size).collect()
        out.append({r["w"]: r["odds"] for r in rows})
    return out


class Trees:
    """Gradient-boosted trees for log loss on binned features: nodes split level by level at the largest gain."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.trees, rate_y = [], float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.start = math.log(rate_y / (1 - rate_y))
        if not len(y) or y.min() == y.max():
            return
        b = self.bin(x)
        f = np.full(len(y), self.start)
        width = BINS + 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits, value = {}, {}
            for level in range(depth):
                for k in np.unique(node):
                    rows = np.flatnonzero(node == k)
                    best = (1e-6, -1, 0)
                    if len(rows) >= 10:
                        for j in range(b.shape[1]):
                            sg, sh = np.bincount(b[rows, j], g[rows], width).cumsum(), np.bincount(b[rows, j], h[rows], width).cumsum()
                            gl, hl, gt, ht = sg[:-1], sh[:-1], sg[-1], sh[-1]
                            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                            gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                            if gain.max() > best[0]:
                                best = (float(gain.max()), j, int(gain.argmax()))
                    if best[1] >= 0:
                        splits[int(k)] = best[1:]
                        node[rows] = 2 * k + 1 + (b[rows, best[1]] > best[2])
                del level
            for k in np.unique(node):
                rows = node == k
                value[int(k)] = rate * float(g[rows].sum() / (h[rows].sum() + 1))
                f[rows] += value[int(k)]
            self.trees.append((splits, value))

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bin(x), np.full(len(x), self.start)
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for k in sorted(splits):
                j, cut = splits[k]
                here = node == k
                node[here] = 2 * k + 1 + (b[here, j] > cut)
            leaf = np.zeros(max(value) + 1)
            for k, v in value.items():
                leaf[k] = v
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, calibrated values), ascending; one pseudo-count of either class on each block."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    ys = np.maximum.accumulate(np.array([(b[0] + 0.1) / (b[1] + 0.2) for b in blocks for _ in (0, 1)])) if blocks else np.zeros(0)
    return xs, ys


class Model:
    """Lexicon, trees and calibration learned from labelled texts. The calibration sees scores of texts whose fold neither the trees nor the lexicon that it uses learned from."""

    def __init__(self, learned: dict[str, float], x: list[np.ndarray], y: np.ndarray, fold: np.ndarray):
        """x: features by the lexicon of all folds but each, last by that of all."""
        self.learned = learned
        out = np.zeros(len(y))
        for k in range(FOLDS):
            rest = fold != k
            out[~rest] = Trees(x[k][rest], y[rest]).predict(x[k][~rest])
        self.trees = Trees(x[-1], y)
        self.xs, self.ys = isotonic(out, y) if len(y) and y.min() < y.max() else (np.zeros(0), np.zeros(0))

    def score(self, texts: list[str | None]) -> np.ndarray:
        among = telling(self.learned)
        raw = self.trees.predict(np.array([features(t, self.learned, among=among)[0] for t in texts]).reshape(-1, N_FEATURES))
        plain = 1 / (1 + np.exp(-raw))
        if not len(self.xs):
            return plain
        # the steps of the calibration keep the order of the trees within a step
        return np.clip(0.98 * np.interp(raw, self.xs, self.ys) + 0.02 * plain, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from `sample` labelled rows at most, those with the smallest hash of the key (any type).

    Rows of a null key or label teach nothing; of labels that repeat a key the
    largest counts, of its texts the least. Texts stay in the executors, which
    count words and compute features; `sample` rows of features, and lexicons
    of LEXICON_WORDS words, come to the driver.
    """
    ship(docs.sparkSession)
    name = F.col(key).cast("string")
    few = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_d")).agg(F.max(label).cast("int").alias("y"))
    few = stored(few.withColumn("o", F.md5(F.col("_d").cast("string"))).orderBy("o", "_d").limit(sample))
    own = docs.select(name.alias("d"), F.col(text).alias("text")).join(F.broadcast(few.select(F.col("_d").cast("string").alias("d"), "y", "o")), "d").groupBy("d", "y", "o").agg(F.min("text").alias("text"))
    texts = stored(own.select("text", F.least(F.col("y"), F.lit(1)).alias("y"), F.pmod(F.xxhash64("o"), F.lit(FOLDS)).cast("int").alias("fold"), "o").repartition(TASKS, "o"))
    lexicons = learn_lexicons(texts)

    def compute(batches):
        among = telling(*lexicons)
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                rows = [[v for row in features(t, *lexicons, among=among) for v in row] for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(rows, pa.list_(pa.float64()))], names=["y", "fold", "o", "x"])

    rows = texts.mapInArrow(compute, "y int, fold int, o string, x array<double>").toArrow().sort_by("o")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, FOLDS + 1, N_FEATURES)
    return Model(lexicons[-1], [x[:, k] for k in range(FOLDS + 1)], rows["y"].to_numpy().astype(float), rows["fold"].to_numpy())


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with a double column toxicity (0 to 1), which replaces one of that name.

    Each text is read whole; a null or empty one gets the score of an empty
    text. With no labelled rows every score is 0.5; with labels of one class
    only, close to that class. Rows are scored one by one, so repeated rows get
    equal scores and no rows give no rows.
    """
    docs = docs.select([c for c in docs.columns if c != "toxicity"])
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(texts.slice(i, 500).to_pylist()), pa.float64())], names=[*batch.schema.names, "toxicity"])

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, toxicity double"
    return docs.mapInArrow(run, schema)


def training(labels: DataFrame) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, training(labels.select("doc_id", "toxic")))
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
