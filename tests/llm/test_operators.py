"""Each operator on small tables: brute force, and nulls, empty and odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline import store
from plumbline.llm import chat, decontamination, html_text, language_model, licenses, mixing, near_dedup, neighbours, substrings, toxicity
from plumbline.llm._text import NON_SPACE, slices, words

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, source string"


def split(text):
    return ALNUM.findall((text or "").translate(LOWER))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))


def test_words():
    import pyarrow as pa

    texts = ["Ab-c  d", "", None, "é1 Ü\t x", "\n", "a" * 50]
    for keep, pattern in ((None, ALNUM), (NON_SPACE, re.compile(r"[^\x20\x09-\x0D]+"))):
        out = []
        for _, raw, off in slices(pa.array(texts), 12):
            s, e, _, upto = words(raw, off) if keep is None else words(raw, off, keep)
            out += [[raw[a:b].tobytes().decode().translate(LOWER) for a, b in zip(s[i:j], e[i:j])] for i, j in zip(upto, upto[1:])]
        assert out == [pattern.findall((t or "").translate(LOWER)) for t in texts]


# 1 language model


def test_lm_base_and_shares(spark):
    rng = random.Random(1)
    docs = [(i, None if i == 3 else "" if i == 4 else " ".join(rng.choice(["a", "b", "the", "c", "X", f"w{i % 7}"]) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    d = spark.createDataFrame(docs + docs[:2], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("train", F.lit(1))
    got = language_model.score_texts(d, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).toPandas()
    tokens = [(i, [w.translate(LOWER) for w in (t or "").split()] + ["\0"]) for i, t in docs + docs[:2]]
    c = collections.Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 9)) for i, ws in tokens)
    assert sorted(zip(got.doc_id, got.n_tokens, got.n_known, got.base_score.round(9))) == want
    assert set(got.train_tokens) == {n} and (got.score < 0).all() and got.score.sum() > got.base_score.sum()


def test_lm_mixture_against_plain_counts(spark):
    import datetime

    import pandas as pd

    rng = random.Random(15)
    day = datetime.date(2020, 1, 1)
    docs = [(day + datetime.timedelta(i), " ".join(rng.choice(["a", "b", "the", "c", f"w{i % 9}"]) for _ in range(rng.randint(0, 30)))) for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id date, text string")
    got = {r["doc_id"]: r for r in language_model.score_texts(d, F.dayofmonth("doc_id") % 3 != 0).collect()}
    tokens = {i: [*t.split(), "\0"] for i, t in docs}
    learn = [i for i, _ in docs if i.day % 3]
    one = collections.Counter(w for i in learn for w in tokens[i])
    two = collections.Counter((a, b) for i in learn for a, b in zip(["\0", *tokens[i]], tokens[i]))
    n, v = sum(one.values()), len(one)
    bucket = lambda c: min(39, c.bit_length())
    cells = collections.Counter()
    for i in learn:
        for a, b in zip(["\0", *tokens[i]], tokens[i]):
            context, pair, word = one[a] - 1, two[a, b] - 1, one[b] - 1
            cells[bucket(context), round(4 * math.log2(max(1, context) / pair)) if pair else -1, round(4 * math.log2(word)) if word else -1] += 1
    w = language_model.mixture(pd.DataFrame([(*k, m) for k, m in cells.items()], columns=["bucket", "q2", "q1", "n"]), n, v)
    for i, ws in tokens.items():
        score = sum(math.log10(w[bucket(one[a]), 0] * two[a, b] / max(1, one[a]) + w[bucket(one[a]), 1] * one[b] / n + w[bucket(one[a]), 2] / (v + 1)) for a, b in zip(["\0", *ws], ws))
        assert got[i]["train"] == bool(i.day % 3) and math.isclose(got[i]["score"], score, rel_tol=1e-9)


def test_lm_long_text(spark, monkeypatch):
    text = " ".join(str(i % 977) for i in range(60_000))
    d = spark.createDataFrame([("x", text), ("y", "0 1 2"), (None, None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in language_model.score_texts(d, F.lit(True)).collect()}
    assert (got["x"]["n_tokens"], got["x"]["n_known"], got[None]["n_tokens"]) == (60_001, 60_001, 1) and got["y"]["train_tokens"] == 60_001 + 4 + 1


def test_lm_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score_texts(d, F.lit(True)).count() == 0
    r = language_model.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (r["train_tokens"], r["n_known"]) == (0, 0) and math.isclose(r["score"], 0, abs_tol=1e-6)


def test_mixture_learns():
    import pandas as pd

    cells = pd.DataFrame({"bucket": [3, 3], "q2": [4, -1], "q1": [40, 40], "n": [900, 100]})
    w = language_model.mixture(cells, 10_000, 500)
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.5 and w[0, 0] == 0


# 2 nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).round(3)
    x[:40] = x[0]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0, None] + [0.0] * 6), (None, x[5].tolist()), (904, [1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("rank", F.lit(0))
    got = collections.defaultdict(list)
    for r in neighbours.nearest(d, F.col("_v") % 10 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 10))
    found = 0
    for q, near in got.items():
        s = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = sorted((v, i) for i, v in enumerate(s) if i != q)[:10]
        assert len(near) == 10 and all(math.isclose(v, s[i]) for i, v in near) and near == sorted(near, key=lambda p: (p[1], p[0]))
        found += len({i for _, i in best} & {i for i, _ in near})
    assert found >= 0.95 * 10 * len(got)
    few = neighbours.nearest(d.where("vec_id in (0, 50, 60)"), F.lit(True)).collect()
    assert len(few) == 6 and neighbours.nearest(d.limit(0), F.lit(True)).count() == 0


def test_nearest_in_leaves_with_trees_of_their_own(spark, monkeypatch):
    for name, value in (("SAMPLE", 60), ("LEAF", 20), ("SPLIT", 50), ("CHUNK", 40)):
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(neighbours.Tree.__init__, "__defaults__", (8, 4, 1))
    rng = np.random.default_rng(27)
    x = rng.normal(size=(12, 6)).repeat(100, axis=0) * 3 + rng.normal(size=(1200, 6))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(d, F.col("_v") % 25 == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    found = sum(len(set(got[q]) & set(np.argsort(np.where(np.arange(1200) == q, np.inf, ((x - x[q]) ** 2).sum(1)), kind="stable")[:10].tolist())) for q in range(0, 1200, 25))
    print("recall", found / 480)
    assert all(len(v) == len(set(v)) == 10 for v in got.values()) and found >= 0.9 * 480


def test_sample_of_a_table_in_many_parts_sends_few_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 100)
    d = spark.range(0, 20_000, 1, 50).select(F.col("id").alias("_v"), F.array(F.col("id").cast("double")).alias("_x"))
    sent = []
    monkeypatch.setattr(type(d), "orderBy", lambda self, *by, f=type(d).orderBy: sent.append(self.count()) or f(self, *by))
    assert neighbours._sample(d.unionAll(d), 20_000).count() == 100
    # not 100 of each part
    assert 100 <= sent[0] <= 200


def test_entries_exchange_vectors_once(spark):
    rows = [(i % 40, [float(i % 3)]) for i in range(400)] + [(7, [5.0]), (7, [5.0]), (900, [-0.0])]
    few = neighbours._entries(spark.createDataFrame(rows, "_v long, _x array<double>"), 3)
    assert {r["_x"][0]: r["ids"] for r in few.collect()} == {0.0: [0, 1, 2, 3], 1.0: [0, 1, 2, 3], 2.0: [0, 1, 2, 3], 5.0: [7]}
    plan = few._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_nearest_of_vectors_as_large_and_as_small_as_doubles(spark):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(40, 6))
    x[10:20] *= 1e200
    x[20:25] *= 1e307
    x[25:30] *= 1e-200
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(d, F.lit(True), recall=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q in range(40):
        want = sorted((math.dist(x[q], x[i]), i) for i in range(40) if i != q)[:10]
        assert [i for _, i in got[q]] == [i for _, i in want] and np.allclose([s for s, _ in got[q]], [s for s, _ in want], rtol=1e-12, atol=0)


def test_nearest_of_far_vectors_that_lie_close(spark):
    rng = np.random.default_rng(23)
    x = 1e8 + rng.normal(size=(200, 4)).round(2)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in neighbours.nearest(d, F.col("_v") == 7, recall=1.0).collect():
        want = sorted((float(np.sqrt(((x[i] - x[7]) ** 2).sum())), i) for i in range(200) if i != 7)
        assert (r["score"], r["vec_id"]) == want[r["rank"] - 1]


# 3 licences


def test_licenses(spark):
    text = "x CC-BY y. All Rights Reserved! the GNU General Public License, version 3. cc by"
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Released under the MIT License."), (5, "the mit licence was rights reserved all"), (6, licenses.TEMPLATES[2][1])], "doc_id long, text string").withColumn("labels", F.lit(0))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(d).collect()}
    ws = split(text)
    spots = [i for p in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (len(ws), len(spots), min(spots), max(spots))
    assert got[1]["base_labels"] == ["cc-by", "gpl", "reserved"] and set(got[1]["labels"]) >= {"cc-by", "gpl", "reserved"}
    assert got[2]["n_words"] == 0 and got[2]["first_word"] is None and got[3]["score"] == 0 and got[5]["labels"] == []
    assert got[4]["labels"] == ["mit"] and got[4]["base_labels"] == [] and got[6]["labels"] == ["mit"] and got[6]["score"] == 1
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_every_notice_of_a_file_is_found():
    every = " x ".join(t[1] for t in licenses.TEMPLATES)
    idf = {w: -float(split(every).count(w)) for w in split(every)}
    assert set(licenses.Index(idf=idf).scan(every)[5]) >= {t[0] for t in licenses.TEMPLATES}
    for t in licenses.TEMPLATES:
        assert {"mit", t[0]} <= set(licenses.Index(idf=idf).scan(licenses.TEMPLATES[2][1] + ". " + t[1])[5])


def test_license_phrases_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x"]
    d = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(40)], "doc_id long, text string")
    texts = dict(d.collect())
    for r in licenses.scan_licenses(d).collect():
        ws = texts[r["doc_id"]].split()
        assert r["n_base"] == sum(ws[i : i + len(p.split())] == p.split() for p in licenses.PHRASES for i in range(len(ws)))


def plain_notices(text):
    """Labels and score by trying every notice at every place."""
    ws, labels, best = split(text), set(), 0.0
    has = lambda part, key: any(part[i : i + len(key)] == key for i in range(len(part) - len(key) + 1))
    for phrase, label in licenses.PHRASES.items():
        if has(ws, phrase.split()):
            labels.add(label)
            best = 1.0
    for label, notice, keys in licenses.TEMPLATES:
        own = split(notice)
        for s in range(len(ws)):
            share = sum(a == b for a, b in zip(own, ws[s : s + len(own)])) / len(own)
            if share >= licenses.SHARE and all(has(ws[max(0, s - 2) : s + len(own) + 2], split(k)) for k in keys):
                labels.add(label)
                best = max(best, share)
    return sorted(labels), best


def test_notices_against_every_place():
    rng = random.Random(61)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in split(t[1])})
    for n in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = split(rng.choice(licenses.TEMPLATES)[1])
            for _ in range(rng.choice([0, 0, 1, 3, len(w) // 3])):
                w[rng.randrange(len(w))] = rng.choice([*vocabulary, "x"])
            parts += [*w[: rng.choice([len(w), len(w), len(w) * 2 // 3])], *(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))]
        text = " ".join(parts)
        idf = {w: rng.random() for w in vocabulary}
        got = licenses.Index(idf=idf).scan(text)
        labels, best = plain_notices(text)
        assert got[5] == labels and math.isclose(got[6], best, abs_tol=1e-12), text


def test_licenses_of_long_and_repeated_texts(spark):
    text = "word " * 60_000 + "Released under the MIT License. " + "word " * 1000 + "all rights reserved"
    d = spark.createDataFrame([(1, text), (1, text), (2, "x")], "doc_id long, text string").withColumn("score", F.lit("y"))
    rows = [tuple(r) for r in licenses.scan_licenses(d).orderBy("doc_id").collect()]
    assert rows[0] == rows[1] and rows[0][1:5] == (61_008, 1, 61_005, 61_005) and rows[0][6] == ["mit", "reserved"] and rows[2][6] == []


# 4 toxicity


def test_toxicity(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(240):
        y = int(i % 4 == 0)
        t = prose(rng, 30) + (" you " + " ".join(rng.choice(["idiot", "moron", "scum", "blorp"]) for _ in range(3)) if y else "") + " " + prose(rng, 20)
        docs.append((i, t))
        labels.append((i, y))
    docs += [(900, None), (901, ""), (None, "you idiot"), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxicity", F.lit("x"))
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    train = toxicity.training(lab)
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in train.where("doc_id is not null").collect()} == {1, 2, 3, 4}
    model = toxicity.fit(d, train)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(d, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) >= 0.95 * len(held)
    text_keys = lambda x: x.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    again = toxicity.score_toxicity(text_keys(d), toxicity.fit(text_keys(d), text_keys(train))).collect()
    assert sum((r["toxicity"] >= 0.5) == bool(dict(labels)[int(r["doc_id"][1:])]) for r in again if r["doc_id"] and int(r["doc_id"][1:]) < 240) >= 235
    none = toxicity.fit(d, lab.limit(0))
    assert {r["toxicity"] for r in toxicity.score_toxicity(d, none).collect()} == {0.5}
    assert toxicity.score_toxicity(d.limit(0), model).count() == 0


def test_lexicons_against_plain_counts(spark):
    rng = random.Random(25)
    rows = [(" ".join(rng.choice(["you", "fool", "sun", "sea", "blorp"][: 5 if i % 3 == 0 else 4]) for _ in range(8)), int(i % 3 == 0), i % 3 if i % 2 else (i // 3) % 3) for i in range(90)]
    got = toxicity.learn_lexicons(spark.createDataFrame([*rows, (None, 0, 1)], "text string, y int, fold int"))
    for left, words_ in zip((0, 1, 2, None), got, strict=True):
        own = [(set((t or "").split()), y) for t, y, f in [*rows, (None, 0, 1)] if f != left]
        a, b = (sum(y == k for _, y in own) for k in (1, 0))
        want = {}
        for w in {w for ws, _ in own for w in ws}:
            c1, c0 = (sum(w in ws for ws, y in own if y == k) for k in (1, 0))
            odds = math.log((c1 + 0.5) / (a + 1)) - math.log((c0 + 0.5) / (b + 1))
            if c1 and c0 + c1 >= toxicity.LEXICON_TEXTS and odds > 1:
                want[w] = odds
        assert set(want) == set(words_) and all(math.isclose(words_[w], want[w]) for w in want) and "blorp" in want


def plain_trees(x, y, trees, depth):
    """Boosted trees with every split of every node tried in turn: predictions for x."""
    f = [math.log(sum(y) / (len(y) - sum(y)))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in f]
        g, h = [a - b for a, b in zip(y, p)], [a * (1 - a) for a in p]
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            fresh = []
            for rows in nodes:
                best, cut = 1e-6, None
                gt, ht = sum(g[i] for i in rows), sum(h[i] for i in rows)
                for j in range(x.shape[1]) if len(rows) >= 10 else ():
                    for v in sorted({x[i, j] for i in rows}):
                        left = [i for i in rows if x[i, j] <= v]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                        if hl >= 0.5 and ht - hl >= 0.5 and gain > best + 1e-12:
                            best, cut = gain, (j, v)
                fresh += [rows] if cut is None else [[i for i in rows if (x[i, cut[0]] <= cut[1]) == side] for side in (True, False)]
            nodes = fresh
        for rows in nodes:
            step = 0.15 * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
            for i in rows:
                f[i] += step
    return f


def test_trees_against_plain_ones():
    rng = np.random.default_rng(26)
    x = rng.integers(0, 12, (120, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 3)).astype(float)
    y[rng.integers(0, 120, 10)] = 1
    got = toxicity.Trees(x, y, trees=4, depth=2).predict(x)
    assert np.allclose(got, plain_trees(x, y.tolist(), 4, 2))


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and len(toxicity.isotonic(np.zeros(0), np.zeros(0))[0]) == 0


# 5 decontamination


def contamination(docs, items):
    """(doc, words, hits, items) by comparing every window."""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(i)
    want = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= own
        want.append((str(i), len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None)), len(found)))
    return sorted(want)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 13, 12, 3, 20, 0, 26, 6, 5, 7])] + [(17, None), (2, prose(rng, 15)), (11, "one"), (None, prose(rng, 30)), (None, "null item"), (21, "null item"), (22, "the the the")]
    docs = []
    for i in range(80):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = split(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 1))
            parts += [" ".join(w[a : a + rng.randint(1, 20)]), prose(rng, rng.randint(0, 6))]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "the the the " * 20), (0, docs[0][1]), (None, items[0][1]), (None, items[0][1]), (103, f"{prose(rng, 30000)} {items[0][1]} {prose(rng, 30000)}")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("c", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(d, b).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"]), r["n_items"]) for r in got) == contamination(docs, items)
    dirty = {i for i, n, h, *_ in contamination(docs, items) if h and 20 * h >= n}
    kept = decontamination.keep_clean(d, b)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in dirty)
    one_each = d.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert {r["doc_id"] for r in decontamination.keep_clean(one_each, b).collect()} == {i for i, _ in docs if i is not None and str(i) not in dirty}
    assert all(r["n_hit"] == 0 for r in decontamination.find_contamination(d, b.limit(0)).collect())
    assert decontamination.find_contamination(d.limit(0), b).count() == 0 and decontamination.keep_clean(d.limit(0), b).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0]


def test_decontamination_by_merge_and_with_text_keys(spark):
    rng = random.Random(16)
    items = [(f"q{i}", prose(rng, 20)) for i in range(30)] + [(f"z{i}", "every item ends with these very words so that one window of all is the same") for i in range(30)]
    docs = [(f"d{i}", f"{prose(rng, 20)} {rng.choice(items)[1]} {prose(rng, 20)}" if i % 2 else prose(rng, 50)) for i in range(60)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = decontamination.find_contamination(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["n_items"]) for r in got) == contamination(docs, items)


# 6 repeated passages


def passage_docs(rng):
    shared, other = [prose(rng, 60) for _ in range(2)]
    docs = [(i, prose(rng, rng.randint(0, 120))) for i in range(20)]
    for i in range(20, 40):
        docs.append((i, " ".join([prose(rng, rng.randint(0, 40)), shared if i % 2 else other, prose(rng, rng.randint(0, 40))])))
    docs += [(50, docs[25][1]), (51, None), (52, ""), (None, docs[30][1]), (53, "ab " * 400), (54, docs[53 - 53][1]), (55, ("xy zw " + prose(rng, 49)) * 3)]
    return docs


def test_passages_against_brute_force(spark):
    docs = passage_docs(random.Random(7))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("spans", F.lit(0))
    own = collections.defaultdict(set)
    for i, t in docs:
        w = split(t)
        for j in range(len(w) - 50):
            own[tuple(w[j : j + 51])].add(i)
    got = {}
    for r in substrings.repeated_passages(d).collect():
        got[r["doc_id"]] = {w for x in [*r["spans"], *r["first_spans"]] for w in range(x >> 31, x & 0x7FFFFFFF)}
    for i, t in docs:
        w, hit = split(t), set()
        for j in range(len(w) - 50):
            if len(own[tuple(w[j : j + 51])]) > 1:
                hit.update(range(j, j + 51))
        assert hit <= got[i] and len(got[i]) <= 1.3 * len(hit) + 5 * bool(hit), i
    cut = {r["doc_id"]: r for r in substrings.cut_repeats(d).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values() if r["text"] is not None)
    left = [split(r["text"]) for r in cut.values()]
    seen = collections.Counter(x for w in left for x in {tuple(w[j : j + 51]) for j in range(len(w) - 50)})
    assert max(seen.values()) == 1 and {i for i, _ in docs if i is not None and i < 20 and i != 0} <= set(cut)
    assert substrings.repeated_passages(d.limit(0)).count() == 0


def equal_words(docs, n=50):
    """Words of each text in runs of n words that another text holds."""
    own = collections.defaultdict(set)
    for i, t in docs:
        w = split(t)
        for j in range(len(w) - n + 1):
            own[tuple(w[j : j + n])].add(i)
    out = {}
    for i, t in docs:
        w, out[i] = split(t), set()
        for j in range(len(w) - n + 1):
            if len(own[tuple(w[j : j + n])]) > 1:
                out[i].update(range(j, j + n))
    return out


def test_passages_of_frequent_lines_and_nested_ones(spark):
    rng = random.Random(12)
    lines = [prose(rng, 12) for _ in range(30)]
    docs = [(i, " ".join(f"{prose(rng, 40)} {x}" for x in rng.sample(lines, 12))) for i in range(60)]
    for i in range(60, 90, 2):
        # what two texts alone share is made of lines that stand in many others
        shared = " ".join(rng.sample(lines, 5))
        docs += [(j, f"{prose(rng, 30)} {shared} {prose(rng, 30)}") for j in (i, i + 1)]
    long = prose(rng, 160).split()
    docs += [(100 + k, f"{prose(rng, 20)} {' '.join(long[k * 7 : 160 - k * 6])} {prose(rng, 20)}") for k in range(8)]
    hit = equal_words(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = substrings.repeated_passages(d).collect()
    got = {r["doc_id"]: {w for x in [*r["spans"], *r["first_spans"]] for w in range(x >> 31, x & 0x7FFFFFFF)} for r in rows}
    assert [i for i, _ in docs if not hit[i] <= got[i]] == []
    assert all(len(hit[i]) >= 50 for i in range(60, 90))


def test_near_duplicate_passage(spark):
    rng = random.Random(8)
    w = prose(rng, 150).split()
    edited = list(w)
    edited[70] = "changed"
    d = spark.createDataFrame([(1, " ".join(w)), (2, "start here " + " ".join(edited) + " and end"), (3, prose(rng, 200))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.repeated_passages(d).collect()}
    both = [sum((x & 0x7FFFFFFF) - (x >> 31) for x in {*got[i]["spans"], *got[i]["first_spans"]}) for i in (1, 2)]
    assert min(both) >= 145 and got[3]["sources"] == []


def test_agreeing_windows_at_many_shifts():
    w = lambda shift, lo, f: (shift, lo, lo + 60, lo - shift, lo + 60 - shift, f)
    others = [w(100 * k, 10 + k % 3, 0) for k in range(1, 9)]
    assert (10, 72, 10, 72) in [x[:4] for x in substrings.together([w(0, 10, 0), *others, w(0, 12, 1)])]


def test_near_duplicate_passage_after_repeated_lines(spark):
    rng = random.Random(13)
    docs = []
    for i in range(0, 40, 2):
        lines = [prose(rng, 10) for _ in range(6)]
        passage = " ".join(lines).split()
        # the lines of the passage stand alone too, before it and after it, in either text
        before, after = (" ".join(f"{x} {prose(rng, 14)}" for x in lines for _ in range(3)) for _ in range(2))
        docs += [(i, f"{before} {' '.join(passage)} {prose(rng, 60)}"), (i + 1, f"{prose(rng, 60)} {' '.join([*passage[:30], 'changed', *passage[31:]])} {after}")]
    got = {r["doc_id"]: r for r in substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i, _ in docs if str(i ^ 1) not in map(str, got[i]["sources"]) and not got[i]["first_spans"]] == []


def test_pairs_behind_short_sharers(spark):
    rng = random.Random(31)
    docs = []
    for k in range(30):
        shared = prose(rng, 60).split()
        docs += [(100 * k + j, f"{prose(rng, 30)} {' '.join(shared)} {prose(rng, 30)}") for j in (0, 1)]
        docs += [(100 * k + 2 + j, f"{prose(rng, 40)} {' '.join(shared[j : j + 40])} {prose(rng, 40)}") for j in range(20)]
    got = {r["doc_id"]: r for r in substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[100 * k + j]["spans"] or got[100 * k + j]["first_spans"] for k in range(30) for j in (0, 1))


def test_fragments_of_all_lengths_against_brute_force(spark):
    rng = random.Random(32)
    sources = [prose(rng, 90).split() for _ in range(6)]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w, n = rng.choice(sources), rng.randint(20, 70)
            a = rng.randint(0, 90 - n)
            parts += [*w[a : a + n], *prose(rng, rng.randint(0, 8)).split()]
        docs.append((i, " ".join(parts)))
    hit = equal_words(docs, 51)
    got = {r["doc_id"]: {w for x in [*r["spans"], *r["first_spans"]] for w in range(x >> 31, x & 0x7FFFFFFF)} for r in substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i, _ in docs if not hit[i] <= got[i]] == []


def test_near_copies_behind_first_texts(spark):
    rng = random.Random(41)
    docs, near = [], []
    for k in range(20):
        shared = prose(rng, 64).split()
        changed = [*shared[:20], "changed", *shared[21:]]
        for j, w in enumerate((shared, changed)):
            near.append(100 * k + j)
            docs.append((100 * k + j, f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}"))
        # texts that hold a part of the passage, and so may be first in the groups of its windows
        docs += [(100 * k + 2 + j, f"{prose(rng, 40)} {' '.join(shared[j : j + 36])} {prose(rng, 40)}") for j in range(0, 28, 2)]
    got = {r["doc_id"]: r for r in substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i in near if not got[i]["spans"] and not got[i]["first_spans"]] == []
    assert sum(bool(got[i]["spans"]) and (i ^ 1) in got[i]["sources"] for i in near) == 20


def passages_of_all_pairs(docs):
    """Words of each text in passages that a text with a smaller hash holds, and in all that it shares, by aligning all pairs at all shifts."""
    import pyarrow as pa

    from plumbline.llm._contents import content_hashes
    from plumbline.llm._text import ALNUM as KEEP, grams

    seq, later, any_ = {}, collections.defaultdict(set), collections.defaultdict(set)
    for i, t in docs:
        for _, raw, off in slices(pa.array([t])):
            _, _, h, upto = words(raw, off, KEEP)
            seq[i] = int(content_hashes(h, upto, raw, off)[0, 0]), grams(h, substrings.SHINGLE).astype(np.uint32)
    for a, b in itertools.permutations(seq, 2):
        if seq[a][0] > seq[b][0] and len(np.intersect1d(seq[a][1], seq[b][1])) > 30:
            x, y = seq[a][1], seq[b][1]
            shifts = np.unique(np.subtract(*np.nonzero(x[:, None] == y[None, :]))).tolist()
            for s, e, s2, e2 in [*substrings.aligned(x, y, shifts), *substrings.passages(x, y)]:
                later[a].update(range(s, e + substrings.SHINGLE))
                any_[a].update(range(s, e + substrings.SHINGLE))
                any_[b].update(range(s2, e2 + substrings.SHINGLE))
    return later, any_


def test_edited_parts_of_passages_against_all_pairs(spark):
    rng = random.Random(1)

    def edited(w, rate):
        out = []
        for x in w:
            u = rng.random() / rate if rate else 1
            out += [prose(rng, 1)] if u < 0.6 else [] if u < 0.8 else [x, prose(rng, 1)] if u < 1 else [x]
        return out

    docs = []
    for _ in range(30):
        base = prose(rng, rng.randint(80, 260)).split()
        for _ in range(rng.randint(3, 10)):
            a = rng.randint(0, len(base) - 70)
            docs.append(" ".join([prose(rng, rng.randint(0, 40)), *edited(base[a : rng.randint(a + 55, len(base))], rng.choice([0, 0.01, 0.02, 0.04])), prose(rng, rng.randint(0, 40))]))
    docs = list(enumerate(docs))
    later, any_ = passages_of_all_pairs(docs)
    got = {r["doc_id"]: [{w for x in r[k] for w in range(x >> 31, x & 0x7FFFFFFF)} for k in ("spans", "first_spans")] for r in substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    print("words missed", sum(len(later[i] - got[i][0]) for i, _ in docs), sum(len(any_[i] - got[i][0] - got[i][1]) for i, _ in docs), "of", sum(map(len, any_.values())))
    assert [i for i, _ in docs if not later[i] <= got[i][0] or not any_[i] <= got[i][0] | got[i][1]] == []


def test_prints_stand_in_each_run():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    y = np.concatenate([rng.integers(0, 1 << 63, 70).astype(np.uint64), x[200 : 200 + substrings.RUN], x[:30]])
    texts = np.repeat([0, 1, 2], [400, 15, 85])
    at, v = substrings.prints(x, texts)
    assert all(((at >= i) & (at <= i + substrings.RUN - substrings.PRINT)).any() for i in range(500 - substrings.RUN + 1) if texts[i] == texts[i + substrings.RUN - 1])
    assert (texts[at] == texts[at + substrings.PRINT - 1]).all()
    assert set(v.tolist()) & set(substrings.prints(y, np.zeros(len(y), int))[1].tolist())


def test_spans_around_prints_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    n, m = 1500, 100
    at = pa.StructArray.from_arrays([pa.array(rng.integers(0, 20, n * m).astype(np.int32)) for _ in "pq"], names=["p", "q"])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m).astype(np.int32)), at)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.arange(n)), lists], names=["h", "r", "hits"]).slice(5)
    tracemalloc.start()
    out = next(substrings._around([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak", peak)
    assert peak < 20_000_000 and out.column(0).to_pylist() == list(range(5, n))
    assert out.column(6).to_pylist() == [sorted({x["p"] - x["q"] for x in hits}) for hits in lists.to_pylist()[5:]]


def test_reachable_parts_hold_all_passages():
    rng = random.Random(5)
    for _ in range(200):
        several = np.array([rng.random() < p for p in [rng.choice([0.5, 0.7, 0.8, 0.9, 1]) for _ in range(4)] for _ in range(30)])
        upto, found = np.concatenate([[0], np.cumsum(several)]), substrings.reachable(several)
        for a, b in itertools.combinations(np.flatnonzero(several).tolist(), 2):
            if upto[b + 1] - upto[a] >= max(41, substrings.SIMILARITY * (b - a + 1)):
                assert any(i <= a and b <= j for i, j in found)


def test_windows_are_deleted_before_texts_are_compared(spark, monkeypatch):
    rng = random.Random(43)
    shared = prose(rng, 60)
    docs = spark.createDataFrame([(i, f"{prose(rng, 20)} {shared} {prose(rng, 20)}") for i in range(4)], "doc_id long, text string")
    before, kept, verified = set(store._made), [], substrings._verified

    def spy(spans, seq):
        kept.extend(set(spark.read.parquet(p).columns) for p in store._made if p not in before)
        return verified(spans, seq)

    monkeypatch.setattr(substrings, "_verified", spy)
    got = substrings.repeated_passages(docs).collect()
    assert kept and not any(c >= {"keys", "places"} or c == {"b", "r"} for c in kept)
    assert sorted(len(r["spans"]) for r in got) == [0, 1, 1, 1]


def test_rarest_shingles_leave_one_in_place():
    counts = np.full(60, 9)
    counts[10:20] = 1
    counts[30] = 2
    found = substrings.rarest(counts)
    assert 30 in found and not set(found) & set(range(10, 20))
    counts[20:30] = 1
    assert len(substrings.rarest(counts[:50])) == 0 and len(substrings.rarest(counts[:10])) == 0


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_recall_of_passages_at_the_threshold(spark):
    rng = random.Random(14)
    docs, n = [], 300
    for i in range(0, 2 * n, 2):
        w = prose(rng, rng.randint(50, 60)).split()
        while True:
            v, at = list(w), rng.randrange(len(w))
            if rng.random() < 0.5:
                v[at] = "changed"
            else:
                v[at:at] = prose(rng, rng.randint(1, 10)).split()
            if 0.8 <= jaccard(w, v) < 0.9:
                break
        docs += [(j, f"{prose(rng, 40)} {' '.join(t)} {prose(rng, 40)}") for j, t in ((i, w), (i + 1, v))]
    got = {r["doc_id"]: r for r in substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = sum(bool(got[i]["spans"] or got[i]["first_spans"]) for i in range(0, 2 * n, 2))
    print("found", found, "of", n)
    assert found >= 0.98 * n


def test_passage_with_words_put_in():
    x = np.arange(1000, 1046 + 44, dtype=np.uint32)
    y = np.concatenate([x[:45], np.arange(13, dtype=np.uint32), x[45:]])
    assert substrings.aligned(x, y, [0]) == [(0, 89, 0, 102)]
    assert substrings.aligned(x, np.concatenate([x[:45], np.arange(30, dtype=np.uint32), x[45:]]), [0, -30]) == [(0, 44, 0, 44), (45, 89, 75, 119)]
    assert substrings.aligned(x[:40], y[:40], [0]) == []


def test_compact_windows_hold_the_least_hash():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    c, v, left, right = substrings.compact_windows(a, np.uint64(5))
    from plumbline.llm._text import mix

    h = mix(a ^ np.uint64(5)) | np.uint64(1)
    assert (h[c] == v).all()
    for k, lo, hi in zip(c, left, right):
        assert h[max(0, k - lo) : k + hi + 1].min() == h[k]
    least = {int(j + h[j : j + substrings.LEAST].argmin()) for j in range(len(h) - substrings.LEAST + 1)}
    assert least == set(c.tolist())
    cuts = [0, 30, 80, 126, 300, 400]
    both = substrings.compact_windows(a, np.uint64(5), np.repeat(np.arange(5), np.diff(cuts)))
    each = [substrings.compact_windows(a[i:j], np.uint64(5)) for i, j in zip(cuts, cuts[1:])]
    assert all((x == np.concatenate([e[k] + (i if k == 0 else 0) for e, i in zip(each, cuts)])).all() for k, x in enumerate(both))


# 7 near duplicates


def brute_classes(docs, weights=None):
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := split(t)) else None for i, t in docs}
    up = {i: i for i, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets.items(), 2):
        if s and t and len(s & t) >= 0.8 * len(s | t):
            up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i, _ in docs}


def near_docs(rng):
    docs = [(i, prose(rng, rng.randint(1, 80))) for i in range(30)]
    base = prose(rng, 200).split()
    for i in range(30, 70):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 20])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("leaders", [(1, 4), ()])
def test_near_duplicates(spark, monkeypatch, leaders):
    monkeypatch.setattr(near_dedup, "LEADERS", leaders)
    monkeypatch.setattr(near_dedup, "BLOCK", 4000)
    docs = near_docs(random.Random(10))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit(0))
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(d).collect()} == brute_classes(docs)


def test_near_duplicates_odd_rows(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "A b, c"), (3, None), (4, ""), (5, "..."), (6, "..."), (7, "!!"), (1, "a b c"), (None, "x y"), (None, "x y")], "doc_id long, text string")
    got = near_dedup.near_duplicates(d).collect()
    assert len(got) == 10 and {(r["doc_id"], r["class_id"]) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (None, None)}
    kept = near_dedup.keep_one(d).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == sorted([("1", "a b c"), ("5", "..."), ("7", "!!"), ("None", "x y")]) and len(kept) == 5
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0


def test_unrelated_long_texts_share_no_sample():
    rng = np.random.default_rng(41)
    sampler, n = near_dedup.Sampler(), 200_000
    x = rng.integers(0, 1 << 32, 2 * n, dtype=np.uint64).astype(np.uint32)
    a, b = sampler.bands(x, np.zeros(2 * n, np.float32), np.array([0, n]))
    assert not (a == b).any()
    short = sampler.bands(x, np.zeros(2 * n, np.float32), np.arange(0, 2 * n, 2000))
    assert all(len(set(short[:, k].tolist())) == len(short) for k in range(near_dedup.BANDS))


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(42)
    sampler, equal, want = near_dedup.Sampler(), 0, 0.0
    for _ in range(300):
        x = rng.integers(0, 1 << 32, 60, dtype=np.uint64).astype(np.uint32)
        wa, wb = rng.integers(1, 5, 50).astype(np.float32), rng.integers(1, 5, 50).astype(np.float32)
        wb[:35] = wa[:35]
        ids = np.concatenate([x[:50], x[10:]])
        a, b = sampler.bands(ids, np.log(np.concatenate([wa, wb[np.r_[10:50, 0:10]]])), np.array([0, 50]))
        full_a, full_b = dict(zip(x[:50].tolist(), wa.tolist())), dict(zip(x[10:].tolist(), wb[np.r_[10:50, 0:10]].tolist()))
        keys = {*full_a, *full_b}
        similarity = sum(min(full_a.get(k, 0), full_b.get(k, 0)) for k in keys) / sum(max(full_a.get(k, 0), full_b.get(k, 0)) for k in keys)
        equal += int((a == b).sum())
        want += near_dedup.BANDS * similarity**near_dedup.ROWS
    assert abs(equal - want) < 5 * math.sqrt(want)


def test_frequencies_against_plain_counts(spark):
    import pyarrow as pa

    rng = random.Random(43)
    line = prose(rng, 12)
    texts = [f"{prose(rng, rng.randint(0, 30))} {line if i % 3 == 0 else ''}" for i in range(200)] + [None, "", line, line]
    idf = near_dedup.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), "text")
    df = collections.Counter()
    for t in texts:
        w = split(t)
        df.update({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ())
    for t in texts[:40]:
        w = split(t)
        for _, raw, off in slices(pa.array([t])):
            _, _, h, upto = words(raw, off)
            _, shingle, _ = near_dedup.shingle_sets(h, upto, raw, off)
            want = sorted(max(1, 1 + math.log((len(texts) + 1) / (df[g] + 1)) / math.log(near_dedup.FREQUENT)) for g in ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ()))
            assert np.allclose(np.sort(idf.of(shingle)), want, rtol=1e-6)


def test_near_duplicates_of_long_texts_and_many_repeats(spark):
    rng = random.Random(44)
    long = prose(rng, 40_000).split()
    edited = [*long[:20_000], "x", *long[20_001:]]
    often = "ab cd ef gh ij " * 70_000
    d = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(edited)), (3, often), (4, often + "ab cd ef gh ij " * 100), (5, "ab cd ef gh ij " * 30_000), (6, prose(rng, 40_000))], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


# 8 chats


def test_chats(spark):
    conv = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["q"], None: ["q", "r"], 7: [None, ""]}
    rows = [(c, t, "user", x, 1) for c, xs in conv.items() for t, x in enumerate(xs)] + [(8, None, None, "z", 1), (8, 1, "user", "y", 1), (9, 5000, "user", "a", 1), (9, 1, "user", "k", 1)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    got = collections.defaultdict(list)
    for r in chat.format_chats(d).orderBy("conv_id", "position").collect():
        got[r["conv_id"]].append(r["rendered"])
    assert set(got) == {2, 4, None, 7, 8, 9}
    assert got[2] == [f"<|user|>\n{x}<|end|>\n" for x in "abc"] and got[8][1] == "<|>\nz<|end|>\n".replace("<|>", "<||>") and got[9][0] == "<|user|>\nk<|end|>\n"
    assert {r["conv_id"]: r["text"] for r in chat.render(chat.format_chats(d)).collect()}[4] == "".join(got[4])
    assert chat.format_chats(d.limit(0)).count() == 0


# 9 mixing


def test_mixing(spark):
    rng = random.Random(11)
    sizes = {"a": 900, "b": 10, "c": 400, None: 30}
    rows = [(len(s or "n") * 100000 + i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 20))), s) for s, n in sizes.items() for i in range(n)]
    rows += [(1, None, "a"), (None, "x y", "b"), (2, "", "zero")]
    d = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("x"))
    got = mixing.mix_sources(d).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    totals, order = collections.Counter(), ["a", "b", "c", "zero", None]
    for _, t, s in rows:
        totals[s] += len((t or "").split())
    weight, cap = dict(zip(order, [5, 2, 1, 5, 2])), {s: 3 * totals[s] for s in order}
    free, rest, want = set(order), sum(totals.values()), {}
    while True:
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > cap[s]]
        if not over:
            break
        for s in over:
            want[s] = cap[s]
            rest -= cap[s]
            free.discard(s)
    want |= {s: level * weight[s] for s in free}
    for s in order:
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert math.isclose(own.target.iloc[0], want[s]) and own.source_size.iloc[0] == totals[s] and abs(own.taken.sum() - want[s]) <= 20
    again = mixing.mix_sources(d.repartition(7)).toPandas()
    key = lambda x: sorted(zip(map(str, x.doc_id), x.taken))
    assert key(got) == key(again) and mixing.mix_sources(d.limit(0)).count() == 0


def test_mixing_of_equal_rows(spark):
    rng = random.Random(51)
    rows = [(None, "w " * 100, "a")] * 400 + [(i, "w " * rng.randint(1, 9), "b") for i in range(3000)] + [(7, "x " * 40, "c")] * 300 + [(None, None, None)] * 5 + [(9, "long " * 60_000, "d"), (8, "x", "d")]
    d = spark.createDataFrame(rows, DOCS).repartition(6)
    got = mixing.mix_sources(d).toPandas()
    assert len(got) == len(rows)
    for s in ("a", "b", "c"):
        own = got[got.source == s]
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 50, s
    again = mixing.mix_sources(d.coalesce(1)).toPandas()
    key = lambda x: sorted(zip(map(str, x.source), map(str, x.doc_id), x.taken))
    assert key(got) == key(again)


# 10 pages


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p>", ""), ("<html><body><nav>menu</nav></body></html>", ""),
    ("<head><title>t</title><style>p{}</style></head><body><nav><a>x</a></nav><div class='ad'>buy</div><article><h1>T &amp; x</h1><p><b>One<br><p>two\n three&nbsp;&lt;4</p><script>var t='</p>';</script></article><footer>f</footer>", "T & x\nOne\ntwo three <4"),
    ("<main><header><h1>H</h1></header><p>text here<div id=comments><p>c</p></div><aside>s</aside><form>q</form></main>", "H\ntext here"),
    ("<body><div class='menu'>m</div><p>" + "long words " * 20 + "</p><p>" + "more of it " * 20 + "</p></body>", ("long words " * 20).strip() + "\n" + ("more of it " * 20).strip()),
    ("<article><p>a<ul><li>b<li>c</ul><table><tr><td>d<td>e</table></article><div class='comments'><article>no</article></div>", "a\nb\nc\nd\ne"),
    ("<div class='page with-sidebar'><div class=nav>n</div><article>a b</article><div class='comments'><article>c</article></div></div>", "a b"),
    ("<article><p>one</p><![ if IE]><p>two</p><![x[ ]]><p>three</p><![endif]></article>", "one\ntwo\nthree"),
    ("<div class='story-intro'>" + "intro words " * 12 + "</div><div class='story-body'><p>" + "</p><p>".join(["body words " * 20] * 15) + "</p></div>", ("intro words " * 12).strip() + ("\n" + ("body words " * 20).strip()) * 15),
    ("<head><title>t</title><body><main><p>hello there</main>", "hello there"),
    ("<div class='sidebar-layout'><p>" + "long words " * 40 + "</p></div>", ("long words " * 40).strip()),
    ("<form><p>" + "long words " * 40 + "</p></form>", ("long words " * 40).strip()),
    ("<article><p>" + "text " * 80 + "</p><section class='related-work'><p>" + "prior work " * 40 + "</p></section><p class='notice'>" + "noted here " * 40 + "</p></article>", ("text " * 80).strip() + "\n" + ("prior work " * 40).strip() + "\n" + ("noted here " * 40).strip()),
    ("<div id=a><a href=x>Home</a><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>By us</p></div><div id=b><h2>Title</h2><p>" + "long words " * 40 + "</p><p>ok.</p><ul><li>one<li>two</ul><p>" + "more words " * 20 + "</p></div><div id=c><p>c 2020</p><p><a>x</a></p><p>y</p><p><a>z</a></p></div>", "Title\n" + ("long words " * 40).strip() + "\nok.\none\ntwo\n" + ("more words " * 20).strip()),
    ("<article>x<!-- c --><p hidden>h</p><p class='cookie-notice'>n</p>y</article>", "x\ny"),
])
def test_pages(html, text):
    assert html_text.main_text(html) == text


def test_pages_without_an_article_element():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"])["html"].to_pylist()[:100]
    bare = [h.replace("<article>", "<div class='x'>").replace("</article>", "</div>").replace('class="ad"', "class='y'") for h in pages]
    same = sum(html_text.main_text(a) == html_text.main_text(b) for a, b in zip(pages, bare))
    changed = sum(html_text.main_text(b, share=0) != html_text.main_text(b) for b in bare)
    assert same >= 0.8 * len(pages) and changed >= 0.8 * len(pages)


def test_pages_table(spark):
    d = spark.createDataFrame([(1, "u", "<article>é x</article>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert [tuple(r) for r in html_text.extract_text(d).select("page_id", "url", "text", "n_chars").orderBy("page_id").collect()] == [(1, "u", "é x", 3), (2, None, "", 0)]
    assert html_text.extract_text(d.limit(0)).count() == 0


def test_worker_memory():
    # one worker stays behind for each Python step of a stage, so that each must stay small
    code = """
import resource
import pyarrow as pa
from plumbline.llm import near_dedup, substrings
texts = [" ".join(f"w{(i * 7919 + j * j * (i + 1)) % 50021}" for j in range(300)) for i in range(100)] * 120
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["d", "text"])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
for rows in (near_dedup._set_rows([batch.select(["text"])]), substrings._window_rows([batch])):
    for _ in rows:
        pass
print(peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    assert float(out.stdout) < 65


def test_passages_that_are_held_are_not_looked_at():
    rng = np.random.default_rng(5)
    x = rng.permutation(1 << 20)[:120].astype(np.uint32)
    swapped = np.concatenate([x[60:], x[:60]])

    def found(y, held, held2):
        columns = {"h": [2], "r": [1], "lo": [1000], "lo2": [0], "shifts": [[1000]], "seq": [x.tobytes()], "seq2": [y.tobytes()], "held": pa.array([held], pa.list_(pa.int64())), "held2": pa.array([held2], pa.list_(pa.int64()))}
        return [tuple(r.values()) for b in substrings._verify([pa.RecordBatch.from_pydict(columns)]) for r in b.to_pylist()]

    own, other = (1000 << 31) + 1119, 119
    for y in (x, swapped):
        assert any(r[2:4] == (1000, 1124) for r in found(y, [], None))
        assert any(r[2:4] == (1000, 1124) for r in found(y, [own - 1], None))
        # the texts that hold it are named all the same
        assert any(r[4:] == (0, 124) for r in found(y, [own], []))
        assert any(r[4:] == (0, 124) for r in found(y, [own], [other]))
        assert not found(y, [own], None)


def test_matched():
    rng = np.random.default_rng(6)
    for n, k in ((0, 0), (0, 5), (5, 0), (40, 60), (90, 30)):
        x, y = rng.integers(0, 50, n).astype(np.uint32), rng.integers(0, 50, k).astype(np.uint32)
        m = substrings.Matched(x, y)
        assert m.both.tolist() == np.isin(x, y).tolist()
        assert m.back().tolist() == np.isin(y, x).tolist()
