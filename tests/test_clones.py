import random

import pytest

from plumbline.operators import clones, duplication


def tokens(spark, files):
    return spark.createDataFrame([(f, i, str(v), i + 1, 0) for f, vs in files.items() for i, v in enumerate(vs)], "file string, pos bigint, value string, line bigint, col bigint")


def found(spark, files, k):
    return [tuple(r) for r in clones.find_clones(tokens(spark, files), k).collect()]


def brute(files, k):
    """Restates the rules: equal windows at up to 200 places, left-maximal, extended, not overlapping, unsubsumed by lines."""
    flat = [(f, i) for f in sorted(files) for i in range(len(files[f]) - k + 1)]
    by = {}
    for f, i in flat:
        by.setdefault(tuple(files[f][i : i + k]), []).append((f, i))
    out = []
    for places in by.values():
        if not 2 <= len(places) <= 200:
            continue
        for x in range(len(places)):
            for y in range(x + 1, len(places)):
                (fa, a), (fb, b) = places[x], places[y]
                if a and b and files[fa][a - 1] == files[fb][b - 1] or fa == fb and a + k > b:
                    continue
                n = k
                while a + n < len(files[fa]) and b + n < len(files[fb]) and not (fa == fb and a + n >= b) and files[fa][a + n] == files[fb][b + n]:
                    n += 1
                out.append((fa, a + 1, a + n, fb, b + 1, b + n, n))
    best = {}
    for c in out:
        best[c[:6]] = max(best.get(c[:6], 0), c[6])
    inside = lambda c, o: c[0] == o[0] and c[3] == o[3] and c[1] >= o[1] and c[2] <= o[2] and c[4] >= o[4] and c[5] <= o[5]
    return sorted((*c, n) for c, n in best.items() if not any(c != o and inside(c, o) for o in best))


def test_boundary(spark):
    files = {"a": range(10), "b": range(10)}
    assert len(found(spark, files, 10)) == 1 and not found(spark, files, 11)


def test_three_files(spark):
    assert len(found(spark, {x: range(60) for x in "abc"}, 50)) == 3


def test_self_clone(spark):
    block = list(range(30))
    assert [(r[0], r[3]) for r in found(spark, {"a": [*block, "x", *block]}, 20)] == [("a", "a")]


def test_subsumption(spark):
    c = spark.createDataFrame([("a", 1, 20, "b", 1, 20, 60), ("a", 5, 15, "b", 5, 15, 50)], "file_a string, start_line_a bigint, end_line_a bigint, file_b string, start_line_b bigint, end_line_b bigint, token_count bigint")
    assert [r["token_count"] for r in clones.unsubsumed(c).collect()] == [60]


def test_empty(spark):
    assert found(spark, {"a": [1]}, 5) == []
    assert clones.find_clones(tokens(spark, {"a": [1]}).limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        clones.find_clones(tokens(spark, {"a": [1]}), 0)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    random.seed(seed)
    block = [random.randint(0, 5) for _ in range(14)]
    files = {}
    for f in "abc":
        files[f] = [x for _ in range(3) for x in ([random.randint(0, 3) for _ in range(6)] + (block[: random.randint(5, 14)] if random.random() < 0.8 else []))]
    assert sorted(found(spark, files, 4)) == brute(files, 4)


def test_only_windows_that_clones_begin_with_are_sent(spark):
    block = list(range(2000))
    t = tokens(spark, {"a": [*block, -1], "b": [-2, *block], "c": [-3, *block[:700], -4, *block[:30], -5]})
    grams = clones.starts(clones.sequences(t), 50)[0]
    # of 4,600 windows that repeat
    assert grams.count() < 200
    order = ("file_a", "pos_a", "file_b", "pos_b")
    got = clones.candidates(grams, 50).orderBy(*order).collect()
    assert len(got) == 3 and got == clones.candidates(clones.windows(t, 50), 50).orderBy(*order).collect()
    assert sorted(found(spark, {"a": block, "b": [-2, *block]}, 50)) == [("a", 1, 2000, "b", 2, 2001, 2000)]


def whole(files, k):
    """All clones, subsumed ones too: as brute, without a limit of places."""
    out = []
    flat = [(f, i) for f in sorted(files) for i in range(len(files[f]) - k + 1)]
    for x, (fa, a) in enumerate(flat):
        for fb, b in flat[x + 1 :]:
            if files[fa][a : a + k] != files[fb][b : b + k] or a and b and files[fa][a - 1] == files[fb][b - 1] or fa == fb and a + k > b:
                continue
            n = k
            while a + n < len(files[fa]) and b + n < len(files[fb]) and not (fa == fb and a + n >= b) and files[fa][a + n] == files[fb][b + n]:
                n += 1
            out.append((fa, a + 1, a + n, fb, b + 1, b + n, n))
    return sorted(out)


def test_windows_at_any_number_of_places(spark):
    # 230 places after others; 229 after others again, whose second windows stand at 230, 229 of them after one token; and the starts of 30 files
    files = {f"f{i:03}": [f"x{i}", *range(6), f"y{i % 7}"] for i in range(230)} | {f"g{i:03}": [f"z{i}", "p" if i else "q", *range(20, 26)] for i in range(230)} | {f"h{i:02}": [*range(40, 46), i % 2] for i in range(30)}
    t = clones.sequences(tokens(spark, files))
    got = sorted(tuple(r) for r in clones.maximal(*clones.starts(t, 6), 6, None).collect())
    assert len(got) == 230 * 229 // 2 + 229 * 228 // 2 + 229 + 30 * 29 // 2 and got == whole(files, 6)
    # the limit stays where it is asked for
    assert clones.maximal(*clones.starts(t, 6), 6).count() == 30 * 29 // 2


def spread(found):
    return {(f, line) for r in found for f, s, e in ((r[0], r[1], r[2]), (r[3], r[4], r[5])) for line in range(s, e + 1)}


@pytest.mark.parametrize("seed", range(4))
def test_lines_of_all_clones(spark, seed, monkeypatch):
    monkeypatch.setattr(clones, "PAIRS", 3)
    random.seed(seed)
    files = {}
    for i in range(40):
        block = [random.randint(0, 2) for _ in range(random.randint(1, 5))] if i % 2 else [10 * i + j for j in range(random.randint(2, 9))]
        files[f"f{i:02}"] = [x for _ in range(random.randint(1, 9)) for x in (*block, *([random.randint(100, 400)] if random.random() < 0.4 else []))]
    got = clones.clones_of(clones.sequences(tokens(spark, files)), 4, None, True).collect()
    assert {(r["file"], line) for r in got for line in range(r["start_line"], r["end_line"] + 1)} == spread(whole(files, 4))


def test_lines_of_windows_at_many_places(spark):
    files = {f"f{i:03}": [*range(6), f"y{i}", f"z{i}"] for i in range(230)}
    t = clones.sequences(tokens(spark, files))
    got = clones.clones_of(t, 6, None, True).collect()
    assert {(r["file"], line) for r in got for line in range(r["start_line"], r["end_line"] + 1)} == {(f, i + 1) for f in files for i in range(6)}
    with pytest.raises(ValueError):
        clones.clones_of(t, 6, 200, True)


def test_sequences_of_texts_that_share_a_key(spark, tmp_path):
    from plumbline.plans.adapters import Tables

    spark.createDataFrame([(1, "a b\n\nc_1, a"), (2, ""), (3, None), (4, "x\ny"), (4, "z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    got = {r["file"]: (r["h"], r["l"]) for r in t.sequences.collect() if r["h"]}
    want = {r["file"]: (r["h"], r["l"]) for r in clones.sequences(t.tokens.where("file <> 'doc4'")).collect()}
    assert got.pop("doc4")[1] == [1, 1, 2] and got == want and got["doc1"][1] == [1, 1, 3, 3, 3]


def pct(spark, pairs, units):
    c = spark.createDataFrame(pairs, "file_a string, start_line_a bigint, end_line_a bigint, file_b string, start_line_b bigint, end_line_b bigint, token_count bigint")
    u = spark.createDataFrame(units, "id string, file string, start_line bigint, end_line bigint, kind string")
    return {r["id"]: r["pct"] for r in duplication.duplication(c, u).collect()}


def test_duplication(spark):
    assert pct(spark, [("f", 1, 25, "z", 1, 25, 50)], [("u", "f", 1, 100, "Function")]) == {"u": 25.0}
    assert round(pct(spark, [("f", 15, 30, "z", 1, 16, 50)], [("u", "f", 20, 40, "Function")])["u"]) == 52
    got = pct(spark, [("f", 10, 29, "z", 1, 20, 50)], [("impl", "f", 1, 100, "Struct"), ("m", "f", 10, 29, "Method")])
    assert got == {"impl": 0.0, "m": 100.0}
    assert pct(spark, [("f", 1, 10, "z", 1, 10, 50)], [("u", "f", 20, 40, "Function")]) == {"u": 0.0}
