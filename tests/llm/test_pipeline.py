"""The chain of stages on planted cases, and the queries that have SQL against DuckDB."""

import os
import random

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    shared, item = prose(rng, 70), prose(rng, 40)
    docs = [(i, prose(rng, 120), "en", f"s{i % 3}") for i in range(60)]
    docs += [(100 + i, prose(rng, 60) + " you idiot moron scum trash " + prose(rng, 30), "en", "s0") for i in range(40)]
    docs += [(200, docs[5][1], "en", "s1"), (201, docs[6][1] + " tail", "en", "s1"), (202, prose(rng, 50) + " " + shared, "en", "s1"), (203, shared + " " + prose(rng, 50), "en", "s2"), (204, prose(rng, 30) + " " + item, "en", "s2")]
    d = spark.createDataFrame([(*r, len(r[1])) for r in docs], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(100 <= r[0] < 200)) for r in docs if r[0] < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= set(rows) and not {i for i in rows if 100 <= i < 200}
    assert not {200, 201, 204} & set(rows)
    assert sum(shared in rows[i]["text"] for i in (202, 203)) == 1 and {202, 203} <= set(rows)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns, name
    assert P.ORACLE_SQL is None and len(P.STAGES) == 5


def test_stages_on_odd_and_on_no_rows(spark, tmp_path):
    import collections

    import corpus_pipeline as P

    rng = random.Random(14)
    plain = prose(rng, 80)
    odd = [(1, None, None, None, None), (None, None, "en", "s0", 0), (2, "", "en", "s0", 0), (None, plain, None, None, 9), (3, plain, "en", "s1", len(plain)), (3, plain, "en", "s1", len(plain)), (4, prose(rng, 20_000), "en", None, 1), (5, "!!!", "en", "s1", 3)]
    docs = odd + [(10 + i, prose(rng, rng.randint(1, 300)) + (" you idiot moron scum" if i % 4 == 0 else ""), "en", "s0", 9) for i in range(200)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, size string, _d long, c int, _x long, _h string, _c1 int"
    d = spark.createDataFrame([(*r, "x", 1, 2, 3, "y", 4) for r in docs], kinds)
    spark.createDataFrame([(10 + i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, None, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(rng, 30)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (r["doc_id"], r["text"])
    for name, stage in P.STAGES:
        got = stage(spark, d, str(tmp_path))
        rows = collections.Counter(map(key, got.collect()))
        if name != "mixing":
            assert got.columns == d.columns, name
        want = collections.Counter((r[0], r[1]) for r in odd)
        if name == "near_dedup":
            assert sum(n for (_, t), n in rows.items() if t == plain) == 1 and sum(n for (_, t), n in rows.items() if not t) == 1
            assert rows[4, odd[6][1]] == rows[5, "!!!"] == 1
        elif name == "substring_dedup":
            # the text of key 3 stands first, also for the row without a key
            assert sum(n for (_, t), n in rows.items() if t == plain) == 2 and (None, plain) not in rows and rows[4, odd[6][1]] == 1
        else:
            assert {k: rows[k] for k in want} == want, name
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["op5_decontamination", "op8_chat_format", "op9_mix_sources"])
def test_sql(spark, name):
    from plumbline.llm.registry import QUERIES, SQL

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.sql(SQL[name]).df()
    rows = lambda x: sorted(map(str, x[sorted(got.columns)].round(6).astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
