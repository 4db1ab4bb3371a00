"""Every query against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from plumbline.plans import duck as duck_sql, source_queries
from plumbline.plans.queries import QUERIES

ORACLES = duck_sql.ORACLES | source_queries.ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def test_names_match():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_no_clones_where_nothing_counts_them(spark, monkeypatch):
    from plumbline.config import Config
    from plumbline.operators import structural
    from plumbline.plans import queries
    from plumbline.plans.adapters import Tables

    def never(*a):
        raise AssertionError("clones are looked for")

    monkeypatch.setattr(queries.clones, "clones_of", never)
    monkeypatch.setattr(queries, "stored", lambda df: df)
    t = Tables(spark, SF)
    fan = structural.fan(t.code, spark.createDataFrame([], "src string, dst string"))
    disabled = Config(disabled_metrics=frozenset({"duplication_pct"}))
    assert "raw" in queries.all_distributions(t, fan, disabled).columns
    assert "raw" in queries.all_distributions(t, fan, symbol="crate0::cust::C1").columns
    with pytest.raises(AssertionError):
        queries.all_distributions(t, fan)
    with pytest.raises(AssertionError):
        queries.all_distributions(t, fan, symbol="doc0::all")


def test_duplication_of_rows_counts_windows_at_many_places(spark, tmp_path):
    from plumbline.operators import clones, duplication
    from plumbline.plans.adapters import Tables

    shared = "\n".join(" ".join(f"w{10 * i + j}" for j in range(10)) for i in range(5))
    own = "\n".join(["own"] * 7)
    docs = [(i, f"a{i}\n{shared}\n" + own.replace("own", f"own{i}")) for i in range(203)] + [(900, "x " * 130)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    got = duplication.share(duplication.lines_of(clones.clones_of(t.sequences, 50, None, True)), t.blocks)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(duck_sql.sql("SELECT id, pct FROM {w_pct}")).df()
    assert (want["pct"] > 0).sum() > 203
    assert canonical(got.toPandas()) == canonical(want)


@pytest.mark.parametrize("name", ["metric_rows_all", "metric_rows_topk"])
def test_rows_have_no_limit_of_places(name):
    assert "places <=" not in ORACLES[name]
