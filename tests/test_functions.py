import pytest
from pyspark.sql import functions as F

from plumbline.config import Config, Thresholds
from plumbline.functions import buckets, names
from plumbline.operators import distribution, rows


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"i int, v {kind}")


def test_thresholds(spark):
    t = Thresholds(0.5, 1, 1.5, 2)
    d = column(spark, [0.0, 0.49, 0.5, 0.99, 1.0, 1.5, 1.99, 2.0, 9.0])
    assert [r[0] for r in d.orderBy("i").select(buckets.bucket(buckets.severity("v", t))).collect()] == ["excellent", "excellent", "good", "good", "fair", "poor", "poor", "critical", "critical"]


def test_two_sided(spark):
    d = column(spark, [1.0, 2, 3, 4, 5, 19, 50, 250])
    got = [r[0] for r in d.orderBy("i").select(buckets.bucket(buckets.severity_two_sided("v", Config().function_size))).collect()]
    assert got == ["poor", "poor", "fair", "good", "excellent", "excellent", "fair", "critical"]


def test_size_low_side_needs_one_caller(spark):
    d = spark.createDataFrame([(2, 1), (2, 0), (3, 1), (250, 30)], "v int, f int")
    got = [r[0] for r in d.select(buckets.bucket(buckets.severity_size("v", "f", Config().function_size))).collect()]
    assert got == ["poor", "excellent", "fair", "critical"]


def test_names(spark):
    d = spark.createDataFrame([("a::b::C::m",), ("p.q::C.m",), ("x",)], "id string")
    got = d.select(names.crate_of("id"), names.local_name("id"), names.short_name("id"), names.simple_name("id")).collect()
    assert [tuple(r) for r in got] == [("a", "b::C::m", "m", "m"), ("p.q", "C.m", None, "m"), ("x", None, None, "x")]
    d = spark.createDataFrame([("a/b/__init__.py",), ("a/c.pyi",)], "p string")
    assert [r[0] for r in d.select(names.python_module("p")).collect()] == ["a.b", "a.c"]


def test_p90(spark):
    d = spark.createDataFrame([("cognitive", str(i), i) for i in range(1, 11)] + [("line_cov", str(i), 100 * (i > 0)) for i in range(10)], "metric string, id string, value bigint")
    got = {r["metric"]: r for r in distribution.summary(d, ("cognitive", "line_cov", "lcom")).collect()}
    assert got["cognitive"]["p90"] == 9 and got["line_cov"]["p90"] == 0 and got["lcom"]["n"] == 0


def suppressed(spark, metric, value, cyc, cog, symbol=None):
    d = [(metric, "s", value)] + [("cyclomatic", "s", cyc)] * (cyc is not None and metric != "cyclomatic") + [("cognitive", "s", cog)] * (cog is not None)
    fans = spark.createDataFrame([("s", 0, 0)], "id string, fan_in bigint, fan_out bigint")
    dist = spark.createDataFrame(d, "metric string, id string, value bigint")
    return rows.score(dist, fans, Config(), symbol).where(F.col("metric") == metric).count() == 0


@pytest.mark.parametrize("args,hidden", [(("fan_out", 40, 2, 1), True), (("fan_out", 40, 25, 1), False), (("fan_out", 40, 2, 20), False), (("fan_out", 40, None, None), True), (("cyclomatic", 30, None, 2), True), (("cyclomatic", 30, None, 25), False), (("params", 8, 2, 1), True), (("params", 8, 25, 1), False), (("params", 8, 2, 20), False)])
def test_suppression(spark, args, hidden):
    assert suppressed(spark, *args) == hidden
    assert not suppressed(spark, *args, symbol="s")


def test_config():
    c = Config.parse({"thresholds": {"lcom": {"excellent": 1, "good": 2, "fair": 3, "poor": 4}, "function_size": {"low": {"excellent": 9, "good": 8, "fair": 7, "poor": 6}}}, "hub": {"min_fan_in": 4}, "disabled_metrics": ["lcom"]})
    assert c.by_name("lcom").poor == 4 and c.function_size.low.poor == 6 and c.function_size.high.poor == 200 and c.hub_min_fan_in == 4 and c.is_disabled("lcom") and c.by_name("fan_in").poor == 15
    with pytest.raises(ValueError):
        Config.parse({"thresholds": {"lcom": {"excellent": 1}}})
    with pytest.warns(UserWarning):
        Config.parse({"disabled_metrics": ["nope"]})
    assert Config.parse(None) == Config()
