from plumbline.operators import coverage, scope
from plumbline.sources import diff, lcov


def units(spark, rows):
    return spark.createDataFrame([(i, f, s, e, k, p) for i, f, s, e, k, p in rows], "id string, file string, start_line bigint, end_line bigint, kind string, parent string")


def report(spark, text):
    return lcov.parse(spark.createDataFrame([("r", text)], "input string, content string"), "/root")


def one(spark, text, rows):
    da, br = report(spark, text)
    return {r["id"]: r for r in coverage.coverage(units(spark, rows), da, br).collect()}, (da, br)


F1 = [("u", "/root/a.rs", 1, 10, "Function", None)]


def test_line_cov(spark):
    got, _ = one(spark, "SF:a.rs\nDA:2,1\nDA:4,0\nDA:6,3\nDA:8,0\nend_of_record\n", F1)
    assert got["u"]["line_cov"] == 50


def test_nested_unit_takes_its_lines(spark):
    got, _ = one(spark, "SF:/root/a.rs\nDA:5,1\nDA:25,1\nend_of_record", [("outer", "/root/a.rs", 1, 50, "Function", None), ("inner", "/root/a.rs", 20, 30, "Function", None)])
    assert got["outer"]["line_cov"] == got["inner"]["line_cov"] == 100 and got["outer"]["total"] == 1


def test_no_data_and_mismatch(spark):
    got, (da, br) = one(spark, "", F1)
    assert got["u"]["line_cov"] == 0
    c = coverage.counters(units(spark, F1), da, br)
    assert c.first()["units_without_data"] == 1
    _, (da, br) = one(spark, "SF:/x/a.js\nDA:1,1\nend_of_record", F1)
    c = coverage.counters(units(spark, F1), da, br)
    assert (c.first()["lcov_files_total"], c.first()["lcov_files_matched"]) == (1, 0)
    assert {r[0] for r in coverage.warnings(c).collect()} == {"no_file_matches", "no_branch_records"}


def test_records(spark):
    text = "DA:1,5\nSF:a.rs\nDA:1,1,abc\nDA:1,2\nDA:x,1\nDA:2,-1\nDA:3\nBRDA:1,0,0,1\nBRDA:1,0,1,0\nBRDA:2,0,0,-\nBRDA:3,0,0\nend_of_record\nDA:9,9\n"
    da, br = report(spark, text)
    assert sorted((r["line"], r["hits"]) for r in da.collect()) == [(1, 1), (1, 2)]
    assert sorted((r["line"], r["taken"]) for r in br.collect()) == [(1, 0), (1, 1), (2, 0)]
    assert coverage.merge_lines(da).first()["hits"] == 3
    got, _ = one(spark, text, F1)
    assert got["u"]["uncov_branches"] == 2


def hunks(spark, text):
    return [(r["file"], r["start_line"], r["end_line"]) for r in diff.parse(spark.createDataFrame([("d", text)], "input string, content string")).collect()]


def test_diff(spark):
    assert hunks(spark, "+++ b/a.rs\n@@ -8,0 +10,3 @@ fn\n+x\n@@ -40 +41 @@\n") == [("a.rs", 10, 12), ("a.rs", 41, 41)]
    assert hunks(spark, "+++ b/a.rs\n@@ -12,2 +11,0 @@\n@@ -1,2 +0,0 @@\n") == [("a.rs", 11, 12), ("a.rs", 1, 1)]
    assert hunks(spark, "+++ /dev/null\n@@ -1 +1 @@\n+++ b/n.rs\n@@ -0,0 +1,5 @@\n") == [("n.rs", 1, 5)]


def test_scope_closes_over_parents(spark):
    u = units(spark, [("S", "a.rs", 1, 3, "Struct", None), ("S::m", "a.rs", 10, 20, "Method", "S"), ("S::n", "a.rs", 30, 40, "Method", "S"), ("b", "b.rs", 1, 9, "Function", None)])
    changed = spark.createDataFrame([("a.rs", False, 15, 15)], "file string, whole_file boolean, start_line bigint, end_line bigint")
    ids, files = scope.display_scope(u, changed)
    assert {r["id"] for r in ids.collect()} == {"S", "S::m"} and [r[0] for r in files.collect()] == ["a.rs"]
    both = scope.union_changes(changed, spark.createDataFrame([("a.rs",), ("b.rs",)], "file string"))
    assert {r["id"] for r in scope.changed_units(u, both).collect()} == {"S", "S::m", "S::n", "b"}
    assert scope.describe("uncommitted", 1, 2) == "uncommitted changes (1 unit in 2 files)"


def test_stream(spark, tmp_path):
    import json

    from plumbline.streaming.watch import lines_by_file, unit_stream

    unit = lambda i, end: {"id": i, "kind": "Function", "file": "a.rs", "span": {"start_line": 1, "start_col": 0, "end_line": end, "end_col": 0}, "reads": [], "writes": [], "calls": [], "tags": []}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rs.json").write_text(json.dumps({"source_path": "a.rs", "cached_at": 3, "units": [unit("x", 9), unit("y", 20)]}))
    q = lines_by_file(unit_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("watched").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("watched").collect()] == [("a.rs", 3, 20, 2)]
