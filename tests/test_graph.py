import random

import pytest

from plumbline.config import Config
from plumbline.operators import calls, complexity, structs, structural
from plumbline.schemas import UNITS

NAMES = [x.strip().split()[0] for x in UNITS.split(", ")]


def unit(i, name, kind="Function", file="f.rs", **more):
    base = {n: 0 for n in NAMES} | {"unit_ord": i, "id": name, "kind": kind, "file": file, "start_line": 1, "end_line": 5, "reads": [], "writes": [], "calls": [], "tags": [], "parent": None, "partial": False, "source_path": file}
    return tuple((base | more)[n] for n in NAMES)


def table(spark, units):
    return spark.createDataFrame(units, UNITS)


def linked(spark, units):
    u = table(spark, units)
    return sorted((r["src"], r["dst"]) for r in calls.edges(calls.unit_calls(u), u).collect())


def test_short_name(spark):
    assert linked(spark, [unit(0, "test::foo", calls=["bar"]), unit(1, "test::bar")]) == [("test::foo", "test::bar")]


def test_no_self_loop(spark):
    assert linked(spark, [unit(0, "test::foo", calls=["foo"])]) == []


def test_no_leak_to_another_crate(spark):
    assert linked(spark, [unit(0, "b::visitor::V::x", calls=["b::visitor::make_span"]), unit(1, "a::visitor::make_span")]) == []


def test_own_crate_first(spark):
    units = [unit(0, "a::u::make_span"), unit(1, "b::u::make_span"), unit(2, "b::u::go", calls=["make_span"])]
    assert linked(spark, units) == [("b::u::go", "b::u::make_span")]


def test_full_id_and_same_file(spark):
    units = [unit(0, "src/a.ts::f", file="src/a.ts", calls=["g", "lib::h"]), unit(1, "src/a.ts::g", file="src/a.ts"), unit(2, "lib::h"), unit(3, "src/b.ts::g", file="src/b.ts")]
    assert linked(spark, units) == [("src/a.ts::f", "lib::h"), ("src/a.ts::f", "src/a.ts::g")]


def test_method_call_and_ambiguous_path(spark):
    units = [unit(0, "c::m::f", calls=["obj.go", "x::go"]), unit(1, "c::T::go")]
    # the tail of a path that is a bare short name stands twice in the index
    assert linked(spark, units) == [("c::m::f", "c::T::go")]
    assert linked(spark, [unit(0, "c::m::f", calls=["x::go"]), unit(1, "c::T::go")]) == []
    assert linked(spark, [unit(0, "c::m::f", calls=["x::T::go"]), unit(1, "c::T::go")]) == [("c::m::f", "c::T::go")]


def test_two_spellings_are_two_edges(spark):
    assert len(linked(spark, [unit(0, "c::f", calls=["g", "c::g"]), unit(1, "c::g")])) == 2


def test_density_and_fans(spark):
    u = table(spark, [unit(i, x) for i, x in enumerate("abc")])
    e = spark.createDataFrame([("a", "b", "Calls"), ("b", "c", "Calls")], "src string, dst string, kind string")
    assert structural.dag_density(u, e).first()["dag_density"] == 1.0
    s = structural.fan_summary(structural.fan(u, e)).first()
    assert (s["fan_in_max"], s["fan_out_max"]) == (1, 1)
    star = spark.createDataFrame([("a", x, "Calls") for x in "bcd"], e.schema)
    s = structural.fan_summary(structural.fan(u, star)).first()
    assert (s["fan_in_max"], s["fan_out_max"]) == (1, 3)
    assert structural.dag_density(u.limit(0), e.limit(0)).first()["dag_density"] == 0
    assert structural.hubs(structural.fan(u, star), Config(hub_min_fan_in=0, hub_min_fan_out=3)).count() == 1


def test_size_and_cyclomatic(spark):
    u = table(spark, [unit(0, "a", start_line=1, end_line=5, branches=0), unit(1, "b", start_line=10, end_line=30, branches=5), unit(2, "c", start_line=40, end_line=100, branches=15), unit(3, "c", start_line=1, end_line=2)])
    got = {r["id"]: r for r in complexity.complexity(u.where("unit_ord < 3")).collect()}
    assert got["c"]["size"] == 61 and got["c"]["cyclomatic"] == 16
    assert {r["id"]: r["size"] for r in complexity.complexity(u).collect()}["c"] == 2  # the last one loaded


def test_methods_per_struct(spark):
    u = table(spark, [unit(0, "Foo", "Struct"), unit(1, "Bar", "Struct"), unit(2, "E", "Struct"), *[unit(3 + i, f"Foo::{i}", "Method", parent="Foo") for i in range(3)], unit(9, "Bar::x", "Method", parent="Bar"), unit(10, "Z::y", "Method", parent="Z")])
    assert {r["id"]: r["value"] for r in structs.methods_per_struct(u).collect()} == {"Foo": 3, "Bar": 1, "E": 0, "Z": 1}


@pytest.mark.parametrize("methods,expected", [
    ([dict(reads=["x"]), dict(writes=["x"])], 1),
    ([dict(reads=["x"]), dict(reads=["y"]), dict(reads=["z"])], 3),
    ([dict(reads=["x"], calls=["S::m1"]), dict(reads=["y"])], 1),
    ([dict(reads=["x"], calls=["self.m1"]), dict(reads=["y"])], 1),
    ([dict(reads=["x"])], 1),
    ([dict(reads=["x"]), dict(reads=["x"]), dict(reads=["y"])], 2),
])
def test_lcom(spark, methods, expected):
    u = table(spark, [unit(i, f"S::m{i}", "Method", parent="S", **m) for i, m in enumerate(methods)])
    assert structs.lcom4(u).first()["value"] == expected


def test_lcom_against_union_find(spark, monkeypatch):
    random.seed(3)
    rows, want = [], {}
    for s in range(12):
        n, up = random.randint(1, 9), {}
        fields = [random.sample(range(8), random.randint(0, 2)) for _ in range(n)]
        up = list(range(n))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in range(n):
            for b in range(a):
                if set(fields[a]) & set(fields[b]):
                    up[top(a)] = top(b)
        want[f"S{s}"] = sum(top(x) == x for x in range(n))
        rows += [unit(100 * s + i, f"S{s}::q{s}_{i}", "Method", parent=f"S{s}", reads=[f"f{x}" for x in f]) for i, f in enumerate(fields)]
    u = table(spark, rows)
    assert {r["id"]: r["value"] for r in structs.lcom4(u).collect()} == want
    monkeypatch.setattr(structs, "FOLD", 2)
    assert {r["id"]: r["value"] for r in structs.lcom4(u).collect()} == want


def test_index_holds_names_that_calls_ask_for(spark):
    u = table(spark, [unit(0, "a::f", calls=["g", "x.h", "p::k"]), unit(1, "a::g"), unit(2, "b::h"), unit(3, "a::k"), unit(4, "a::never")])
    kept = calls.asked_for(calls.name_index(u), calls.unit_calls(u))
    assert {r["id"] for r in kept.collect()} == {"a::g", "b::h", "a::k"}
