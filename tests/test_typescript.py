import pytest

from plumbline.extract import typescript_units as T
from plumbline.extract.tables import source_units

SOURCE = """
import { x } from './x';
export async function load(a: string, { b }: P, ...rest: T[]): Promise<Map<string, T>> {
  if (a && b) { return run(a); } else if (!a) { throw new Err.Bad('x'); } else { skip(); }
  function inner(q) { for (const z of q) { z.go(); } }
  items.map((i) => i.deep ? other() : 1);
  return a ? b : rest;
}
const add = (m: number, n = 2) => m > n ? call(m.size) : n || 0;
const plain = 5;
@dec()
export default class Box<T> extends Base implements I {
  private n = 0;
  handler = () => { hidden(); };
  constructor(private readonly s: S, k: number) { super(); this.n = k; }
  get size(): number { return this.n; }
  set size(v) { this.n += v.len; v.total++; }
  static async #secret() { while (true) { do { this.tick(); } while (a); } }
  run(p?: P): void {
    switch (p.kind) {
      case 1: this.n++; break;
      case 2: { break; }
      default:
    }
    try { this.box.open(); } catch (e) { if (e) { log?.warn(e); } }
  }
}
"""


def by_id(source=SOURCE):
    return {u["id"].removeprefix("a.ts::"): u for u in T.units(source, "a.ts")}


def test_units():
    u = by_id()
    assert list(u) == ["load", "load::inner", "add", "Box", "Box::constructor", "Box::get_size", "Box::set_size", "Box::secret", "Box::run"]
    assert [u[k]["kind"] for k in ("load", "Box", "Box::run")] == ["Function", "Struct", "Method"]
    assert u["Box::run"]["parent"] == "a.ts::Box" and u["load::inner"]["parent"] is None
    assert [u[k]["params"] for k in ("load", "add", "Box::constructor", "Box::run")] == [3, 2, 1, 1]
    assert (u["load"]["start_line"], u["load"]["end_line"]) == (3, 8) and (u["Box"]["start_line"], u["Box"]["end_line"]) == (12, 27)


def test_measures():
    u = by_id()
    assert u["load"]["branches"] == 4 and u["load"]["cognitive_complexity"] == 1 + 1 + 1 + 1 + 1
    assert u["load::inner"]["branches"] == 1 and u["add"]["branches"] == 2 and u["add"]["max_scope_lines"] == 0
    assert u["Box::run"]["branches"] == 3 and u["Box::run"]["cognitive_complexity"] == 1 + 1 + 2 and u["Box::run"]["max_scope_lines"] == 5
    assert u["Box::secret"]["branches"] == 2 and u["Box::secret"]["cognitive_complexity"] == 1 + 2


def test_calls_and_fields():
    u = by_id()
    assert u["load"]["calls"] == ["run", "Err.Bad", "skip", "items.map"] and u["add"]["calls"] == ["call"]
    assert u["Box::run"]["calls"] == ["this.box.open", "log.warn"]
    assert (u["Box::run"]["reads"], u["Box::run"]["writes"]) == (["p.kind", "box"], ["n"])
    assert (u["Box::set_size"]["reads"], u["Box::set_size"]["writes"]) == (["v.len"], ["n", "v.total"])
    assert u["Box::get_size"]["reads"] == ["n"] and u["add"]["reads"] == ["m.size"]


@pytest.mark.parametrize("source,name", [("export default () => 1", "default"), ("export default function () { }", "default"), ("export default async (a) => { b(); }", "default"), ("const f = function g(a) { return a }", "f"), ("let h = async x => x", "h")])
def test_values(source, name):
    assert list(by_id(source)) == [name]


def test_table(spark):
    files = spark.createDataFrame([("a.ts", SOURCE), ("b.py", "def f(): pass"), ("k/tests/c.rs", "fn r() { c::s() }"), ("m.c", "x"), ("d.js", "function f( {")], "path string, content string")
    assert {r["id"] for r in source_units(files).where("file <> 'a.ts'").collect()} == {"b::f", "k::tests::c::r"} and source_units(files).count() == 11
    assert source_units(files).where("file = 'k/tests/c.rs'").first()["calls"] == ["k::tests::c::s"]


def test_regular_expressions_hold_no_brackets():
    source = "export function a(x: string) {\n  if (/[({`'\"]/.test(x)) {\n    return x.replace(/\\/{2}/g, '/') + 6 / 2 / 1;\n  }\n  return x;\n}\nfunction b(y) { return y / 2 }\n"
    found = {u["id"].split("::")[1]: u for u in T.units(source, "r.ts")}
    assert set(found) == {"a", "b"} and found["a"]["end_line"] == 6 and found["a"]["branches"] == 1
    assert len(T.mask_regexes(source)) == len(source)
