import json
import subprocess

import pytest

from plumbline import cli
from plumbline.config import Config
from plumbline.extract import lexers, python_units as P
from plumbline.extract.tables import python_units, qualify_test_crates, tokenize
from plumbline.plans import report
from plumbline.sinks.writers import write_entries, write_tokens
from plumbline.sources import caches, files


def body(source):
    import ast

    return ast.parse(source).body


@pytest.mark.parametrize("source,n", [
    ("x = 1", 0), ("if a: pass", 1), ("if a:\n pass\nelif b:\n pass\nelse:\n pass", 2), ("if a and b: pass", 2),
    ("if a:\n pass\nelif b and c:\n pass", 2), ("for x in (a or b): pass", 1), ("while a or b: pass", 2),
    ("try:\n pass\nexcept A:\n pass\nexcept B:\n pass\nfinally:\n pass", 2), ("match x:\n case 1:\n  pass\n case 2:\n  pass", 1),
    ("x = a if b else c", 1), ("return_ = [y for y in z if y]", 0), ("def f():\n if a: pass", 0), ("with a:\n if b: pass", 1),
    ("if a:\n pass\nelse:\n if b:\n  pass", 2), ("f(a and b, k=c or d)", 1),
])
def test_branches(source, n):
    assert P.branches(body(source)) == n


@pytest.mark.parametrize("source,n", [
    ("if a:\n if b: pass", 3), ("if a:\n pass\nelif b:\n pass\nelse:\n pass", 3), ("for x in y:\n while z:\n  pass", 3),
    ("try:\n pass\nexcept A:\n if b: pass", 3), ("with a:\n if b: pass", 2), ("x = a and b and c", 2), ("x = a if b else c", 1),
    ("if a:\n x = b if c else d", 3), ("f(lambda: a if b else c)", 2), ("match x:\n case 1:\n  if a: pass", 3),
])
def test_cognitive(source, n):
    assert P.cognitive(body(source)) == n


def test_calls_and_fields():
    assert P.calls(body("a.b(c(), d=e())\nself.x(y)\na.b()\nz().w()\nf = lambda: q()")) == ["a.b", "c", "Self.x", "z"]
    reads, writes = P.fields(body("self.a = self.b\nself.c += 1\nself.m(self.d)\nself.e: int\nx = self.f.g"))
    assert reads == ["b", "c", "d", "f"] and writes == ["a", "c"]
    assert P.max_scope(body("if a:\n x\n y\nelse:\n z\nwith b:\n c")) == 5


def test_units():
    got = P.units("@d\ndef f(a, *b, **c): pass\nclass C:\n def m(self, x):\n  def inner(): pass\n  return self.y\n @staticmethod\n def s(z): pass\nif q:\n def hidden(): pass\n", "pkg/__init__.py")
    assert [(u["id"], u["kind"], u["parent"], u["params"], u["start_line"]) for u in got] == [
        ("pkg::f", "Function", None, 3, 1), ("pkg::C", "Struct", None, 0, 3), ("pkg::C.m", "Method", "pkg::C", 1, 4), ("pkg::C.m.inner", "Method", "pkg::C.m", 0, 5), ("pkg::C.s", "Method", "pkg::C", 1, 7),
    ]
    assert got[2]["reads"] == ["y"] and P.units("def (", "x.py") == []


def values(lang, source):
    return [t[0] for t in lexers.LEXERS[lang].tokens(source)]


def test_python_tokens():
    assert values("python", 'x = f"a" + rb\'b\' # c\nif y: return 1e-5 ** 2') == ["$ID", "=", "$LIT", "+", "$LIT", "if", "$ID", ":", "return", "$LIT", "**", "$LIT"]
    assert [t[1:] for t in lexers.PYTHON.tokens('a\n"""x\ny""" b')] == [(1, 0), (2, 0), (3, 5)]
    assert values("python", "a\n# t:ignore-start\nb c\n# t:ignore-end\nd") == ["$ID", "$ID"]
    assert [t[1] for t in lexers.PYTHON.tokens('"a\\\nb" c')] == [1, 1]


def test_other_tokens():
    assert values("typescript", "const f = (a?: T) => `x${b}`; // c\na ??= 0x1f; /* d\n*/ b") == ["const", "$ID", "=", "(", "$ID", "?", ":", "$ID", ")", "=>", "$LIT", ";", "$ID", "??=", "$LIT", ";", "$ID"]
    assert values("rust", "fn f<'a>(self) -> u8 { b'x' + r#\"y\"# /* a /* b */ */ .. 1.5 }") == ["fn", "$ID", "<", "'a", ">", "(", "$ID", ")", "->", "$ID", "{", "$LIT", "+", "$LIT", "..", "$LIT", "}"]
    assert values("go", "func f() { x := `a` + 'b' ; return }") == ["func", "$ID", "(", ")", "{", "$ID", ":=", "$LIT", "+", "$LIT", "return", "}"]


def test_token_file():
    data = caches.encode_tokens("a.py", 7, [("x", 1, 0), ("y", 2, 3), ("x", 3, 1)])
    assert caches.decode_tokens(data) == ("a.py", 7, [("x", 1, 0), ("y", 2, 3), ("x", 3, 1)])
    assert len(caches.encode_tokens("a.py", 7, [("x", 1, 0)] * 100)) < 1200
    for n in (2, 9, len(data) - 1):
        with pytest.raises(ValueError):
            caches.decode_tokens(data[:n])


def test_test_crates(spark):
    u = spark.createDataFrame([("it::a", "it", ["it::b", "lib::c"], "my-pkg/tests/it.rs"), ("x::a", None, ["x::b"], "my-pkg/src/x.rs")], "id string, parent string, calls array<string>, source_path string")
    got = sorted(tuple(r) for r in qualify_test_crates(u).select("id", "parent", "calls").collect())
    assert got == [("my_pkg::tests::it::a", "my_pkg::tests::it", ["my_pkg::tests::it::b", "lib::c"]), ("x::a", None, ["x::b"])]


SOURCE = "def a(x):\n    if x:\n        return b(x)\n    return 0\n\n\ndef b(y):\n    return y\n\n\nclass C:\n    def m(self):\n        return a(self.z)\n"


@pytest.fixture
def project(tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "m.py").write_text(SOURCE)
    (tmp_path / "skip.txt").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "n.py").write_text("def n(): pass")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    return tmp_path


def test_project(spark, project, tmp_path):
    paths = files.sources(str(project), "python")
    assert paths == ["pkg/m.py"]
    source = files.read(spark, str(project), paths)
    u, t = python_units(source, 5), tokenize(source)
    assert {r["id"] for r in u.collect()} == {"pkg.m::a", "pkg.m::b", "pkg.m::C", "pkg.m::C.m"}
    r = report.check(u, t, Config())
    assert sorted((x["src"], x["dst"]) for x in r.edges.collect()) == [("pkg.m::C.m", "pkg.m::a"), ("pkg.m::a", "pkg.m::b")]
    assert r.tsv(-1).startswith("scope: whole project\nmetric\tsymbol")
    import json

    out = json.loads(r.json())
    assert out["units"] == 4 and out["edges"] == 2 and out["metrics"]["complexity"]["cyclomatic"]["max"] == 2
    folder = tmp_path / "cache"
    assert write_entries(u, str(folder)) == 1 and write_tokens(t, str(folder), 5) == 1
    back = caches.read_units(spark, str(folder), 5)
    assert {(x["id"], x["params"], tuple(x["calls"])) for x in back.collect()} == {(x["id"], x["params"], tuple(x["calls"])) for x in u.collect()}
    assert caches.read_units(spark, str(folder), 6).count() == 0
    assert caches.read_tokens(spark, str(folder)).count() == t.count()
    (folder / "bad.tokens").write_bytes(b"\1")
    assert caches.read_tokens(spark, str(folder)).count() == t.count()


def test_cli(spark, project, capsys):
    args = ["--root", str(project)]
    assert cli.main([*args, "check", "-A", "-k", "3"], spark) == 0
    assert capsys.readouterr().out.startswith("scope: whole project")
    assert cli.main([*args, "check"], spark) == 0
    assert "uncommitted changes (4 units in 1 file)" in capsys.readouterr().out
    assert cli.main([*args, "get", "pkg.m::b"], spark) == 0
    assert capsys.readouterr().out == "def b(y):\n    return y\n"
    assert cli.main([*args, "ls", "--kind", "fn", "--json"], spark) == 0
    assert "pkg.m::a" in capsys.readouterr().out
    assert cli.main([*args, "check", "nope::x"], spark) == 1
    assert cli.main([*args, "ignore", "pkg.m::a", "lcom"], spark) == 0
    assert caches.Ignores(str(project / ".plumbline")).is_ignored("pkg.m::a", "lcom")
    assert cli.main([*args, "ignore", "pkg.m::a", "--remove"], spark) == 0 and not (project / ".plumbline" / "ignores.json").exists()
    assert cli.main([*args, "metrics", "get", "line_cov"], spark) == 0
    assert ">= 90" in capsys.readouterr().out


def test_cli_coverage_by_absolute_paths(spark, project, capsys, tmp_path):
    args = ["--root", str(project), "check", "-A", "-k", "-1"]
    body = "".join(f"DA:{i},1\n" for i in range(1, 40))
    for name, path in (("abs", project / "pkg" / "m.py"), ("rel", "pkg/m.py"), ("dots", "pkg/../pkg/./m.py")):
        (tmp_path / f"{name}.info").write_text(f"SF:{path}\n{body}BRDA:1,0,0,1\nend_of_record\n")
        assert cli.main([*args, "--cov", str(tmp_path / f"{name}.info")], spark) == 0
        got = capsys.readouterr()
        assert "line_cov" not in got.out and "warning" not in got.err, name
    (tmp_path / "other.info").write_text("SF:/elsewhere/m.js\nDA:1,1\nend_of_record\n")
    assert cli.main([*args, "--cov", str(tmp_path / "other.info"), "--cov", str(tmp_path / "none.info")], spark) == 0
    got = capsys.readouterr()
    assert "line_cov\tpkg.m::a\t0%" in got.out and "skipped --cov" in got.err and "none of which" in got.err and "no BRDA" in got.err


def test_cli_scope_lines_filter_and_cached_tokens(spark, project, capsys, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(project), "-c", "user.email=x@x", "-c", "user.name=x", *a], check=True, capture_output=True)
    if not (project / ".git").exists():
        git("init", "-q")
    git("add", "-A")
    git("commit", "-q", "-m", "one")
    git("branch", "-f", "main")
    git("checkout", "-q", "-b", "topic")
    (project / "pkg" / "n.py").write_text("def added(z):\n    if z:\n        return 1\n    return 2\n")
    git("add", "-A")
    git("commit", "-q", "-m", "two")
    root = ["--root", str(project)]
    assert cli.main([*root, "check"], spark) == 0
    assert "scope: branch diff vs main (1 unit in 1 file)" in capsys.readouterr().out
    assert cli.main([*root, "check", "pkg"], spark) == 0 and capsys.readouterr().out.startswith("scope: path pkg")
    assert cli.main([*root, "check", "pkg.m::a"], spark) == 0 and capsys.readouterr().out.startswith("scope: symbol pkg.m::a")
    (project / "sub").mkdir()
    assert cli.main([*root, "check", "--filter", "sub"], spark) == 0 and "(0 units in 0 files)" in capsys.readouterr().out
    assert cli.main([*root, "check", "--json", "-A"], spark) == 0 and '"mode": "whole-project"' in capsys.readouterr().out
    # two files of a language that only the cache knows, with the same tokens
    from plumbline.sources.caches import encode_tokens

    cache = tmp_path / "tokens"
    cache.mkdir()
    span = {"start_line": 1, "start_col": 0, "end_line": 60, "end_col": 0}
    for name in ("a.kt", "b.kt"):
        (cache / f"{name}.tokens").write_bytes(encode_tokens(name, 9, [(f"v{i}", i + 1, 0) for i in range(60)]))
        unit = {"id": f"{name}::f", "kind": "Function", "file": name, "span": span, "reads": [], "writes": [], "calls": [], "tags": []}
        (cache / f"{name}.json").write_text(json.dumps({"source_path": name, "units": [unit], "cached_at": 9}))
    assert cli.main([*root, "--cache", str(cache), "check", "-A", "-k", "-1"], spark) == 0
    assert "duplication_pct\ta.kt::f\t100" in capsys.readouterr().out
    assert cli.main([*root, "--cache", str(cache), "--generation", "10", "check", "-A", "-k", "-1"], spark) == 0
    assert "a.kt" not in capsys.readouterr().out
