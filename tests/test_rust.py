from plumbline.extract import rust_units as R

SOURCE = r"""
//! docs { not a bracket
use std::fmt;

#[derive(Debug)]
pub struct Foo<T> { a: T, b: Vec<u8> }
pub struct Unit;

impl<T: Clone> Foo<T> {
    pub fn new(a: T, mut n: usize) -> Self { Self { a, b: helper(n) } }

    #[inline]
    fn run(&mut self, other: &Foo<T>, (x, y): (u8, u8)) -> Option<u8> {
        if x > 1 && y > 2 {
            self.b[0] += 1;
        } else if let Some(z) = other.a {
            for i in 0..3 { println!("{} {}", self.a, if i { 1 } else { 2 }); }
        } else {
            self.log.warn(|e| e || self.flag);
        }
        match x {
            1 => self.go(),
            2 | 3 => { Self::stat(crate::util::f(y)) }
            _ if x == 9 => super::up(),
            _ => {}
        }
        loop { self.n = other.count; }
    }
}

impl fmt::Display for Foo<u8> {
    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, "{}", '"') }
}

trait T { fn no(&self); fn default(&self) -> u8 { 1 } }

mod inner {
    pub async fn free<'a>(s: &'a str) -> &'a str where s: X { s.trim().len::<u8>(1); s }
}
"""


def test_rust():
    u = {x["id"]: x for x in R.units(SOURCE, "crates/my-lib/src/a/b.rs")}
    p = "my_lib::a::b"
    assert list(u) == [f"{p}::Foo", f"{p}::Unit", f"{p}::Foo::new", f"{p}::Foo::run", f"{p}::Foo::fmt", f"{p}::inner::free"]
    run = u[f"{p}::Foo::run"]
    assert (run["kind"], run["parent"], run["params"], run["start_line"], run["end_line"]) == ("Method", f"{p}::Foo", 2, 12, 28)
    assert run["branches"] == 1 + 1 + 1 + 1 + 1 + 3 + 1
    assert run["cognitive_complexity"] == 1 + 1 + 1 + 2 + 1 + 1 + 1 + 1
    assert run["max_scope_lines"] == 6
    assert run["writes"] == ["b", "n"] and run["reads"] == ["other.a", "log", "flag", "other.count"]
    assert run["calls"] == ["Some", "_.warn", "self.go", f"{p}::Foo::stat", "my_lib::util::f", "my_lib::a::up"]
    assert u[f"{p}::Foo::new"]["params"] == 2 and u[f"{p}::Foo::new"]["calls"] == ["helper"]
    assert u[f"{p}::inner::free"]["kind"] == "Function" and u[f"{p}::inner::free"]["calls"] == ["s.trim", "_.len"]


def test_paths():
    assert R.module_path("src/lib.rs") == ("crate",) and R.module_path("src/x/mod.rs", {"": "top-name"}) == ("top_name", "x")
    assert R.module_path("my-pkg/tests/it.rs") == ("it",)
    assert R.units("fn f( {", "src/lib.rs") == []


def test_crates(tmp_path):
    from plumbline.sources.files import rust_crates

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "Cargo.toml").write_text('[package]\nname = "the-x"\n')
    (tmp_path / "Cargo.toml").write_text("[workspace]\n")
    assert rust_crates(str(tmp_path)) == {"x": "the-x"} and R.module_path("x/src/y.rs", {"x": "the-x"}) == ("the_x", "y")
