"""Parts of unit ids and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def crate_of(unit_id) -> Column:
    """Before the first `::`; the whole id without one."""
    return F.substring_index(unit_id, "::", 1)


def local_name(unit_id) -> Column:
    """After the first `::`; null without one."""
    c = F.col(unit_id) if isinstance(unit_id, str) else unit_id
    return F.when(F.instr(c, "::") > 0, F.substr(c, F.instr(c, "::") + 2))


def short_name(unit_id) -> Column:
    """After the last `::` of the local name; null if that has none."""
    local = local_name(unit_id)
    return F.when(F.instr(local, "::") > 0, F.substring_index(local, "::", -1))


def simple_name(name) -> Column:
    """After the last `::`, then after the last `.`."""
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def python_module(path) -> Column:
    """Dotted module of a Python file; a package's __init__ is the package."""
    dotted = F.replace(F.regexp_replace(path, r"\.pyi?$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"\.__init__$", "")


def normalised(path, root: str) -> Column:
    """Absolute path, without `.`, `..` and doubled slashes; links are not followed."""
    c = F.col(path) if isinstance(path, str) else path
    absolute = F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(absolute, "/"), F.array().cast("array<string>"), step), "/"))


def within(path, *roots: str) -> Column:
    """A path relative to the first of these roots that it lies under; as it is, if it lies under none. Relative ones are under the first."""
    c = normalised(path, roots[0])
    out = F.when(F.lit(False), c)
    for r in roots:
        prefix = r.rstrip("/") + "/"
        out = out.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1)))
    return out.otherwise(c)


def in_path(file, path: str) -> Column:
    """The file itself, or a file in that folder."""
    c = F.col(file) if isinstance(file, str) else file
    p = path.rstrip("/")
    return (c == p) | c.startswith(p + "/")


def language(path) -> Column:
    """By extension; null for other files."""
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    return F.when(ext == "rs", "rust").when(ext.isin("ts", "tsx", "js", "jsx"), "typescript").when(ext.isin("py", "pyi"), "python").when(ext == "go", "go")


def cache_path(path, suffix: str = ".json") -> Column:
    """Mirrored name of a source file in a cache: the suffix is added, so a.ts and a.tsx stay apart."""
    return F.concat(F.col(path) if isinstance(path, str) else path, F.lit(suffix))


def test_crate_qualified(name, package: str, kind: str) -> Column:
    """Ids of test, bench and example crates start with package and kind."""
    return F.concat(F.lit(f"{package}::{kind}::"), name)


def truncated(text, n: int) -> Column:
    """Cut to n, the last three being dots."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, max(0, n - 3)), F.lit("..."))).otherwise(c)


def relative_target(call, root: str) -> Column:
    """Go call targets with an absolute file, relative to the module."""
    c = F.col(call) if isinstance(call, str) else call
    prefix = root.rstrip("/") + "/"
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)
