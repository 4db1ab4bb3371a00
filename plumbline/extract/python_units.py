"""Units of Python source: functions, methods and classes with what metrics need, from the standard parser.

What an analysis looks into is a table from node types to their parts; other
expressions are leaves to it.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
TRIES = (ast.Try, ast.TryStar)
WITHS = (ast.With, ast.AsyncWith)

_COMMON = {
    ast.BoolOp: ("values",),
    ast.BinOp: ("left", "right"),
    ast.UnaryOp: ("operand",),
    ast.IfExp: ("test", "body", "orelse"),
    ast.Compare: ("left", "comparators"),
    ast.Attribute: ("value",),
    ast.Subscript: ("value", "slice"),
    ast.Starred: ("value",),
    ast.Await: ("value",),
    ast.List: ("elts",),
    ast.Tuple: ("elts",),
    ast.Dict: ("keys", "values"),
}
_YIELDS = {ast.Yield: ("value",), ast.YieldFrom: ("value",), ast.Set: ("elts",)}
#: Parts of expressions that fields are read in; that calls are found in; that branches are counted in; that nest.
READ_IN = _COMMON | {ast.Call: ("func", "args")}
CALLED_IN = _COMMON | _YIELDS | {ast.Call: ("args", "func")}
BRANCH_IN = _COMMON | _YIELDS | {ast.Call: ("func", "args"), ast.Lambda: ("body",), ast.ListComp: ("elt",), ast.SetComp: ("elt",), ast.GeneratorExp: ("elt",)}


def parts(e: ast.expr, table: dict) -> Iterator[ast.expr]:
    if isinstance(e, ast.Dict) and ast.Dict in table:
        for k, v in zip(e.keys, e.values, strict=True):
            yield from (x for x in (k, v) if x is not None)
        return
    for name in table.get(type(e), ()):
        found = getattr(e, name)
        yield from found if isinstance(found, list) else [found] * (found is not None)


def clauses(node: ast.If) -> tuple[list[tuple[ast.expr, list[ast.stmt]]], list[ast.stmt]]:
    """Test and body of if and each elif, and the body of else."""
    out = [(node.test, node.body)]
    rest = node.orelse
    while len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == node.col_offset:
        out.append((rest[0].test, rest[0].body))
        rest = rest[0].orelse
    return out, rest


def blocks(s: ast.stmt) -> list[list[ast.stmt]]:
    """Bodies of a compound statement, in order; none of a nested definition."""
    if isinstance(s, ast.If):
        tests, rest = clauses(s)
        return [b for _, b in tests] + [rest]
    if isinstance(s, LOOPS):
        return [s.body, s.orelse]
    if isinstance(s, TRIES):
        return [s.body, *(h.body for h in s.handlers), s.orelse, s.finalbody]
    if isinstance(s, ast.Match):
        return [c.body for c in s.cases]
    return [s.body] if isinstance(s, WITHS) else []


def branches(body: list[ast.stmt]) -> int:
    def expr(e: ast.expr | None) -> int:
        if e is None:
            return 0
        own = len(e.values) - 1 if isinstance(e, ast.BoolOp) else int(isinstance(e, ast.IfExp))
        return own + sum(map(expr, parts(e, BRANCH_IN)))

    total = 0
    for s in body:
        if isinstance(s, ast.If):
            total += len(clauses(s)[0]) + expr(s.test)
        elif isinstance(s, LOOPS):
            total += 1 + (expr(s.test) if isinstance(s, ast.While) else 0)
        elif isinstance(s, TRIES):
            total += len(s.handlers)
        elif isinstance(s, ast.Match):
            total += max(0, len(s.cases) - 1)
        elif isinstance(s, (ast.Expr, ast.Return, ast.Assign, ast.AugAssign, ast.AnnAssign)):
            total += expr(s.value)
        total += sum(map(branches, blocks(s)))
    return total


def cognitive(body: list[ast.stmt], nesting: int = 0) -> int:
    """Branches weighed by nesting; elif and else cost one, whatever the nesting."""

    def expr(e: ast.expr | None, n: int) -> int:
        if isinstance(e, ast.IfExp):
            return 1 + n + expr(e.test, n) + expr(e.body, n + 1) + expr(e.orelse, n + 1)
        if isinstance(e, ast.BoolOp):
            return len(e.values) - 1 + sum(expr(v, n) for v in e.values)
        if isinstance(e, ast.Call):
            return expr(e.func, n) + sum(expr(a, n) for a in e.args)
        return expr(e.body, n + 1) if isinstance(e, ast.Lambda) else 0

    total = 0
    for s in body:
        deeper = [(b, nesting + 1) for b in blocks(s)]
        if isinstance(s, ast.If):
            tests, rest = clauses(s)
            total += nesting + len(tests) + bool(rest) + sum(expr(t, nesting) for t, _ in tests)
        elif isinstance(s, LOOPS):
            total += 1 + nesting + (expr(s.test, nesting) if isinstance(s, ast.While) else 0)
        elif isinstance(s, TRIES):
            total += len(s.handlers) * (1 + nesting)
            handled = [h.body for h in s.handlers]
            deeper = [(b, nesting + any(b is h for h in handled)) for b in blocks(s)]
        elif isinstance(s, ast.Match):
            total += 1 + nesting
        elif isinstance(s, (ast.Expr, ast.Return, ast.Assign, ast.AugAssign, ast.AnnAssign)):
            total += expr(s.value, nesting)
        total += sum(cognitive(b, n) for b, n in deeper)
    return total


def max_scope(body: list[ast.stmt]) -> int:
    """Lines of the longest compound statement; its clauses are never longer."""
    top = 0
    for s in body:
        inner = blocks(s)
        if inner:
            top = max(top, (s.end_lineno or s.lineno) - s.lineno + 1)
        top = max([top, *map(max_scope, inner)])
    return top


def dotted(e: ast.expr) -> str | None:
    if isinstance(e, ast.Name):
        return e.id
    left = dotted(e.value) if isinstance(e, ast.Attribute) else None
    return f"{left}.{e.attr}" if left else None


def looked_at(s: ast.stmt, message: bool) -> list[tuple[list[ast.expr], list[list[ast.stmt]]]]:
    """Expressions of a statement that calls and reads are looked for in, each group before the blocks that follow it."""
    if isinstance(s, ast.If):
        tests, rest = clauses(s)
        return [([t], [b]) for t, b in tests] + [([], [rest])]
    if isinstance(s, (ast.For, ast.AsyncFor)):
        own = [s.iter]
    elif isinstance(s, ast.While):
        own = [s.test]
    elif isinstance(s, ast.Match):
        own = [s.subject]
    elif isinstance(s, WITHS):
        own = [i.context_expr for i in s.items]
    elif isinstance(s, ast.Raise):
        own = [s.exc]
    elif isinstance(s, ast.Assert):
        own = [s.test, s.msg] if message else [s.test]
    elif isinstance(s, (ast.Expr, ast.Return, ast.Assign, ast.AugAssign, ast.AnnAssign)):
        own = [s.value]
    else:
        own = []
    return [([e for e in own if e is not None], blocks(s))]


def calls(body: list[ast.stmt]) -> list[str]:
    """Names that are called, each once, in order; self.x is Self.x."""
    found: dict[str, None] = {}

    def expr(e: ast.expr) -> None:
        if isinstance(e, ast.Call):
            name = dotted(e.func)
            if name:
                head, _, tail = name.rpartition(".")
                found.setdefault(f"Self.{tail}" if head == "self" else name)
        for x in parts(e, CALLED_IN):
            expr(x)

    def walk(stmts: list[ast.stmt]) -> None:
        for s in stmts:
            for own, inner in looked_at(s, message=True):
                for e in own:
                    expr(e)
                for b in inner:
                    walk(b)

    walk(body)
    return list(found)


def fields(body: list[ast.stmt]) -> tuple[list[str], list[str]]:
    """Attributes of self that are read, and that are written. self.x() is no read; self.x += 1 is both."""
    reads: dict[str, None] = {}
    writes: dict[str, None] = {}
    own = lambda e: isinstance(e, ast.Attribute) and isinstance(e.value, ast.Name) and e.value.id == "self"

    def expr(e: ast.expr) -> None:
        if own(e):
            reads.setdefault(e.attr)
            return
        skip = isinstance(e, ast.Call) and own(e.func)
        for x in e.args if skip else parts(e, READ_IN):
            expr(x)

    def walk(stmts: list[ast.stmt]) -> None:
        for s in stmts:
            targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, (ast.AugAssign, ast.AnnAssign)) else []
            for t in targets:
                if own(t):
                    if not isinstance(s, ast.AnnAssign) or s.value is not None:
                        writes.setdefault(t.attr)
                    if isinstance(s, ast.AugAssign):
                        reads.setdefault(t.attr)
                elif not isinstance(s, ast.AnnAssign):
                    expr(t)
            for group, inner in looked_at(s, message=False):
                for e in group:
                    expr(e)
                for b in inner:
                    walk(b)

    walk(body)
    return list(reads), list(writes)


def module_path(path: str) -> str:
    name = path.removesuffix(".pyi") if path.endswith(".pyi") else path.removesuffix(".py")
    return name.replace("/", ".").removesuffix(".__init__")


def units(source: str, path: str) -> list[dict]:
    """Units of a file, outer before inner; nothing from a file that does not parse.

    Definitions at the top and in the bodies of other definitions count, those
    in if or with do not. A function anywhere within a class is a method. Spans
    begin at the first decorator.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    module, out = module_path(path), []

    def visit(body: list[ast.stmt], scope: tuple[str, ...], in_class: bool) -> None:
        for s in body:
            if not isinstance(s, (*FUNCTIONS, ast.ClassDef)):
                continue
            first = min([s, *s.decorator_list], key=lambda x: (x.lineno, x.col_offset))
            at = (first.lineno, first.col_offset - (first is not s))
            unit = {"id": f"{module}::{'.'.join((*scope, s.name))}", "kind": "Struct", "file": path, "start_line": at[0], "start_col": at[1], "end_line": s.end_lineno, "end_col": s.end_col_offset}
            unit |= {"reads": [], "writes": [], "calls": [], "tags": [], "params": 0, "branches": 0, "max_scope_lines": 0, "parent": f"{module}::{'.'.join(scope)}" if scope else None, "cognitive_complexity": 0, "partial": False}
            if isinstance(s, FUNCTIONS):
                a = s.args
                named = [*a.posonlyargs, *a.args]
                reads, writes = fields(s.body) if in_class and named and named[0].arg == "self" else ([], [])
                unit |= {"kind": "Method" if in_class else "Function", "params": sum(x.arg not in ("self", "cls") for x in (*named, *a.kwonlyargs)) + (a.vararg is not None) + (a.kwarg is not None), "branches": branches(s.body), "cognitive_complexity": cognitive(s.body), "max_scope_lines": max_scope(s.body), "calls": calls(s.body), "reads": reads, "writes": writes}
            out.append(unit)
            visit(s.body, (*scope, s.name), in_class or isinstance(s, ast.ClassDef))

    visit(tree.body, (), False)
    return out
