"""Units of Rust source, from tokens and matched brackets.

Without a compiler, paths are taken as they are written (Self, self, super and
crate put in full), methods are called on what stands before them, and an impl
belongs to the type of that name in its own module. What macros are given is not
looked into.
"""

from __future__ import annotations

from collections.abc import Iterator

from .go_units import GoSource
from .lexers import RUST
from .typescript_units import OPEN

CONTROL = ("if", "match", "for", "while", "loop")
ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
WORDS = frozenset("if match for while loop return fn let move in as ref mut break continue unsafe async await where else impl dyn use pub".split())


def module_path(path: str, crates: dict[str, str] | None = None) -> tuple[str, ...]:
    """Crate and modules of a file. crates: package by folder; without one the folder above src names it. Tests, benches and examples are crates named after their file."""
    parts = path.removesuffix(".rs").split("/")
    if len(parts) > 1 and parts[-2] in ("tests", "benches", "examples"):
        return (parts[-1],)
    at = len(parts) - 1 - parts[::-1].index("src") if "src" in parts else -1
    folder = "/".join(parts[: max(at, 0)])
    name = (crates or {}).get(folder) or (parts[at - 1] if at > 0 else "crate")
    inner = parts[at + 1 :]
    if inner and inner[-1] in ("mod", "lib", "main"):
        inner = inner[:-1]
    return (name.replace("-", "_"), *inner)


class RustSource(GoSource):
    owner: tuple[str, ...] | None = None
    module: tuple[str, ...] = ()

    def operand(self, i: int) -> bool:
        """Whether what stands before i is a value, so that an operator there has a left side."""
        return i > 0 and (self.kind[i - 1] == "literal" or self.t[i - 1] in (")", "]", "}", "?") or self.name(i - 1) and self.t[i - 1] not in WORDS)

    def skip_function(self, i: int, hi: int) -> int:
        """Index after a nested item or the brackets of a macro."""
        if self.name(i) and self.tok(i + 1) == "!" and self.tok(i + 2) in OPEN:
            return self.end(i + 2)
        if self.t[i] == "fn" and self.name(i + 1):
            j = self.block(i, hi)
            return self.end(j) if j < hi else hi
        return i

    def logical(self, i: int) -> bool:
        return self.kind[i] == "operator" and self.t[i] in ("&&", "||") and self.operand(i)

    def keyword(self, i: int) -> str:
        """The control keyword at i, if it is one; the `if` of a match arm is none."""
        t = self.t[i]
        if t == "if":
            j = i + 1
            while j < self.n and self.t[j] not in ("{", "=>", ";"):
                j = self.end(j) if self.t[j] in ("(", "[") and j in self.pair else j + 1
            if self.tok(j) == "=>":
                return ""
        return t if self.kind[i] == "word" and t in CONTROL and self.tok(i + 1) != "<" else ""

    def closure(self, i: int, hi: int) -> tuple[int, int] | None:
        """Body of a closure whose parameters begin at i."""
        if self.t[i] not in ("|", "||") or self.operand(i):
            return None
        j = i + 1
        while self.t[i] == "|" and j < hi and self.t[j] != "|":
            j = self.end(j) if self.t[j] in OPEN and j in self.pair else j + 1
        j += self.t[i] == "|"
        if self.tok(j) == "->":
            j = self.block(j, hi)
        end = self.end(j) if self.tok(j) == "{" else j
        while self.tok(j) != "{" and end < hi and self.t[end] not in (",", ";", ")", "]", "}"):
            end = self.end(end) if self.t[end] in OPEN and end in self.pair else end + 1
        return j, end

    def branches(self, lo: int, hi: int) -> int:
        total = 0
        for i in self.walk(lo, hi):
            k = self.keyword(i)
            if k == "match":
                j = self.block(i + 1, hi)
                total += max(0, self.arms(j) - 1)
            else:
                total += bool(k) or self.logical(i)
        return total

    def arms(self, j: int) -> int:
        n, k, close = 0, j + 1, self.end(j) - 1
        while k < close:
            n += self.t[k] == "=>"
            k = self.end(k) if self.t[k] in OPEN and k in self.pair else k + 1
        return n

    def cognitive(self, lo: int, hi: int, nesting: int = 0) -> int:
        total, i = 0, lo
        while i < hi:
            j = self.skip_function(i, hi)
            if j > i:
                i = j
                continue
            k = self.keyword(i)
            if k:
                j = self.block(i + 1, hi)
                end = self.end(j)
                total += 1 + nesting + self.cognitive(i + 1, j, nesting) + self.cognitive(j + 1, end - 1, nesting + 1)
                i = end
                if k == "if" and self.tok(i) == "else":
                    i += 1
                    if self.tok(i) == "{":
                        total += 1 + self.cognitive(i + 1, self.end(i) - 1, nesting + 1)
                        i = self.end(i)
            elif body := self.closure(i, hi):
                total += self.cognitive(*body, nesting + 1)
                i = max(body[1], i + 1)
            else:
                total += self.logical(i)
                i += 1
        return total

    def max_scope(self, lo: int, hi: int) -> int:
        top = 0
        for i in self.walk(lo, hi):
            j = self.block(i + 1, hi) if self.keyword(i) else i + 1 if self.t[i] in ("else", "unsafe", "=>") and self.tok(i + 1) == "{" else -1
            if j in self.pair:
                top = max(top, self.at[self.pair[j]][2] - self.at[j][0] + 1)
            elif body := self.closure(i, hi):
                top = max(top, self.at[min(body[1], hi) - 1][2] - self.at[i][0] + 1)
        return top

    def full(self, path: list[str]) -> str:
        head = path[0]
        if head == "Self" and self.owner:
            return "::".join([*self.owner, *path[1:]])
        if head == "crate":
            return "::".join([*self.module[:1], *path[1:]])
        if head in ("self", "super"):
            base, rest = list(self.module), path
            while rest and rest[0] in ("self", "super"):
                base, rest = base[:-1] if rest[0] == "super" and len(base) > 1 else base, rest[1:]
            return "::".join([*base, *rest])
        return "::".join(path)

    def calls(self, lo: int, hi: int) -> list[str]:
        found: dict[str, None] = {}
        for i in self.walk(lo, hi):
            if self.t[i] != "(" or self.kind[i] != "operator" or i - 1 < lo:
                continue
            last = i - 1
            if self.t[last] == ">":  # f::<T>(x)
                depth = 0
                while last > lo:
                    depth += (self.t[last] == ">") - (self.t[last] == "<")
                    last -= 1
                    if not depth:
                        break
                last -= self.t[last] == "::"
            if not self.name(last) or self.t[last] in WORDS or self.tok(last - 1) == "fn":
                continue
            if self.tok(last - 1) == ".":
                before = last - 2
                found.setdefault(f"{self.t[before] if self.name(before) and self.tok(before - 1) != '.' else '_'}.{self.t[last]}")
                continue
            path = [self.t[last]]
            while self.tok(last - 1) == "::" and self.name(last - 2):
                last -= 2
                path.insert(0, self.t[last])
            found.setdefault(self.full(path))
        return list(found)

    def fields(self, lo: int, hi: int, params: list[str]) -> tuple[list[str], list[str]]:
        reads: dict[str, None] = {}
        writes: dict[str, None] = {}
        for i in self.walk(lo, hi):
            if self.tok(i - 1) in (".", "::") or self.tok(i + 1) != "." or self.t[i] != "self" and self.t[i] not in params or i + 2 >= hi or self.kind[i + 2] == "operator" or self.tok(i + 3) in ("(", "::") or self.t[i + 2] == "await":
                continue
            name, j = self.t[i + 2] if self.t[i] == "self" else f"{self.t[i]}.{self.t[i + 2]}", i + 3
            while self.tok(j) == "[" and j in self.pair:
                j = self.end(j)
            (writes if self.tok(j) in ASSIGN and self.tok(i - 1) != "*" else reads).setdefault(name)
        return list(reads), list(writes)

    def items(self, lo: int, hi: int) -> None:
        i = lo
        while i < hi:
            t = self.t[i] if self.kind[i] == "word" else self.t[i] if self.t[i] == "#" else ""
            if t == "#" and self.tok(i + 1) == "[":
                i = self.end(i + 1)
            elif t == "mod" and self.name(i + 1) and self.tok(i + 2) == "{":
                self.module = (*self.module, self.t[i + 1])
                self.items(i + 3, self.end(i + 2) - 1)
                self.module = self.module[:-1]
                i = self.end(i + 2)
            elif t == "struct" and self.name(i + 1):
                j = i + 2
                while j < hi and self.tok(j) not in (";", "{"):
                    j = self.end(j) if self.tok(j) == "(" else j + 1
                end = self.end(j) if self.tok(j) == "{" else min(j + 1, hi)
                self.emit(self.module, self.t[i + 1], "Struct", self.begin(i), end)
                i = end
            elif t == "impl":
                j = self.block(i, hi)
                if (name := self.impl_type(i + 1, j)):
                    self.owner = (*self.module, name)
                    self.members(j + 1, self.end(j) - 1)
                    self.owner = None
                i = self.end(j)
            elif t == "fn" and self.name(i + 1):
                i = self.function(i, hi)
            elif t == "trait" or self.t[i] in OPEN and i in self.pair:
                j = self.block(i, hi) if t == "trait" else i
                i = self.end(j)
            else:
                i += 1

    def members(self, lo: int, hi: int, *_: object) -> None:
        i = lo
        while i < hi:
            i = self.function(i, hi) if self.t[i] == "fn" and self.name(i + 1) else self.end(i) if self.t[i] in OPEN and i in self.pair else i + 1

    def impl_type(self, i: int, j: int) -> str:
        """Name of the type that an impl is for."""
        i = self._angles(i) if self.tok(i) == "<" else i
        name = ""
        while i < j and self.t[i] != "where":
            if self.t[i] == "for" and self.tok(i + 1) != "<":
                name = ""
            elif self.name(i) and self.t[i] not in ("dyn", "mut"):
                name = self.t[i]
            i = self._angles(i) if self.t[i] == "<" else i + 1
        return name

    def begin(self, i: int) -> int:
        """Index of the first word of an item, with its visibility and attributes."""
        while i > 0 and (self.t[i - 1] in ("pub", "async", "unsafe", "const", "extern") and self.name(i - 1) or self.t[i - 1] == ")" and self.tok(self.pair.get(i - 1, 0) - 1) == "pub" or self.t[i - 1] == "]" and self.tok(self.pair.get(i - 1, 0) - 1) == "#"):
            i = i - 1 if self.name(i - 1) else self.pair[i - 1] - 1
        return i

    def function(self, i: int, hi: int) -> int:
        j = i + 2
        j = self._angles(j) if self.tok(j) == "<" else j
        if self.tok(j) != "(":
            return j
        n, names = 0, []
        for a, b in self.groups(j):
            own = [self.t[k] for k in range(a, b)]
            if "self" in own and ":" not in own or own[:2] == ["self", ":"]:
                continue
            n += 1
            plain = own[1:] if own[:1] == ["mut"] else own
            if len(plain) > 1 and plain[1] == ":":
                names.append(plain[0])
        k = self.end(j)
        while k < hi and self.tok(k) not in ("{", ";"):
            k = self.end(k) if self.tok(k) in ("(", "[") and k in self.pair else k + 1
        if self.tok(k) != "{":
            return k + 1
        end = self.end(k)
        scope = self.owner or self.module
        self.emit(scope, self.t[i + 1], "Method" if self.owner else "Function", self.begin(i), end, n, names, (k + 1, end - 1), "::".join(self.owner) if self.owner else None)
        return end

    def groups(self, i: int) -> Iterator[tuple[int, int]]:
        """Ranges between the commas of the group at i, attributes left out."""
        j, close = i + 1, self.pair.get(i, self.n)
        while j < close:
            while self.tok(j) == "#" and self.tok(j + 1) == "[":
                j = self.end(j + 1)
            k = j
            while k < close and self.tok(k) != ",":
                k = self.end(k) if self.tok(k) in OPEN and k in self.pair else self._angles(k) if self.tok(k) == "<" else k + 1
            if k > j:
                yield j, k
            j = k + 1

    def emit(self, scope: tuple[str, ...], name: str, kind: str, start: int, end: int, params: int = 0, names: list[str] = (), body: tuple[int, int] | None = None, parent: str | None = None) -> None:
        self.add(scope, name, kind, start, end, params, names, body, True, parent)
        self.units[-1]["id"] = "::".join((*scope, name))


def units(source: str, path: str, crates: dict[str, str] | None = None) -> list[dict]:
    """Structs, functions and methods in their order; nothing of a file whose brackets do not match."""
    s = RustSource(source, path, RUST)
    s.module = module_path(path, crates)
    if not s.broken:
        s.items(0, s.n)
    return s.units
