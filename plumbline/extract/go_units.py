"""Units of Go source, from tokens and matched brackets. Closures belong to the function around them; calls are names as they stand, not resolved by type."""

from __future__ import annotations

from plumbline.sources.files import is_generated_go

from .lexers import GO
from .typescript_units import OPEN, Source

# Names of the language that are no calls to units.
BUILTINS = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr any".split())
WORDS = frozenset("if for switch select func return go defer case range map chan struct interface else var const type".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class GoSource(Source):
    receiver = ""

    def block(self, i: int, hi: int) -> int:
        """Index of the { that ends the head of a statement at i."""
        while i < hi and self.tok(i) != "{":
            i = self.end(i) if self.tok(i) in ("(", "[") and i in self.pair else i + 1
        return i

    def branches(self, lo: int, hi: int) -> int:
        total = 0
        for i in range(lo, hi):
            t = self.t[i]
            if self.kind[i] == "word" and t in ("switch", "select"):
                j = self.block(i + 1, hi)
                total += max(0, sum(self.t[k] in ("case", "default") and self.inside(k, j) for k in range(j + 1, self.end(j) - 1)) - 1)
            else:
                total += t in ("&&", "||") or self.kind[i] == "word" and t in ("if", "for")
        return total

    def cognitive(self, lo: int, hi: int, nesting: int = 0) -> int:
        total, i = 0, lo
        while i < hi:
            t = self.t[i] if self.kind[i] != "literal" else ""
            if t in ("if", "for", "switch", "select"):
                j = self.block(i + 1, hi)
                end = self.end(j)
                total += 1 + nesting + self.cognitive(i + 1, j, nesting) + self.cognitive(j + 1, end - 1, nesting + 1)
                i = end
                if t == "if" and self.tok(i) == "else":
                    i += 1
                    if self.tok(i) == "{":
                        total += 1 + self.cognitive(i + 1, self.end(i) - 1, nesting + 1)
                        i = self.end(i)
            elif t == "case":  # what a case is held against does not count
                while i < hi and self.tok(i) != ":":
                    i = self.end(i) if self.tok(i) in OPEN and i in self.pair else i + 1
            else:
                total += t in ("&&", "||")
                i += 1
        return total

    def max_scope(self, lo: int, hi: int) -> int:
        top = 0
        for i in range(lo, hi):
            t = self.t[i] if self.kind[i] != "literal" else ""
            j = self.block(i + 1, hi) if t in ("if", "for", "switch", "select") else i + 1 if t == "else" and self.tok(i + 1) == "{" else i if t == "{" and self.at[i][0] > self.at[i - 1][2] and self.tok(i - 1) != "," else -1
            if j in self.pair:
                top = max(top, self.at[self.pair[j]][2] - self.at[j][0] + 1)
        return top

    def calls(self, lo: int, hi: int) -> list[str]:
        found: dict[str, None] = {}
        for i in range(lo, hi):
            last = i - 1
            if self.t[i] == "(" and self.kind[i] == "operator" and last >= lo and self.name(last) and self.t[last] not in WORDS and self.tok(last - 1) != "func" and (got := self.chain(last)):
                if got[1] not in BUILTINS:
                    found.setdefault(got[1])
        return list(found)

    def fields(self, lo: int, hi: int, params: list[str]) -> tuple[list[str], list[str]]:
        reads: dict[str, None] = {}
        writes: dict[str, None] = {}
        for i in range(lo, hi):
            if not self.receiver or self.tok(i) != self.receiver or self.tok(i - 1) == "." or self.tok(i + 1) != "." or not self.name(i + 2):
                continue
            name, line, j = f"self.{self.t[i + 2]}", self.at[i][0], i + 3
            begin = i
            while begin > lo and self.at[begin - 1][2] == line and self.tok(begin - 1) not in ("{", ";"):
                begin -= 1
            left = not any(self.t[k] in ASSIGN or self.t[k] == ":=" for k in range(begin, i))
            plain = self.tok(j) not in (".", "[", "(")
            k = j
            while left and k < hi and self.at[k][0] == line and (self.tok(k) in (".", ",", "[") or self.name(k)):
                k = self.end(k) if self.tok(k) == "[" else k + 1
            if left and self.tok(k) in ASSIGN and self.at[k][0] == line:
                if plain:
                    writes.setdefault(name)
            elif plain and self.tok(j) in ("++", "--"):
                writes.setdefault(name)
            elif self.tok(j) != "(" or left:
                reads.setdefault(name)
        return list(reads), list(writes)

    def functions(self) -> None:
        inits, methods, i = 0, [], 0
        while i < self.n:
            if self.t[i] == "type" and self.name(i):
                j, end = (i + 2, self.end(i + 1) - 1) if self.tok(i + 1) == "(" else (i + 1, i + 2)
                while j < end:
                    k = self._angles_square(j + 1)
                    if self.name(j) and self.tok(k) in ("struct", "interface") and self.tok(k + 1) == "{":
                        self.add((), self.t[j], "Struct", j, self.end(k + 1))
                        j = self.end(k + 1)
                    else:
                        j = self.end(j) if self.tok(j) in OPEN and j in self.pair else j + 1
                i = max(j, i + 1)
            elif self.t[i] == "func" and self.name(i):
                start, owner = i, None
                i += 1
                if self.tok(i) == "(":
                    owner, i = i, self.end(i)
                name = self.tok(i)
                j = self._angles_square(i + 1)
                n = self.parameters(j)[0] if self.tok(j) == "(" else 0
                k = self.end(j)
                while k < self.n and self.tok(k) != "{" and not (self.t[k] in ("func", "type", "var", "const") and self.at[k][0] > self.at[k - 1][2]):
                    k = self.end(k) if self.tok(k) in ("(", "[") else self.end(k + 1) if self.tok(k) in ("struct", "interface") and self.tok(k + 1) == "{" else k + 1
                body = (k + 1, self.end(k) - 1) if self.tok(k) == "{" else None
                end = self.end(k) if body else k
                if owner is not None:
                    inner = [self.t[x] for x in range(owner + 1, self.pair[owner])]
                    named = len(inner) > 1 and inner[0].isidentifier() and inner[1] not in (".", "[")
                    kind = next((x for x in inner[named:] if x.isidentifier()), "")
                    methods.append((kind, inner[0] if named else "", name, start, end, n, body))
                else:
                    if name == "init":
                        name, inits = f"init_{inits}" if inits else name, inits + 1
                    self.receiver = ""
                    self.add((), name, "Function", start, end, n, [], body)
                i = max(end, i + 1)
            else:
                i = self.end(i) if self.tok(i) in OPEN and i in self.pair else i + 1
        for kind, self.receiver, name, start, end, n, body in methods:
            self.add((kind,), name, "Method", start, end, n, [], body, True, f"{self.path}::{kind}")

    def _angles_square(self, i: int) -> int:
        """After type parameters at i."""
        return self.end(i) if self.tok(i) == "[" and i in self.pair else i


def units(source: str, path: str) -> list[dict]:
    """Structs and functions in their order, then methods; nothing of generated files, or of those whose brackets do not match."""
    if is_generated_go(path, source):
        return []
    s = GoSource(source, path, GO)
    if not s.broken:
        s.functions()
    return s.units
