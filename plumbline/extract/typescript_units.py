"""Units of TypeScript and JavaScript source, from tokens and matched brackets.

There is no grammar here: statements are told by their keywords, blocks by their
brackets, functions by `function`, `=>` and the shape of class members. Regular
expressions are masked first; JSX text is read as tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from .lexers import TYPESCRIPT, Lexer, _template_end

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
LOOPS = ("for", "while", "do")
#: What a name before `(` or a region of an expression cannot be.
CONTROL = frozenset("if for while switch catch function return typeof await super import new delete void in of instanceof do else case throw yield with".split())
STATEMENT = frozenset("if for while do switch return const let var try throw function class break continue export import".split())
MODIFIERS = frozenset("public private protected static readonly abstract override async get set declare accessor * @".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
#: After these, `?` marks something optional.
NOT_TERNARY = frozenset(") , : = ; ] }".split())


_PIECES = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[\w$]+|\s+|.""", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("await case delete do else in instanceof new of return throw typeof void yield".split())


def mask_regexes(source: str) -> str:
    """Regular-expression literals as strings of the same length: their brackets and quotes match nothing."""
    out, at, before = [], 0, ""
    while at < len(source):
        m = _PIECES.match(source, at)
        piece = m[0]
        if piece == "`":
            piece = source[at : _template_end(source, at + 1)]
        elif piece == "/" and (before in _BEFORE_REGEX or not before or not (before[-1].isalnum() or before[-1] in "_$)]}\"'`")):
            found = _REGEX.match(source, at)
            if found:
                piece = '"' + "x" * (len(found[0]) - 2) + '"'
        out.append(piece)
        at += len(piece)
        if not piece.isspace() and not piece.startswith(("//", "/*")):
            before = piece
    return "".join(out)


class Source:
    """Tokens with their places, matched brackets, and what is measured on a range of them."""

    def __init__(self, text: str, path: str, lexer: Lexer = TYPESCRIPT):
        self.path = path
        self.t: list[str] = []
        self.kind: list[str] = []
        self.at: list[tuple[int, int, int, int]] = []
        for kind, tok, line, col in lexer.raw(mask_regexes(text) if lexer is TYPESCRIPT else text):
            rows = tok.count("\n")
            self.t.append(tok)
            self.kind.append(kind)
            self.at.append((line, col, line + rows, len(tok) - tok.rfind("\n") - 1 if rows else col + len(tok)))
        self.n = len(self.t)
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, tok in enumerate(self.t):
            if self.kind[i] == "operator" and tok in OPEN:
                stack.append(i)
            elif self.kind[i] == "operator" and tok in CLOSE and stack:
                j = stack.pop()
                self.pair[j], self.pair[i] = i, j
        self.broken = bool(stack)
        self.units: list[dict] = []

    def tok(self, i: int) -> str:
        return self.t[i] if 0 <= i < self.n else ""

    def name(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "word"

    def end(self, i: int) -> int:
        """Index after the group that opens at i."""
        return self.pair.get(i, self.n - 1) + 1

    def arrow_of(self, i: int) -> int:
        """Index of => if the group at i holds the parameters of an arrow function, else -1."""
        j = self.end(i)
        if self.tok(j) == ":":  # a result type
            k = j + 1
            while k < self.n and self.tok(k) not in ("=>", ";", "{", ")", "=", ","):
                k = self.end(k) if k in self.pair and self.tok(k) in OPEN else k + 1
            j = k
        return j if self.tok(j) == "=>" else -1

    def expression_end(self, i: int, hi: int) -> int:
        while i < hi:
            if self.t[i] in OPEN and i in self.pair:
                i = self.end(i)
                continue
            if self.t[i] in (",", ";") or self.t[i] in CLOSE or self.kind[i] == "word" and self.t[i] in STATEMENT:
                return i
            i += 1
        return hi

    def skip_function(self, i: int, hi: int) -> int:
        """Index after a nested function that begins at i; i if none does."""
        if self.tok(i) == "function" and self.kind[i] == "word":
            j = i + 1
            while j < hi and self.tok(j) != "(":
                j += 1
            j = self.end(j)
            while j < hi and self.tok(j) != "{":
                j += 1
            return self.end(j) if j < hi else hi
        arrow = self.arrow_of(i) if self.tok(i) == "(" and i in self.pair else i + 1 if self.name(i) and self.tok(i + 1) == "=>" else -1
        if arrow < 0:
            return i
        return self.end(arrow + 1) if self.tok(arrow + 1) == "{" else self.expression_end(arrow + 1, hi)

    def walk(self, lo: int, hi: int) -> Iterator[int]:
        """Indexes outside nested functions."""
        i = lo
        while i < hi:
            j = self.skip_function(i, hi)
            if j > i:
                i = j
                continue
            yield i
            i += 1

    def statement(self, i: int, hi: int) -> int:
        """Index after the statement at i."""
        if self.tok(i) == "{":
            return self.end(i)
        if self.tok(i) in ("if", "for", "while", "with", "switch"):
            i += 1 + (self.tok(i + 1) == "await")
            i = self.statement(self.end(i), hi)
            return self.statement(i + 1, hi) if self.tok(i) == "else" else i
        line = self.at[i][2] if i < hi else 0
        while i < hi and self.tok(i) != ";":
            if self.at[i][0] > line and self.name(i) and self.name(i - 1):
                return i
            line = self.at[i][2]
            i = self.end(i) if self.tok(i) in OPEN and i in self.pair else i + 1
        return min(hi, i + 1)

    def is_ternary(self, i: int) -> bool:
        return self.t[i] == "?" and self.tok(i + 1) not in NOT_TERNARY

    def branches(self, lo: int, hi: int) -> int:
        total, own_while = 0, set()
        for i in self.walk(lo, hi):
            t = self.t[i]
            if self.kind[i] == "word" and self.tok(i - 1) not in (".", "?."):
                if t == "do":
                    own_while.add(self.statement(i + 1, hi))
                total += t in ("if", "for", "do") or t == "while" and i not in own_while
                if t == "switch":
                    j = self.end(i + 1)
                    body = self.end(j) - 1
                    cases = sum(self.t[k] in ("case", "default") and self.tok(k - 1) not in (".", "?.") and self.inside(k, j) for k in self.walk(j + 1, body))
                    total += max(0, cases - 1)
            else:
                total += t in ("&&", "||") or self.is_ternary(i)
        return total

    def inside(self, k: int, opening: int) -> bool:
        """Whether k stands directly in the group that opens there."""
        j = opening + 1
        while j <= k:
            if j == k:
                return True
            j = self.end(j) if self.tok(j) in OPEN and j in self.pair else j + 1
        return False

    def cognitive(self, lo: int, hi: int, nesting: int = 0) -> int:
        total, i = 0, lo
        while i < hi:
            j = self.skip_function(i, hi)
            if j > i:
                i = j
                continue
            t, word = self.t[i], self.kind[i] == "word" and self.tok(i - 1) not in (".", "?.")
            if word and t in ("if", "for", "while", "switch") and self.tok(i + 1 + (self.tok(i + 1) == "await")) == "(":
                group = i + 1 + (self.tok(i + 1) == "await")
                after = self.end(group)
                end = self.statement(after, hi)
                total += 1 + nesting + self.cognitive(group, after, nesting) + self.cognitive(after, end, nesting + 1)
                i = end
                if t == "if" and self.tok(i) == "else" and self.tok(i + 1) != "if":
                    end = self.statement(i + 1, hi)
                    total += 1 + self.cognitive(i + 1, end, nesting + 1)
                    i = end
            elif word and t == "do":
                end = self.statement(i + 1, hi)
                total += 1 + nesting + self.cognitive(i + 1, end, nesting + 1)
                i = end + (self.tok(end) == "while")
            elif word and t == "catch":
                after = self.end(i + 1) if self.tok(i + 1) == "(" else i + 1
                end = self.statement(after, hi)
                total += 1 + nesting + self.cognitive(after, end, nesting + 1)
                i = end
            elif self.is_ternary(i):
                end = self.expression_end(i + 1, hi)
                total += 1 + nesting + self.cognitive(i + 1, end, nesting + 1)
                i = end
            else:
                total += t in ("&&", "||")
                i += 1
        return total

    def max_scope(self, lo: int, hi: int) -> int:
        top = 0
        for i in self.walk(lo, hi):
            before = self.tok(i - 1)
            if self.t[i] == "{" and i in self.pair and (before in (")", "{", "}", ";") or before in ("else", "try", "finally", "do", "catch")):
                start = i
                if before == ")" and self.tok(self.pair.get(i - 1, 0) - 1) == "switch":
                    start = self.pair[i - 1] - 1
                top = max(top, self.at[self.pair[i]][2] - self.at[start][0] + 1)
        return top

    def chain(self, last: int) -> tuple[int, str] | None:
        """Dotted name that ends at a word; None if something else is called or indexed before it."""
        parts, i = [self.t[last]], last
        while self.tok(i - 1) in (".", "?.") or self.tok(i - 1) == "#" and self.tok(i - 2) in (".", "?."):
            i -= 2 if self.tok(i - 1) != "#" else 3
            if not self.name(i):
                return None
            parts.append(self.t[i])
        return i, ".".join(reversed(parts))

    def calls(self, lo: int, hi: int) -> list[str]:
        found: dict[str, None] = {}
        for i in self.walk(lo, hi):
            last = -1
            if self.t[i] == "(":
                last = i - 1 - (self.tok(i - 1) in ("?.", "!"))
                if self.tok(self.end(i)) == "{" and self.tok(last - 1) not in (".", "?.", "new"):
                    last = -1 if self.tok(last) not in ("if",) else last  # a method of an object
            elif self.t[i] == "new" and self.name(i + 1):
                last = i + 1
                while self.tok(last + 1) == "." and self.name(last + 2):
                    last += 2
            if last >= lo and self.name(last) and self.t[last] not in CONTROL and (got := self.chain(last)):
                if got[1] not in CONTROL and not got[1].startswith("super."):
                    found.setdefault(got[1])
        return list(found)

    def fields(self, lo: int, hi: int, params: list[str]) -> tuple[list[str], list[str]]:
        reads: dict[str, None] = {}
        writes: dict[str, None] = {}
        for i in range(lo, hi):
            if not self.name(i) or self.tok(i - 1) in (".", "?.") or self.tok(i + 1) not in (".", "?.") or not self.name(i + 2) or self.t[i] != "this" and self.t[i] not in params:
                continue
            name, after = self.t[i + 2] if self.t[i] == "this" else f"{self.t[i]}.{self.t[i + 2]}", self.tok(i + 3)
            if after == "(":
                continue
            alone = after not in (".", "?.", "[")
            if after in ASSIGN or alone and (after in ("++", "--") or self.tok(i - 1) in ("++", "--")):
                writes.setdefault(name)
            else:
                reads.setdefault(name)
        return list(reads), list(writes)

    def parameters(self, i: int, properties: bool = True) -> tuple[int, list[str]]:
        """Number of parameters of the group at i, and their plain names; `this` is none, nor, for constructors, a declared property."""
        n, names, j, close = 0, [], i + 1, self.pair.get(i, self.n)
        while j < close:
            k = j
            while k < close and self.tok(k) != ",":
                k = self.end(k) if self.tok(k) in OPEN and k in self.pair else self._angles(k) if self.tok(k) == "<" else k + 1
            first = self.tok(j)
            if first != "this" and (properties or first not in ("public", "private", "protected", "readonly", "override")):
                n += 1
                if self.name(j):
                    names.append(first)
            j = k + 1
        return n, names

    def _angles(self, k: int) -> int:
        depth, j = 0, k
        while j < self.n:
            t = self.t[j]
            depth += (t == "<") - (t == ">") - 2 * (t == ">>") - 3 * (t == ">>>")
            j += 1
            if depth <= 0:
                return j
            if t in (";", "{"):
                break
        return k + 1

    def add(self, scope: tuple[str, ...], name: str, kind: str, start: int, end: int, params: int = 0, names: list[str] = (), body: tuple[int, int] | None = None, block: bool = True, parent: str | None = None) -> None:
        a, b = self.at[start], self.at[min(end, self.n) - 1]
        unit = {"id": "::".join((self.path, *scope, name)), "kind": kind, "file": self.path, "start_line": a[0], "start_col": a[1], "end_line": b[2], "end_col": b[3], "reads": [], "writes": [], "calls": [], "tags": [], "params": params, "branches": 0, "max_scope_lines": 0, "parent": parent, "cognitive_complexity": 0, "partial": False}
        if body:
            reads, writes = self.fields(*body, list(names))
            unit |= {"reads": reads, "writes": writes, "calls": self.calls(*body), "branches": self.branches(*body), "cognitive_complexity": self.cognitive(*body), "max_scope_lines": self.max_scope(*body) if block else 0}
        self.units.append(unit)

    def declarations(self, lo: int, hi: int, scope: tuple[str, ...]) -> None:
        i = lo
        while i < hi:
            t, before = self.t[i], self.tok(i - 1)
            statement = self.kind[i] == "word" and before in ("", ";", "}", "{", ")", "export", "default", "async", "else", "declare", "abstract") or i == lo or self.kind[i] == "word" and self.at[i][0] > self.at[i - 1][2]
            if t == "function" and statement and (self.name(i + 1 + (self.tok(i + 1) == "*")) or before == "default" or self.tok(i - 2) == "default"):
                j = i + 1 + (self.tok(i + 1) == "*")
                name = self.t[j] if self.name(j) else "default"
                while j < hi and self.tok(j) != "(":
                    j += 1
                n, names = self.parameters(j)
                k = self.end(j)
                while k < hi and self.tok(k) not in ("{", ";"):
                    k += 1
                start = i - (before == "async")
                if self.tok(k) == "{":
                    self.add(scope, name, "Function", start, self.end(k), n, names, (k + 1, self.end(k) - 1))
                    self.declarations(k + 1, self.end(k) - 1, (*scope, name))
                    k = self.end(k)
                i = k
            elif t == "class" and statement and (self.name(i + 1) or before == "default"):
                name = self.t[i + 1] if self.name(i + 1) and self.t[i + 1] not in ("extends", "implements") else "default"
                k = i + 1
                while k < hi and self.tok(k) != "{":
                    k = self.end(k) if self.tok(k) == "(" else k + 1
                self.add(scope, name, "Struct", i, self.end(k))
                self.members(k + 1, self.end(k) - 1, (*scope, name))
                i = self.end(k)
            elif t in ("const", "let", "var") and statement and self.name(i + 1):
                i = self.variable(i + 1, hi, scope)
            elif t == "default" and before == "export" and self.tok(i + 1) not in ("function", "class", "async") or t == "async" and before == "default" and self.tok(i + 1) == "(":
                j = i + 1 + (self.tok(i + 1) == "async")
                i = self.function_value("default", j, j, hi, scope) or i + 1
            else:
                j = self.skip_function(i, hi)
                i = j if j > i else i + 1

    def variable(self, i: int, hi: int, scope: tuple[str, ...]) -> int:
        """A declared name and, if it is a function, its unit; index after what was read."""
        j = i + 1
        while j < hi and self.tok(j) not in ("=", ";", ",") and not (self.name(j) and self.t[j] in STATEMENT):
            j = self.end(j) if self.tok(j) in OPEN and j in self.pair else j + 1
        if self.tok(j) != "=":
            return j
        k = j + 1 + (self.tok(j + 1) == "async")
        return self.function_value(self.t[i], i, k, hi, scope) or j + 1

    def function_value(self, name: str, start: int, k: int, hi: int, scope: tuple[str, ...]) -> int | None:
        if self.tok(k) == "<":
            k = self._angles(k)
        arrow = self.arrow_of(k) if self.tok(k) == "(" and k in self.pair else k + 1 if self.name(k) and self.tok(k + 1) == "=>" else -1
        if self.tok(k) == "function":
            while k < hi and self.tok(k) != "(":
                k += 1
            n, names = self.parameters(k)
            while k < hi and self.tok(k) != "{":
                k = self.end(k) if self.tok(k) == "(" else k + 1
        elif arrow >= 0:
            n, names = self.parameters(k) if self.tok(k) == "(" else (1, [self.t[k]])
            k = arrow + 1
        else:
            return None
        block = self.tok(k) == "{"
        end = self.end(k) if block else self.expression_end(k, hi)
        self.add(scope, name, "Function", start, end, n, names, (k + 1, end - 1) if block else (k, end), block)
        return end

    def members(self, lo: int, hi: int, scope: tuple[str, ...]) -> None:
        parent, i = "::".join((self.path, *scope)), lo
        while i < hi:
            start, accessor = i, ""
            while i < hi and (self.t[i] in MODIFIERS or self.t[i] == "#") and not (self.name(i) and self.tok(i + 1) in ("(", "=", ";", ":", "?", "!", "<")):
                if self.t[i] == "@":
                    i += 2
                    while self.tok(i) == ".":
                        i += 2
                    i = self.end(i) if self.tok(i) == "(" else i
                    continue
                accessor = f"{self.t[i]}_" if self.t[i] in ("get", "set") else accessor
                i += 1
            if i >= hi:
                break
            name = self.t[i].strip("'\"")
            computed = self.t[i] == "["
            j = self.end(i) if computed else i + 1
            j = self._angles(j) if self.tok(j) == "<" else j + (self.tok(j) == "?")
            if self.tok(j) == "(" and self.t[i] != "{":
                n, names = self.parameters(j, properties=name != "constructor")
                k = self.end(j)
                while k < hi and self.tok(k) not in ("{", ";") and not (self.tok(k) == "}" or self.at[k][0] > self.at[k - 1][2] and self.name(k) and self.tok(k - 1) not in (":", "|", "&")):
                    k = self.end(k) if self.tok(k) == "(" else k + 1
                if self.tok(k) == "{":
                    if not computed:
                        self.add(scope, accessor + name, "Method", start, self.end(k), n, names, (k + 1, self.end(k) - 1), True, parent)
                    k = self.end(k)
                i = k
            elif self.tok(i) == "{":  # a static block
                i = self.end(i)
            else:
                line = self.at[i][2]
                while i < hi and self.tok(i) != ";" and not (self.at[i][0] > line and self.tok(i - 1) not in ASSIGN and self.kind[i] == "word"):
                    line = self.at[i][2]
                    j = self.skip_function(i, hi)
                    i = j if j > i else self.end(i) if self.tok(i) in OPEN and i in self.pair else i + 1
                i += self.tok(i) == ";"


def units(source: str, path: str) -> list[dict]:
    """Units of a file; nothing from one whose brackets do not match."""
    s = Source(source, path)
    if s.broken:
        return []
    s.declarations(0, s.n, ())
    return s.units


