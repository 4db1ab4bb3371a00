"""Normalised tokens of source text: keywords and operators as they stand, names as $ID, literals as $LIT, comments left out.

Each language is a table of patterns for one scanner. Text between comments that
hold `<tool>:ignore-start` and `<tool>:ignore-end` gives no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

NAME, LITERAL = "$ID", "$LIT"
_START, _END = re.compile(r"\w+:ignore-start"), re.compile(r"\w+:ignore-end")


def _any(operators: str) -> str:
    return "|".join(re.escape(o) for o in sorted(operators.split(), key=len, reverse=True))


@dataclass(frozen=True)
class Lexer:
    keywords: frozenset[str]
    pattern: re.Pattern
    #: Whether a newline after a backslash in a literal counts as a line.
    counts_escaped: bool = True
    #: Names that stand for themselves even so, and those that are names although they look like keywords.
    newline: re.Pattern = field(default=re.compile(r"\n"))

    def tokens(self, source: str) -> Iterator[tuple[str, int, int]]:
        """(value, line from 1, column from 0)."""
        for kind, text, line, col in self.raw(source):
            yield (LITERAL if kind == "literal" else text if kind != "word" or text in self.keywords else NAME), line, col

    def raw(self, source: str) -> Iterator[tuple[str, str, int, int]]:
        """(literal, word or operator; text; line; column)."""
        at, line, start, ignoring = 0, 1, 0, False
        n = len(source)
        while at < n:
            m = self.pattern.match(source, at)
            kind = m.lastgroup if m else "other"
            text = m[0] if m else source[at]
            if ignoring and kind not in ("comment", "newline", "space"):
                kind, text = "skip", source[at]
            elif kind == "template":
                text = source[at : _template_end(source, at + 1)]
            elif kind == "nested":
                kind, text = "comment", source[at : _nested_end(source, at)]
            elif kind == "open":  # a long string that never ends
                kind, text = "literal", source[at : max(at + len(text), n - 2)]
            if kind == "comment":
                if _START.search(text):
                    ignoring = True
                elif _END.search(text):
                    ignoring = False
            elif kind in ("word", "literal"):
                yield kind, text, line, at - start
            elif kind == "template":
                yield "literal", text, line, at - start
            elif kind in ("operator", "other", "verbatim"):
                yield "operator", text, line, at - start
            counted = text if self.counts_escaped or kind != "literal" else re.sub(r"\\.", "  ", text, flags=re.S)
            at += len(text)
            if kind == "newline":
                line, start = line + 1, at
            elif "\n" in counted:
                line += counted.count("\n")
                start = at - (len(counted) - counted.rfind("\n") - 1)


def _template_end(source: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"\\.|\$\{|\}|`", re.S).finditer(source, at):
        if m[0] == "${":
            depth += 1
        elif m[0] == "}":
            depth -= depth > 0
        elif m[0] == "`" and not depth:
            return m.end()
    return len(source)


def _nested_end(source: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(source, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(source)


# Words and operators of the languages.
PYTHON_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type"
PYTHON_OPERATORS = "**= //= >>= <<= == != <= >= += -= *= /= %= &= |= ^= ** // >> << -> := .."
TYPESCRIPT_WORDS = "abstract as async await break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in infer instanceof interface is keyof let module namespace new null of override private protected public readonly return satisfies set static super switch this throw true try type typeof undefined unique var void while with yield"
TYPESCRIPT_OPERATORS = "=== !== >>> **= &&= ||= ??= ... <<= >>= == != <= >= && || ++ -- += -= *= /= %= => ** ?? ?. << >> &= |= ^="
RUST_WORDS = "as async await break const continue dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return static struct trait true type unsafe use where while"
RUST_OPERATORS = "<<= >>= ... ..= :: -> => == != <= >= && || += -= *= /= %= ^= &= |= << >> .."
GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
GO_OPERATORS = "&^= <<= >>= ... <- ++ -- == != <= >= := && || += -= *= /= %= &= |= ^= << >> &^"

PYTHON = Lexer(
    frozenset(PYTHON_WORDS.split()),
    re.compile(
        r"""(?P<newline>\r\n|\r|\n)|(?P<space>[ \t]+|\\\n)|(?P<comment>\#[^\n]*)
        |(?P<literal>(?:[fF][rRbB]?|[rR][bBfF]?|[bB][rRfF]?|[uU])?(?:(?P<q>\"{3}|'{3})(?:\\.|(?!(?P=q)).)*?(?P=q)|(?!\"{3}|'{3})(?P<p>["'])(?:\\.|(?!(?P=p))[^\n])*(?P=p)?)
            |(?=[0-9]|\.[0-9])(?:[A-Za-z0-9._]|(?<=[eE])[+-])+)
        |(?P<open>(?:[fF][rRbB]?|[rR][bBfF]?|[bB][rRfF]?|[uU])?(?:\"{3}|'{3}))
        |(?P<word>[^\W\d]\w*)|(?P<operator>"""
        + _any(PYTHON_OPERATORS).replace("#", r"\#")
        + ")",
        re.S | re.X,
    ),
    counts_escaped=False,
)
TYPESCRIPT = Lexer(
    frozenset(TYPESCRIPT_WORDS.split()),
    re.compile(
        r"""(?P<newline>\n)|(?P<space>[ \t\r]+)|(?P<comment>//[^\n]*|/\*.*?\*/|/\*.*(?=.\Z))
        |(?P<literal>(?P<p>["'])(?:\\.|(?!(?P=p)).)*(?P=p)?|(?=[0-9]|\.[0-9])[A-Za-z0-9._]+)
        |(?P<template>`)|(?P<word>(?:[^\W\d]|\$)(?:\w|\$)*)|(?P<operator>"""
        + _any(TYPESCRIPT_OPERATORS)
        + ")",
        re.S | re.X,
    ),
    counts_escaped=False,
)
RUST = Lexer(
    frozenset(RUST_WORDS.split()),
    re.compile(
        r"""(?P<newline>\n)|(?P<space>[ \t\r]+)|(?P<comment>//[^\n]*)|(?P<nested>/\*)
        |(?P<literal>(?:br|cr|r)(?P<h>\#*)".*?"(?P=h)|[bc]?"(?:\\.|[^"\\])*"?|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'|[0-9](?:[0-9A-Za-z_]|(?<=[eE])[+-](?=[0-9]))*(?:\.(?![.A-Za-z_])(?:[0-9](?:[0-9A-Za-z_]|(?<=[eE])[+-](?=[0-9]))*)?)?)
        |(?P<verbatim>'[^\W\d]\w*)|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<operator>"""
        + _any(RUST_OPERATORS)
        + ")",
        re.S | re.X,
    ),
)
GO = Lexer(
    frozenset(GO_WORDS.split()),
    re.compile(
        r"""(?P<newline>\n)|(?P<space>[ \t\r;]+)|(?P<comment>//[^\n]*|/\*.*?\*/)
        |(?P<literal>"(?:\\.|[^"\\\n])*"?|`[^`]*`?|'(?:\\.[^']*|[^'\\\n])'|(?=[0-9]|\.[0-9])(?:[0-9A-Za-z._]|(?<=[eEpP])[+-])+)
        |(?P<word>[^\W\d]\w*)|(?P<operator>"""
        + _any(GO_OPERATORS)
        + ")",
        re.S | re.X,
    ),
)
LEXERS = {"python": PYTHON, "typescript": TYPESCRIPT, "rust": RUST, "go": GO}
