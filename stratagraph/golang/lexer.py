"""Tokens of Go source: exact for literals, comments and positions."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, char, mark, newline
    text: str
    line: int
    column: int
    pos: int


_PIECE = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|`[^`]*`?)|(?P<char>'(?:[^'\\\n]|\\.)*'?)
    |(?P<name>[^\W\d]\w*)|(?P<number>(?:0[xXbBoO])?[\d][\w.]*(?:[eEpP][+-]\d+)?|\.\d[\w.]*)
    |(?P<mark><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|.)""",
    re.X | re.S,
)


def tokens(source: str, newlines: bool = False) -> list[Token]:
    """Tokens with 1-based lines and byte columns; comments are left out."""
    out, line, start = [], 1, 0
    for m in _PIECE.finditer(source):
        kind, text, pos = m.lastgroup, m.group(), m.start()
        if kind not in ("space", "line", "block") and (kind != "newline" or newlines):
            out.append(Token(kind, text, line, len(source[start:pos].encode()) + 1, pos))
        n = text.count("\n")
        if n:
            line += n
            start = pos + text.rindex("\n") + 1
    return out


def unquote(literal: str) -> str:
    """The value of a string literal; malformed escapes stay as they are."""
    if literal[:1] == "`":
        return literal[1:].removesuffix("`").replace("\r", "")
    body = literal[1:].removesuffix('"') if len(literal) > 1 else ""
    simple = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}

    def one(m: re.Match) -> str:
        e = m.group(1)
        if e in simple:
            return simple[e]
        if e[0] in "xuU":
            return chr(int(e[1:], 16))
        return chr(int(e, 8))

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", lambda m: one(m) if len(m.group(1)) > 1 or m.group(1) in simple else m.group(), body)


def digest(parts: list[Token]) -> str:
    """SCL-04: a hash over the tokens, blind to comments and layout."""
    return hashlib.sha256("\0".join(t.text for t in parts).encode()).hexdigest()
