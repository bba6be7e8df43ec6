"""Tokens of the dialect."""

from __future__ import annotations

import re
from typing import NamedTuple


class ParseError(ValueError):
    """The statement isn't part of the dialect."""


class Token(NamedTuple):
    kind: str  # word, name (quoted), number, string, param, op, end
    text: str
    at: int


_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|--[^\n]*)
  | (?P<number>\d+\.\d*|\.\d+|\d+)
  | (?P<word>[A-Za-z_]\w*)
  | "(?P<name>(?:[^"]|"")*)"
  | '(?P<string>(?:[^']|'')*)'
  | (?P<param>\$\d+|\?)
  | (?P<op><=|>=|!=|<>|[-+*/=<>(),.;])
    """,
    re.VERBOSE,
)


def tokenize(sql: str) -> list[Token]:
    tokens, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected character {sql[at]!r} at {at}")
        kind = m.lastgroup
        if kind != "skip":
            text = m[kind]
            if kind in ("name", "string"):
                quote = '"' if kind == "name" else "'"
                text = text.replace(quote * 2, quote)
            tokens.append(Token(kind, "!=" if text == "<>" and kind == "op" else text, at))
        at = m.end()
    tokens.append(Token("end", "", len(sql)))
    return tokens
