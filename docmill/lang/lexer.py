"""Query text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QuerySyntaxError(ValueError):
    """The query text doesn't follow the grammar."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, number, string, template, bind, op, end
    value: object
    at: int

    def is_word(self, *words: str) -> bool:
        return self.kind == "name" and str(self.value).upper() in words


_OPS = ["??", "?.", "||", "|>", "&&", "==", "!=", "<=", ">=", "<<", ">>", "=~", "!~", "~=", "..", "->", "[*]", *"+-*/%<>=!~&|^?:.,()[]{}"]
_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|//[^\n]*)"
    r"|(?P<template>\$(?P<tq>[\"'])(?:\\.|(?!(?P=tq)).)*(?P=tq))"
    r"|(?P<string>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')"
    r"|(?P<number>\d+(?:\.(?!\.)\d+)?(?:[eE][+-]?\d+)?)"
    r"|(?P<bind>@\w+)"
    r"|(?P<quoted>`[^`]*`)"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<op>" + "|".join(map(re.escape, _OPS)) + ")",
    re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f"}


def unquote(body: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[2], 16)) if m[2] else _ESCAPES.get(m[1], m[1])

    return re.sub(r"\\(u([0-9a-fA-F]{4})|.)", lambda m: one(m) if m[2] else _ESCAPES.get(m[1], m[1]), body, flags=re.DOTALL)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        if (m := _TOKEN.match(text, at)) is None:
            raise QuerySyntaxError(f"unexpected character {text[at]!r} at {at}")
        kind, raw = m.lastgroup, m[0]
        if kind == "tq":
            kind = "template"
        if kind == "string":
            out.append(Token("string", unquote(raw[1:-1]), at))
        elif kind == "template":
            out.append(Token("template", raw[2:-1], at))
        elif kind == "number":
            out.append(Token("number", float(raw) if re.search(r"[.eE]", raw) else int(raw), at))
        elif kind == "bind":
            out.append(Token("bind", raw[1:], at))
        elif kind == "quoted":
            out.append(Token("quoted", raw[1:-1], at))
        elif kind in ("name", "op"):
            out.append(Token(kind, raw, at))
        at = m.end()
    return [*out, Token("end", None, at)]
