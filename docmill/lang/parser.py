"""Tokens to syntax tree, by precedence climbing."""

from __future__ import annotations

import re

from . import tree as t
from .lexer import QuerySyntaxError, Token, tokenize, unquote

#: Binary operators from loose to tight; words are matched in any case.
LEVELS: list[tuple[str, ...]] = [
    ("??",),
    ("||",),
    ("|>",),
    ("OR",),
    ("AND", "&&"),
    ("|",),
    ("^",),
    ("&",),
    ("==", "!=", "<", "<=", ">", ">=", "IN", "LIKE", "=~", "!~", "~=", "NOT IN", "NOT LIKE", "="),
    ("..",),
    ("<<", ">>"),
    ("+", "-"),
    ("*", "/", "%"),
]
BODY = ("FOR", "FILTER", "LET", "COLLECT", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "INSERT", "UPDATE", "REMOVE", "DELETE", "UPSERT", "WINDOW")
ENDS = (*BODY, "SORT", "ORDER", "LIMIT", "RETURN")
DIRECTIONS = ("OUTBOUND", "INBOUND", "ANY")


def parse(text: str) -> t.Query:
    p = Parser(tokenize(text))
    query = p.query(top=True)
    if p.now.kind != "end":
        raise QuerySyntaxError(f"unexpected {p.now.value!r} at {p.now.at}")
    return query


def parse_expression(text: str) -> t.Node:
    p = Parser(tokenize(text))
    out = p.expression()
    if p.now.kind != "end":
        raise QuerySyntaxError(f"unexpected {p.now.value!r} at {p.now.at}")
    return out


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        token = self.now
        self.at += token.kind != "end"
        return token

    def word(self, *words: str) -> bool:
        if self.now.is_word(*words):
            self.at += 1
            return True
        return False

    def op(self, *ops: str) -> bool:
        if self.now.kind == "op" and self.now.value in ops:
            self.at += 1
            return True
        return False

    def need_op(self, op: str) -> None:
        if not self.op(op):
            raise QuerySyntaxError(f"expected {op!r} instead of {self.now.value!r} at {self.now.at}")

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            raise QuerySyntaxError(f"expected {' or '.join(words)} instead of {self.now.value!r} at {self.now.at}")

    def name(self) -> str:
        if self.now.kind in ("name", "quoted"):
            return str(self.next().value)
        raise QuerySyntaxError(f"expected a name instead of {self.now.value!r} at {self.now.at}")

    # -- queries

    def query(self, top: bool = False) -> t.Query:
        stream = view = None
        if top and self.word("CREATE"):
            if self.word("STREAM"):
                stream = self.name()
            else:
                self.need_word("MATERIALIZED")
                self.need_word("VIEW")
                view = self.name()
            self.need_word("AS")
        elif top and self.word("REFRESH"):
            self.need_word("MATERIALIZED")
            self.need_word("VIEW")
            return t.Query((), refresh_view=self.name())
        body: list[t.Node] = []
        while self.now.is_word(*BODY):
            body.append(self.clause())
        sort: tuple = ()
        if self.word("SORT") or (self.word("ORDER") and (self.word("BY") or True)):
            sort = self.sort_keys()
        offset = limit = None
        if self.word("LIMIT"):
            limit = self.expression()
            if self.op(","):
                offset, limit = limit, self.expression()
        returns = None
        if self.word("RETURN"):
            distinct = self.now.is_word("DISTINCT") and not (self.peek().kind == "op" and self.peek().value in (",", ")", "."))
            self.at += distinct
            returns = self.expression()
            if distinct:
                returns = t.Call("__DISTINCT", (returns,))
        elif not any(isinstance(c, t.MUTATIONS) for c in body):
            raise QuerySyntaxError("a query needs RETURN or a mutation")
        return t.Query(tuple(body), sort, offset, limit, returns, stream, view)

    def sort_keys(self) -> tuple[tuple[t.Node, bool], ...]:
        keys = []
        while True:
            e = self.expression()
            keys.append((e, not self.word("DESC") or False))
            if keys[-1][1]:
                self.word("ASC")
            if not self.op(","):
                return tuple(keys)

    def clause(self) -> t.Node:
        if self.word("FOR"):
            return self.for_clause()
        if self.word("FILTER"):
            return t.Filter(self.expression())
        if self.word("LET"):
            return t.Let(self.assignments())
        if self.word("COLLECT"):
            return self.collect()
        if self.now.is_word("JOIN", "LEFT", "RIGHT", "FULL", "INNER"):
            kind = "INNER"
            if not self.now.is_word("JOIN"):
                kind = str(self.next().value).upper()
                self.word("OUTER")
            self.need_word("JOIN")
            collection = self.name()
            self.need_word("ON")
            return t.Join(kind, collection, self.expression())
        if self.word("INSERT"):
            document = self.expression()
            self.need_word("INTO")
            return t.Insert(document, self.name())
        if self.word("UPDATE"):
            selector = self.expression()
            self.need_word("WITH")
            changes = self.expression(stop_in=True)
            self.need_word("IN")
            return t.Update(selector, changes, self.name())
        if self.word("REMOVE", "DELETE"):
            selector = self.expression(stop_in=True)
            self.need_word("IN")
            return t.Remove(selector, self.name())
        if self.word("UPSERT"):
            search = self.expression()
            self.need_word("INSERT")
            insert = self.expression()
            whole = self.now.is_word("REPLACE")
            self.need_word("UPDATE", "REPLACE")
            update = self.expression(stop_in=True)
            self.need_word("IN")
            return t.Upsert(search, insert, update, whole, self.name())
        self.need_word("WINDOW")
        sliding = self.now.is_word("SLIDING")
        self.need_word("TUMBLING", "SLIDING")
        self.need_op("(")
        size = slide = time = None
        while not self.op(")"):
            if self.word("SIZE"):
                size = str(self.next().value)
            elif self.word("SLIDE"):
                slide = str(self.next().value)
            else:
                self.need_word("TIME")
                time = self.name()
            self.op(",")
        if size is None:
            raise QuerySyntaxError("a window needs SIZE")
        return t.Windowed(sliding, size, slide, time)

    def assignments(self) -> tuple[tuple[str, t.Node], ...]:
        out = []
        while True:
            name = self.name()
            self.need_op("=")
            out.append((name, self.expression()))
            if not self.op(","):
                return tuple(out)

    def for_clause(self) -> t.Node:
        var = self.name()
        edge = self.name() if self.op(",") else None
        self.need_word("IN")
        if self.word("SHORTEST_PATH"):
            start = self.expression()
            self.need_word("TO")
            end = self.expression()
            direction = str(self.next().value).upper()
            return t.ShortestPath(var, edge, start, end, direction, self.name())
        low, high = 1, 1
        if self.now.kind == "number" and (self.peek().is_word(*DIRECTIONS) or (self.peek().value == ".." and self.peek(3).is_word(*DIRECTIONS))):
            low = high = int(self.next().value)
            if self.op(".."):
                high = int(self.next().value)
        if self.now.is_word(*DIRECTIONS):
            direction = str(self.next().value).upper()
            start = self.expression()
            return t.Traverse(var, edge, low, high, direction, start, self.name())
        return t.For(var, self.expression())

    def collect(self) -> t.Collect:
        keys: list[tuple[str, t.Node]] = []
        while self.now.kind in ("name", "quoted") and self.peek().value == "=" and not self.now.is_word("INTO", "WITH", "AGGREGATE"):
            name = self.name()
            self.need_op("=")
            keys.append((name, self.expression()))
            if not self.op(","):
                break
        into = count = None
        aggregates: list[t.Aggregate] = []
        while True:
            if self.word("INTO"):
                into = self.name()
            elif self.now.is_word("WITH") and self.peek().is_word("COUNT"):
                self.at += 2
                self.need_word("INTO")
                count = self.name()
            elif self.word("AGGREGATE"):
                while True:
                    var = self.name()
                    self.need_op("=")
                    func = self.name().upper()
                    self.need_op("(")
                    arg = None if self.op(")") else self.expression()
                    if arg is not None:
                        self.need_op(")")
                    aggregates.append(t.Aggregate(var, func, arg))
                    if not self.op(","):
                        break
            else:
                return t.Collect(tuple(keys), into, count, tuple(aggregates))

    # -- expressions

    def expression(self, stop_in: bool = False) -> t.Node:
        if self.now.is_word("FOR") or (self.now.is_word("LET") and self.peek(2).value == "="):
            return t.Sub(self.query())
        saved, self.stop_in = getattr(self, "stop_in", False), stop_in
        try:
            test = self.level(0)
            if self.op("?"):
                then = self.expression()
                self.need_op(":")
                return t.Ternary(test, then, self.expression())
            return test
        finally:
            self.stop_in = saved

    def infix(self, ops: tuple[str, ...]) -> str | None:
        token = self.now
        if token.kind == "op":
            found = token.value if token.value in ops else None
            if found:
                self.at += 1
            return found
        if token.kind != "name":
            return None
        upper = str(token.value).upper()
        if upper == "NOT" and self.peek().is_word("IN", "LIKE") and f"NOT {str(self.peek().value).upper()}" in ops:
            self.at += 2
            return f"NOT {str(self.tokens[self.at - 1].value).upper()}"
        if upper in ops and not (upper == "IN" and self.stop_in):
            self.at += 1
            return upper
        return None

    def level(self, n: int) -> t.Node:
        if n == len(LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while (op := self.infix(LEVELS[n])) is not None:
            right = self.level(n + 1)
            if op == "|>":
                if not isinstance(right, t.Call):
                    raise QuerySyntaxError("the right side of |> must be a call")
                left = t.Call(right.name, (left, *right.args))
            else:
                left = t.Binary({"&&": "AND", "=": "=="}.get(op, op), left, right)
        return left

    def unary(self) -> t.Node:
        if self.op("-"):
            arg = self.unary()
            return t.Lit(-arg.value) if isinstance(arg, t.Lit) and isinstance(arg.value, (int, float)) and not isinstance(arg.value, bool) else t.Unary("-", arg)
        if self.op("+"):
            return self.unary()
        if self.op("~"):
            return t.Unary("~", self.unary())
        if self.op("!") or self.word("NOT"):
            return t.Unary("NOT", self.unary())
        return self.postfix(self.primary())

    def postfix(self, base: t.Node) -> t.Node:
        while True:
            if self.op(".", "?."):
                base = t.Field(base, self.name())
            elif self.op("[*]"):
                path = []
                while self.op(".", "?."):
                    path.append(self.name())
                base = t.Spread(base, tuple(path))
            elif self.op("["):
                key = self.expression()
                self.need_op("]")
                base = t.Field(base, key.value) if isinstance(key, t.Lit) and isinstance(key.value, str) else t.Index(base, key)
            else:
                return base

    def primary(self) -> t.Node:
        token = self.now
        if token.kind in ("number", "string"):
            self.at += 1
            return t.Lit(token.value)
        if token.kind == "template":
            self.at += 1
            return template(str(token.value))
        if token.kind == "bind":
            self.at += 1
            return t.Bind(str(token.value))
        if self.op("("):
            if (names := self.lambda_params()) is not None:
                return t.Lambda(names, self.expression())
            inner = self.expression()
            self.need_op(")")
            return inner
        if self.op("["):
            return t.Arr(self.items("]"))
        if self.op("{"):
            return self.object()
        if token.is_word("TRUE", "FALSE", "NULL"):
            self.at += 1
            return t.Lit({"TRUE": True, "FALSE": False, "NULL": None}[str(token.value).upper()])
        if token.is_word("CASE"):
            self.at += 1
            return self.case()
        if token.is_word("ANY", "ALL", "NONE") and self.peek().kind in ("name", "quoted") and self.peek(2).is_word("IN"):
            kind = str(self.next().value).upper()
            var = self.name()
            self.need_word("IN")
            array = self.level(LEVELS.index(("..",)))
            self.need_word("SATISFIES")
            return t.Quantifier(kind, var, array, self.expression())
        if token.kind in ("name", "quoted"):
            name = self.name()
            if self.op("->"):
                return t.Lambda((name,), self.expression())
            if token.kind == "name" and self.op("("):
                call = t.Call(name.upper(), self.items(")"))
                return self.over(call) if self.now.is_word("OVER") else call
            return t.Var(name)
        raise QuerySyntaxError(f"unexpected {token.value!r} at {token.at}")

    def lambda_params(self) -> tuple[str, ...] | None:
        """The names of `(a, b) ->` after its opening parenthesis, or None with nothing read."""
        at, names = self.at, []
        while self.now.kind in ("name", "quoted"):
            names.append(self.name())
            if not self.op(","):
                break
        if names and self.op(")") and self.op("->"):
            return tuple(names)
        self.at = at
        return None

    def items(self, close: str) -> tuple[t.Node, ...]:
        out: list[t.Node] = []
        while not self.op(close):
            if out:
                self.need_op(",")
            if self.op(close):
                break
            out.append(self.expression())
        return tuple(out)

    def object(self) -> t.Obj:
        out: list[tuple[str, t.Node]] = []
        while not self.op("}"):
            if out:
                self.need_op(",")
                if self.op("}"):
                    break
            key = str(self.next().value) if self.now.kind == "string" else self.name()
            out.append((key, self.expression() if self.op(":") else t.Var(key)))
        return t.Obj(tuple(out))

    def case(self) -> t.Case:
        subject = None if self.now.is_word("WHEN") else self.expression()
        whens = []
        while self.word("WHEN"):
            test = self.expression()
            self.need_word("THEN")
            whens.append((test, self.expression()))
        other = self.expression() if self.word("ELSE") else None
        self.need_word("END")
        return t.Case(subject, tuple(whens), other)

    def over(self, call: t.Call) -> t.Over:
        self.need_word("OVER")
        self.need_op("(")
        partition: tuple[t.Node, ...] = ()
        order: tuple[tuple[t.Node, bool], ...] = ()
        if self.word("PARTITION"):
            self.need_word("BY")
            found = [self.expression()]
            while self.op(","):
                found.append(self.expression())
            partition = tuple(found)
        if self.word("ORDER"):
            self.need_word("BY")
            order = self.sort_keys()
        self.need_op(")")
        return t.Over(call, partition, order)


def template(body: str) -> t.Template:
    """`a ${expr} b`: text and expressions in turn."""
    parts: list[t.Node] = []
    at = 0
    for m in re.finditer(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}", body):
        if m.start() > at:
            parts.append(t.Lit(unquote(body[at : m.start()])))
        parts.append(parse_expression(m[1]))
        at = m.end()
    if at < len(body):
        parts.append(t.Lit(unquote(body[at:])))
    return t.Template(tuple(parts))
