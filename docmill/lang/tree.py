"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


class Node:
    """Base of all expressions and clauses."""


@dataclass(frozen=True)
class Lit(Node):
    value: Any


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class Bind(Node):
    name: str


@dataclass(frozen=True)
class Field(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class Index(Node):
    base: Node
    key: Node


@dataclass(frozen=True)
class Spread(Node):
    base: Node
    path: tuple[str, ...]


@dataclass(frozen=True)
class Obj(Node):
    items: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Arr(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Ternary(Node):
    test: Node
    then: Node
    other: Node


@dataclass(frozen=True)
class Case(Node):
    subject: Node | None
    whens: tuple[tuple[Node, Node], ...]
    other: Node | None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Lambda(Node):
    params: tuple[str, ...]
    body: Node


@dataclass(frozen=True)
class Quantifier(Node):
    kind: str
    var: str
    array: Node
    test: Node


@dataclass(frozen=True)
class Template(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Over(Node):
    call: Call
    partition: tuple[Node, ...]
    order: tuple[tuple[Node, bool], ...]


@dataclass(frozen=True)
class Sub(Node):
    query: Query


@dataclass(frozen=True)
class For(Node):
    var: str
    source: Node


@dataclass(frozen=True)
class Traverse(Node):
    var: str
    edge: str | None
    low: int
    high: int
    direction: str
    start: Node
    edges: str


@dataclass(frozen=True)
class ShortestPath(Node):
    var: str
    edge: str | None
    start: Node
    end: Node
    direction: str
    edges: str


@dataclass(frozen=True)
class Filter(Node):
    test: Node


@dataclass(frozen=True)
class Let(Node):
    items: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Aggregate(Node):
    var: str
    func: str
    arg: Node | None


@dataclass(frozen=True)
class Collect(Node):
    keys: tuple[tuple[str, Node], ...]
    into: str | None
    count: str | None
    aggregates: tuple[Aggregate, ...]


@dataclass(frozen=True)
class Join(Node):
    kind: str
    collection: str
    on: Node


@dataclass(frozen=True)
class Insert(Node):
    document: Node
    collection: str


@dataclass(frozen=True)
class Update(Node):
    selector: Node
    changes: Node
    collection: str


@dataclass(frozen=True)
class Remove(Node):
    selector: Node
    collection: str


@dataclass(frozen=True)
class Upsert(Node):
    search: Node
    insert: Node
    update: Node
    replace: bool
    collection: str


@dataclass(frozen=True)
class Windowed(Node):
    sliding: bool
    size: str
    slide: str | None
    time: str | None


@dataclass(frozen=True)
class Query(Node):
    body: tuple[Node, ...]
    sort: tuple[tuple[Node, bool], ...] = ()
    offset: Node | None = None
    limit: Node | None = None
    returns: Node | None = None
    stream: str | None = None
    create_view: str | None = None
    refresh_view: str | None = None
    extra: dict = field(default_factory=dict, compare=False, hash=False)


MUTATIONS = (Insert, Update, Remove, Upsert)


def rewrite(node: Any, change) -> Any:
    """The tree with change(n) in place of every node n for which it isn't None; replaced nodes aren't entered."""
    if isinstance(node, tuple):
        return tuple(rewrite(x, change) for x in node)
    if not (is_dataclass(node) and isinstance(node, Node)):
        return node
    if (new := change(node)) is not None:
        return new
    changed = {f.name: rewrite(getattr(node, f.name), change) for f in fields(node) if f.name != "extra"}
    return replace(node, **changed)


def walk(node: Any):
    """All nodes below, itself included."""
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node) and isinstance(node, Node):
        yield node
        for f in fields(node):
            if f.name != "extra":
                yield from walk(getattr(node, f.name))


def free_names(node: Any) -> set[str]:
    """Names of variables used; lambda and quantifier variables inside count too only where unbound."""
    if isinstance(node, tuple):
        return set().union(*(free_names(x) for x in node)) if node else set()
    if isinstance(node, Var):
        return {node.name}
    if isinstance(node, Lambda):
        return free_names(node.body) - set(node.params)
    if isinstance(node, Quantifier):
        return free_names(node.array) | (free_names(node.test) - {node.var})
    if is_dataclass(node) and isinstance(node, Node):
        return set().union(*(free_names(getattr(node, f.name)) for f in fields(node) if f.name != "extra")) if fields(node) else set()
    return set()
