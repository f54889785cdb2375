"""Function names of the query language, and how users add their own."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from .values import QueryError, Value


@dataclass(frozen=True)
class Context:
    """How a call is compiled: in a filter (safe) what fails is null, elsewhere it raises."""

    safe: bool = False
    parameters: dict | None = None


@dataclass(frozen=True)
class Function:
    """A lambda argument: parameter count and its body as a function of values."""

    arity: int
    body: Callable[..., Value]


Compiled = Callable[..., Value]
FUNCTIONS: dict[str, tuple[Compiled, int, int]] = {}


def named(*names: str, least: int = 0, most: int | None = None):
    """Registers f(ctx, *args) under names, for `least` to `most` arguments (None: as many as there are)."""

    def add(f: Compiled) -> Compiled:
        for name in names:
            FUNCTIONS[name] = (f, least, 10_000 if most is None else most)
        return f

    return add


def register(name: str, f: Callable[..., Column], returns) -> None:
    """A user's function of columns (also a udf or pandas_udf), with the type that it returns."""
    FUNCTIONS[name.upper()] = ((lambda ctx, *args: Value(f(*(a.col for a in args)), returns)), 0, 10_000)


def call(name: str, ctx: Context, args: list) -> Value:
    load()
    if name not in FUNCTIONS:
        raise QueryError(f"unknown function {name}")
    f, least, most = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise QueryError(f"{name} takes {least} to {most} arguments, not {len(args)}")
    return f(ctx, *args)


def load() -> None:
    for module in ("strings", "dates", "numbers", "arrays", "objects", "kinds", "geo", "vectors", "phonetic"):
        importlib.import_module(f"docmill.functions.{module}")
