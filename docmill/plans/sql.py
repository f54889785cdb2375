"""SQL: reading statements go to Spark SQL over the catalog's tables; writing ones become set operations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import QueryError
from ..operators.mutations import merged, with_system_columns
from ..sources.checkpoints import saved

_WORD = re.compile(r"'(?:''|[^'])*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_]\w*")


def register(engine, text: str) -> None:
    """Temporary views for the tables that the text names."""
    for name in {m[0].strip("`") for m in _WORD.finditer(text) if not m[0].startswith(("'", '"'))}:
        if engine.catalog.has(name):
            engine.catalog.table(name).createOrReplaceTempView(name)


def run(engine, text: str, args: dict) -> DataFrame:
    """Standard SQL semantics of null, outer joins and GROUP BY. `:name` placeholders take their values from args.

    INSERT gives the new rows, UPDATE the changed rows and DELETE the removed ones.
    """
    text = text.strip().rstrip(";")
    word = text.split(None, 1)[0].upper()
    if word == "INSERT":
        return insert(engine, text, args)
    if word == "UPDATE":
        return update(engine, text, args)
    if word == "DELETE":
        return delete(engine, text, args)
    if word not in ("SELECT", "WITH", "VALUES", "("):
        raise QueryError(f"no SQL statement begins with {word}")
    register(engine, text)
    return engine.spark.sql(text, args=args or None)


def insert(engine, text: str, args: dict) -> DataFrame:
    m = re.fullmatch(r"INSERT\s+INTO\s+`?(\w+)`?\s*(?:\(([^)]*)\))?\s*((?:VALUES|SELECT|WITH)\b.*)", text, re.IGNORECASE | re.DOTALL)
    if m is None:
        raise QueryError("INSERT INTO table (columns) VALUES ... or SELECT ...")
    name, columns, source = m.groups()
    register(engine, source)
    rows = engine.spark.sql(source, args=args or None)
    if columns:
        rows = rows.toDF(*(c.strip().strip("`\"") for c in columns.split(",")))
    elif engine.catalog.has(name):
        rows = rows.toDF(*engine.catalog.table(name).columns[: len(rows.columns)])
    new = saved(with_system_columns(rows, name))
    engine.catalog.append(name, new) if not engine.catalog.has(name) else engine.catalog.replace(name, merged(engine.catalog.table(name), new))
    return new


def outside(text: str) -> list[tuple[int, str]]:
    """(position, character) of what stands outside quotes and parentheses."""
    out, depth, quote = [], 0, None
    for i, c in enumerate(text):
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif depth == 0:
            out.append((i, c))
    return out


def split_where(rest: str) -> tuple[str, str | None]:
    """What stands before and after the statement's own WHERE, not one in a literal or a subquery."""
    bare = [" "] * len(rest)
    for i, c in outside(rest):
        bare[i] = c
    m = re.search(r"\bWHERE\b", "".join(bare), re.IGNORECASE)
    return (rest.strip(), None) if m is None else (rest[: m.start()].strip(), rest[m.end() :].strip() or None)


def assignments(text: str) -> list[tuple[str, str]]:
    """`a = 1, b = f(x, y)` at the outer level."""
    commas = [i for i, c in outside(text) if c == ","]
    parts = [text[a + 1 : b] for a, b in zip([-1, *commas], [*commas, len(text)], strict=True)]
    return [(a.strip().strip("`"), b.strip()) for a, _, b in (p.partition("=") for p in parts)]


def marked(engine, name: str, condition: str | None, args: dict, changes: list[tuple[str, str]]) -> DataFrame:
    """The table with __hit for the rows that the condition is true for, and the new values of the changed columns."""
    register(engine, f"`{name}` {condition or ''} {' '.join(value for _, value in changes)}")
    new = "".join(f", {value} AS `__new{i}`" for i, (_, value) in enumerate(changes))
    return engine.spark.sql(f"SELECT *, coalesce({condition or 'true'}, false) AS __hit{new} FROM `{name}`", args=args or None)


def update(engine, text: str, args: dict) -> DataFrame:
    m = re.fullmatch(r"UPDATE\s+`?(\w+)`?\s+SET\s+(.*)", text, re.IGNORECASE | re.DOTALL)
    if m is None:
        raise QueryError("UPDATE table SET column = value, ... WHERE ...")
    sets, condition = split_where(m[2])
    changes = assignments(sets)
    rows = marked(engine, m[1], condition, args, changes)
    for i, (column, _) in enumerate(changes):
        old = F.col(f"`{column}`") if column in rows.columns else F.lit(None)
        rows = rows.withColumn(column, F.when(F.col("__hit"), F.col(f"__new{i}")).otherwise(old))
    done = saved(rows.drop(*(f"__new{i}" for i in range(len(changes)))))
    engine.catalog.replace(m[1], done.drop("__hit"))
    return done.where("__hit").drop("__hit")


def delete(engine, text: str, args: dict) -> DataFrame:
    m = re.fullmatch(r"DELETE\s+FROM\s+`?(\w+)`?\s*(.*)", text, re.IGNORECASE | re.DOTALL)
    if m is None:
        raise QueryError("DELETE FROM table WHERE ...")
    _, condition = split_where(m[2])
    done = saved(marked(engine, m[1], condition, args, []))
    engine.catalog.replace(m[1], done.where("NOT __hit").drop("__hit"))
    return done.where("__hit").drop("__hit")


def translated(text: str) -> str:
    """A SELECT as text of the query language, whose rules of null it then follows."""
    from .translate import translate

    return translate(text)
