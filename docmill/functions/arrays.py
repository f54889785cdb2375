"""Array functions; lambdas are Functions over values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import Function, named
from .strings import known
from .values import BOOL, LONG, TEXT, QueryError, Value, array, common, common_of, conform, constant, equal, storable, truthy


def items(v: Value, name: str) -> Value:
    if v.is_null:
        return array([])
    if not v.is_array:
        raise QueryError(f"{name} needs an array, not {v.type.simpleString()}")
    return v


def both(a: Value, b: Value) -> tuple[Column, Column, T.DataType]:
    """Two arrays with one type."""
    type_ = storable(common_of(a, b))
    return conform(a, type_), conform(b, type_), type_


def has(a: Column, x: Value, element: T.DataType) -> Column:
    return F.exists(a, lambda y: equal(Value(y, element), x))


@named("FIRST", least=1, most=1)
def _first(ctx, a):
    a = items(a, "FIRST")
    return Value(F.get(a.col, F.lit(0)), a.element)


@named("LAST", least=1, most=1)
def _last(ctx, a):
    a = items(a, "LAST")
    return Value(F.get(a.col, F.size(a.col) - 1), a.element)


@named("NTH", least=2, most=2)
def _nth(ctx, a, i):
    a = items(a, "NTH")
    return Value(F.get(a.col, i.col.cast("int")), a.element)


@named("REVERSE", least=1, most=1)
def _reverse(ctx, a):
    return Value(F.reverse(a.col), a.type)


@named("SORTED", "SORT", least=1, most=1)
def _sorted(ctx, a):
    return Value(F.sort_array(items(a, "SORTED").col), a.type)


@named("SORTED_DESC", "SORT_DESC", least=1, most=1)
def _sorted_desc(ctx, a):
    return Value(F.sort_array(items(a, "SORTED_DESC").col, asc=False), a.type)


@named("UNIQUE", least=1, most=1)
def _unique(ctx, a):
    return Value(F.array_distinct(items(a, "UNIQUE").col), a.type)


@named("FLATTEN", least=1, most=2)
def _flatten(ctx, a, depth=None):
    a = items(a, "FLATTEN")
    for _ in range(1 if depth is None else int(known(depth, "FLATTEN"))):
        if not isinstance(a.element, T.ArrayType):
            break
        a = Value(F.flatten(F.filter(a.col, lambda x: x.isNotNull())), a.element)
    return a


def appended(a: Value, xs: list[Value], front: bool = False) -> Value:
    more = array(xs)
    x, y, type_ = both(a, more)
    return Value(F.concat(y, x) if front else F.concat(x, y), type_)


@named("PUSH", least=2, most=3)
def _push(ctx, a, x, unique=None):
    out = appended(items(a, "PUSH"), [x])
    if unique is not None and known(unique, "PUSH"):
        return Value(F.when(has(a.col, x, a.element), a.col).otherwise(out.col), out.type)
    return out


@named("APPEND", least=2)
def _append(ctx, a, *xs):
    out = items(a, "APPEND")
    for x in xs:
        if x.is_array:
            p, q, type_ = both(out, x)
            out = Value(F.concat(p, q), type_)
        else:
            out = appended(out, [x])
    return out


@named("UNSHIFT", least=2)
def _unshift(ctx, a, *xs):
    return appended(items(a, "UNSHIFT"), list(xs), front=True)


@named("POP", least=1, most=1)
def _pop(ctx, a):
    return Value(F.slice(items(a, "POP").col, 1, F.greatest(F.size(a.col) - 1, F.lit(0))), a.type)


@named("SHIFT", least=1, most=1)
def _shift(ctx, a):
    return Value(F.slice(items(a, "SHIFT").col, 2, F.greatest(F.size(a.col) - 1, F.lit(0))), a.type)


@named("SLICE", least=2, most=3)
def _slice(ctx, a, start, length=None):
    """Zero-based; a negative start counts from the end."""
    a, n, s = items(a, "SLICE"), F.size(a.col), start.col.cast("int")
    at = F.when(s < 0, F.greatest(n + s, F.lit(0))).otherwise(F.least(s, n))
    size = n - at if length is None else F.least(F.greatest(length.col.cast("int"), F.lit(0)), n - at)
    return Value(F.slice(a.col, at + 1, size), a.type)


@named("TAKE", least=2, most=2)
def _take(ctx, a, n):
    return Value(F.slice(items(a, "TAKE").col, F.lit(1), F.greatest(n.col.cast("int"), F.lit(0))), a.type)


@named("DROP", least=2, most=2)
def _drop(ctx, a, n):
    k = F.greatest(n.col.cast("int"), F.lit(0))
    return Value(F.slice(items(a, "DROP").col, k + 1, F.greatest(F.size(a.col) - k, F.lit(0))), a.type)


@named("CHUNK", least=2, most=2)
def _chunk(ctx, a, n):
    size = int(known(n, "CHUNK"))
    if size < 1:
        raise QueryError("CHUNK needs a positive size")
    starts = F.when(F.size(items(a, "CHUNK").col) > 0, F.sequence(F.lit(1), F.size(a.col), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return Value(F.transform(starts, lambda i: F.slice(a.col, i, F.lit(size))), T.ArrayType(a.type))


@named("POSITION", "INDEX_OF", least=2, most=2)
def _position(ctx, a, x):
    a = items(a, "POSITION")
    hits = F.transform(a.col, lambda y: equal(Value(y, a.element), x))
    return Value((F.array_position(hits, True) - 1).cast("long"), LONG)


@named("COUNT", least=1, most=1)
def _count(ctx, v):
    if v.is_array or isinstance(v.type, T.MapType):
        return Value(F.coalesce(F.size(v.col), F.lit(0)).cast("long"), LONG)
    if isinstance(v.type, T.StructType):
        return Value(F.when(v.col.isNull(), 0).otherwise(len(v.type.fields)).cast("long"), LONG)
    return Value(F.when(v.col.isNull(), 0).otherwise(1).cast("long"), LONG)


@named("LENGTH", least=1, most=1)
def _length(ctx, v):
    if v.is_text:
        return Value(F.coalesce(F.char_length(v.col), F.lit(0)).cast("long"), LONG)
    if v.is_array or v.is_object:
        return _count(ctx, v)
    return constant(0)


@named("UNION", least=1)
def _union(ctx, *arrays):
    out = items(arrays[0], "UNION")
    for a in arrays[1:]:
        x, y, type_ = both(out, items(a, "UNION"))
        out = Value(F.concat(x, y), type_)
    return Value(F.array_distinct(out.col), out.type)


def _shared(y: Column, element: T.DataType):
    return lambda e: has(y, Value(e, element), element)


def _without(found):
    return lambda e: ~found(e)


@named("INTERSECTION", least=2)
def _intersection(ctx, a, *more):
    """Elements of the first that all others have; repeats of the first stay."""
    out = items(a, "INTERSECTION")
    for b in more:
        x, y, type_ = both(out, items(b, "INTERSECTION"))
        out = Value(F.filter(x, _shared(y, type_.elementType)), type_)
    return out


@named("MINUS", "DIFFERENCE", least=2)
def _minus(ctx, a, *more):
    out = items(a, "MINUS")
    for b in more:
        x, y, type_ = both(out, items(b, "MINUS"))
        found = _shared(y, type_.elementType)
        out = Value(F.filter(x, _without(found)), type_)
    return out


def sequence(a: Column, b: Column, step: Column | None = None) -> Column:
    """Whole numbers from a to b, both included; empty where the step leads away."""
    s = F.lit(1).cast("long") if step is None else step
    none = F.array().cast("array<bigint>")
    return F.when(((s > 0) & (a <= b)) | ((s < 0) & (a >= b)), F.sequence(a, b, s)).otherwise(none)


@named("RANGE", least=1, most=3)
def _range(ctx, a, b=None, step=None):
    low, high = (F.lit(0).cast("long"), a) if b is None else (a.col.cast("long"), b)
    return Value(sequence(low, high.col.cast("long"), None if step is None else step.col.cast("long")), T.ArrayType(LONG))


@named("CONTAINS_ARRAY", least=2, most=2)
def _contains_array(ctx, a, x):
    return Value(has(items(a, "CONTAINS_ARRAY").col, x, a.element), BOOL)


@named("ZIP", least=2, most=2)
def _zip(ctx, a, b):
    """Pairs up to the shorter length."""
    type_ = common([a.element, b.element])
    n = F.least(F.size(a.col), F.size(b.col))
    x, y = F.slice(a.col, F.lit(1), n), F.slice(b.col, F.lit(1), n)
    pairs = F.zip_with(x, y, lambda p, q: F.array(conform(Value(p, a.element), type_), conform(Value(q, b.element), type_)))
    return Value(pairs, T.ArrayType(T.ArrayType(type_)))


# -- with lambdas


def function(f, name: str) -> Function:
    if not isinstance(f, Function):
        raise QueryError(f"{name} needs a lambda")
    return f


@named("FILTER", least=2, most=2)
def _filter(ctx, a, f):
    a, f = items(a, "FILTER"), function(f, "FILTER")
    return Value(F.filter(a.col, lambda x: truthy(f.body(Value(x, a.element)))), a.type)


@named("MAP", least=2, most=2)
def _map(ctx, a, f):
    a, f = items(a, "MAP"), function(f, "MAP")
    type_ = f.body(Value(F.lit(None).cast(a.element), a.element)).type
    return Value(F.transform(a.col, lambda x: f.body(Value(x, a.element)).col), T.ArrayType(TEXT if isinstance(type_, T.NullType) else type_))


@named("ALL", "EVERY", least=2, most=2)
def _all(ctx, a, f):
    a, f = items(a, "ALL"), function(f, "ALL")
    return Value(F.forall(a.col, lambda x: truthy(f.body(Value(x, a.element)))), BOOL)


@named("ANY", "SOME", least=2, most=2)
def _any(ctx, a, f):
    a, f = items(a, "ANY"), function(f, "ANY")
    return Value(F.exists(a.col, lambda x: truthy(f.body(Value(x, a.element)))), BOOL)


@named("REDUCE", least=3, most=3)
def _reduce(ctx, a, first, second):
    """REDUCE(array, lambda, initial) or REDUCE(array, initial, lambda)."""
    f, start = (first, second) if isinstance(first, Function) else (second, first)
    a, f = items(a, "REDUCE"), function(f, "REDUCE")
    type_ = f.body(Value(start.col, start.type), Value(F.lit(None).cast(a.element), a.element)).type
    type_ = common([type_, start.type])
    return Value(F.aggregate(a.col, conform(start, type_), lambda acc, x: conform(f.body(Value(acc, type_), Value(x, a.element)), type_)), type_)
