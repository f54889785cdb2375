"""Mathematics, and aggregates over arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import named
from .values import DOUBLE, LONG, QueryError, Value, constant, finite, number


def real(c: Column) -> Value:
    return Value(c.cast("double"), DOUBLE)


def guarded(ctx, ok: Column, c: Column, what: str) -> Value:
    """c where ok; elsewhere null in filters and an error otherwise."""
    if ctx.safe:
        return real(F.when(ok, c))
    return real(F.when(ok | ok.isNull(), c).otherwise(F.raise_error(F.lit(what)).cast("double")))


def _plain(name: str, f, *more: str) -> None:
    @named(name, *more, least=1, most=1)
    def one(ctx, v):
        return real(f(number(v, name)))


for _names, _f in {
    ("FLOOR",): F.floor,
    ("CEIL", "CEILING"): F.ceil,
    ("ABS",): F.abs,
    ("EXP",): F.exp,
    ("SIN",): F.sin,
    ("COS",): F.cos,
    ("TAN",): F.tan,
    ("ATAN",): F.atan,
    ("DEGREES",): F.degrees,
    ("RADIANS",): F.radians,
    ("SIGN",): F.signum,
}.items():
    _plain(_names[0], _f, *_names[1:])


def _bounded(names: tuple[str, ...], ok, f) -> None:
    @named(*names, least=1, most=1)
    def one(ctx, v):
        x = number(v, names[0])
        return guarded(ctx, ok(x), f(x), f"{names[0]} is not defined here")


_bounded(("SQRT",), lambda x: x >= 0, F.sqrt)
_bounded(("LOG", "LN"), lambda x: x > 0, F.ln)
_bounded(("LOG10",), lambda x: x > 0, F.log10)
_bounded(("LOG2",), lambda x: x > 0, F.log2)
_bounded(("ASIN",), lambda x: F.abs(x) <= 1, F.asin)
_bounded(("ACOS",), lambda x: F.abs(x) <= 1, F.acos)


def half_away(x: Column, places: Column | None = None) -> Column:
    """Halves away from zero, by scaling in double precision."""
    scale = F.lit(1.0) if places is None else F.pow(F.lit(10.0), places.cast("double"))
    return F.signum(x) * F.floor(F.abs(x * scale) + 0.5) / scale


@named("ROUND", least=1, most=2)
def _round(ctx, v, places=None):
    return real(half_away(number(v, "ROUND"), None if places is None else places.col))


@named("POW", "POWER", least=2, most=2)
def _pow(ctx, a, b):
    return real(finite(F.pow(number(a, "POW"), number(b, "POW"))))


@named("ATAN2", least=2, most=2)
def _atan2(ctx, a, b):
    return real(F.atan2(number(a, "ATAN2"), number(b, "ATAN2")))


@named("PI", most=0)
def _pi(ctx):
    return constant(math.pi)


@named("E", most=0)
def _e(ctx):
    return constant(math.e)


@named("RANDOM", "RAND", most=0)
def _random(ctx):
    return real(F.rand())


@named("RANDOM_INT", "RAND_INT", least=2, most=2)
def _random_int(ctx, a, b):
    x, y = number(a), number(b)
    return Value((x + F.floor(F.rand() * (y - x + 1))).cast("long"), LONG)


@named("TRUNCATE", "TRUNC", least=1, most=1)
def _trunc(ctx, v):
    x = number(v, "TRUNC")
    return real(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


@named("MOD", least=2, most=2)
def _mod(ctx, a, b):
    from .values import arithmetic

    return arithmetic("%", a, b, ctx.safe)


@named("CLAMP", least=3, most=3)
def _clamp(ctx, v, low, high):
    return real(F.least(F.greatest(number(v), number(low)), number(high)))


# -- over arrays


def numbers(v: Value, name: str) -> Column:
    """The numeric elements as doubles."""
    if not v.is_array:
        raise QueryError(f"{name} needs an array, not {v.type.simpleString()}")
    element = Value(F.lit(None), v.element)
    if element.is_number:
        return F.transform(F.filter(v.col, lambda x: x.isNotNull()), lambda x: x.cast("double"))
    return F.filter(F.transform(v.col, lambda x: F.lit(None).cast("double")), lambda x: x.isNotNull())


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


@named("SUM", least=1, most=1)
def _sum(ctx, v):
    return real(total(numbers(v, "SUM")))


@named("AVG", "AVERAGE", least=1, most=1)
def _avg(ctx, v):
    n = numbers(v, "AVG")
    return real(F.when(F.size(n) > 0, total(n) / F.size(n)))


def _extreme(name: str, fold) -> None:
    @named(name, least=1)
    def one(ctx, *args):
        if len(args) > 1 or not args[0].is_array:
            cols = [number(a, name) for a in args]
            pick = F.least if name == "MIN" else F.greatest
            return real(pick(*cols) if len(cols) > 1 else cols[0])
        return real(fold(numbers(args[0], name)))


_extreme("MIN", F.array_min)
_extreme("MAX", F.array_max)


@named("MEDIAN", least=1, most=1)
def _median(ctx, v):
    s = F.array_sort(numbers(v, "MEDIAN"))
    n = F.size(s)
    at = lambda i: F.get(s, i.cast("int"))
    return real(F.when(n == 0, None).when(n % 2 == 1, at((n - 1) / 2)).otherwise((at(n / 2 - 1) + at(n / 2)) / 2))


@named("PERCENTILE", least=2, most=2)
def _percentile(ctx, v, p):
    """Linear interpolation between the nearest ranks; p from 0 to 100."""
    s = F.array_sort(numbers(v, "PERCENTILE"))
    at = (F.size(s) - 1) * number(p) / 100
    low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return real(low + (high - low) * (at - F.floor(at)))


def _moment(names: tuple[str, ...], finish) -> None:
    @named(*names, least=1, most=1)
    def one(ctx, v):
        n = numbers(v, names[0])
        mean = total(n) / F.size(n)
        squares = F.aggregate(n, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return real(F.when(F.size(n) >= 2, finish(squares / F.size(n))))


_moment(("VARIANCE", "VAR_POP", "VAR_SAMP"), lambda c: c)
_moment(("STDDEV", "STDDEV_POP", "STDDEV_SAMP", "STDDEV_POPULATION"), F.sqrt)


@named("COUNT_DISTINCT", "COUNT_UNIQUE", "UNIQUE_COUNT", least=1, most=1)
def _count_distinct(ctx, v):
    return Value(F.size(F.array_distinct(v.col)).cast("long"), LONG)
