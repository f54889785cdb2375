"""Date and time functions. All times are UTC; inputs are timestamps, milliseconds or ISO texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import named
from .strings import known, text_of
from .values import DOUBLE, LONG, QueryError, Value, as_time

#: Unit names in full and short forms.
UNITS = {
    **dict.fromkeys(("y", "year", "years"), "year"),
    **dict.fromkeys(("m", "month", "months"), "month"),
    **dict.fromkeys(("w", "week", "weeks"), "week"),
    **dict.fromkeys(("d", "day", "days"), "day"),
    **dict.fromkeys(("h", "hour", "hours"), "hour"),
    **dict.fromkeys(("i", "minute", "minutes"), "minute"),
    **dict.fromkeys(("s", "second", "seconds"), "second"),
    **dict.fromkeys(("f", "millisecond", "milliseconds"), "millisecond"),
}
MILLIS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1_000, "millisecond": 1}
#: Strftime codes and the patterns of Spark's formatter.
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSSSSS", "3f": "SSS", "p": "a", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "e": "d", "Z": "'UTC'", "z": "'+0000'"}


def unit(v: Value, name: str) -> str:
    word = str(known(v, name)).lower()
    if word not in UNITS:
        raise QueryError(f"{name} knows no unit {word!r}")
    return UNITS[word]


def time(v: Value, name: str) -> Column:
    if not (v.is_time or v.is_number or v.is_text or v.is_null):
        raise QueryError(f"{name} needs a date, not {v.type.simpleString()}")
    return as_time(v)


def iso(c: Column) -> Value:
    return text_of(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def local(c: Column, tz: Value | None, name: str) -> Column:
    return c if tz is None else F.from_utc_timestamp(c, known(tz, name))


@named("NOW", "DATE_NOW", most=0)
def _now(ctx):
    return Value(F.unix_millis(F.current_timestamp()), LONG)


@named("NOW_ISO", "DATE_NOW_ISO", most=0)
def _now_iso(ctx):
    return iso(F.current_timestamp())


@named("DATE_ISO8601", least=1, most=1)
def _iso8601(ctx, v):
    return iso(time(v, "DATE_ISO8601"))


@named("DATE_TIMESTAMP", least=1, most=1)
def _timestamp(ctx, v):
    return Value(F.unix_millis(time(v, "DATE_TIMESTAMP")), LONG)


def _part(name: str, f) -> None:
    @named(name, least=1, most=2)
    def part(ctx, v, tz=None):
        return Value(f(local(time(v, name), tz, name)).cast("long"), LONG)


for _name, _f in {
    "DATE_YEAR": F.year,
    "DATE_MONTH": F.month,
    "DATE_DAY": F.dayofmonth,
    "DATE_HOUR": F.hour,
    "DATE_MINUTE": F.minute,
    "DATE_SECOND": F.second,
    "DATE_DAYOFWEEK": lambda c: F.dayofweek(c) - 1,
    "DATE_QUARTER": F.quarter,
    "DATE_DAYS_IN_MONTH": lambda c: F.dayofmonth(F.last_day(c)),
    "DATE_DAYOFYEAR": F.dayofyear,
    "DATE_ISOWEEK": F.weekofyear,
    "DATE_WEEK": F.weekofyear,
}.items():
    _part(_name, _f)


@named("DATE_TRUNC", least=2, most=3)
def _trunc(ctx, v, u, tz=None):
    c = F.date_trunc(unit(u, "DATE_TRUNC"), local(time(v, "DATE_TRUNC"), tz, "DATE_TRUNC"))
    return iso(c if tz is None else F.to_utc_timestamp(c, known(tz, "DATE_TRUNC")))


@named("DATE_FORMAT", least=2, most=3)
def _format(ctx, v, pattern, tz=None):
    def one(m: re.Match) -> str:
        if m[1] == "%":
            return "%"
        if m[1] not in STRFTIME:
            raise QueryError(f"DATE_FORMAT knows no %{m[1]}")
        return STRFTIME[m[1]]

    parts = re.split(r"(%(?:3f|[A-Za-z%]))", str(known(pattern, "DATE_FORMAT")))
    java = "".join(re.sub(r"%(3f|[A-Za-z%])", one, p) if k % 2 else ("'" + p.replace("'", "''") + "'" if p else "") for k, p in enumerate(parts))
    return text_of(F.date_format(local(time(v, "DATE_FORMAT"), tz, "DATE_FORMAT"), java))


def add(c: Column, n: Column, u: str) -> Column:
    """Years and months by the calendar, clamped to the month's end; other units by their length."""
    if u in ("year", "month"):
        months = n.cast("int") * (12 if u == "year" else 1)
        day = F.add_months(c, months)
        return (F.unix_micros(c) - F.unix_micros(F.date_trunc("day", c)) + F.unix_micros(day.cast("timestamp"))).cast("long").alias("us")
    return F.unix_micros(c) + (n.cast("double") * MILLIS[u] * 1000).cast("long")


@named("DATE_ADD", least=3, most=4)
def _date_add(ctx, v, n, u, tz=None):
    return iso(F.timestamp_micros(add(time(v, "DATE_ADD"), n.col, unit(u, "DATE_ADD"))))


@named("DATE_SUBTRACT", "DATE_SUB", least=3, most=4)
def _date_subtract(ctx, v, n, u, tz=None):
    return iso(F.timestamp_micros(add(time(v, "DATE_SUBTRACT"), -n.col, unit(u, "DATE_SUBTRACT"))))


@named("DATE_DIFF", least=3, most=6)
def _date_diff(ctx, a, b, u, fraction=None, tz1=None, tz2=None):
    """Second minus first date."""
    x, y, kind = local(time(a, "DATE_DIFF"), tz1, "DATE_DIFF"), local(time(b, "DATE_DIFF"), tz2 or tz1, "DATE_DIFF"), unit(u, "DATE_DIFF")
    exact = fraction is not None and bool(known(fraction, "DATE_DIFF"))
    if kind in ("year", "month"):
        months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
        whole = F.year(y) - F.year(x) if kind == "year" else months
        return Value((months / 12 if kind == "year" else months).cast("double") if exact else whole.cast("double"), DOUBLE)
    millis = (F.unix_millis(y) - F.unix_millis(x)) / F.lit(float(MILLIS[kind]))
    return Value(millis if exact else F.when(millis < 0, F.ceil(millis)).otherwise(F.floor(millis)).cast("double"), DOUBLE)


def bucket_millis(size: str) -> int:
    m = re.fullmatch(r"(\d+)\s*([smhd])", size.strip())
    if m is None or int(m[1]) == 0:
        raise QueryError(f"no bucket size: {size!r}")
    return int(m[1]) * {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}[m[2]]


def bucket(c: Column, millis: int) -> Column:
    """Start of the bucket (milliseconds) that a time lies in, counted from 1970."""
    ms = F.unix_millis(c)
    return ms - F.pmod(ms, F.lit(millis).cast("long"))


@named("TIME_BUCKET", least=2, most=2)
def _time_bucket(ctx, v, size):
    start = bucket(time(v, "TIME_BUCKET"), bucket_millis(known(size, "TIME_BUCKET")))
    if v.is_number:
        return Value(start, LONG)
    at = F.timestamp_millis(start)
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return text_of(F.when(start % 1000 == 0, F.concat(whole, F.lit("+00:00"))).otherwise(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))))


@named("HUMAN_TIME", least=1, most=2)
def _human(ctx, v, now=None):
    reference = F.current_timestamp() if now is None else time(now, "HUMAN_TIME")
    seconds = (F.unix_millis(reference) - F.unix_millis(time(v, "HUMAN_TIME"))) / 1000
    size, out = F.abs(seconds), None
    say = lambda n, word: F.concat(F.floor(n).cast("string"), F.lit(f" {word}"), F.when(F.floor(n) == 1, "").otherwise("s"))
    steps = ((60, 1, "second"), (3600, 60, "minute"), (86_400, 3600, "hour"), (604_800, 86_400, "day"), (2_592_000, 604_800, "week"), (31_536_000, 2_592_000, "month"))
    for below, length, word in steps:
        out = (F if out is None else out).when(size < below, say(size / length, word))
    words = out.otherwise(say(size / 31_536_000, "year"))
    return text_of(F.when(size < 1, F.lit("just now")).when(seconds < 0, F.concat(F.lit("in "), words)).otherwise(F.concat(words, F.lit(" ago"))))
