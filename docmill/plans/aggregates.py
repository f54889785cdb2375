"""Aggregate functions of COLLECT, of subqueries and of grouped arrays, as native aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import DOUBLE, LONG, TEXT, QueryError, Value

NAMES = {
    "COUNT": "COUNT", "SUM": "SUM", "AVG": "AVG", "AVERAGE": "AVG", "MIN": "MIN", "MINIMUM": "MIN", "MAX": "MAX", "MAXIMUM": "MAX",
    "LENGTH": "DISTINCT", "COUNT_DISTINCT": "DISTINCT", "COUNT_UNIQUE": "DISTINCT", "UNIQUE": "DISTINCT",
    "COLLECT_LIST": "LIST", "COLLECT": "LIST", "MEDIAN": "MEDIAN", "VARIANCE": "VARIANCE", "VAR_POP": "VARIANCE", "VAR_SAMP": "VARIANCE",
    "STDDEV": "STDDEV", "STDDEV_POP": "STDDEV", "STDDEV_SAMP": "STDDEV", "APPROX_COUNT_DISTINCT": "APPROX",
}
#: Functions of an array that can be computed as aggregates of its elements, without the array. MIN and MAX of an array
#: look at numbers only and give doubles.
OVER_ARRAYS = {
    "SUM": "SUM", "AVG": "AVG", "AVERAGE": "AVG", "MIN": "LEAST", "MAX": "GREATEST", "MEDIAN": "MEDIAN", "VARIANCE": "VARIANCE", "VAR_POP": "VARIANCE",
    "STDDEV": "STDDEV", "STDDEV_POP": "STDDEV", "COUNT_DISTINCT": "DISTINCT", "LENGTH": "ROWS", "COUNT": "ROWS",
}


def aggregate(kind: str, v: Value | None) -> Value:
    """One of the kinds above over v (None: over rows)."""
    if kind == "ROWS" or v is None:
        if kind not in ("ROWS", "COUNT", "DISTINCT"):
            raise QueryError(f"{kind} needs an argument")
        return Value(F.count(F.lit(1)), LONG)
    if kind == "COUNT":
        return Value(F.count(v.col), LONG)
    if kind == "LIST":
        kept = F.collect_list(F.struct(v.col.cast("string").alias("v") if v.is_null else v.col.alias("v")))
        return Value(F.transform(kept, lambda s: s["v"]), T.ArrayType(TEXT if v.is_null else v.type))
    if kind == "DISTINCT":
        return Value(F.count_distinct(v.col) + F.coalesce(F.max(F.when(v.col.isNull(), 1).otherwise(0)), F.lit(0)).cast("long"), LONG)
    if kind == "APPROX":
        return Value(F.approx_count_distinct(v.col), LONG)
    if kind in ("MIN", "MAX") and (v.is_number or v.is_text or v.is_time):
        return Value((F.min if kind == "MIN" else F.max)(v.col), v.type)
    x = v.col.cast("double") if v.is_number else F.lit(None).cast("double")
    made: dict[str, Column] = {
        "SUM": F.coalesce(F.sum(x), F.lit(0.0)),
        "AVG": F.avg(x),
        **dict.fromkeys(("MIN", "LEAST"), F.min(x)),
        **dict.fromkeys(("MAX", "GREATEST"), F.max(x)),
        "MEDIAN": F.median(x),
        "VARIANCE": F.when(F.count(x) >= 2, F.var_pop(x)),
        "STDDEV": F.when(F.count(x) >= 2, F.stddev_pop(x)),
    }
    if kind not in made:
        raise QueryError(f"unknown aggregate {kind}")
    return Value(made[kind], DOUBLE)


def of_nothing(kind: str, type_: T.DataType) -> Column | None:
    """What the aggregate of no rows is, where that isn't null."""
    if kind in ("ROWS", "COUNT", "DISTINCT", "APPROX"):
        return F.lit(0).cast("long")
    if kind == "SUM":
        return F.lit(0.0)
    if kind == "LIST":
        return F.array().cast(type_)
    return None
