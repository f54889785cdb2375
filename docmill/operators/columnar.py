"""Columnar collections: projection, filters, aggregates and time buckets over Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bucket, bucket_millis
from ..functions.values import QueryError

AGGREGATES = {"AVERAGE": "AVG", "MINIMUM": "MIN", "MAXIMUM": "MAX", "COUNT_UNIQUE": "COUNT_DISTINCT", "UNIQUE": "COUNT_DISTINCT"}


def condition(spec: dict) -> Column:
    """{"column", "op", "value"} with op eq ne gt gte lt lte in, or {"and": [..]}, {"or": [..]}. Reaches the scan."""
    if "and" in spec or "or" in spec:
        parts = [condition(s) for s in spec.get("and", spec.get("or"))]
        return reduce(and_ if "and" in spec else or_, parts)
    c, op, v = F.col(spec["column"]), spec["op"].lower(), spec.get("value")
    tests = {"eq": lambda: c == v, "ne": lambda: c != v, "gt": lambda: c > v, "gte": lambda: c >= v, "lt": lambda: c < v, "lte": lambda: c <= v, "in": lambda: c.isin(*v)}
    if op not in tests:
        raise QueryError(f"unknown filter {op!r}")
    return tests[op]()


def made(func: str, column: str) -> Column:
    """COUNT counts cells, null ones too; SUM, AVG, MIN and MAX look at numbers only."""
    name = AGGREGATES.get(func.upper(), func.upper())
    x = F.col(column).try_cast("double") if hasattr(Column, "try_cast") else F.col(column).cast("double")
    table = {
        "COUNT": lambda: F.count(F.lit(1)),
        "SUM": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "AVG": lambda: F.avg(x),
        "MIN": lambda: F.min(x),
        "MAX": lambda: F.max(x),
        "COUNT_DISTINCT": lambda: F.count_distinct(F.col(column)) + F.coalesce(F.max(F.col(column).isNull().cast("long")), F.lit(0)),
    }
    if name not in table:
        raise QueryError(f"unknown aggregate {func!r}")
    return table[name]()


class Columnar:
    """One columnar collection of a catalog."""

    def __init__(self, catalog, name: str):
        self.catalog, self.name = catalog, name

    def table(self, where: dict | None = None) -> DataFrame:
        df = self.catalog.table(self.name)
        return df.where(condition(where)) if where else df

    def read(self, columns: Sequence[str] | None = None, where: dict | None = None, limit: int | None = None) -> DataFrame:
        df = self.table(where)
        df = df.select(*columns) if columns else df
        return df if limit is None else df.limit(limit)

    def aggregate(self, column: str, func: str, where: dict | None = None) -> DataFrame:
        return self.table(where).agg(made(func, column).alias("_agg"))

    def group_by(self, keys: Sequence[str | dict], column: str, func: str, where: dict | None = None) -> DataFrame:
        """Keys are column names or {"column", "bucket": "1h"}; the result has the keys and `_agg`."""
        by = []
        for k in keys:
            if isinstance(k, str):
                by.append(F.col(k))
            else:
                start = F.timestamp_millis(bucket(F.col(k["column"]).cast("timestamp"), bucket_millis(k["bucket"])))
                by.append(start.alias(k["column"]))
        return self.table(where).groupBy(*by).agg(made(func, column).alias("_agg"))

    def insert(self, rows: DataFrame) -> DataFrame:
        return self.catalog.append(self.name, rows)

    def delete(self, where: dict) -> DataFrame:
        return self.catalog.replace(self.name, self.table().where(~F.coalesce(condition(where), F.lit(False))))
