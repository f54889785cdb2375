"""The engine: queries in the query language or in SQL against a catalog."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from .lang import tree as t
from .lang.parser import parse
from .plans.compiler import Compiler
from .sources.catalog import Catalog


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, flat_joins: bool = False):
        self.spark, self.catalog, self.flat_joins = spark, catalog or Catalog(spark), flat_joins
        self.streams: dict[str, DataFrame] = {}  # streaming tables by name
        self.stream_options = None  # streaming.streams.Options

    def query(self, text: str, binds: dict | None = None):
        """A query's rows. Reading queries are lazy; mutations, views and streams take effect at once (a stream's handle
        is returned)."""
        tree = parse(text)
        compiler = Compiler(self.spark, self.catalog, binds, self.flat_joins)
        if tree.stream:
            from .streaming import streams

            return streams.create(self, tree, binds)
        if tree.create_view:
            from .operators import views

            return views.create(self, tree, text, binds)
        if tree.refresh_view:
            from .operators import views

            return views.refresh(self, tree.refresh_view)
        if any(isinstance(c, t.MUTATIONS) for c in tree.body):
            from .operators import mutations

            return mutations.run(compiler, tree)
        return compiler.run(tree)

    def sql(self, text: str, **args) -> DataFrame:
        from .plans import sql

        return sql.run(self, text, args)

    def pages(self, df: DataFrame, size: int = 1000) -> Iterator[list[dict]]:
        """A cursor: the rows in pages, one partition at a time on the driver."""
        rows = (r.asDict(recursive=True) for r in df.toLocalIterator(prefetchPartitions=True))
        while page := list(islice(rows, size)):
            yield page

    def explain(self, text: str, binds: dict | None = None) -> str:
        """Clauses in order, and Spark's formatted plan."""
        tree = parse(text)
        df = Compiler(self.spark, self.catalog, binds, self.flat_joins).run(replace(tree, extra={}))
        steps = [type(c).__name__ for c in tree.body] + (["Sort"] if tree.sort else []) + (["Limit"] if tree.limit is not None else []) + ["Return"]
        plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return " -> ".join(steps) + "\n" + plan
