"""Continuous queries: CREATE STREAM over Structured Streaming."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import QueryError, Value
from ..lang import tree as t
from ..lang.parser import parse
from ..plans.compiler import HIDDEN, Compiler, Frame, document


@dataclass
class Options:
    """How streams of an engine run. Results go to `folder`/name as Parquet, or without a folder to a table in memory."""

    watermark: str | None = None
    trigger: dict = field(default_factory=lambda: {"processingTime": "1 second"})
    folder: str | None = None
    mode: str | None = None


def spark_duration(size: str) -> str:
    m = re.fullmatch(r"(\d+)\s*([smhd])", size)
    if m is None:
        raise QueryError(f"no window size: {size!r}")
    return f"{m[1]} { {'s': 'seconds', 'm': 'minutes', 'h': 'hours', 'd': 'days'}[m[2]]}"


def half(size: str) -> str:
    seconds = int(size[:-1]) * {"s": 1, "m": 60, "h": 3600, "d": 86_400}[size[-1]]
    return f"{max(1, seconds // 2)} seconds"


class _Sources:
    """The catalog, with streaming tables first."""

    def __init__(self, catalog, streams: dict[str, DataFrame]):
        self.catalog, self.streams = catalog, streams

    def has(self, name: str) -> bool:
        return name in self.streams or self.catalog.has(name)

    def table(self, name: str) -> DataFrame:
        return self.streams[name] if name in self.streams else self.catalog.table(name)

    @property
    def kinds(self):
        return self.catalog.kinds


def live_changes(df: DataFrame) -> DataFrame:
    """Change events as documents: inserts and updates count, deletes don't. Other streams are taken as they are."""
    if {"type", "new"} <= set(df.columns):
        return df.where(~F.lower("type").isin("delete", "remove")).select("new.*")
    return df


def compiled(engine, tree: t.Query, binds: dict | None = None, options: Options | None = None) -> tuple[DataFrame, bool]:
    """The streaming (or, over a batch table, plain) DataFrame of a stream's query, and whether it aggregates.

    A window is tumbling or sliding (SLIDE, by default half of SIZE) in event time of the column that TIME names or of
    the source's first timestamp column, and in processing time if there is none. With COLLECT each window is a group,
    and its bounds are the variables window_start and window_end; without, rows carry them.
    """
    options = options or Options()
    sources = {n: live_changes(df) for n, df in getattr(engine, "streams", {}).items()}
    first = tree.body[0] if tree.body else None
    if not (isinstance(first, t.For) and isinstance(first.source, t.Var)):
        raise QueryError("a stream begins with FOR x IN collection")
    source = sources.get(first.source.name)
    source = engine.catalog.table(first.source.name) if source is None else source
    windowed = next((c for c in tree.body if isinstance(c, t.Windowed)), None)
    if windowed is not None:
        times = [f.name for f in source.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        column = windowed.time or (times[0] if times else None)
        if column is None:
            source, column = source.withColumn(f"{HIDDEN}time", F.current_timestamp()), f"{HIDDEN}time"
        source = source.withColumn(column, F.col(column).cast("timestamp"))
        if source.isStreaming:
            source = source.withWatermark(column, options.watermark or spark_duration(windowed.size))
    compiler = Compiler(engine.spark, _Sources(engine.catalog, sources | {first.source.name: source}), binds)
    frame: Frame = document(source, first.var)
    if windowed is not None:  # beside the document, where the watermark still marks it
        frame = replace(frame, df=source.select(F.struct(*source.columns).alias(first.var), F.col(column).alias(f"{HIDDEN}at")))
    aggregates = False
    for c in tree.body[1:]:
        if isinstance(c, t.Windowed):
            slide = None if not c.sliding else spark_duration(c.slide) if c.slide else half(c.size)
            w = F.window(f"{HIDDEN}at", spark_duration(c.size), slide)
            frame = replace(frame, df=frame.df.withColumn("window", w))
        elif isinstance(c, t.Collect):
            frame, aggregates = _grouped(compiler, frame, c, windowed is not None), True
        else:
            frame = compiler.clause(frame, c)
    if windowed is not None and not aggregates:
        bounds = {"window_start": Value(F.col("window.start"), T.TimestampType()), "window_end": Value(F.col("window.end"), T.TimestampType())}
        frame = frame.having(**bounds)
    returns = tree.returns
    v = compiler.expr(returns, frame.scope)
    df = frame.df.select(v.col.alias("value"))
    return (df.select("value.*") if isinstance(v.type, T.StructType) and v.type.fields else df), aggregates


def _grouped(compiler: Compiler, frame: Frame, c: t.Collect, windowed: bool) -> Frame:
    from ..plans.aggregates import NAMES, aggregate

    keys = {n: compiler.expr(e, frame.scope) for n, e in c.keys}
    made = {} if c.count is None else {c.count: aggregate("ROWS", None)}
    if c.into:
        raise QueryError("a stream keeps no rows of its groups; use AGGREGATE")
    for a in c.aggregates:
        kind = NAMES.get(a.func, a.func)
        if kind == "DISTINCT":
            kind = "APPROX"  # exact distinct counts have no streaming form
        made[a.var] = aggregate(kind, None if a.arg is None else compiler.expr(a.arg, frame.scope))
    by = [v.col.alias(n) for n, v in keys.items()] + (["window"] if windowed else [])
    df = frame.df.groupBy(*by).agg(*(v.col.alias(n) for n, v in made.items()))
    types = {n: v.type for n, v in (keys | made).items()}
    if windowed:
        df = df.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
        types |= {"window_start": T.TimestampType(), "window_end": T.TimestampType()}
    return Frame(df, types, (), True)


def create(engine, tree: t.Query, binds: dict | None = None) -> StreamingQuery:
    """Starts the stream under its name. Restarting a name with the same folder goes on where it stopped."""
    options: Options = getattr(engine, "stream_options", None) or Options()
    df, aggregates = compiled(engine, tree, binds, options)
    if not df.isStreaming:
        raise QueryError(f"{tree.body[0].source.name} is not a stream")
    writer = df.writeStream.queryName(tree.stream).trigger(**options.trigger)
    if options.folder is None:
        return writer.format("memory").outputMode(options.mode or ("complete" if aggregates else "append")).start()
    at = f"{options.folder}/{tree.stream}"
    return writer.format("parquet").outputMode(options.mode or "append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").start()


def stop(engine, name: str) -> bool:
    for q in engine.spark.streams.active:
        if q.name == name:
            q.stop()
            return True
    return False


def running(engine) -> list[str]:
    return [q.name for q in engine.spark.streams.active if q.name]


def live_query(engine, text: str, changes: DataFrame, deliver: Callable[[DataFrame], None], folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs a whole query again on every batch of changes and hands over its result."""
    parse(text)
    writer = changes.writeStream.option("checkpointLocation", f"{folder}/live-{uuid.uuid4().hex}")
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(lambda _, __: deliver(engine.query(text))).start()


def on_change(changes: DataFrame, act: Callable[[DataFrame, int], None], kinds: tuple[str, ...], folder: str, trigger: dict | None = None) -> StreamingQuery:
    """A trigger: act gets the events of these kinds, batch by batch with the batch's number, which makes retries visible."""
    chosen = changes.where(F.lower("type").isin(*kinds))
    writer = chosen.writeStream.option("checkpointLocation", f"{folder}/trigger-{uuid.uuid4().hex}")
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(act).start()
