"""Breadth-first traversal and shortest paths as frontier joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import QueryError, Value, common, conform, field_of
from ..lang import tree as t
from ..sources.checkpoints import saved


def id_of(v: Value) -> Column:
    if v.is_text or v.is_null:
        return v.col.cast("string")
    if isinstance(v.type, T.StructType):
        return field_of(v, "_id").col.cast("string")
    raise QueryError("a start vertex is an id or a document")


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(from, to, edge, order): how edges can be walked."""
    numbered = edges.select(F.struct(*(F.col(f"`{c}`") for c in edges.columns)).alias("edge"), F.monotonically_increasing_id().alias("order"))
    valid = numbered.where("coalesce(edge._from, '') <> '' AND coalesce(edge._to, '') <> ''")
    out = valid.select(F.col("edge._from").alias("from"), F.col("edge._to").alias("to"), "edge", "order")
    back = valid.select(F.col("edge._to").alias("from"), F.col("edge._from").alias("to"), "edge", "order")
    return {"OUTBOUND": lambda: out, "INBOUND": lambda: back, "ANY": lambda: out.unionByName(back)}[direction]()


def reached(starts: DataFrame, edges: DataFrame, direction: str, low: int, high: int) -> DataFrame:
    """(start, id, depth, edge): each vertex once per start, at its least depth, by the first edge in scan order.

    One join per level against the edges, one anti join against what was visited; levels are written to the shared
    folder, and the loop ends with the first empty one.
    """
    walk = steps(edges, direction)
    edge_type = walk.schema["edge"].dataType
    level = saved(starts.select("start", F.col("start").alias("id")).where("start IS NOT NULL").distinct())
    level = level.select("start", "id", F.lit(0).alias("depth"), F.lit(None).cast(edge_type).alias("edge"))
    visited, found = level.select("start", "id"), [level] if low == 0 else []
    for depth in range(1, high + 1):
        nexts = level.join(walk, level["id"] == walk["from"]).groupBy("start", walk["to"].alias("id")).agg(F.min_by(walk["edge"], walk["order"]).alias("edge"))
        level = saved(nexts.join(visited, ["start", "id"], "left_anti").select("start", "id", F.lit(depth).alias("depth"), "edge"))
        if level.isEmpty():
            break
        visited = visited.unionByName(level.select("start", "id"))
        if depth >= low:
            found.append(level)
    empty = level.where(F.lit(False))
    return reduce(DataFrame.unionByName, found, empty)


def with_documents(catalog, rows: DataFrame, column: str, name: str, collections: list[str] | None = None) -> tuple[DataFrame, T.DataType]:
    """rows with the vertex documents of ids like `collection/key`; rows without one go. The names of the collections
    are looked up in the rows unless they are given."""
    if collections is None:
        collections = [r[0] for r in rows.select(F.substring_index(column, "/", 1)).distinct().collect()]
    tables = []
    for c in collections:
        if c and catalog.has(c):
            df = catalog.table(c)
            vertex = F.col("_id") if "_id" in df.columns else F.concat(F.lit(f"{c}/"), F.col("_key").cast("string"))
            fields = [F.col(f"`{x}`") for x in df.columns] + ([] if "_id" in df.columns else [vertex.alias("_id")])
            tables.append(df.select(vertex.alias("__vertex"), F.struct(*fields).alias(name)))
    if not tables:
        type_ = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_id", T.StringType())])
        return rows.where(F.lit(False)).withColumn(name, F.lit(None).cast(type_)), type_
    type_ = common([x.schema[name].dataType for x in tables])
    same = [x.select("__vertex", conform(Value(F.col(name), x.schema[name].dataType), type_).cast(type_).alias(name)) for x in tables]
    vertices = reduce(DataFrame.unionByName, same)
    return rows.join(vertices, rows[column] == vertices["__vertex"]).drop("__vertex"), type_


def traverse(catalog, starts: DataFrame, edges: str, direction: str = "OUTBOUND", low: int = 1, high: int = 1) -> DataFrame:
    """API form: starts has a column `start`; gives start, depth, vertex, edge."""
    rows = reached(starts, catalog.table(edges), direction, low, high)
    return with_documents(catalog, rows, "id", "vertex")[0].select("start", "depth", "vertex", "edge")


def shortest_path(catalog, start: str, end: str, edges: str, direction: str) -> list[tuple[int, str, object]]:
    """(position, id, edge) along a path of fewest edges, or nothing. Only the path itself comes to the driver."""
    walk = steps(catalog.table(edges), direction)
    if start == end:
        return [(0, start, None)]
    spark = walk.sparkSession
    level = spark.createDataFrame([(start,)], "id string")
    visited, levels = level, []
    while True:
        nexts = level.join(walk, level["id"] == walk["from"]).groupBy(walk["to"].alias("id")).agg(F.min_by(F.struct(level["id"].alias("p"), walk["edge"].alias("e")), walk["order"]).alias("by"))
        nexts = saved(nexts.join(visited, "id", "left_anti"))
        if nexts.isEmpty():
            return []
        levels.append(nexts)
        if not nexts.where(F.col("id") == end).isEmpty():
            break
        level = nexts.select("id")
        visited = visited.unionByName(level)
    path, at = [], end
    for n in range(len(levels), 0, -1):
        row = levels[n - 1].where(F.col("id") == at).first()
        path.append((n, at, row.by.e))
        at = row.by.p
    return [(0, start, None), *reversed(path)]


def compile_clause(compiler, frame, c):
    """FOR v[, e] IN .. as columns v and e of the frame."""
    from dataclasses import replace

    catalog = compiler.catalog
    if isinstance(c, t.Traverse):
        frame, e = compiler.hoisted(frame, c.start)
        start = id_of(compiler.expr(e, frame.scope))
        starts = frame.df.select(start.alias("start"))
        rows, type_ = with_documents(catalog, reached(starts, catalog.table(c.edges), c.direction, c.low, c.high), "id", c.var)
        found = rows.select(F.col("start").alias("__start"), c.var, F.col("edge").alias(c.edge or "__edge"))
        types = {c.var: type_} | ({c.edge: rows.schema["edge"].dataType} if c.edge else {})
        joined = frame.df.withColumn("__from", start).join(found, F.col("__from") == F.col("__start")) if frame.types else found
        return replace(frame, df=joined.select(*frame.types, *types), types=frame.types | types, started=True)
    ends = []
    for e in (c.start, c.end):
        v = compiler.expr(e, {})
        ends.append(compiler.spark.range(1).select(id_of(v).alias("id")).first().id)
    edge_type = T.StructType(catalog.table(c.edges).schema.fields)
    path = shortest_path(catalog, *ends, c.edges, c.direction)
    schema = T.StructType([T.StructField("__at", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField(c.edge or "__edge", edge_type)])
    rows = compiler.spark.createDataFrame(path, schema)
    rows, type_ = with_documents(catalog, rows, "id", c.var)
    types = {c.var: type_} | ({c.edge: edge_type} if c.edge else {})
    df = rows.orderBy("__at").select(*types)
    side = replace(frame, df=df, types=types, started=True)
    return side if not frame.types else compiler.crossed(frame, side)


def invalid_edges(df: DataFrame) -> DataFrame:
    """Edges without a source or a target."""
    return df.where("coalesce(_from, '') = '' OR coalesce(_to, '') = ''")
