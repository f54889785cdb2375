"""INSERT, UPDATE, REMOVE and UPSERT as set operations on whole tables, and the write-side upkeep of collections."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import QueryError, Value, common, conform, field_of
from ..lang import tree as t
from ..sources.checkpoints import saved

SYSTEM = ("_key", "_id", "_rev", "_created_at", "_updated_at")


def time_ordered_key() -> Column:
    """A version-7 UUID: milliseconds, then random bits."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    rest = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    hexes = F.concat(ms, F.lit("7"), F.substring(rest, 14, 3), F.lit("a"), F.substring(rest, 18, 15))
    part = lambda a, n: F.substring(hexes, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))


def with_system_columns(df: DataFrame, collection: str) -> DataFrame:
    """A key where there is none, id, revision and times."""
    key = F.coalesce(F.col("_key").cast("string"), time_ordered_key()) if "_key" in df.columns else time_ordered_key()
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    df = df.withColumn("_key", key)
    return df.withColumns({"_id": F.concat(F.lit(f"{collection}/"), F.col("_key")), "_rev": F.uuid(), "_created_at": now, "_updated_at": now})


def fitted(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns and types that both tables can have."""
    types = {f.name: f.dataType for f in like.schema.fields}
    out = []
    for f in df.schema.fields:
        type_ = common([f.dataType, types[f.name]]) if f.name in types else f.dataType
        out.append(conform(Value(F.col(f"`{f.name}`"), f.dataType), type_).cast(type_).alias(f.name))
    return df.select(*out)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return fitted(a, b).unionByName(fitted(b, a), allowMissingColumns=True)


def key_of(v: Value) -> Column:
    if v.is_text:
        return F.element_at(F.split(v.col, "/"), -1)
    if isinstance(v.type, T.StructType):
        key = field_of(v, "_key")
        return key.col.cast("string") if not key.is_null else F.element_at(F.split(field_of(v, "_id").col.cast("string"), "/"), -1)
    raise QueryError("a selector is a key or a document with _key")


def run(compiler, query: t.Query) -> DataFrame:
    """Executes a mutation; gives RETURN's rows, else one row of counts. NEW and OLD are bound."""
    at = next(i for i, c in enumerate(query.body) if isinstance(c, t.MUTATIONS))
    clause = query.body[at]
    from ..plans.compiler import Frame

    frame, _ = compiler.body(t.Query(query.body[:at], returns=t.Lit(None)), Frame(compiler.spark.range(1).select(), {}))
    if not frame.types and not frame.started:
        frame = replace(frame, started=True)
    do = {t.Insert: insert, t.Update: update, t.Remove: remove, t.Upsert: upsert}[type(clause)]
    frame, counts = do(compiler, frame, clause)
    if query.returns is None:
        return compiler.spark.createDataFrame([tuple(counts.get(k, 0) for k in ("inserted", "updated", "removed"))], "inserted long, updated long, removed long")
    rest = t.Query(query.body[at + 1 :], query.sort, query.offset, query.limit, query.returns)
    frame, returns = compiler.body(rest, frame)
    frame, returns = compiler.ordered(frame, rest, returns)
    v = compiler.expr(returns, frame.scope)
    df = frame.df.select(v.col.alias("value"))
    return df.select("value.*") if isinstance(v.type, T.StructType) and v.type.fields else df


def flat(frame, name: str) -> DataFrame:
    return frame.df.select(f"{name}.*")


def check_collection(catalog, collection: str, df: DataFrame, updating: bool = False) -> None:
    kind = catalog.kinds.get(collection, "document")
    if kind == "timeseries" and updating:
        raise QueryError(f"{collection} is append-only")
    if kind == "edge":
        if not {"_from", "_to"} <= set(df.columns):
            raise QueryError("edges need _from and _to")
        bad = df.where("coalesce(_from, '') = '' OR coalesce(_to, '') = ''")
        if not bad.isEmpty():
            raise QueryError("edges need _from and _to")


def written(catalog, collection: str, keys: DataFrame, new: DataFrame, after: int | None = None) -> None:
    """The collection's next version, after one that was read: without the rows of these keys, with new ones, which keep its
    unique indexes. Where the new rows have the collection's columns and types, files without such a key stay as they are."""
    table = catalog.table(collection)
    kept = table.join(keys.select("_key"), "_key", "left_anti")
    for columns in catalog.unique.get(collection, ()):
        if set(columns) <= set(new.columns):
            check_unique(collection, kept, new, columns)
    both = merged(table, new)
    types = lambda df: {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if collection in catalog.loaders or types(both) != types(table):
        catalog.replace(collection, merged(kept, new), after=after)
    else:
        catalog.exchange(collection, keys, fitted(new, table).select(*(F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields)), after)


def check_unique(collection: str, kept: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> None:
    """Fails where a new row's values are those of another row; nulls don't count. Kept rows without a match aren't grouped."""
    values = new.select(*(F.col(f"`{c}`") for c in columns)).where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    taken = kept.join(values.distinct(), list(columns), "left_semi").select(*columns) if set(columns) <= set(kept.columns) else values.limit(0)
    if (bad := unique_violations(values.unionByName(taken), *columns).first()) is not None:
        raise QueryError(f"{collection}: {', '.join(f'{c} = {bad[c]!r}' for c in columns)} must be unique")


def insert(compiler, frame, c: t.Insert):
    from ..plans.compiler import Frame

    catalog = compiler.catalog
    frame, e = compiler.hoisted(frame, c.document)
    doc = compiler.expr(e, frame.scope)
    if not isinstance(doc.type, T.StructType):
        raise QueryError("INSERT needs an object")
    # Written once, so that random keys and times, and the order of rows, are the same in every use.
    fixed = saved(with_system_columns(frame.df.select(doc.col.alias("d")).select("d.*"), c.collection).withColumn("__at", F.monotonically_increasing_id()))
    new = fixed.drop("__at")
    check_collection(catalog, c.collection, new)
    if catalog.has(c.collection) and "_key" in catalog.table(c.collection).columns and "_key" in doc.type.fieldNames():
        last = fixed.withColumn("__n", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("__at")))).where("__n = 1").drop("__n", "__at")
        written(catalog, c.collection, new, last)
    elif catalog.has(c.collection) and catalog.unique.get(c.collection):
        written(catalog, c.collection, new.limit(0), new)
    else:
        for columns in catalog.unique.get(c.collection, ()):
            check_unique(c.collection, new.limit(0), new, columns)
        catalog.append(c.collection, new)
    n = new.count()
    return Frame(new.select(F.struct("*").alias("NEW")), {"NEW": new.schema}, (), True), {"inserted": n}


def changes_by_key(compiler, frame, selector: t.Node, changes: t.Node | None) -> DataFrame:
    """Per key its last change; keys that come twice get one."""
    frame, selector = compiler.hoisted(frame, selector)
    key = key_of(compiler.expr(selector, frame.scope)).alias("__key")
    if changes is None:
        return frame.df.select(key).where("__key IS NOT NULL").distinct()
    frame, changes = compiler.hoisted(frame, changes)
    v = compiler.expr(changes, frame.scope)
    if not isinstance(v.type, T.StructType):
        raise QueryError("changes are an object")
    rows = frame.df.select(key, v.col.alias("__changes"), F.monotonically_increasing_id().alias("__at")).where("__key IS NOT NULL")
    return rows.groupBy("__key").agg(F.max_by("__changes", "__at").alias("__changes"))


def applied(table: DataFrame, changes: DataFrame, whole: bool = False) -> DataFrame:
    """The rows of table whose _key has changes: a shallow merge, or with `whole` a replacement; __old has the rows before."""
    type_ = changes.schema["__changes"].dataType
    joined = table.join(changes, table["_key"] == changes["__key"])
    out = []
    for f in table.schema.fields:
        old = Value(F.col(f"`{f.name}`"), f.dataType)
        if f.name == "_rev":
            out.append(F.uuid().alias("_rev"))
        elif f.name == "_updated_at":
            out.append(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("_updated_at"))
        elif f.name in type_.fieldNames() and not f.name.startswith("_"):
            new = field_of(Value(F.col("__changes"), type_), f.name)
            both = common([old.type, new.type])
            out.append(conform(new, both).cast(both).alias(f.name))
        elif whole and not f.name.startswith("_"):
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            out.append(old.col.alias(f.name))
    for name in type_.fieldNames():
        if name not in table.columns and not name.startswith("_"):
            out.append(F.col("__changes")[name].alias(name))
    return joined.select(*out, F.struct(*(F.col(f"`{x}`") for x in table.columns)).alias("__old"))


def changed_frame(done: DataFrame):
    """NEW and OLD as the variables of what follows."""
    from ..plans.compiler import Frame

    names = [x for x in done.columns if x != "__old"]
    out = done.select(F.struct(*(F.col(f"`{x}`") for x in names)).alias("NEW"), F.col("__old").alias("OLD"))
    return Frame(out, {f.name: f.dataType for f in out.schema.fields}, (), True)


def update(compiler, frame, c: t.Update):
    """Changed rows are written once for NEW and OLD, and the table's next version once: kept rows and changed ones."""
    catalog, table = compiler.catalog, compiler.catalog.table(c.collection)
    read = catalog.version(c.collection)
    check_collection(catalog, c.collection, table, updating=True)
    done = saved(applied(table, changes_by_key(compiler, frame, c.selector, c.changes)))
    written(catalog, c.collection, done, done.drop("__old"), read)
    return changed_frame(done), {"updated": done.count()}


def remove(compiler, frame, c: t.Remove):
    from ..plans.compiler import Frame

    catalog, table = compiler.catalog, compiler.catalog.table(c.collection)
    read = catalog.version(c.collection)
    keys = changes_by_key(compiler, frame, c.selector, None)
    gone = saved(table.join(keys, table["_key"] == keys["__key"], "left_semi"))
    written(catalog, c.collection, gone, table.limit(0), read)
    return Frame(gone.select(F.struct("*").alias("OLD")), {"OLD": gone.schema}, (), True), {"removed": gone.count()}


def upsert(compiler, frame, c: t.Upsert):
    """Rows whose key is known are updated (or with REPLACE replaced), the others inserted.

    Rows of the same key follow each other: a known document takes the last change, an unknown one is inserted by the
    first row and takes the last change of the others. A row without a key, or whose new document has another key than
    the one sought, never meets another row: each inserts a document.
    """
    catalog = compiler.catalog
    frame, search = compiler.hoisted(frame, c.search)
    frame, new = compiler.hoisted(frame, c.insert)
    frame, change = compiler.hoisted(frame, c.update)
    key, new, change = key_of(compiler.expr(search, frame.scope)), compiler.expr(new, frame.scope), compiler.expr(change, frame.scope)
    if not (isinstance(new.type, T.StructType) and isinstance(change.type, T.StructType)):
        raise QueryError("UPSERT inserts an object and updates with one")
    if not catalog.has(c.collection):
        catalog.replace(c.collection, with_system_columns(compiler.spark.createDataFrame([], T.StructType([f for f in new.type.fields if f.name != "_key"])), c.collection))
    table, read = catalog.table(c.collection), catalog.version(c.collection)
    rows = saved(frame.df.select(key.alias("__key"), new.col.alias("__insert"), change.col.alias("__changes"), F.monotonically_increasing_id().alias("__at")))
    keys = table.select(F.col("_key").alias("__key"))
    known = rows.join(keys, "__key", "left_semi").groupBy("__key").agg(F.max_by("__changes", "__at").alias("__changes"))
    unknown = rows.join(keys, "__key", "left_anti")
    own = F.col("__insert")["_key"].cast("string") if "_key" in new.type.fieldNames() else F.lit(None).cast("string")
    meets = F.coalesce(own == F.col("__key"), F.lit(False))
    first = unknown.where(meets).groupBy("__key").agg(F.min_by("__insert", "__at").alias("__insert"), F.max_by("__changes", "__at").alias("__changes"), F.count(F.lit(1)).alias("__n"))
    fresh = saved(with_system_columns(first.select("__insert.*").unionByName(unknown.where(~meets).select("__insert.*")), c.collection))
    again = first.where("__n > 1").select("__key", "__changes")
    twice = applied(fresh, again, c.replace).drop("__old")
    inserted = merged(fresh.join(twice.select("_key"), "_key", "left_anti"), twice) if "_key" in new.type.fieldNames() else fresh
    updated = applied(table, known, c.replace)
    done = saved(merged(updated, inserted))
    written(catalog, c.collection, done, done.drop("__old"), read)
    n_new = fresh.count()
    return changed_frame(done), {"inserted": n_new, "updated": rows.count() - n_new}


# -- upkeep


def prune(catalog, collection: str, before_ms: int) -> DataFrame:
    """Drops documents whose time-ordered key is older."""
    table = catalog.table(collection)
    made = F.conv(F.substring(F.replace(F.col("_key"), F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")
    return catalog.replace(collection, table.where(made >= before_ms))


def expire(catalog, collection: str, field: str, seconds: int) -> DataFrame:
    """Drops documents whose time (seconds, milliseconds or ISO text) plus `seconds` has passed; others stay, null too."""
    from ..functions.values import as_time

    table = catalog.table(collection)
    v = Value(F.col(f"`{field}`"), table.schema[field].dataType)
    due = F.unix_millis(as_time(v)) + seconds * 1000
    return catalog.replace(collection, table.where(due.isNull() | (due > F.unix_millis(F.current_timestamp()))))


def unique_violations(df: DataFrame, *columns: str) -> DataFrame:
    """Values of a unique index that occur more than once; nulls don't count."""
    return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).groupBy(*columns).count().where("count > 1")


def validate(df: DataFrame, rules: dict[str, str], strict: bool = True) -> DataFrame:
    """Checks rows against named SQL conditions. Strict raises at the first bad row; else `_violations` lists them."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    if not strict:
        return df.withColumn("_violations", found)
    checked = df.withColumn("_violations", found)
    bad = F.size("_violations") > 0
    return checked.where(F.when(bad, F.raise_error(F.concat(F.lit("schema: "), F.array_join("_violations", ", "))).cast("boolean")).otherwise(True)).drop("_violations")
