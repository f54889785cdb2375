"""Object and JSON functions. Objects are structs; maps where the keys are data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import named
from .strings import known, string
from .values import BOOL, TEXT, QueryError, Value, array, common, conform, constant, field_of, struct, text


def fields(v: Value, name: str) -> dict[str, Value]:
    if v.is_null:
        return {}
    if not isinstance(v.type, T.StructType):
        raise QueryError(f"{name} needs an object, not {v.type.simpleString()}")
    return {f.name: field_of(v, f.name) for f in v.type.fields}


def names(args: tuple[Value, ...], what: str) -> list[str]:
    out: list[str] = []
    for a in args:
        k = known(a, what)
        out += k if isinstance(k, list) else [k]
    return out


def as_map(v: Value) -> Value:
    """An object as a map of one value type."""
    if isinstance(v.type, T.MapType):
        return v
    f = fields(v, "this function")
    type_ = common([x.type for x in f.values()])
    type_ = TEXT if isinstance(type_, T.NullType) else type_
    parts = [c for k, x in f.items() for c in (F.lit(k), conform(x, type_).cast(type_))]
    return Value(F.create_map(*parts) if parts else F.create_map().cast(T.MapType(TEXT, type_)), T.MapType(TEXT, type_))


@named("MERGE", "MERGE_OBJECTS", least=1)
def _merge(ctx, *args):
    """Shallow: later fields win; null arguments are left out."""
    if len(args) == 1 and args[0].is_array and isinstance(args[0].element, T.MapType):
        folded = F.aggregate(args[0].col, F.create_map().cast(args[0].element), lambda a, m: _over(a, m))
        return Value(folded, args[0].element)
    if any(isinstance(a.type, T.MapType) for a in args):
        out = as_map(args[0])
        for a in args[1:]:
            out = Value(_over(out.col, as_map(a).col), out.type)
        return out
    merged: dict[str, Value] = {}
    for a in args:
        for k, v in fields(a, "MERGE").items():
            if k in merged:
                type_ = common([merged[k].type, v.type])
                old = conform(merged[k], type_)
                v = Value(F.when(a.col.isNull(), old).otherwise(conform(v, type_)), type_)
            merged[k] = v
    return struct(merged)


def _over(a, b):
    """Map a with the entries of b put over it."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def deep(a: Value, b: Value) -> Value:
    x, y = fields(a, "MERGE_DEEP"), fields(b, "MERGE_DEEP")
    out = dict(x)
    for k, v in y.items():
        both = k in x and isinstance(x[k].type, T.StructType) and isinstance(v.type, T.StructType)
        out[k] = deep(x[k], v) if both else v
    return struct(out)


@named("MERGE_DEEP", "MERGE_RECURSIVE", "DEEP_MERGE", least=1)
def _merge_deep(ctx, *args):
    out = args[0]
    for a in args[1:]:
        out = deep(out, a)
    return out


@named("ATTRIBUTES", "KEYS", least=1, most=1)
def _attributes(ctx, v):
    if isinstance(v.type, T.MapType):
        return Value(F.map_keys(v.col), T.ArrayType(TEXT))
    if v.is_array and isinstance(v.element, T.StructType):
        each = array([constant(f.name) for f in v.element.fields])
        return Value(F.flatten(F.transform(v.col, lambda _: each.col)), each.type)
    return array([constant(k) for k in fields(v, "ATTRIBUTES")])


@named("VALUES", least=1, most=1)
def _values(ctx, v):
    if isinstance(v.type, T.MapType):
        return Value(F.map_values(v.col), T.ArrayType(v.type.valueType))
    if v.is_array and isinstance(v.element, T.StructType):
        type_ = array(list(fields(Value(F.lit(None).cast(v.element), v.element), "VALUES").values())).type
        return Value(F.flatten(F.transform(v.col, lambda x: conform(array(list(fields(Value(x, v.element), "VALUES").values())), type_))), type_)
    return array(list(fields(v, "VALUES").values()))


@named("KEEP", least=2)
def _keep(ctx, v, *keys):
    wanted = set(names(keys, "KEEP"))
    if isinstance(v.type, T.MapType):
        return Value(F.map_filter(v.col, lambda k, _: k.isin(*wanted)), v.type)
    return struct({k: x for k, x in fields(v, "KEEP").items() if k in wanted})


@named("UNSET", "WITHOUT", least=2)
def _unset(ctx, v, *keys):
    gone = set(names(keys, "UNSET"))
    if isinstance(v.type, T.MapType):
        return Value(F.map_filter(v.col, lambda k, _: ~k.isin(*gone)), v.type)
    return struct({k: x for k, x in fields(v, "UNSET").items() if k not in gone})


@named("HAS", "HAS_KEY", least=2, most=2)
def _has(ctx, v, key):
    """Whether the object's type has the field; for maps, whether this one has the key."""
    if isinstance(v.type, T.MapType):
        return Value(F.coalesce(F.map_contains_key(v.col, key.col), F.lit(False)), BOOL)
    if v.is_array and isinstance(v.element, T.StructType):
        return Value(F.coalesce(F.size(v.col) > 0, F.lit(False)) & F.lit(known(key, "HAS") in v.element.fieldNames()), BOOL)
    if isinstance(v.type, T.StructType):
        return Value(v.col.isNotNull() & F.lit(known(key, "HAS") in v.type.fieldNames()), BOOL)
    return constant(False)


@named("GET", least=2, most=3)
def _get(ctx, v, path, default=None):
    out = v
    for step in str(known(path, "GET")).split("."):
        out = field_of(out, step)
    if default is None:
        return out
    type_ = common([out.type, default.type])
    return Value(F.coalesce(conform(out, type_), conform(default, type_)), type_)


@named("JSON_PARSE", "PARSE_JSON", least=1, most=2)
def _json_parse(ctx, s, schema=None):
    """With a schema in DDL a value of that type; without one an object of texts, its values as JSON writes them."""
    kind = T.MapType(TEXT, TEXT) if schema is None else T._parse_datatype_string(known(schema, "JSON_PARSE"))
    return Value(F.from_json(string(s, "JSON_PARSE"), kind), kind)


@named("JSON_STRINGIFY", "TO_JSON", least=1, most=1)
def _json_stringify(ctx, v):
    if v.is_text:
        return Value(F.concat(F.lit('"'), F.regexp_replace(v.col, r'(["\\])', r"\\$1"), F.lit('"')), TEXT)
    return Value(text(v, "null"), TEXT)


@named("JSON_STRINGIFY_PRETTY", least=1, most=1)
def _json_pretty(ctx, v):
    return Value(F.to_json(v.col, {"pretty": "true"}) if v.is_array or v.is_object else text(v, "null"), TEXT)


@named("ENTRIES", least=1, most=1)
def _entries(ctx, v):
    m = as_map(v)
    pair = T.StructType([T.StructField("key", TEXT), T.StructField("value", m.type.valueType)])
    return Value(F.transform(F.map_entries(m.col), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), T.ArrayType(pair))


@named("FROM_ENTRIES", least=1, most=1)
def _from_entries(ctx, a):
    e = a.element
    if not (isinstance(e, T.StructType) and len(e.fields) == 2):
        raise QueryError("FROM_ENTRIES needs an array of {key, value}")
    return Value(F.map_from_entries(a.col), T.MapType(e.fields[0].dataType, e.fields[1].dataType))


@named("ZIP_OBJECTS", "ZIP_OBJECT", least=2, most=2)
def _zip_objects(ctx, keys, values):
    return Value(F.map_from_arrays(keys.col, values.col), T.MapType(TEXT, values.element))
