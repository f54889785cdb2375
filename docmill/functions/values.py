"""Typed column values, and the language's rules of truth, comparison, arithmetic and text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, BOOL, LONG, DOUBLE, TEXT, TIME = T.NullType(), T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType(), T.TimestampType()


class QueryError(ValueError):
    """The query means something that its data don't allow."""


@dataclass(frozen=True)
class Value:
    """A column and its static type; `literal` where the value is known when the plan is made."""

    col: Column
    type: T.DataType
    literal: object = None
    constant: bool = False

    @property
    def is_null(self) -> bool:
        return isinstance(self.type, T.NullType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_text(self) -> bool:
        return isinstance(self.type, T.StringType)

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_object(self) -> bool:
        return isinstance(self.type, (T.StructType, T.MapType))

    @property
    def is_time(self) -> bool:
        return isinstance(self.type, (T.TimestampType, T.TimestampNTZType, T.DateType))

    @property
    def element(self) -> T.DataType:
        return self.type.elementType if self.is_array else NULL


def constant(value: object) -> Value:
    if value is None:
        return Value(F.lit(None), NULL, None, True)
    if isinstance(value, bool):
        return Value(F.lit(value), BOOL, value, True)
    if isinstance(value, int):
        return Value(F.lit(value).cast("long"), LONG, value, True)
    if isinstance(value, float):
        return Value(F.lit(value), DOUBLE, value, True)
    if isinstance(value, str):
        return Value(F.lit(value), TEXT, value, True)
    if isinstance(value, (list, tuple)):
        return array([constant(v) for v in value])
    if isinstance(value, dict):
        return struct({k: constant(v) for k, v in value.items()})
    raise QueryError(f"no literal for {value!r}")


def null_of(type_: T.DataType) -> Value:
    return Value(F.lit(None).cast(type_), type_)


def field_of(base: Value, name: str) -> Value:
    """A field, null where the type has none of this name."""
    if isinstance(base.type, T.StructType):
        for f in base.type.fields:
            if f.name == name:
                return Value(base.col.getField(f"`{name}`" if not name.isidentifier() else name), f.dataType)
    if isinstance(base.type, T.MapType):
        return Value(F.try_element_at(base.col, F.lit(name)), base.type.valueType)
    return Value(F.lit(None), NULL)


def struct(items: dict[str, Value]) -> Value:
    if not items:
        return Value(F.create_map().cast("map<string,string>"), T.MapType(TEXT, TEXT))
    cols = {k: materialised(v) for k, v in items.items()}
    return Value(F.struct(*(v.col.alias(k) for k, v in cols.items())), T.StructType([T.StructField(k, v.type) for k, v in cols.items()]))


def materialised(v: Value) -> Value:
    """Values without a type of their own become null strings, so that they can be stored."""
    return Value(v.col.cast("string"), TEXT) if v.is_null else v


def common(types: list[T.DataType]) -> T.DataType:
    """The type that values of all these types can take."""
    known = [x for x in types if not isinstance(x, T.NullType)]
    if not known:
        return NULL
    if all(x == known[0] for x in known):
        return known[0]
    if all(isinstance(x, T.NumericType) for x in known):
        return LONG if all(isinstance(x, T.IntegralType) for x in known) else DOUBLE
    if all(isinstance(x, T.ArrayType) for x in known):
        return T.ArrayType(common([x.elementType for x in known]))
    if all(isinstance(x, T.StructType) for x in known):
        names = list(dict.fromkeys(f.name for x in known for f in x.fields))
        return T.StructType([T.StructField(n, common([f.dataType for x in known for f in x.fields if f.name == n])) for n in names])
    return TEXT


def storable(type_: T.DataType) -> T.DataType:
    """Arrays of nothing known are arrays of strings."""
    return T.ArrayType(TEXT) if isinstance(type_, T.ArrayType) and isinstance(type_.elementType, T.NullType) else type_


def is_blank(v: Value) -> bool:
    """A constant array without a value that would give it a type."""
    return v.constant and isinstance(v.literal, list) and all(x is None for x in v.literal)


def common_of(*values: Value) -> T.DataType:
    """The type that all values can take; arrays without values take any."""
    return common([T.ArrayType(NULL) if is_blank(v) else v.type for v in values])


def conform(v: Value, type_: T.DataType) -> Column:
    """v as a value of a type that common() found."""
    if is_blank(v) and isinstance(type_, T.ArrayType):
        element = TEXT if isinstance(type_.elementType, T.NullType) else type_.elementType
        return F.array(*(F.lit(None).cast(element) for _ in v.literal)).cast(T.ArrayType(element))
    if v.type == type_ or isinstance(type_, T.NullType):
        return v.col
    if isinstance(type_, T.StringType):
        return text(v)
    if isinstance(type_, T.StructType) and isinstance(v.type, T.StructType):
        made = F.struct(*(conform(field_of(v, f.name), f.dataType).cast(f.dataType).alias(f.name) for f in type_.fields))
        return F.when(v.col.isNotNull(), made)
    if isinstance(type_, T.ArrayType) and v.is_array:
        return F.transform(v.col, lambda x: conform(Value(x, v.element), type_.elementType))
    return v.col.cast(type_)


def array(items: list[Value]) -> Value:
    type_ = common_of(*items)
    whole = all(v.constant for v in items)
    values = [v.literal for v in items] if whole else None
    type_ = storable(type_)
    if not items or isinstance(type_, T.NullType):
        return Value(F.array(*(F.lit(None).cast("string") for _ in items)).cast("array<string>"), T.ArrayType(TEXT), values, whole)
    return Value(F.array(*(conform(v, type_) for v in items)), T.ArrayType(type_), values, whole)


def either(test: Column, a: Value, b: Value) -> Value:
    type_ = storable(common_of(a, b))
    return Value(F.when(test, conform(a, type_)).otherwise(conform(b, type_)), type_)


# -- text


def number_text(c: Column) -> Column:
    """Whole numbers without a fraction."""
    d = c.cast("double")
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("long").cast("string")).otherwise(d.cast("string"))


def text(v: Value, null: str | None = None) -> Column:
    """The value as text; complex values as JSON. `null` is the text of null."""
    if v.is_null:
        out = F.lit(None).cast("string")
    elif v.is_text:
        out = v.col
    elif isinstance(v.type, T.IntegralType) or v.is_bool:
        out = v.col.cast("string")
    elif v.is_number:
        out = number_text(v.col)
    elif v.is_time:
        out = F.date_format(v.col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    else:
        out = F.to_json(v.col)
    return out if null is None else F.coalesce(out, F.lit(null))


# -- truth and comparison


def truthy(v: Value) -> Column:
    """Null, false, 0, "", [] and {} are false, all else is true. Never null."""
    if v.is_null:
        return F.lit(False)
    if v.is_bool:
        return F.coalesce(v.col, F.lit(False))
    if v.is_number:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.is_text:
        return F.coalesce(v.col != "", F.lit(False))
    if v.is_array or isinstance(v.type, T.MapType):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def predicate(v: Value) -> Column:
    """What FILTER keeps: only rows for which a boolean is true."""
    return v.col if v.is_bool else F.lit(False)


def _kind(v: Value) -> str:
    return "null" if v.is_null else "number" if v.is_number else "text" if v.is_text else "bool" if v.is_bool else "time" if v.is_time else "complex"


def aligned(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Both sides in comparable types, or None where the kinds differ."""
    ka, kb = _kind(a), _kind(b)
    if "null" in (ka, kb) or ka == kb:
        if ka == "complex" and kb == "complex" and a.type != b.type:
            type_ = common([a.type, b.type])
            return conform(a, type_), conform(b, type_)
        return a.col, b.col
    if "time" in (ka, kb):
        zoneless = next((v.type for v in (a, b) if isinstance(v.type, T.TimestampNTZType)), None)
        return tuple(v.col if v.type == zoneless else as_time(v).cast(zoneless or TIME) for v in (a, b))
    return None


def as_time(v: Value) -> Column:
    """Timestamps, milliseconds since 1970 and ISO texts as timestamps; null where that fails."""
    if v.is_time:
        return v.col.cast("timestamp")
    if v.is_number:
        return F.timestamp_millis(v.col.cast("long"))
    if v.is_text:
        return F.try_to_timestamp(v.col)
    return F.lit(None).cast("timestamp")


def equal(a: Value, b: Value) -> Column:
    if (sides := aligned(a, b)) is None:
        return a.col.isNull() & b.col.isNull()
    return sides[0].eqNullSafe(sides[1])


def compare(op: str, a: Value, b: Value, filtering: bool = False) -> Column:
    """Null is below everything; values of different kinds count as equal.

    In a filter against a constant the null branch is a disjunct, which reaches the scan; elsewhere the result is never null.
    """
    if op in (">", ">="):
        return compare({">": "<", ">=": "<="}[op], b, a, filtering)
    strict = op == "<"
    if (sides := aligned(a, b)) is None:
        return (a.col.isNull() & b.col.isNotNull()) if strict else (a.col.isNull() | b.col.isNotNull())
    if a.is_null or b.is_null:
        return (a.col.isNull() & b.col.isNotNull()) if strict else a.col.isNull()
    x, y = sides
    test = x < y if strict else x <= y
    if filtering and b.constant:
        return test | x.isNull()
    if filtering and a.constant:
        return test
    return F.coalesce(test, x.isNull() & y.isNotNull() if strict else x.isNull())


# -- arithmetic


def finite(c: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def number(v: Value, what: str = "arithmetic") -> Column:
    if v.is_number or v.is_null:
        return v.col.cast("double")
    raise QueryError(f"{what} needs numbers, not {v.type.simpleString()}")


def arithmetic(op: str, a: Value, b: Value, safe: bool) -> Value:
    if op == "+" and (a.is_text or b.is_text):
        if not ((a.is_text or a.is_null) and (b.is_text or b.is_null)):
            raise QueryError("+ needs two numbers or two strings")
        return Value(F.concat(a.col.cast("string"), b.col.cast("string")), TEXT)
    x, y = number(a, op), number(b, op)
    if op == "+":
        return Value(x + y, DOUBLE)
    if op == "-":
        return Value(x - y, DOUBLE)
    if op == "*":
        return Value(x * y, DOUBLE)
    if op == "/":
        return Value(F.try_divide(x, y) if safe else x / y, DOUBLE)
    return Value(F.try_mod(x, y) if safe else x % y, DOUBLE)


def bitwise(op: str, a: Value, b: Value) -> Value:
    x, y = number(a, op).cast("long"), number(b, op).cast("long")
    if op in ("<<", ">>"):
        shifted = F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int"))
        return Value(shifted.cast("double"), DOUBLE)
    made: dict[str, Callable[[], Column]] = {"&": lambda: x.bitwiseAND(y), "|": lambda: x.bitwiseOR(y), "^": lambda: x.bitwiseXOR(y)}
    return Value(made[op]().cast("double"), DOUBLE)
