"""Type checks and conversions, control, identifiers, digests and encodings."""

from __future__ import annotations

import hashlib
import hmac
import os
import time
import uuid
import warnings

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import named
from .strings import known, string, text_of
from .values import BOOL, DOUBLE, TEXT, QueryError, Value, array, common_of, conform, constant, either, equal, storable, text, truthy


def _check(names: tuple[str, ...], test) -> None:
    @named(*names, least=1, most=1)
    def one(ctx, v):
        return Value(v.col.isNotNull() & F.lit(bool(test(v))), BOOL)


_check(("IS_ARRAY", "IS_LIST"), lambda v: v.is_array)
_check(("IS_BOOL", "IS_BOOLEAN"), lambda v: v.is_bool)
_check(("IS_NUMBER", "IS_NUMERIC"), lambda v: v.is_number)
_check(("IS_STRING",), lambda v: v.is_text or v.is_time)
_check(("IS_OBJECT", "IS_DOCUMENT"), lambda v: v.is_object)


@named("IS_INTEGER", "IS_INT", least=1, most=1)
def _is_integer(ctx, v):
    return Value(F.coalesce(v.col.cast("double") == F.floor(v.col.cast("double")), F.lit(False)) if v.is_number else F.lit(False), BOOL)


@named("IS_NULL", least=1, most=1)
def _is_null(ctx, v):
    return Value(v.col.isNull(), BOOL)


@named("IS_EMPTY", least=1, most=1)
def _is_empty(ctx, v):
    if v.is_text:
        return Value(v.col.isNull() | (v.col == ""), BOOL)
    if v.is_array or isinstance(v.type, T.MapType):
        return Value(v.col.isNull() | (F.size(v.col) == 0), BOOL)
    return Value(v.col.isNull(), BOOL)


@named("TYPEOF", "TYPE_OF", "TYPENAME", least=1, most=1)
def _typeof(ctx, v):
    """Every number is an "int"."""
    name = "bool" if v.is_bool else "int" if v.is_number else "string" if v.is_text or v.is_time else "array" if v.is_array else "object"
    return text_of(F.when(v.col.isNull(), "null").otherwise(name))


@named("TO_NUMBER", "TO_NUM", least=1, most=1)
def _to_number(ctx, v):
    if v.is_bool:
        return Value(F.coalesce(v.col.cast("int"), F.lit(0)).cast("double"), DOUBLE)
    if v.is_number or v.is_text:
        return Value(F.coalesce(v.col.try_cast("double"), F.lit(0.0)), DOUBLE)
    return constant(0.0)


@named("TO_BOOL", "TO_BOOLEAN", least=1, most=1)
def _to_bool(ctx, v):
    if v.is_text:
        return Value(F.coalesce(~F.lower(v.col).isin("", "false", "0"), F.lit(False)), BOOL)
    return Value(v.col.isNotNull() if v.is_array or v.is_object else truthy(v), BOOL)


@named("TO_ARRAY", "TO_LIST", least=1, most=1)
def _to_array(ctx, v):
    if v.is_array:
        return v
    one = array([v])
    return Value(F.when(v.col.isNull(), F.slice(one.col, 1, 0)).otherwise(one.col), one.type)


@named("COALESCE", "NOT_NULL", "FIRST_NOT_NULL", least=1)
def _coalesce(ctx, *args):
    type_ = storable(common_of(*args))
    return Value(F.coalesce(*(conform(a, type_) for a in args)), type_)


@named("NULLIF", least=2, most=2)
def _nullif(ctx, a, b):
    return Value(F.when(~equal(a, b), a.col), a.type)


@named("IF", least=3, most=3)
def _if(ctx, test, a, b):
    """Here every value but false and null counts as true."""
    return either(F.coalesce(test.col, F.lit(False)) if test.is_bool else test.col.isNotNull(), a, b)


@named("ASSERT", least=1, most=2)
def _assert(ctx, test, message=None):
    said = F.lit("assertion failed") if message is None else text(message, "null")
    return Value(F.when(truthy(test), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")), BOOL)


@named("SLEEP", least=1, most=1)
def _sleep(ctx, v):
    warnings.warn("SLEEP does nothing in a distributed plan", stacklevel=2)
    return constant(True)


# -- identifiers


@named("UUID", "UUID_V4", "UUIDV4", most=0)
def _uuid(ctx):
    return text_of(F.uuid())


_ULID = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_NANO = "useandom-26T198340PX75pxJACKVERYMINDBUSHWOLF_GQZbfghjklqvwyzrict"


def uuid7() -> str:
    n = (int(time.time() * 1000) << 80) | int.from_bytes(os.urandom(10), "big")
    n = n & ~(0xF << 76) | (7 << 76)
    return str(uuid.UUID(int=n & ~(0x3 << 62) | (0x2 << 62)))


def ulid() -> str:
    n = (int(time.time() * 1000) << 80) | int.from_bytes(os.urandom(10), "big")
    return "".join(_ULID[n >> 5 * k & 31] for k in range(25, -1, -1))


def nanoid(size: int) -> str:
    return "".join(_NANO[b & 63] for b in os.urandom(size))


def _made(names: tuple[str, ...], make) -> None:
    @named(*names, most=0)
    def one(ctx):
        @F.pandas_udf("string")
        def made(seed: pd.Series) -> pd.Series:
            return seed.map(lambda _: make())

        return text_of(made.asNondeterministic()(F.rand()))


_made(("UUID_V7", "UUIDV7"), uuid7)
_made(("ULID",), ulid)


@named("NANOID", most=1)
def _nanoid(ctx, n=None):
    size = 21 if n is None else int(known(n, "NANOID"))

    @F.pandas_udf("string")
    def made(seed: pd.Series) -> pd.Series:
        return seed.map(lambda _: nanoid(size))

    return text_of(made.asNondeterministic()(F.rand()))


# -- digests and encodings


@named("MD5", least=1, most=1)
def _md5(ctx, s):
    return text_of(F.md5(string(s, "MD5")))


@named("SHA256", least=1, most=1)
def _sha256(ctx, s):
    return text_of(F.sha2(string(s, "SHA256"), 256))


@named("SHA512", least=1, most=1)
def _sha512(ctx, s):
    return text_of(F.sha2(string(s, "SHA512"), 512))


@named("BASE64_ENCODE", "TO_BASE64", least=1, most=1)
def _base64(ctx, s):
    return text_of(F.replace(F.base64(F.encode(string(s, "BASE64_ENCODE"), "UTF-8")), F.lit("\r\n"), F.lit("")))


@named("BASE64_DECODE", "FROM_BASE64", least=1, most=1)
def _unbase64(ctx, s):
    return text_of(F.decode(F.unbase64(string(s, "BASE64_DECODE")), "UTF-8"))


@named("HEX_ENCODE", "TO_HEX", least=1, most=1)
def _hex(ctx, s):
    return text_of(F.lower(F.hex(F.encode(string(s, "HEX_ENCODE"), "UTF-8"))))


@named("HEX_DECODE", "FROM_HEX", least=1, most=1)
def _unhex(ctx, s):
    return text_of(F.decode(F.unhex(string(s, "HEX_DECODE")), "UTF-8"))


@named("HMAC_SHA256", least=2, most=2)
def _hmac(ctx, key, message):
    @F.pandas_udf("string")
    def signed(k: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else hmac.new(a.encode(), b.encode(), hashlib.sha256).hexdigest() for a, b in zip(k, m, strict=True)])

    return Value(signed(string(key, "HMAC_SHA256"), string(message, "HMAC_SHA256")), TEXT)


@named("ARGON2_HASH", "ARGON2_VERIFY", least=1, most=2)
def _argon2(ctx, *args):
    raise QueryError("Argon2 needs a native library that isn't part of this engine")
