"""Vector measures as column expressions, and BM25 of one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import total
from .registry import named
from .strings import known, normalised, string
from .values import DOUBLE, QueryError, Value

#: Fixed values of BM25, and of the corpus that the one-text form assumes.
K1, B = 1.5, 0.75
ASSUMED_DOCS, ASSUMED_LENGTH = 1000.0, 100.0


def doubles(v: Value, name: str) -> Column:
    if not v.is_array or not isinstance(v.element, (T.NumericType, T.NullType)):
        raise QueryError(f"{name} needs arrays of numbers")
    return v.col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.sqrt(total(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x - y) * (x - y))))


@named("VECTOR_SIMILARITY", least=2, most=2)
def _similarity(ctx, a, b):
    return Value(cosine(doubles(a, "VECTOR_SIMILARITY"), doubles(b, "VECTOR_SIMILARITY")), DOUBLE)


@named("VECTOR_DISTANCE", least=2, most=3)
def _distance(ctx, a, b, metric=None):
    x, y = doubles(a, "VECTOR_DISTANCE"), doubles(b, "VECTOR_DISTANCE")
    kind = "euclidean" if metric is None else str(known(metric, "VECTOR_DISTANCE"))
    return Value(1 - cosine(x, y) if kind == "cosine" else euclidean(x, y), DOUBLE)


@named("VECTOR_NORMALIZE", least=1, most=1)
def _normalize(ctx, a):
    x = doubles(a, "VECTOR_NORMALIZE")
    return Value(F.when(norm(x) > 0, F.transform(x, lambda e: e / norm(x))).otherwise(F.array().cast("array<double>")), T.ArrayType(DOUBLE))


def words_of(c: Column) -> Column:
    return F.filter(F.split(normalised(c), " "), lambda w: w != "")


def bm25(words: Column, terms: Column, docs: Column, mean_length: Column, df) -> Column:
    """Sum over terms of idf * tf saturation; df is a function from a term to its document frequency."""

    def one(term):
        tf = F.size(F.filter(words, lambda w: w == term)).cast("double")
        idf = F.ln((docs - df(term) + 0.5) / (df(term) + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(words) / mean_length))).otherwise(F.lit(0.0))

    return total(F.transform(terms, one))


@named("BM25", least=2, most=2)
def _bm25(ctx, s, query):
    """With an assumed corpus: 1000 documents of mean length 100, each term in a tenth of them."""
    df = F.lit(ASSUMED_DOCS / 10)
    words, terms = words_of(string(s, "BM25")), words_of(string(query, "BM25"))
    return Value(bm25(words, terms, F.lit(ASSUMED_DOCS), F.lit(ASSUMED_LENGTH), lambda _: df), DOUBLE)
