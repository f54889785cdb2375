"""Vector, full-text and hybrid search over DataFrames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import B, K1, cosine, dot, euclidean, words_of

#: Scores of an exact and of a near token, results at most, and the constant of reciprocal ranks.
EXACT, NEAR, LIMIT, RRF = 10.0, 5.0, 100, 60


def literal(query: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def similarity(vector: Column, query: Sequence[float], metric: str) -> Column:
    """Larger is nearer, for every metric."""
    q, v = literal(query), vector.cast("array<double>")
    if metric == "cosine":
        return cosine(v, q)
    if metric == "dot":
        return dot(v, q)
    if metric == "euclidean":
        return 1 / (1 + euclidean(v, q))
    raise ValueError(f"unknown metric {metric!r}")


def vector_search(df: DataFrame, field: str, query: Sequence[float], k: int = 10, metric: str = "cosine", order: str | None = None) -> DataFrame:
    """df's k nearest rows with `score`, nearest first; exact. `order` breaks ties."""
    scored = df.where(F.col(field).isNotNull()).withColumn("score", similarity(F.col(field), query, metric))
    return scored.orderBy(F.desc("score"), *([order] if order else [])).limit(k)


class VectorIndex:
    """Rows by the nearest of a number of centroids, one folder each: a search reads the folders near the query only.

    Searches without an index stay exact; so is this one if it probes every list.
    """

    def __init__(self, spark, folder: str, field: str, centroids: list[list[float]], metric: str):
        self.spark, self.folder, self.field, self.centroids, self.metric = spark, folder, field, centroids, metric

    @classmethod
    def build(cls, df: DataFrame, field: str, folder: str, metric: str = "cosine", lists: int | None = None) -> VectorIndex:
        """Centroids come from a sample of 256 rows a list; every row with a vector is indexed. By default there are as
        many lists as the root of the rows, 4,096 at most."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = df.where(F.col(field).isNotNull())
        n = rows.count()
        lists = lists or max(1, min(4096, round(math.sqrt(n))))
        vectors = lambda x: x.withColumn("__x", array_to_vector(F.col(field).cast("array<double>")))
        sample = vectors(rows.sample(min(1.0, 256 * lists / n), seed=7) if n > 256 * lists else rows)
        model = KMeans(featuresCol="__x", predictionCol="__list", k=max(2, lists), seed=7, maxIter=10, distanceMeasure="cosine" if metric == "cosine" else "euclidean").fit(sample)
        placed = model.transform(vectors(rows)).drop("__x")
        placed.repartition(F.col("__list"), F.pmod(F.xxhash64(field), F.lit(max(1, n // (lists * 1_000_000))))).write.mode("overwrite").partitionBy("__list").parquet(folder)
        return cls(df.sparkSession, folder, field, [c.tolist() for c in model.clusterCenters()], metric)

    def search(self, query: Sequence[float], k: int = 10, probes: int = 8, order: str | None = None) -> DataFrame:
        """The k nearest rows of the `probes` lists whose centroids are nearest, with `score`."""
        q = [float(x) for x in query]
        length = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
        inner = lambda c: sum(a * b for a, b in zip(q, c, strict=True))
        near = {"cosine": lambda c: inner(c) / length(c), "dot": inner, "euclidean": lambda c: -sum((a - b) ** 2 for a, b in zip(q, c, strict=True))}[self.metric]
        chosen = sorted(range(len(self.centroids)), key=lambda i: -near(self.centroids[i]))[:probes]
        rows = self.spark.read.parquet(self.folder).where(F.col("__list").isin(chosen)).drop("__list")
        return vector_search(rows, self.field, q, k, self.metric, order)


def vector_stats(df: DataFrame, field: str) -> DataFrame:
    """One row about a vector column: how many there are, their lengths and norms."""
    v = F.col(field).cast("array<double>")
    size, length = F.size(v), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    made = {"vectors": F.count(v), "missing": F.count_if(v.isNull()), "dimension": F.max(F.when(v.isNotNull(), size)), "mixed": F.min(F.when(v.isNotNull(), size)) != F.max(F.when(v.isNotNull(), size)), "mean_norm": F.avg(length)}
    return df.agg(*(c.alias(n) for n, c in made.items()))


def quantised(df: DataFrame, field: str, dims: int) -> tuple[DataFrame, list[float], list[float]]:
    """df with `codes`, one byte per dimension between that dimension's least and greatest value; and those bounds."""
    at = lambda i: F.get(field, F.lit(i)).cast("double")
    row = df.agg(*(F.min(at(i)).alias(f"a{i}") for i in range(dims)), *(F.max(at(i)).alias(f"b{i}") for i in range(dims))).first()
    low, high = [float(row[f"a{i}"] or 0) for i in range(dims)], [float(row[f"b{i}"] or 0) for i in range(dims)]
    span = [(h - a) / 255 or 1.0 for a, h in zip(low, high, strict=True)]
    code = lambda x, i: F.round((x - F.get(literal(low), i)) / F.get(literal(span), i)).cast("short")
    return df.withColumn("codes", F.transform(F.col(field).cast("array<double>"), code)), low, high


def quantised_search(df: DataFrame, low: list[float], high: list[float], field: str, query: Sequence[float], k: int = 10, metric: str = "cosine", rerank: int = 4) -> DataFrame:
    """Asymmetric: the query against decoded codes gives rerank * k rows, their vectors decide."""
    span = literal([(h - a) / 255 or 1.0 for a, h in zip(low, high, strict=True)])
    decoded = F.transform("codes", lambda c, i: c * F.get(span, i) + F.get(literal(low), i))
    near = df.withColumn("score", similarity(decoded, query, metric)).orderBy(F.desc("score")).limit(k * rerank)
    return vector_search(near.drop("score", "codes"), field, query, k, metric)


def query_words(spark, text: str) -> list[str]:
    row = spark.range(1).select(F.array_distinct(words_of(F.lit(text))).alias("w")).first()
    return list(row.w)


def fulltext(df: DataFrame, fields: str | Sequence[str], query: str, distance: int = 2, limit: int | None = LIMIT) -> DataFrame:
    """(doc, score, matched): candidates share a word with the query; each pair of words scores 10 if equal, 5 if within
    `distance` edits. The best field counts. Best first; all of them where limit is None."""
    words = query_words(df.sparkSession, query)
    names = [fields] if isinstance(fields, str) else list(fields)
    terms = F.array(*(F.lit(w) for w in words)).cast("array<string>")
    near = lambda w, q: F.levenshtein(w, q, distance) >= 0

    def of_field(name: str) -> tuple[Column, Column, Column]:
        own = words_of(F.coalesce(F.col(name).cast("string"), F.lit("")))
        pair = lambda w, q: F.when(w == q, EXACT).when(near(w, q), NEAR).otherwise(0.0)
        score = F.aggregate(terms, F.lit(0.0), lambda total, q: total + F.aggregate(own, F.lit(0.0), lambda a, w: a + pair(w, q)))
        return score, F.filter(terms, lambda q: F.exists(own, lambda w: (w == q) | near(w, q))), F.arrays_overlap(own, terms)

    scores, hits, shares = zip(*map(of_field, names), strict=True)
    candidate = shares[0]
    for s in shares[1:]:
        candidate = candidate | s
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    matched = F.array_distinct(F.flatten(F.array(*hits)))
    doc = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    found = df.where(candidate).select(doc.alias("doc"), best.alias("score"), matched.alias("matched")).orderBy(F.desc("score"))
    return found if limit is None else found.limit(limit)


def bm25_search(df: DataFrame, field: str, query: str, key: str, k: int = 10) -> DataFrame:
    """Top k by BM25 with the corpus's own statistics: (key, score). One pass for counts, one for scores."""
    words = query_words(df.sparkSession, query)
    own = df.select(key, words_of(F.coalesce(F.col(field), F.lit(""))).alias("w"))
    has = [F.sum(F.array_contains("w", x).cast("int")).alias(f"d{i}") for i, x in enumerate(words)]
    row = own.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean"), *has).first()

    def part(word: str, df_: float) -> Column:
        tf = F.size(F.filter("w", lambda y: y == word)).cast("double")
        idf = F.ln(F.lit(1 + (row.n - df_ + 0.5) / (df_ + 0.5)))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("w") / F.lit(float(row["mean"] or 1))))

    score = sum((part(x, float(row[f"d{i}"] or 0)) for i, x in enumerate(words)), F.lit(0.0))
    return own.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def hybrid_search(
    df: DataFrame, key: str, vector_field: str, query: Sequence[float], text_field: str, text: str,
    vector_weight: float = 0.5, text_weight: float = 0.5, limit: int = 10, fusion: str = "weighted", metric: str = "cosine", pool: int = LIMIT,
) -> DataFrame:
    """(doc, score, vector_score, text_score, sources): both rankings, fused by min-max weights or reciprocal ranks."""
    near = vector_search(df, vector_field, query, pool, metric, key).select(F.col(key).alias("k"), F.col("score").alias("vector_score"))
    found = fulltext(df, text_field, text, limit=pool).select(F.col(f"doc.{key}").alias("k"), F.col("score").alias("text_score"))
    both = near.join(found, "k", "full")
    if fusion == "rrf":
        rank = lambda c: F.row_number().over(Window.orderBy(F.desc_nulls_last(c), "k"))  # noqa: E731  at most 2 * pool rows
        part = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (RRF + rank(c))).otherwise(0.0)
        score = part("vector_score") + part("text_score")
    else:
        whole = Window.partitionBy()

        def scaled(c: str) -> Column:
            low, high = F.min(c).over(whole), F.max(c).over(whole)
            return F.coalesce(F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.when(F.col(c).isNotNull(), 1.0)), F.lit(0.0))

        score = vector_weight * scaled("vector_score") + text_weight * scaled("text_score")
    fused = both.withColumn("score", score).orderBy(F.desc("score"), "k").limit(limit)
    sources = F.array_compact(F.array(F.when(F.col("vector_score").isNotNull(), F.lit("vector")), F.when(F.col("text_score").isNotNull(), F.lit("fulltext"))))
    docs = df.select(F.col(key).alias("k"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"))
    out = docs.join(fused, "k").select("doc", "score", "vector_score", "text_score", sources.alias("sources"))
    return out.orderBy(F.desc("score"))


def near(df: DataFrame, lat: str, lon: str, at: tuple[float, float], k: int) -> DataFrame:
    """The k nearest places with `distance` in metres."""
    from ..functions.geo import haversine

    d = haversine(F.lit(at[0]), F.lit(at[1]), F.col(lat).cast("double"), F.col(lon).cast("double"))
    return df.withColumn("distance", d).where("distance IS NOT NULL").orderBy("distance").limit(k)


def within_radius(df: DataFrame, lat: str, lon: str, at: tuple[float, float], metres: float) -> DataFrame:
    """Places within a radius; a latitude band, which reaches the scan, comes before the exact distance."""
    from ..functions.geo import EARTH_RADIUS, haversine

    band = math.degrees(metres / EARTH_RADIUS) * 1.0000001
    d = haversine(F.lit(at[0]), F.lit(at[1]), F.col(lat).cast("double"), F.col(lon).cast("double"))
    return df.where(F.col(lat).between(at[0] - band, at[0] + band)).withColumn("distance", d).where(F.col("distance") <= metres)

