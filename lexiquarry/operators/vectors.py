"""Vector search: exact similarities in SQL functions, nearest neighbours, thresholds, late interaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column, b: Column) -> Column:
    d = lambda x, y: x.cast("double") - y.cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: d(x, y) * d(x, y)), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, kind: str = "euclidean") -> Column:
    """euclidean 1/(1+d*d), dot and cosine (1+x)/2 from 0 on, max_inner_product 1+x or 1/(1-x)."""
    if kind == "euclidean":
        return 1 / (1 + squared(a, b))
    x = dot(a, b)
    if kind == "cosine":
        x = F.try_divide(x, F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    if kind == "max_inner_product":
        return F.when(x < 0, 1 / (1 - x)).otherwise(x + 1)
    return F.greatest((1 + x) / 2, F.lit(0.0))


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(df: DataFrame, key: str, column: str, query, k: int, kind: str = "euclidean", where: Column | None = None) -> DataFrame:
    """(key, score) of the k most similar rows, after an optional filter. Each task keeps its own k best."""
    rows = df if where is None else df.where(where)
    return rows.where(F.col(column).isNotNull()).select(key, similarity(F.col(column), literal(query), kind).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def at_least(df: DataFrame, key: str, column: str, query, least: float, kind: str = "euclidean") -> DataFrame:
    """(key, score) of all rows whose similarity reaches a threshold."""
    return df.where(F.col(column).isNotNull()).select(key, similarity(F.col(column), literal(query), kind).alias("score")).where(F.col("score") >= least)


def max_sim(query: Column, document: Column, kind: str = "dot") -> Column:
    """Late interaction: for each query vector its best similarity among the document's, summed."""
    best = lambda q: F.coalesce(F.array_max(F.transform(document, lambda d: similarity(q, d, kind))), F.lit(0.0))
    return F.aggregate(F.transform(query, best), F.lit(0.0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def quantized(v: Column, low: float, high: float, bits: int = 7) -> Column:
    """Scalars as integers of so many bits between two bounds."""
    steps = (1 << bits) - 1
    return F.transform(v, lambda x: F.round((F.least(F.greatest(x.cast("double"), F.lit(float(low))), F.lit(float(high))) - low) * steps / (high - low)).cast("int"))
