"""Collecting hits: sorting, pages, merging, fusing and scoring again. Each keeps k rows per task before one task merges them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SortKey:
    """A column or expression to sort by; missing values come first or last, or count as a value."""

    by: Column
    reverse: bool = False
    missing_first: bool = False
    missing: object = None

    def column(self) -> Column:
        x = self.by if self.missing is None else F.coalesce(self.by, F.lit(self.missing))
        if self.missing_first:
            return x.desc_nulls_first() if self.reverse else x.asc_nulls_first()
        return x.desc_nulls_last() if self.reverse else x.asc_nulls_last()


def top(hits: DataFrame, key: str, k: int, *keys: SortKey) -> DataFrame:
    """The k first by the keys (best score without any), then by key."""
    order = [s.column() for s in keys] or [F.col("score").desc()]
    return hits.orderBy(*order, key).limit(k)


def after(hits: DataFrame, key: str, cursor: list, *keys: SortKey) -> DataFrame:
    """Hits behind a cursor (a value for each sort key, and the row's key); missing values need a `missing` value here."""
    out, equal = F.lit(False), F.lit(True)
    for s, v in zip([*keys, SortKey(F.col(key))], cursor):
        x = s.by if s.missing is None else F.coalesce(s.by, F.lit(s.missing))
        out = out | (equal & (x < F.lit(v) if s.reverse else x > F.lit(v)))
        equal = equal & (x == F.lit(v))
    return hits.where(out)


def merged(shards: list[DataFrame], key: str, k: int) -> DataFrame:
    """The k best of several results; equal scores by shard, then key."""
    rows = None
    for i, s in enumerate(shards):
        part = s.withColumn("shard", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy(F.col("score").desc(), "shard", key).limit(k)


def rank_fusion(results: list[DataFrame], key: str, k: int = 60, most: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of top lists: sum of 1 / (k + rank). The lists are top-k results, so their ranks are few."""
    rows = None
    for r in results:
        ranked = r.select(key, (1 / (k + F.row_number().over(Window.orderBy(F.col("score").desc(), key)))).alias("part"))
        rows = ranked if rows is None else rows.unionByName(ranked)
    out = rows.groupBy(key).agg(F.sum("part").alias("score")).orderBy(F.col("score").desc(), key)
    return out.limit(most) if most else out


def rescored(first: DataFrame, second: DataFrame, key: str, k: int, weight: float = 1.0) -> DataFrame:
    """The k best of a first result with weight * the second's score added where it matches."""
    best = first.orderBy(F.col("score").desc(), key).limit(k)
    other = second.select(key, F.col("score").alias("__second"))
    return best.join(other, key, "left").select(key, (F.col("score") + weight * F.coalesce("__second", F.lit(0.0))).alias("score"))


def rescored_by(first: DataFrame, rows: DataFrame, key: str, k: int, value: Column) -> DataFrame:
    """The k best of a result, scored again by a value of their rows."""
    best = first.orderBy(F.col("score").desc(), key).limit(k)
    return best.join(rows, key).select(key, value.alias("score"))


def sort_rescored(first: DataFrame, rows: DataFrame, key: str, k: int, *keys: SortKey) -> DataFrame:
    """The k best of a result in the order of sort keys over their rows, with the place as `rank` (k is small: one task ranks)."""
    best = first.orderBy(F.col("score").desc(), key).limit(k).join(rows, key)
    order = [s.column() for s in keys] + [F.col(key).asc()]
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def positive(hits: DataFrame) -> DataFrame:
    """Hits with a score above 0."""
    return hits.where("score > 0")


def field_stats(df: DataFrame, *columns: str) -> DataFrame:
    """(field, min, max, n) of numeric columns, as doubles; n counts rows with a value."""
    one = lambda c: F.struct(F.lit(c).alias("field"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.count(c).alias("n"))
    return df.agg(F.array(*map(one, columns)).alias("s")).select(F.inline("s"))
