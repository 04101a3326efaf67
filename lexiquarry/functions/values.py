"""Per-document value functions: numeric sources that queries, sorts and filters share. All are columns; null is a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def default(x: Column, *others: Column) -> Column:
    """The first that exists."""
    return F.coalesce(x, *others)


def div(a: Column, b: Column) -> Column:
    """Division as floating point has it: a signed infinity or NaN for a zero divisor."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a.isNotNull() & b.isNotNull(), F.lit(NAN))


def linear(x: Column, m: float, c: float) -> Column:
    return x * float(m) + float(c)


def recip(x: Column, m: float, a: float, b: float) -> Column:
    """a / (m * x + b)."""
    return div(F.lit(float(a)), x * float(m) + float(b))


def range_map(x: Column, low: float, high: float, target: Column, otherwise: Column | None = None) -> Column:
    """target within [low, high], else the default or the value."""
    return F.when(x.between(low, high), target).otherwise(x if otherwise is None else otherwise)


def most(*xs: Column) -> Column:
    """The greatest of those that exist, 0 if none does."""
    return F.coalesce(F.greatest(*xs), F.lit(0.0))


def fewest(*xs: Column) -> Column:
    """The least of those that exist, 0 if none does."""
    return F.coalesce(F.least(*xs), F.lit(0.0))


def compare(test: Column) -> Column:
    """A comparison that is false where a side is missing."""
    return F.coalesce(test, F.lit(False))


def enum(x: Column, labels: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]), x.cast("int"))


def selector(values: Column, kind: str = "min") -> Column:
    """One value of a multi-valued field: min, max, middle_min or middle_max."""
    if kind in ("min", "max"):
        return F.array_min(values) if kind == "min" else F.array_max(values)
    s = F.array_sort(values)
    return F.get(s, F.floor((F.size(s) - (1 if kind == "middle_min" else 0)) / 2).cast("int"))


def scaled(df: DataFrame, x: Column, low: float, high: float, name: str) -> DataFrame:
    """df and x moved to [low, high] by its least and greatest finite value in all of df; low if all are equal."""
    fine = F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != INF), x.cast("double"))
    ends = df.agg(F.struct(F.min(fine).alias("a"), F.max(fine).alias("b")).alias("e")).select("e").scalar()
    span = ends["b"] - ends["a"]
    factor = F.when(span == 0, 0.0).otherwise(F.try_divide(F.lit(float(high - low)), span))
    return df.withColumn(name, (x - ends["a"]) * factor + float(low))


# features


def saturation(s: Column, pivot: float, w: float = 1.0) -> Column:
    return w * s / (s + float(pivot))


def log_feature(s: Column, scaling: float, w: float = 1.0) -> Column:
    return w * F.log(s + float(scaling))


def sigmoid(s: Column, pivot: float, power: float, w: float = 1.0) -> Column:
    raised = F.pow(s, F.lit(float(power)))
    return w * raised / (raised + float(pivot) ** power)


def distance_feature(x: Column, origin: float, pivot: float, w: float = 1.0) -> Column:
    """w * pivot / (pivot + distance)."""
    return w * float(pivot) / (float(pivot) + F.abs(x - origin))


#: Formats of dates as terms, by resolution.
DATE_FORMATS = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH", "minute": "yyyyMMddHHmm", "second": "yyyyMMddHHmmss", "millisecond": "yyyyMMddHHmmssSSS"}


def date_term(ts: Column, resolution: str = "day") -> Column:
    """A time as a term whose order is that of time, cut to a resolution."""
    return F.date_format(ts, DATE_FORMATS[resolution])


def date_of_term(term: Column, resolution: str = "day") -> Column:
    """The first moment that a date term stands for; null where it is none."""
    return F.try_to_timestamp(term, F.lit(DATE_FORMATS[resolution]))


def date_round(ts: Column, resolution: str = "day") -> Column:
    """A time cut to a resolution."""
    return F.date_trunc(resolution, ts)
