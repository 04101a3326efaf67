"""Typed readers and writers for CSV, JSON lines and TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """A CSV with a header of any subset of the columns in any order; quotes and line ends within quotes as RFC 4180 has
    them; an empty cell is a missing value. Cells that don't parse, and rows without a key, raise."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', emptyValue="", nullValue="")
    known = {f.name: f for f in schema.fields}
    extra = [c for c in raw.columns if c not in known]
    if extra or key not in raw.columns:
        raise ValueError(f"unknown columns {extra}" if extra else f"no column {key}")
    cells = []
    for name in raw.columns:
        typed = F.col(f"`{name}`").try_cast(known[name].dataType)
        cells.append(F.when(F.col(f"`{name}`").isNotNull() & typed.isNull(), F.raise_error(F.concat(F.lit(f"{name}: cannot read "), F.col(f"`{name}`"))).cast(known[name].dataType)).otherwise(typed).alias(name))
    out = raw.select(*cells)
    return out.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit("a row has no key")).cast(known[key].dataType)).otherwise(F.col(key)))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, absent: dict[str, list] | None = None) -> DataFrame:
    """One object a line; values that stand for a missing one (by field) become null."""
    out = spark.read.schema(schema).json(path)
    for name, values in (absent or {}).items():
        out = out.withColumn(name, F.when(~F.col(name).isin(values), F.col(name)))
    return out


def write_tsv(hits: DataFrame, path: str) -> None:
    hits.write.mode("overwrite").csv(path, sep="\t", header=True)


def place(lat, lon):
    """A point where both coordinates are there and in range."""
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))
