"""Helpers that the training-data operators share: scratch tables on shared storage and text batches in Arrow."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.sources.shared import shared_dir

#: UTF-8 bytes of text that one call of a batch function gets; a single longer text is a call of its own.
BATCH_BYTES = 4 << 20
#: Rows in a batch that Spark sends to a Python worker, at most.
BATCH_ROWS = 2000


class Scratch:
    """Parquet tables under the shared folder, written to cut lineage: a lost executor costs no recomputation before them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df and returns the written table."""
        path = f"{self.root}/{table}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        """Removes a table that nothing reads any more."""
        jvm, path = self.spark._jvm, f"{self.root}/{table}"
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches, which whole texts fill; a smaller bound that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def trim() -> None:
    """Gives freed memory back to the system: workers live on for the next stage, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def quoted(name: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, names) -> list[T.StructField]:
    """df's fields but those that clash with names (upper and lower case are equal, as in Spark)."""
    gone = {n.lower() for n in names}
    return [f for f in df.schema.fields if f.name.lower() not in gone]


def slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most this many bytes of text each, or one row."""
    if texts.nbytes <= most:
        if len(texts):
            yield 0, len(texts)
        return
    lo = size = 0
    for i, x in enumerate(pc.binary_length(texts).to_pylist()):
        if i > lo and size + (x or 0) > most:
            yield lo, i
            lo, size = i, 0
        size += x or 0
    if lo < len(texts):
        yield lo, len(texts)


def append_by_text(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable, drop_text: bool = False, most: int = BATCH_BYTES) -> DataFrame:
    """df with columns computed from its text column in Arrow batches.

    make() runs once in each Python worker's task and returns a function from a list of texts (None: null) to one
    list or array per field. An input column whose name clashes with a new one gives way to the new one; all other
    columns pass unchanged. Batches are cut by bytes (most), so memory doesn't grow with the number or length of the texts.
    """
    small_batches(df.sparkSession)
    kept = without(df, [f.name for f in fields] + ([text_col] if drop_text else []))
    src = df.select(*[quoted(f.name) for f in kept], quoted(text_col).cast("string").alias("__text"))
    names, n = [f.name for f in kept] + [f.name for f in fields], len(kept)
    types = [_arrow(f.dataType) for f in fields]

    def run(batches):
        work = make()
        for b in batches:
            texts = b.column(n)
            for lo, hi in slices(texts, most):
                new = work(texts.slice(lo, hi - lo).to_pylist())
                old = [b.column(i).slice(lo, hi - lo) for i in range(n)]
                yield pa.RecordBatch.from_arrays(old + [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(new, types)], names=names)
        del work
        trim()

    return src.mapInArrow(run, T.StructType(kept + fields))


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)
