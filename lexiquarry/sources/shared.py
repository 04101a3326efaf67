"""The folder that driver and executors share, and small helpers around files and small inputs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

#: Inputs below this many bytes are dealt over all cores before work on texts: a small file is one row group, so one task.
SMALL_INPUT = 256 << 20
#: Inputs that are read in fewer tasks for each core than this are dealt, in so many parts: some of the cores would wait for the last task.
DEALT = 2


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset the warehouse, which a cluster shares too, or /tmp if all runs on one machine."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/lexiquarry"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lexiquarry"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fingerprint(df: DataFrame, *more: str) -> str:
    """A name for the files under df as they are now: paths, sizes and times of change, and more."""
    spark, h = df.sparkSession, hashlib.sha256("\n".join(more).encode())
    for f in sorted(df.inputFiles()):
        fs, p = file_system(spark, f)
        s = fs.getFileStatus(p)
        h.update(f"{f} {s.getLen()} {s.getModificationTime()}\n".encode())
    return h.hexdigest()[:24]


def spread(df: DataFrame) -> DataFrame:
    """A small input over all cores; a larger one as it is read, if that gives the cores enough tasks."""
    spark, size = df.sparkSession, plan_bytes(df)
    cores = spark.sparkContext.defaultParallelism
    if size <= SMALL_INPUT:
        return df.repartition(cores)
    task = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(DEALT * cores) if size < DEALT * cores * task else df


def fewer_rows(spark: SparkSession, most: int) -> None:
    """Bounds the rows of Arrow batches, which texts fill; a smaller bound that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def plan_bytes(df: DataFrame) -> int:
    """The size of df's result as the optimizer guesses it from the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
