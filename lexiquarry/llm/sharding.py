"""Sharding by histogram sort: documents in key order, cut into shards of nearly equal bytes, moved once.

The key is (hash of the text, hash of the document id), so equal texts stand side by side and a group is split only
where a boundary has to fall inside it. Splitters are found without moving rows: candidate boundaries (probes) are laid
into each splitter's bracket, every partition sums the exact bytes between them, and the brackets close around the
targets until each splitter is within tolerance or no key is left inside its bracket. Each round also learns the least
and greatest key in every bracket, so a bracket around one large group shrinks to it and goes on by document id.
Shards are cut into ranges of a task's size by the same splitters; one exchange then moves each row to its range.

Cases: a null text has no bytes and a size of 1, and the key of an empty one; a null id has a key of its own; rows of
equal text and id are alike and stand together; an empty table gives no rows; texts of any length move whole; an input
column named as a new one gives way.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.common import Scratch, quoted, without

#: A shard's bytes differ from an equal share by this fraction at most, where rows allow it; a range's within a shard by the other.
TOLERANCE, RANGE_TOLERANCE = 0.001, 0.1
#: Probes in a bracket, and ranges in all at most; their product bounds what the driver and a broadcast hold.
PROBES, MOST_RANGES = 16, 1 << 16
TOP = 1 << 128


def as_bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], "S16")


def row_keys(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """128-bit keys as byte strings in unsigned order."""
    out = np.empty((len(h), 2), ">u8")
    out[:, 0], out[:, 1] = h.view(np.uint64), k.view(np.uint64)
    return out.view("S16").ravel() if len(h) else np.empty(0, "S16")


def histogram(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Per interval between sorted probes: bytes, rows, least and greatest key. Every partition sums its own rows first."""
    at = keys.sparkSession.sparkContext.broadcast(as_bytes(probes))

    def count(batches):
        n = len(at.value) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, b"", "S16"), np.full(n, b"", "S16")
        for b in batches:
            if not b.num_rows:
                continue
            own = row_keys(b.column(0).to_numpy(), b.column(1).to_numpy())
            order = np.argsort(own)
            own = own[order]
            place = np.searchsorted(at.value, own, "right")
            size += np.bincount(place, b.column(2).to_numpy()[order], n).astype(np.int64)
            some, first, c = np.unique(place, return_index=True, return_counts=True)
            new = rows[some] == 0
            least[some] = np.where(new | (own[first] < least[some]), own[first], least[some])
            most[some] = np.where(new | (own[first + c - 1] > most[some]), own[first + c - 1], most[some])
            rows[some] += c
        some = np.flatnonzero(rows)
        hexed = lambda x: [bytes(v).ljust(16, b"\0").hex() for v in x[some]]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(size[some]), pa.array(rows[some]), pa.array(hexed(least), pa.string()), pa.array(hexed(most), pa.string())], names=["i", "size", "rows", "least", "most"])

    parts = keys.mapInArrow(count, "i int, size long, rows long, least string, most string")
    got = parts.groupBy("i").agg(F.sum("size"), F.sum("rows"), F.min("least"), F.max("most")).collect()
    return {r[0]: (r[1], r[2], int(r[3], 16), int(r[4], 16)) for r in got}


def splitters(keys: DataFrame, shards: int, ranges: int) -> list[int]:
    """Keys that cut keys (h, k, size) into shards * ranges runs; a run holds the keys from its splitter on."""
    parts = shards * ranges
    (total, _, low, high) = histogram(keys, []).get(0, (0, 0, 0, 0))
    # a bracket: keys from its low end to below its high end may lie around the target; bytes below the low end are known
    brackets = {i: [low, high + 1, 0, total] for i in range(1, parts)}
    chosen: dict[int, int] = {}
    slack = lambda i: total / shards * TOLERANCE if i % ranges == 0 else total / parts * RANGE_TOLERANCE
    while brackets:
        for i in [i for i, (lo, hi, below, upto) in brackets.items() if hi - lo <= 1 or below == upto]:
            lo, hi, below, upto = brackets.pop(i)
            chosen[i] = lo if total * i / parts - below <= upto - total * i / parts else hi
        probes = sorted({lo + (hi - lo) * j // (PROBES + 1) for lo, hi, _, _ in brackets.values() for j in range(PROBES + 2)} - {TOP})
        if not probes:
            break
        seen = histogram(keys, probes)
        below, run = [], 0
        for j in range(len(probes)):
            run += seen.get(j, (0,))[0]
            below.append(run)
        for i, bracket in list(brackets.items()):
            target = total * i / parts
            j = bisect.bisect_right(below, target) - 1
            j = max(j, 0)
            near = min((x for x in (j, j + 1) if x < len(probes)), key=lambda x: abs(below[x] - target))
            if abs(below[near] - target) <= slack(i):
                chosen[i] = probes[near]
                del brackets[i]
                continue
            inside = seen.get(j + 1)
            upto = below[j + 1] if j + 1 < len(probes) else total
            if inside is None or inside[2] == inside[3]:  # one key is left: the cut goes before it or behind it
                least = inside[2] if inside else probes[j]
                chosen[i] = least if target - below[j] <= upto - target else least + 1
                del brackets[i]
            else:
                brackets[i] = [inside[2], inside[3] + 1, below[j], upto]
    return [min(chosen[i], TOP - 1) for i in range(1, parts)]


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df and size, shard (from 0) and slot (from 0 within a shard, without gaps, in key order)."""
    spark = df.sparkSession
    kept = without(df, ["size", "shard", "slot"])
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    names, kept = [f.name for f in kept], [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)]  # no column has a working name
    size = (F.octet_length(text).cast("long") + 1).alias("__size")
    h, k = F.xxhash64(text).alias("__h"), F.coalesce(F.xxhash64(quoted(id_col).cast("string")), F.lit(-1).cast("long")).alias("__k")
    scratch = Scratch(spark, "sharding")
    keys = scratch.keep(df.select(h, k, size), "keys")
    ranges = min(max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)), MOST_RANGES // shards)
    cuts = splitters(keys, shards, ranges)
    seen = histogram(keys, cuts)
    scratch.drop("keys")
    base, run = [], 0
    for i in range(shards * ranges):
        run = 0 if i % ranges == 0 else run
        base.append(run)
        run += seen.get(i, (0, 0))[1]
    at = spark.sparkContext.broadcast(as_bytes(cuts))

    def assigned(batches):
        for b in batches:
            n = b.num_columns
            place = np.searchsorted(at.value, row_keys(b.column(n - 2).to_numpy(), b.column(n - 1).to_numpy()), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place.astype(np.int32))], names=[*b.schema.names, "__part"])

    src = df.select(*[quoted(n).alias(f.name) for n, f in zip(names, kept)], size, h, k)
    moved = src.mapInArrow(assigned, T.StructType([*src.schema.fields, T.StructField("__part", T.IntegerType())]))
    moved = moved.repartitionById(shards * ranges, F.col("__part")).sortWithinPartitions("__part", "__h", "__k")
    # the row's number within its task: the low 33 bits of the built-in id
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    bases = spark.createDataFrame([(i, b) for i, b in enumerate(base)], "__part int, __base long")
    out = moved.withColumn("__n", number).join(F.broadcast(bases), "__part")
    return out.select(*[F.col(f.name).alias(n) for n, f in zip(names, kept)], F.col("__size").alias("size"), F.floor(F.col("__part") / ranges).cast("int").alias("shard"), (F.col("__base") + F.col("__n")).alias("slot"))
