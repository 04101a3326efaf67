"""Token ids of documents in binary shards, with a minimal perfect hash index for keyed access.

Layout under a folder on shared storage:

- tokens-00000.bin, ...: "LQT1", item size (uint32), then the raw ids of a range of documents in ascending key order,
  little-endian, two bytes an id if the vocabulary fits, else four.
- index-00000.bin, ...: one bucket of the index. "LQX2", keys n and levels m (uint32), words of each level (uint32 x m),
  the levels' bit words (uint64), then per slot: fingerprint (uint64), shard (uint32), ids (uint32), offset in ids
  within the shard (uint64), rows (uint64).
- the manifest (Parquet): shard, rows, ids, and the ids before it.

A key (a 64-bit hash of the document id) picks a bucket and, within it, a slot by a minimal perfect hash: level by
level, a key whose bit no other key shares takes that bit, and its slot is the bit's rank. The stored fingerprint, a
second hash of the document id, tells a key that was never indexed, and ids whose first hashes are equal: of these, one
is in the index, the others in a table of clashes beside it. So ids are told apart by 128 bits. A lookup reads a few
bits whatever the number of keys.

Cases: a null text is empty and holds only the end id; a null key is a key of its own and comes first; rows that share
a key stand together (ordered by a hash of the text) and share one index entry, whose `rows` says how many they are (a table beside the index has them all);
an empty table gives no shards and no rows. All files are written under a temporary name and renamed, so a task that
runs twice leaves one whole file.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.bpe import Codec
from lexiquarry.llm.common import Scratch, quoted, slices, small_batches, trim

#: Keys that a bucket of the index holds at most on average; there are at least this many buckets to a shuffle partition.
BUCKET_KEYS, BUCKETS_EACH = 1_000_000, 8
#: Words in a worker's cache, and letters that are encoded at a time.
CACHE_WORDS, PART = 350_000, 2 << 20
#: Bits of a level for each key that is left, and levels before the rest is told apart by ever larger ones.
GAMMA = 2.0
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mix of 64-bit integers, another for each seed."""
    x = x + np.uint64((seed * int(GOLDEN) + int(GOLDEN)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: levels of bits, a key's slot is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(x).astype(np.uint32) for x in levels]
        self.ranks, base = [], 0
        for c in counts:
            before = np.cumsum(c, dtype=np.int64) - c + base
            self.ranks.append(before)
            base += int(c.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            words = int(len(left) * GAMMA) // 64 + 1
            at = (mixed(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            own = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(own, bitorder="little").view("<u8").copy())
            left = left[~own[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 if it runs out of levels (never indexed)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (mixed(keys[left], k) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            out[left[hit]] = ranks[w] + np.bitwise_count(bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            left = left[~hit]
        return out


SLOT = np.dtype([("print", "<u8"), ("shard", "<u4"), ("ids", "<u4"), ("offset", "<u8"), ("rows", "<u8")])
ENTRY = [("shard", T.IntegerType()), ("at", T.LongType()), ("ids", T.LongType()), ("rows", T.LongType())]


def index_bytes(keys: np.ndarray, slots: np.ndarray) -> bytes:
    """The file of a bucket: slots[i] belongs to keys[i]."""
    ph = PerfectHash.build(keys)
    table = np.zeros(ph.size, SLOT)
    table[ph.slots(keys)] = slots
    head = struct.pack("<4sII", b"LQX2", len(keys), len(ph.levels)) + np.array([len(x) for x in ph.levels], "<u4").tobytes()
    return head + b"".join(x.tobytes() for x in ph.levels) + table.tobytes()


def index_read(data: bytes) -> tuple[PerfectHash, np.ndarray]:
    magic, n, m = struct.unpack_from("<4sII", data)
    if magic != b"LQX2":
        raise ValueError("not an index bucket")
    words, at, levels = np.frombuffer(data, "<u4", m, 12), 12 + 4 * m, []
    for w in words.tolist():
        levels.append(np.frombuffer(data, "<u8", w, at))
        at += 8 * w
    return PerfectHash(levels), np.frombuffer(data, SLOT, n, at)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's address; a path without a scheme is local, Hadoop's names of S3 are S3."""
    uri = re.sub("^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def published(store: fs.FileSystem, path: str, write) -> None:
    """Writes a file under a name of its own, then renames it."""
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(own) as out:
        write(out)
    store.move(own, path)


@functools.lru_cache(2)
def library_codec(path: str) -> Codec:
    """Words are merged by the tokenizers library."""
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_file(path).model.tokenize
    with open(path, encoding="utf-8") as f:
        return Codec(json.load(f), lambda spelled: [x.id for x in tokenize(spelled)], CACHE_WORDS, PART)


def key_hash(col) -> F.Column:
    """The 64 bits that stand for a key; a null key has a value of its own."""
    return F.coalesce(F.xxhash64(col.cast("string")), F.lit(-1).cast("long"))


def print_hash(col) -> F.Column:
    """The 64 bits of a key's fingerprint, of another hash than the first."""
    return F.coalesce(F.xxhash64(F.lit("fingerprint"), F.reverse(col.cast("string"))), F.lit(-1).cast("long"))


class TokenStore:
    """A written store."""

    def __init__(self, spark: SparkSession, uri: str, shards: int, buckets: int, manifest: DataFrame, wide: bool, repeats: DataFrame | None = None, clashes: DataFrame | None = None):
        self.spark, self.uri, self.shards, self.buckets, self.manifest, self.dtype = spark, uri, shards, buckets, manifest, "<u4" if wide else "<u2"
        #: All rows (kh, fp, shard, at, ids) of keys that several rows share, and the entries (kh, fp, shard, at, ids, rows)
        #: of keys whose first hash is another's in the index; None if there are none.
        self.repeats, self.clashes = repeats, clashes

    @classmethod
    def write(cls, df: DataFrame, vocabulary: str, end_id: int, key_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> TokenStore:
        """Encodes every whole text, appends end_id, and writes shards in ascending key order and their index."""
        spark = df.sparkSession
        small_batches(spark)
        scratch = Scratch(spark, "tokens")
        wide, uri = len(library_codec(vocabulary).strings) > 1 << 16 or end_id >= 1 << 16, f"{scratch.root}/store"
        dtype = "<u4" if wide else "<u2"
        store, root = place(uri)
        store.create_dir(root, recursive=True)
        n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # the key's own order decides; the text's hash spreads and orders rows of one key
        src = df.select(quoted(key_col).alias("k"), quoted(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
        src = src.repartitionByRange(n, F.col("k").asc_nulls_first(), "h").sortWithinPartitions(F.col("k").asc_nulls_first(), "h").select(key_hash(F.col("k")).alias("kh"), "t", F.spark_partition_id().alias("p"), print_hash(F.col("k")).alias("fp"))

        def write_shard(batches):
            codec = library_codec(vocabulary)
            end = np.array([end_id], "<u4").tobytes()
            disk, top = place(uri)
            out = path = own = None
            shard = offset = 0
            for b in batches:
                for lo, hi in slices(b.column(1)):
                    if out is None:
                        shard = b.column(2)[0].as_py()
                        path = f"{top}/tokens-{shard:05d}.bin"
                        own = f"{path}.{uuid.uuid4().hex}.tmp"
                        out = disk.open_output_stream(own)
                        out.write(struct.pack("<4sI", b"LQT1", np.dtype(dtype).itemsize))
                    sizes = []
                    for ids in codec.encode_batch(b.column(1).slice(lo, hi - lo).to_pylist()):
                        ids += end
                        sizes.append(len(ids) // 4)
                        out.write(np.frombuffer(ids, "<u4").astype(dtype).tobytes())
                    size = np.array(sizes, np.int64)
                    starts = offset + np.cumsum(size) - size
                    offset += int(size.sum())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.full(len(size), shard, np.int32)), pa.array(starts), pa.array(size), b.column(3).slice(lo, hi - lo)], names=["kh", "shard", "at", "ids", "fp"])
            if out is not None:
                out.close()
                disk.move(own, path)
            trim()

        entries = scratch.keep(src.mapInArrow(write_shard, "kh long, shard int, at long, ids long, fp long"), "entries")
        # a manifest row a shard; their number is that of the partitions
        per_shard = sorted(entries.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("ids").alias("ids")).collect())
        before, manifest = 0, []
        for r in per_shard:
            manifest.append((r["shard"], r["rows"], r["ids"], before))
            before += r["ids"]
        kept = scratch.keep(spark.createDataFrame(manifest, "shard int, rows long, ids long, before long"), "manifest")
        # an index entry a key: its first row, and how many rows share it
        keys = entries.groupBy("kh", "fp").agg(F.min(F.struct("shard", "at", "ids")).alias("e"), F.count("*").alias("rows")).select("kh", "fp", "e.*", "rows")
        buckets = max(BUCKETS_EACH * n, sum(r["rows"] for r in per_shard) // BUCKET_KEYS)
        by_bucket = keys.withColumn("b", F.pmod(F.col("kh"), F.lit(buckets)).cast("int")).repartition("b").sortWithinPartitions("b", "kh", "fp")
        names = ["kh", "fp", "shard", "at", "ids", "rows"]

        def write_index(batches):
            """A row of how many keys a bucket holds, and the rows that clash."""
            disk, top = place(uri)
            for bucket, columns in grouped(batches, 6):
                first = np.concatenate([[True], columns[0][1:] != columns[0][:-1]])
                kh, fp, shard, at, ids, rows = (c[first] for c in columns)
                keys_ = kh.view(np.uint64)
                slots = np.zeros(len(keys_), SLOT)
                slots["print"], slots["shard"], slots["offset"], slots["ids"], slots["rows"] = fp.view(np.uint64), shard, at, ids, rows
                data = index_bytes(keys_, slots)
                published(disk, f"{top}/index-{bucket:05d}.bin", lambda out, data=data: out.write(data))
                other = [pa.array(c[~first]) for c in columns]
                m = len(other[0])
                yield pa.RecordBatch.from_arrays([pa.array([len(keys_)] + [0] * m, pa.int64()), *[pa.concat_arrays([pa.nulls(1, c.type), c]) for c in other]], names=["keys", *names])

        written = by_bucket.select("b", *names).mapInArrow(write_index, "keys long, kh long, fp long, shard int, at long, ids long, rows long")
        written = scratch.keep(written, "buckets")
        own, other = written.agg(F.sum("keys"), F.count("kh")).first()
        repeats, clashes = None, written.where("kh is not null").select(*names) if other else None
        if (own or 0) + other < sum(r["rows"] for r in per_shard):
            shared = entries.groupBy("kh", "fp").count().where("count > 1").select("kh", "fp")
            repeats = scratch.keep(entries.join(shared, ["kh", "fp"], "left_semi").select("kh", "fp", "shard", "at", "ids"), "repeats")
        scratch.drop("entries")
        return cls(spark, uri, n, buckets, kept, wide, repeats, clashes)

    def lookup(self, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
        """keys and, through the index, shard, at (ids within the shard) and rows; keys that aren't there go. One read of each bucket."""
        uri, buckets = self.uri, self.buckets
        hashed = keys.select(quoted(key_col).alias("k"), key_hash(quoted(key_col)).alias("kh"), print_hash(quoted(key_col)).alias("fp"))
        key_type = hashed.schema["k"].dataType
        src = hashed.withColumn("b", F.pmod(F.col("kh"), F.lit(buckets)).cast("int")).repartition("b").sortWithinPartitions("b")

        def find(batches):
            disk, top = place(uri)
            open_bucket = index = table = None
            for b in batches:
                which = b.column(3).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
                for lo, hi in zip(edges, edges[1:]):
                    if which[lo] != open_bucket:
                        open_bucket = which[lo]
                        path = f"{top}/index-{open_bucket:05d}.bin"
                        index = None  # no key fell into this bucket
                        if disk.get_file_info(path).type != fs.FileType.NotFound:
                            with disk.open_input_stream(path) as f:
                                index, table = index_read(f.read())
                    if index is None:
                        continue
                    kh, fp = (b.column(i).slice(lo, hi - lo).to_numpy().view(np.uint64) for i in (1, 2))
                    slot = index.slots(kh)
                    good = (slot >= 0) & (table["print"][slot] == fp)
                    e = table[slot[good]]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).filter(pa.array(good)), pa.array(e["shard"].astype(np.int32)), *[pa.array(e[x].astype(np.int64)) for x in ("offset", "ids", "rows")]], names=[key_col, *[x for x, _ in ENTRY]])

        found = src.mapInArrow(find, T.StructType([T.StructField(key_col, key_type), *[T.StructField(x, t) for x, t in ENTRY]]))
        if self.clashes is not None:
            found = found.unionByName(hashed.join(self.clashes, ["kh", "fp"]).select(F.col("k").alias(key_col), *[x for x, _ in ENTRY]))
        return found

    def read(self, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
        """Per stored row of a key: its token_ids (binary, unsigned 32-bit), start among the ids of all documents, n_tokens.

        A key that several rows share gives each of them once, however often it is asked for; another gives its row each time.
        A shard's keys are read in order of their offsets, so reads of a shard go forward only.
        """
        uri, dtype = self.uri, self.dtype
        small_batches(self.spark)
        found = self.lookup(keys, key_col)
        if self.repeats is not None:
            shared = found.where("rows > 1").select(quoted(key_col), "rows", key_hash(quoted(key_col)).alias("kh"), print_hash(quoted(key_col)).alias("fp")).dropDuplicates(["kh", "fp"])
            each = shared.join(self.repeats, ["kh", "fp"]).select(quoted(key_col), "shard", "at", "ids", "rows")
            found = found.where("rows = 1").unionByName(each)
        found = found.join(F.broadcast(self.manifest.select("shard", "before")), "shard")
        src = found.repartitionById(self.shards, F.col("shard")).sortWithinPartitions("shard", "at").select(quoted(key_col), "shard", "at", "ids", "before", "rows")
        width = np.dtype(dtype).itemsize

        def fetch(batches):
            disk, top = place(uri)
            f = shard = None
            for b in batches:
                which, at, ids = (b.column(i).to_numpy() for i in (1, 2, 3))
                out = []
                for s, a, n in zip(which.tolist(), at.tolist(), ids.tolist()):
                    if s != shard:
                        f = disk.open_input_file(f"{top}/tokens-{s:05d}.bin")
                        shard = s
                        if f.read(8) != struct.pack("<4sI", b"LQT1", width):
                            raise ValueError(f"shard {s} has another format")
                    f.seek(8 + a * width)
                    out.append(np.frombuffer(f.read(n * width), dtype).astype("<u4").tobytes())
                start = pa.array(at + b.column(4).to_numpy())
                for lo in range(0, len(out), 2000):
                    part = slice(lo, lo + 2000)
                    yield pa.RecordBatch.from_arrays([b.column(0)[part], start[part], b.column(3)[part], pa.array(out[part], pa.binary())], names=[key_col, "start", "n_tokens", "token_ids"])

        return src.mapInArrow(fetch, T.StructType([found.schema[key_col], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]))


def grouped(batches, columns: int):
    """(group, its columns as arrays) from batches sorted by their first column; one group is held at a time."""
    held, group = [], None

    def made():
        return group, [np.concatenate(x) for x in zip(*held)]

    for b in batches:
        which = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
        for lo, hi in zip(edges, edges[1:]):
            if hi == lo:
                continue
            if held and which[lo] != group:
                yield made()
                held = []
            group = int(which[lo])
            held.append([b.column(i + 1).slice(lo, hi - lo).to_numpy() for i in range(columns)])
    if held:
        yield made()
