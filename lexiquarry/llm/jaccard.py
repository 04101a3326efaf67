"""Exact set-similarity join on word shingles, and its linked components.

Sets of hashed shingles are cut into segments by size band and indexed by segment signatures (shingles.Scheme), so that
every pair that links meets in a bucket. A first pass over all sets counts how often segments of several sizes are equal
in each band; the segments and their weights are allocated by that. One exchange moves the signatures, packed by bucket
range; a batch with many members of a bucket sends the least of them and keeps the links to it:

1. A small bucket gives its pairs, a larger one the links of its members to the least of them.
2. Links are tested against a parity sketch (two sets' sketches differ in no more bits than the sets in elements), those
   of large sets then against a wider one, since a short sketch of many elements tells nothing, then exactly on the
   texts; what passes is joined to components.
3. In larger buckets that still hold several components, members of different components are compared by their sketches,
   in blocks of bounded size, and what passes is tested exactly: at first each member's nearest only, which joins most
   of what belongs together, then all that still lie in different components. No pair of a bucket is left out: a pair
   of one component needs no test.

Equal sets of one batch are joined at once and only their first goes on. No step gathers a bucket or a component in one
task: a batch sends at most SMALL members of a bucket, the number of ranges grows with the documents, the members of
large buckets are dealt by salted keys and cut into blocks, and joins on one document of a pair leave a hot one to be
split by the engine's handling of skewed joins. Of the largest component in a bucket, members aren't compared with
each other.

Cases: a null, empty or wordless text has an empty set, linked with nothing; a null id belongs to no component and is
linked with nothing; rows that share an id are one vertex; an empty table gives no rows. Ids are integers. Texts are
taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import Scratch, quoted, slices, small_batches, trim
from lexiquarry.llm.graph import components
from lexiquarry.llm.hashing import mix
from lexiquarry.llm.shingles import CELLS, LEVELS, Scheme, Shingler

#: Members of a bucket that gives all its pairs; members of a block.
SMALL, BLOCK = 4, 1024
#: Bits of a sketch at least, of the part that is tested first, and of a sketch at most; of a wide one at most.
LEAST, BITS, MOST, WIDEST = 256, 1024, 4096, 1 << 16
#: Ids that may be broadcast (8 bytes each) instead of moving texts.
BROADCAST_IDS = 1 << 21
#: Ranges of buckets for each shuffle partition at least, so that tasks are even, and documents for each range at most.
RANGES, RANGE_DOCS = 8, 20_000
#: Parts that the members of a bucket are dealt to.
SALTS = 32
#: A second search for nearest members pays if the first gave a link for each so many documents; all pairs are tested anyway.
SECOND = 200
LINK, CROWD, SAME, DOC = range(4)
#: What a batch sends: bucket entries (key, doc), keys of buckets that are large in it, equal sets, documents, links and
#: members (key, doc) of large buckets, the documents' sketches, and the wide ones of those that have one.
PACKED = ["sig", "hot", "same", "docs", "stars", "crowd", "short", "wide"]
DOC_ROW = np.dtype([("id", "<i8"), ("n", "<i8")])


def short(n: int) -> int:
    """Bits of the sketch of a set of n elements: four for each, so that few differences hide each other."""
    return min(MOST, max(LEAST, 1 << (4 * n - 1).bit_length())) if n else LEAST


def sketches(sets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bit string for each set: the parity of the number of elements that hash to each of short(size) bits.

    The halves of one, one xor the other, are the sketch of half the bits, so any two can be compared.
    """
    out: list[bytes] = []
    ends = np.cumsum(sizes)
    for lo in range(0, len(sizes), 512):
        n = sizes[lo : lo + 512]
        part = sets[ends[lo] - sizes[lo] : ends[lo + len(n) - 1]]
        bits = np.array([short(x) for x in n.tolist()])
        edges = np.concatenate([[0], np.cumsum(bits)])
        at = np.repeat(edges[:-1], n) + (mix(part ^ np.uint64(0x5851F42D4C957F2D)) % np.repeat(bits, n).astype(np.uint64)).astype(np.int64)
        flat = np.packbits(np.bincount(at, minlength=edges[-1]) & 1).tobytes()
        cut = (edges // 8).tolist()
        out += [flat[x:y] for x, y in zip(cut, cut[1:])]
    return out


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one in each row of 64-bit words, in as few words."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def by_width(bits: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sketches by their number of 64-bit words: which they are, and they themselves as rows."""
    words = np.array([len(x) // 8 for x in bits])
    out = {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        out[w] = at, np.frombuffer(b"".join([bits[i] for i in at]), "<u8").reshape(-1, w)
    return out


def width(n: int) -> int:
    """Bits of the wide sketch of a set of n elements: n at least, as far as it goes; 0 where the short one does."""
    return min(WIDEST, 1 << (n - 1).bit_length()) if n > BITS else 0


def wide_sketch(s: np.ndarray) -> bytes:
    """As sketches(), in width(len(s)) bits."""
    bits = width(len(s))
    at = mix(s ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(max(bits, 1))
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1).tobytes() if bits else b""


def close_wide(num: int, den: int, a: bytes | None, b: bytes | None, n: int, m: int) -> bool:
    """close() of two wide sketches, at the lesser width; true where one has none."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, "<u8")[None], np.frombuffer(b, "<u8")[None]
    least = min(x.shape[1], y.shape[1])
    return bool(close(num, den, folded(x, least), folded(y, least), n, m)[0][0])


def close(num: int, den: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets with sketches a and b (rows of 64-bit words) and sizes n and m can link, and the bits in which they differ."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return (apart * (den + num) <= (n + m) * (den - num)) & (n * den >= m * num) & (m * den >= n * num), apart


def close_pairs(num: int, den: int, a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """close() of the sketches of many pairs, each at its lesser width."""
    ok = np.zeros(len(a), bool)
    for w, (at, x) in by_width(a).items():
        for v, (there, y) in by_width([b[i] for i in at]).items():
            ok[at[there]] = close(num, den, folded(x[there], min(w, v)), folded(y, min(w, v)), n[at[there]], m[at[there]])[0]
    return ok


def runs(*columns: np.ndarray):
    """Ranges of rows that are equal in all columns."""
    n = len(columns[0])
    if n:
        new = np.zeros(n, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(new).tolist(), n]
        yield from zip(edges, edges[1:])


def groups(batches, keys: int):
    """Columns of each group of rows, from batches sorted by their first columns; one group is held at a time."""
    held, own = [], None
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(keys)]
        for lo, hi in runs(*cols):
            key = tuple(int(c[lo]) for c in cols)
            if held and key != own:
                yield own, pa.Table.from_batches(held).combine_chunks()
                held = []
            own = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield own, pa.Table.from_batches(held).combine_chunks()


class JaccardJoin:
    """Links documents whose sets of k-word shingles have den * |both| >= num * |either|."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.k, self.num, self.den = docs.sparkSession, k, num, den
        self.scratch = Scratch(self.spark, "jaccard")
        small_batches(self.spark)
        self.all = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
        self.docs = self.all.where("id is not null")

    def measured(self, total: int) -> dict[int, tuple[int, list[float]]]:
        """By size band, its sets and the chances that segments of two of them are equal, counted over all documents."""
        k, num, den = self.k, self.num, self.den

        def tally(batches):
            shingler, scheme, counts = Shingler(k), Scheme(num, den, total), {}
            for b in batches:
                for lo, hi in slices(b.column(0)):
                    scheme.tally(*shingler.sets(b.column(0).slice(lo, hi - lo).to_pylist()), counts)
            for (band, level), n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), band, np.int32)), pa.array(np.full(len(at), level, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["band", "level", "cell", "n"])
            trim()

        cells = self.docs.select("text").mapInArrow(tally, "band int, level int, cell int, n long").groupBy("band", "level", "cell").agg(F.sum("n").cast("double").alias("n"))
        out: dict[int, tuple[int, list[float]]] = {}
        for r in cells.groupBy("band", "level").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares")).collect():
            n, chances = out.setdefault(r["band"], (0, [0.0] * len(LEVELS)))
            equal = (r["squares"] - r["n"]) / max(r["n"] * (r["n"] - 1), 1)
            chances[r["level"]] = max(0.0, (equal - 1 / CELLS) / (1 - 1 / CELLS))
            out[r["band"]] = max(n, int(r["n"])), chances
        return out

    def found(self) -> DataFrame:
        """(kind, a, b, sketch, wide): links, members of larger buckets (a: the bucket), equal sets, and documents (b: set size)."""
        k, num, den, total = self.k, self.num, self.den, self.all.count()
        ranges, measured = max(RANGES * int(self.spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_DOCS), self.measured(total)

        def emit(batches):
            shingler, scheme = Shingler(k), Scheme(num, den, total, measured)
            for b in batches:
                for lo, hi in slices(b.column(1)):
                    ids = b.column(0).slice(lo, hi - lo).to_numpy()
                    sets, sizes = shingler.sets(b.column(1).slice(lo, hi - lo).to_pylist())
                    rows = np.zeros(len(ids), DOC_ROW)
                    rows["id"], rows["n"] = ids, sizes
                    ends = np.cumsum(sizes)
                    first: dict[bytes, int] = {}
                    keep, same = [], []
                    for i, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
                        if n:
                            j = first.setdefault(xxhash.xxh3_128_digest(sets[e - n : e].tobytes()), i)
                            (keep if j == i else same).append((j, i))
                    keep = np.array([i for i, _ in keep], np.int64)
                    n = sizes[keep]
                    own = sets[np.repeat(ends[keep] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    keys, owners = scheme.signatures(own, n)
                    entry = np.stack([keys.view(np.int64), ids[keep[owners]]], axis=1)
                    entry = entry[np.lexsort((entry[:, 1], entry[:, 0]))]
                    # of a bucket with many members here only the least goes on; the others are linked with it and crowd the bucket
                    start = np.flatnonzero(np.concatenate([[True], entry[1:, 0] != entry[:-1, 0]])) if len(entry) else np.zeros(0, np.int64)
                    size = np.diff(np.append(start, len(entry)))
                    many = np.repeat(size > SMALL, size)
                    behind = many.copy()
                    behind[start] = False
                    local = entry[behind]
                    stars = np.stack([np.repeat(entry[start, 1], size)[behind], local[:, 1]], axis=1)
                    stars = np.unique(stars[stars[:, 0] != stars[:, 1]], axis=0)
                    hot, entry = many[~behind], entry[~behind]
                    part = (entry[:, 0].view(np.uint64) >> np.uint64(24)) % np.uint64(ranges)
                    order = np.argsort(part, kind="stable")
                    entry, part, hot = entry[order], part[order], hot[order]
                    p, blobs = [], []
                    for x, y in runs(part):
                        p.append(int(part[x]))
                        blobs.append((entry[x:y].tobytes(), entry[x:y, 0][hot[x:y]].tobytes(), *[b""] * 6))
                    pairs = np.array([(ids[a], ids[c]) for a, c in same], np.int64).tobytes()
                    p.append(int(mix(ids[:1].view(np.uint64))[0] % np.uint64(ranges)))
                    wide = b"".join(wide_sketch(sets[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist()) if n > BITS)
                    blobs.append((b"", b"", pairs, rows.tobytes(), stars.tobytes(), local.tobytes(), b"".join(sketches(sets, sizes)), wide))
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), *[pa.array(x, pa.binary()) for x in zip(*blobs)]], names=["p", *PACKED])
            trim()

        def meet(batches):
            for _, t in groups(batches, 1):
                sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<i8").reshape(-1, 2)
                sig = sig[np.lexsort((sig[:, 1], sig[:, 0]))]
                if len(sig):
                    sig = sig[np.concatenate([[True], (sig[1:] != sig[:-1]).any(axis=1)])]
                key, doc = sig[:, 0], sig[:, 1]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                size = np.diff(np.append(start, len(key)))
                hot = np.unique(np.frombuffer(b"".join(t.column("hot").to_pylist()), "<i8"))
                large = (size > SMALL) | np.isin(key[start], hot)
                links = [np.zeros((0, 2), np.int64)]
                for n in range(2, SMALL + 1):
                    at = start[(size == n) & ~large]
                    links += [np.stack([doc[at + i], doc[at + j]], axis=1) for i in range(n) for j in range(i + 1, n)]
                crowded = np.repeat(large, size)
                centre = np.repeat(doc[start], size)
                links.append(np.stack([centre, doc], axis=1)[crowded & (centre != doc)])
                links = np.unique(np.concatenate(links), axis=0)
                yield out(LINK, links[:, 0], links[:, 1])
                yield out(CROWD, key[crowded], doc[crowded])
                for kind, name in ((LINK, "stars"), (CROWD, "crowd")):
                    for blob in t.column(name).to_pylist():
                        pairs = np.frombuffer(blob, "<i8").reshape(-1, 2)
                        yield out(kind, pairs[:, 0], pairs[:, 1])
                same = np.frombuffer(b"".join(t.column("same").to_pylist()), "<i8").reshape(-1, 2)
                yield out(SAME, same[:, 0], same[:, 1])
                for blob, *bits in zip(*[t.column(x).to_pylist() for x in ("docs", "short", "wide")]):
                    rows = np.frombuffer(blob, DOC_ROW)
                    ends = [np.cumsum([0] + [of(n) // 8 for n in rows["n"].tolist()]).tolist() for of in (short, width)]
                    yield out(DOC, rows["id"], rows["n"], *[[b[x:y] or None for x, y in zip(e, e[1:])] for b, e in zip(bits, ends)])
            trim()

        def out(kind, a, b, *bits):
            n = len(a)
            bits = [pa.array(x, pa.binary()) for x in bits] or [pa.nulls(n, pa.binary())] * 2
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b)), *bits], names=["kind", "a", "b", "sketch", "wide"])

        packed = self.docs.mapInArrow(emit, "p int, " + ", ".join(f"{x} binary" for x in PACKED))
        return packed.repartition("p").sortWithinPartitions("p").mapInArrow(meet, "kind byte, a long, b long, sketch binary, wide binary")

    def sketched(self, pairs: DataFrame, docs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches let them link."""
        num, den = self.num, self.den
        side = lambda x: docs.select(F.col("a").alias(x), F.col("b").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

        def test(batches):
            for t in batches:
                ok = close_pairs(num, den, t.column(4).to_pylist(), t.column(5).to_pylist(), t.column(2).to_numpy(), t.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok))

        return self.sifted(both.mapInArrow(test, "a long, b long"), docs)

    def sifted(self, pairs: DataFrame, docs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose wide sketches let them link, or of which one has none: whole texts are moved for few others."""
        num, den = self.num, self.den
        side = lambda x: docs.select(F.col("a").alias(x), F.col("b").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "wa", "wb")

        def test(batches):
            for t in batches:
                n, m, x, y = (t.column(i).to_pylist() for i in range(2, 6))
                ok = [close_wide(num, den, *of) for of in zip(x, y, n, m)]
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return both.mapInArrow(test, "a long, b long").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, tested on the texts: b's are dealt to blocks, each with its a."""
        k, num, den = self.k, self.num, self.den
        counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        dealt = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("k"), "b")
        want = dealt.select("a", "k", F.col("b").alias("id"), F.lit(1).alias("other")).union(dealt.select("a", "k", F.col("a").alias("id"), F.lit(0).alias("other")).distinct())
        want = self.scratch.keep(want, f"want-{self.round}")
        ids = want.select("id").distinct()
        texts = self.docs
        if ids.count() <= BROADCAST_IDS:
            texts = texts.join(F.broadcast(ids), "id", "left_semi")
        rows = want.join(texts, "id").select("a", "k", "other", "id", "text").repartition("a", "k").sortWithinPartitions("a", "k", "other")

        def test(batches):
            shingler, centre, own = Shingler(k), [], None
            for b in batches:
                a, block, other, ids = (b.column(i).to_numpy() for i in range(4))
                for lo, hi in slices(b.column(4)):
                    sets, sizes = shingler.sets(b.column(4).slice(lo, hi - lo).to_pylist())
                    ends, good = np.cumsum(sizes), []
                    for i in range(lo, hi):
                        s = sets[ends[i - lo] - sizes[i - lo] : ends[i - lo]]
                        if (a[i], block[i]) != own:
                            own, centre = (a[i], block[i]), []
                        if not other[i]:
                            centre.append(s.copy())
                        elif any(linked(num, den, c, s) for c in centre):
                            good.append((a[i], ids[i]))
                    got = np.array(good, np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])
            trim()

        return rows.mapInArrow(test, "a long, b long")

    def across(self, crowd: DataFrame, docs: DataFrame, roots: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of different components that meet in a larger bucket and whose sketches let them link.

        nearest: of each member in a block only the one whose sketch is nearest.
        """
        num, den = self.num, self.den
        rows = crowd.join(roots, crowd["doc"] == roots["node"], "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
        # per bucket with several components: the largest one, and blocks for its members and for the others
        by_root = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
        mixed = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
        mixed = mixed.select("key", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("many"))
        mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(SALTS)).cast("int")).join(mixed, ["key", "salt"])
        in_top, h = F.col("root") == F.col("top"), F.xxhash64("doc")
        rows = rows.withColumn("block", F.when(in_top, F.col("few") + F.pmod(h, "many")).otherwise(F.pmod(h, "few")).cast("int"))
        tiles = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("few") + F.when(in_top, 0).otherwise(F.col("many")) - 1)))
        tiles = tiles.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "doc", "root")
        tiles = tiles.join(docs.select(F.col("a").alias("doc"), F.col("b").alias("n"), "sketch"), "doc")
        tiles = tiles.select("key", "i", "j", "block", "doc", "root", "n", "sketch").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

        def compare(batches):
            for (_, i, j), t in groups(batches, 3):
                block, doc, root, n = (t.column(c).to_numpy() for c in ("block", "doc", "root", "n"))
                bits = t.column("sketch").to_pylist()
                # members outside the largest component, each against all that come later or are in the largest
                names, of, many = np.unique(root, return_inverse=True, return_counts=True)
                order = np.argsort(of == many.argmax(), kind="stable")
                block, doc, root, n, bits = block[order], doc[order], root[order], n[order], [bits[r] for r in order]
                whole, first = by_width(bits), np.zeros((len(doc), 0), "<u8")
                if len(doc) > many.max():
                    least = min(BITS // 64, *whole)
                    first = np.empty((len(doc), least), "<u8")
                    for at, rows in whole.values():
                        first[at] = folded(rows, least)
                for x in range(len(doc) - many.max()):
                    there = slice(x + 1, None)
                    ok, _ = close(num, den, first[x], first[there], n[x], n[there])
                    ok &= root[there] != root[x]
                    if i != j:
                        ok &= block[there] != block[x]
                    if ok.any():
                        # what passes in few bits is tested in all that both have
                        b, apart, own = [], [], np.frombuffer(bits[x], "<u8")[None]
                        like = np.flatnonzero(ok) + x + 1
                        for w, (at, rows) in whole.items():
                            of = np.searchsorted(at, like)
                            of = of[(of < len(at)) & (at[np.minimum(of, len(at) - 1)] == like)]
                            least = min(w, own.shape[1])
                            good, far = close(num, den, folded(own, least), folded(rows[of], least), n[x], n[at[of]])
                            b.append(doc[at[of]][good])
                            apart.append(far[good])
                        b, apart = np.concatenate(b), np.concatenate(apart)
                        if not len(b):
                            continue
                        b = b[[apart.argmin()]] if nearest else b
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b, doc[x])), pa.array(np.maximum(b, doc[x]))], names=["a", "b"])

        return self.sifted(tiles.mapInArrow(compare, "a long, b long").distinct(), docs)

    def done(self) -> None:
        """Removes the tables of a round that nothing reads any more."""
        self.scratch.drop(f"near-{self.round}")
        self.scratch.drop(f"want-{self.round}")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(a: id, b: set size) of every document with an id; (node, root) of those with a lesser id in their component."""
        keep = self.scratch.keep
        found = keep(self.found(), "found")
        docs, links = found.where(f"kind = {DOC}").select("a", "b", "sketch", "wide"), found.where(f"kind = {LINK}").select("a", "b").distinct()
        self.round = 1
        edges = keep(self.verified(keep(self.sketched(links, docs), "near-1")), "edges-1").union(found.where(f"kind = {SAME}").select("a", "b"))
        roots = components(edges, self.scratch, "roots")
        self.done()
        crowd = found.where(f"kind = {CROWD}").select(F.col("a").alias("key"), F.col("b").alias("doc"))
        # first the nearest of each, while that joins many; then all pairs that still lie in different components
        total = docs.count()
        for self.round, nearest in ((2, True), (3, True), (4, False)):
            if self.round == 3 and more.count() * SECOND < total:
                continue
            more = keep(self.verified(keep(self.across(crowd, docs, roots, nearest), f"near-{self.round}")), f"edges-{self.round}")
            if more.limit(1).count():
                roots = components(roots.toDF("a", "b").union(more), self.scratch, f"roots-{self.round}")
            self.done()
        return docs.select("a", "b"), roots


def linked(num: int, den: int, a: np.ndarray, b: np.ndarray) -> bool:
    """Exactly: den * |both| >= num * |either|, of sorted sets, neither empty."""
    n, m = len(a), len(b)
    if not n or not m or n * den < m * num or m * den < n * num:
        return False
    if n > m:
        a, b, n, m = b, a, m, n
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, m - 1)] == a).sum())
    return den * both >= num * (n + m - both)


def components_of(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles (set size), component_id (the least id reachable by links, its own included)."""
    join = JaccardJoin(docs, k, num, den, id_col, text_col)
    sizes, roots = join.run()
    out = sizes.join(roots, sizes["a"] == roots["node"], "left").select(F.col("a").alias(id_col), F.col("b").alias("n_shingles"), F.coalesce("root", "a").alias("component_id"))

    def count(batches):
        shingler = Shingler(k)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                _, n = shingler.sets(b.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), pa.nulls(hi - lo, pa.int64())], names=[id_col, "n_shingles", "component_id"])

    return out.union(join.all.where("id is null").mapInArrow(count, f"`{id_col}` long, n_shingles long, component_id long"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one of the least id, and of rows that share an id the first by text. Rows with a null id stay."""
    join = JaccardJoin(docs, k, num, den, id_col, text_col)
    sizes, roots = join.run()
    gone = roots.select(F.col("node").alias("__gone"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no column of docs has the name of one that is joined
    own, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    kept = safe.join(gone, own.cast("long") == F.col("__gone"), "left_anti")
    again = sizes.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    if not again.limit(1).count():
        return kept.toDF(*names)
    ids = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    once = kept.join(ids, own.cast("long") == F.col("a"), "left_anti")
    rows = kept.join(ids, own.cast("long") == F.col("a"), "left_semi")
    # by text, then by the row as JSON, which orders columns of every type
    least = F.min_by(F.struct(*safe.columns), F.struct(F.coalesce(text.cast("string"), F.lit("")), F.to_json(F.struct(*safe.columns))))
    return once.union(rows.groupBy(own.alias("__own")).agg(least.alias("w")).select("w.*")).toDF(*names)
