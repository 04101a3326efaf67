"""A corpus: documents, their postings, and the plan that a query tree compiles to.

Postings are rows (term, key, tf, pos, len_<field>...), one for each term of each document; they are made and stored as
blocks, the documents of one term in a run of tokens as lists. `build` stores them once, in directories by a hash of the term
and sorted by term within, with a table of the terms' statistics; a query then reads its own terms' files only. Without an index they are computed from the texts by the same code.

A query compiles in two steps. Its `match` and `score` name slots (occurrences or places of a term, tests of terms,
frequencies of phrases, statistics), and the corpus notes them; then one scan of the noted terms is grouped by document into
a row of slots. A single term needs no grouping. Phrases and intervals that need a program run in Arrow batches, over rows
that hold their terms. Documents themselves are joined only if a clause reads their columns or can match without a term.

The key must be unique. A null or empty text has no terms; such documents match queries without terms only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.functions import similarity as sim
from lexiquarry.functions.analysis import ANALYZERS, Analyzer
from lexiquarry.sources.shared import fewer_rows, file_system, plan_bytes, spread

#: Bytes of text for each directory of postings.
BUCKET_BYTES = 64 << 20
#: Tokens that a Python worker turns into postings at a time: what bounds its memory, whatever the table's size.
BLOCK_TOKENS = 1 << 20
#: Rows of an Arrow batch of tokens.
BATCH_ROWS = 2000
#: Stands for a field in the rows of lengths.
LENGTHS = ""
#: Multi-term queries of at most so many terms read these terms' files; others test every term of the postings.
LISTED = 1024
TERMS = [T.StructField("bucket", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("ttf", T.LongType())]


def sliced(batch: pa.RecordBatch, fields: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most BLOCK_TOKENS tokens in all fields, or one row."""
    sizes = sum(pc.fill_null(pc.list_value_length(batch.column(1 + i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(fields))
    lo = 0
    ends = np.cumsum(sizes)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_TOKENS, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def blocks(batch: pa.RecordBatch, fields: list[str]) -> dict[str, list[pa.Array]]:
    """Rows of (key, tokens of each field) as blocks of each field (term, documents, occurrences, keys, tfs, places, lengths of each field).

    A block has the documents of one term; under the field LENGTHS all documents stand in one.
    """
    keys, found, lens = batch.column(0), {}, []
    for i, f in enumerate(fields):
        toks = batch.column(1 + i)
        flat = toks.flatten()
        row = pc.list_parent_indices(toks).to_numpy(zero_copy_only=False).astype(np.int64)
        places = flat.field(1).to_numpy(zero_copy_only=False)
        step = (np.diff(places) > 0) | (np.diff(row) > 0)
        if step.all():  # each place once and in order
            counts = np.bincount(row, minlength=len(keys))
        else:
            counts = np.bincount(np.unique((row << 32) + places) >> 32, minlength=len(keys))
        lens.append(pa.array(counts.astype(np.int32)))
        found[f] = (flat.field(0).dictionary_encode(), row, places, step.all())
    offsets = lambda at: pa.array(at.astype(np.int32))
    out = {}
    for f, (words, row, places, sorted_) in found.items():
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group = code * len(keys) + row
        order = np.argsort(group, kind="stable") if sorted_ else np.lexsort((places, group))
        group = group[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(group)))
        rows, codes = group[first] % max(1, len(keys)), group[first] // max(1, len(keys))
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        at, take = offsets(np.append(new, len(codes))), pa.array(rows)
        each = pa.ListArray.from_arrays(offsets(np.append(first, len(group))), pa.array(places[order].astype(np.int32)))
        lists = [keys.take(take), pa.array(tf.astype(np.int32)), each, *[n.take(take) for n in lens]]
        ttf = np.add.reduceat(tf, new) if len(new) else tf
        out[f] = [words.dictionary.take(pa.array(codes[new])), pa.array(np.diff(np.append(new, len(codes))).astype(np.int32)), pa.array(ttf.astype(np.int64)), *[pa.ListArray.from_arrays(at, x) for x in lists]]
    n, at = len(keys), pa.array([0, len(keys)], pa.int32())
    none = pa.nulls(1, pa.list_(pa.list_(pa.int32())))
    out[LENGTHS] = [pa.nulls(1, pa.string()), pa.array([n], pa.int32()), pa.array([0], pa.int64()), pa.ListArray.from_arrays(at, keys), pa.nulls(1, pa.list_(pa.int32())), none, *[pa.ListArray.from_arrays(at, x) for x in lens]]
    return out


class Stats:
    """Numbers of the whole corpus that a score names."""

    def __init__(self, corpus: Corpus):
        slot, whole = corpus._slot, corpus.whole
        self.df = lambda f, t: F.col(slot("df", f, t))
        self.ttf = lambda f, t: F.col(slot("ttf", f, t))
        self.docs = lambda f: whole(f, "doc_count")
        self.tokens = lambda f: whole(f, "sum_ttf")


class Corpus:
    """Documents with a key and the analyzed text fields that queries can name; coded: lengths as one byte keeps them."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: dict[str, str | Analyzer] | None = None, similarity=None, coded: bool = False):
        self.key, self.similarity, self.coded = key, similarity or sim.bm25(), coded
        self.analyzers = {f: ANALYZERS[a] if isinstance(a, str) else a for f, a in (text or {"text": "simple_ascii"}).items()}
        self.docs, self.path, self.meta = docs, None, {}
        self.slots: dict = {}

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def like(self, **changes) -> Corpus:
        out = object.__new__(Corpus)
        out.__dict__ = self.__dict__ | {"slots": {}} | changes
        return out

    def model(self, field_: str):
        return self.similarity.of(field_) if isinstance(self.similarity, sim.PerField) else self.similarity

    # ---- tables

    def tokens(self) -> DataFrame:
        """(key, _t_<field>...)."""
        return spread(self.docs).select(self.key, *[a(F.col(f)).alias(f"_t_{f}") for f, a in self.analyzers.items()])

    def _schema(self) -> T.StructType:
        """Blocks of postings: the documents of a term, with the places and the documents' lengths, as lists."""
        lists = [(self.key, self.docs.schema[self.key].dataType), ("tf", T.IntegerType()), ("pos", T.ArrayType(T.IntegerType())), *[(f"len_{f}", T.IntegerType()) for f in self.analyzers]]
        return T.StructType([T.StructField("term", T.StringType()), T.StructField("_df", T.IntegerType()), T.StructField("_ttf", T.LongType()), *[T.StructField(n, T.ArrayType(t)) for n, t in lists]])

    def _blocks(self) -> DataFrame:
        """(field, term, _df, _ttf, lists...) computed from the texts."""
        fields, schema = list(self.analyzers), self._schema()
        names = ["field", *schema.names]
        fewer_rows(self.spark, BATCH_ROWS)

        def run(batches):
            for b in batches:
                for part in sliced(b, len(fields)):
                    for f, cols in blocks(part, fields).items():
                        yield pa.RecordBatch.from_arrays([pa.array([f] * len(cols[0]), pa.string()), *cols], names=names)

        return self.tokens().mapInArrow(run, T.StructType([T.StructField("field", T.StringType()), *schema]))

    def _rows_of(self, blocks_: DataFrame, *columns: str) -> DataFrame:
        """A row for each document of each block: its key and these columns."""
        at = blocks_.select(*["term" for _ in range("term" in columns)], *[c for c in columns if c != "term"], F.posexplode(self.key).alias("__i", "__key"))
        pick = {self.key: F.col("__key")} | {c: F.col("term") if c == "term" else F.get(c, F.col("__i")) for c in columns}
        names = [*[c for c in columns if c == "term"], self.key, *[c for c in columns if c != "term"]]
        return at.select(*[pick[c].alias(c) for c in names])

    def _stored(self, table: str, fields: list[T.StructField], f: str | None = None) -> DataFrame:
        """A table of the index, without a look at its files for the schema."""
        df = self.spark.read.schema(T.StructType(fields)).parquet(f"{self.path}/{table}")
        return df if f is None else df.where(F.col("field") == f)

    def blocks(self, f: str) -> DataFrame:
        """The blocks of a field."""
        if self.path:
            return self._stored("blocks", [*self._schema(), T.StructField("field", T.StringType()), T.StructField("bucket", T.IntegerType())], f)
        return self._blocks().where(F.col("field") == f).drop("field")

    def posted(self, f: str, terms: Iterable[str] | None = None, only: Column | None = None, places: bool = True) -> DataFrame:
        """Postings of a field: (term, key, tf, pos, len_...); of these terms, or where a condition on term holds. places: with pos."""
        found = self.blocks(f) if terms is None else self._of_terms(self.blocks(f), f, terms)
        found = found if only is None else found.where(only)
        return self._rows_of(found, "term", "tf", *(["pos"] if places else []), *[f"len_{g}" for g in self.analyzers])

    def lengths(self) -> DataFrame:
        """(key, len_<field>...) of every document."""
        if self.path:
            return self._stored("lengths", [self.docs.schema[self.key], *[T.StructField(f"len_{f}", T.IntegerType()) for f in self.analyzers]])
        return self._rows_of(self._blocks().where(F.col("field") == LENGTHS), *[f"len_{f}" for f in self.analyzers])

    def dictionary(self, f: str) -> DataFrame:
        """(term, df, ttf) of a field."""
        if self.path:
            return self._stored("terms", [*TERMS, T.StructField("field", T.StringType())], f)
        return self.blocks(f).groupBy("term").agg(F.sum("_df").alias("df"), F.sum("_ttf").alias("ttf"))

    def collection_stats(self, f: str) -> DataFrame:
        """(field, max_doc, doc_count, sum_ttf, sum_df)."""
        if self.path:
            return self.spark.read.parquet(f"{self.path}/collection").where(F.col("field") == f).drop("buckets")
        n = F.col(f"len_{f}")
        of_docs = self.lengths().agg(F.count("*").alias("max_doc"), F.count(F.when(n > 0, 1)).alias("doc_count"))
        of_terms = self.blocks(f).agg(F.coalesce(F.sum("_ttf"), F.lit(0)).alias("sum_ttf"), F.coalesce(F.sum("_df"), F.lit(0)).alias("sum_df"))
        return of_docs.crossJoin(of_terms).select(F.lit(f).alias("field"), "*")  # one row each

    def term_stats(self, f: str) -> DataFrame:
        """(field, term, df, ttf)."""
        return self.dictionary(f).select(F.lit(f).alias("field"), "term", "df", "ttf")

    def postings(self, f: str) -> DataFrame:
        """(field, term, key, pos), a row for each occurrence."""
        return self.posted(f).select(F.lit(f).alias("field"), "term", self.key, F.explode("pos").alias("pos"))

    # ---- the stored index

    def build(self, path: str, buckets: int | None = None) -> Corpus:
        """Stores the postings under path and returns the corpus that reads them. The collection's table comes last, as the mark of a whole index."""
        buckets = buckets or max(1, min(4096, plan_bytes(self.docs) // BUCKET_BYTES))
        fs, home = file_system(self.spark, path)
        work = f"{path}-{uuid.uuid4().hex}"
        self._blocks().write.parquet(f"{work}/stage")
        stage = self.spark.read.schema(T.StructType([T.StructField("field", T.StringType()), *self._schema()])).parquet(f"{work}/stage")
        order = ["field", "bucket", "term", F.get(self.key, F.lit(0))]
        all_ = stage.where(F.col("field") != LENGTHS).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        all_.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("field", "bucket").parquet(f"{work}/blocks")
        terms = all_.groupBy("field", "bucket", "term").agg(F.sum("_df").alias("df"), F.sum("_ttf").alias("ttf"))
        terms.sortWithinPartitions("field", "bucket", "term").write.partitionBy("field").parquet(f"{work}/terms")
        self._rows_of(stage.where(F.col("field") == LENGTHS), *[f"len_{f}" for f in self.analyzers]).write.parquet(f"{work}/lengths")
        lens, words = self.spark.read.parquet(f"{work}/lengths"), self.spark.read.parquet(f"{work}/terms")
        counts = lens.agg(F.count("*").alias("max_doc"), *[F.count(F.when(F.col(f"len_{f}") > 0, 1)).alias(f"n_{f}") for f in self.analyzers]).first()
        sums = {r["field"]: (r["a"], r["b"]) for r in words.groupBy("field").agg(F.sum("ttf").alias("a"), F.sum("df").alias("b")).collect()}
        rows = [(f, counts["max_doc"], counts[f"n_{f}"], *sums.get(f, (0, 0)), buckets) for f in self.analyzers]
        fs.delete(file_system(self.spark, f"{work}/stage")[1], True)
        meta = self.spark.createDataFrame(rows, "field string, max_doc long, doc_count long, sum_ttf long, sum_df long, buckets int")
        meta.coalesce(1).write.parquet(f"{work}/collection")
        if fs.exists(home) or not fs.rename(file_system(self.spark, work)[1], home):  # another session was faster
            fs.delete(file_system(self.spark, work)[1], True)
        return self.open(path)

    def open(self, path: str) -> Corpus:
        meta = {r["field"]: r for r in self.spark.read.parquet(f"{path}/collection").collect()}
        return self.like(path=path, meta=meta)

    def indexed(self, path: str) -> Corpus:
        """The corpus over the index at path, built where there is none."""
        fs, done = file_system(self.spark, f"{path}/collection/_SUCCESS")
        return self.open(path) if fs.exists(done) else self.build(path)

    def stored(self, path: str) -> Corpus:
        """The same corpus with its postings under path."""
        return self.indexed(path)

    def _of_terms(self, df: DataFrame, f: str, terms: Iterable[str]) -> DataFrame:
        """The rows of these terms; of a stored table, the directories that can't hold them aren't read."""
        terms = list(terms)
        if self.path:
            buckets = self.meta[f]["buckets"]
            hashes = [F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms]
            df = df.where(F.col("bucket").isin(*hashes) if hashes else F.lit(False))
        return df.where(F.col("term").isin(terms))

    # ---- slots that queries name

    def _slot(self, kind: str, *what) -> str:
        return self.slots.setdefault((kind, *what), f"__{kind}{len(self.slots)}")

    def tf(self, f: str, term: str) -> Column:
        return F.coalesce(F.col(self._slot("tf", f, term)).cast("double"), F.lit(0.0))

    def places(self, f: str, term: str) -> Column:
        return F.coalesce(F.col(self._slot("pos", f, term)), F.array().cast("array<int>"))

    def length(self, f: str) -> Column:
        n = F.coalesce(F.col(self._slot("len", f)), F.lit(0))
        return (sim.coded_length(n) if self.coded else n).cast("double")

    def holds(self, f: str, terms: Iterable[str]) -> Column:
        """Whether the document holds any of these terms."""
        out = F.lit(False)
        for t in terms:
            out = out | (self.tf(f, t) > 0)
        return out

    def has(self, f: str, test: Callable[[Column], Column]) -> Column:
        """Whether the document has a term that passes test."""
        key = str(test(F.col("term")))
        self.tests = getattr(self, "tests", {}) | {(f, key): test}
        return F.coalesce(F.col(self._slot("has", f, key)), F.lit(False))

    def places_where(self, f: str, test: Callable[[Column], Column]) -> Column:
        """The places of all terms that pass test."""
        self.has(f, test)
        return F.coalesce(F.col(self._slot("any", f, str(test(F.col("term"))))), F.array().cast("array<int>"))

    def sum_of(self, owner, f: str, test: Callable[[Column], Column], score: Callable[..., Column]) -> Column:
        """The sum of score(term, tf, length, df, ttf) over the document's terms that pass test."""
        self.has(f, test)
        name = self._slot("sum", f, str(test(F.col("term"))), owner)
        self.sums = getattr(self, "sums", {}) | {name: score}
        return F.coalesce(F.col(name), F.lit(0.0))

    def count_of(self, owner, candidates: Column, lists: list[Column], fn: Callable[[list[list[int]]], float]) -> Column:
        """fn of lists of positions, in Arrow batches, 0 where candidates is false."""
        name = self._slot("freq", owner)
        self.programs = getattr(self, "programs", {}) | {name: (candidates, lists, fn)}
        return F.coalesce(F.col(name), F.lit(0.0))

    def every(self) -> None:
        """The query can match documents without its terms."""
        self._slot("every")

    def reads_docs(self) -> None:
        """The query reads columns of documents."""
        self._slot("docs")

    def whole(self, f: str, what: str) -> Column:
        """doc_count, sum_ttf, sum_df or max_doc of a field."""
        if self.meta:
            return F.lit(float(self.meta[f][what]))
        return F.col(self._slot("all", f, what))

    def whole_now(self, f: str, what: str) -> Column:
        """As whole, for expressions over postings, where slots aren't there yet."""
        return self.whole(f, what) if self.meta else self.collection_stats(f).select(F.col(what).cast("double")).scalar()

    def doc_freqs(self, f: str, terms: list[str]) -> tuple[int, dict[str, int]]:
        """Documents in all, and those with each term."""
        found = {r["term"]: r["df"] for r in self._of_terms(self.dictionary(f), f, terms).select("term", "df").collect()}
        total = self.meta[f]["max_doc"] if self.meta else self.docs.count()
        return total, {t: found.get(t, 0) for t in terms}

    def expanded(self, f: str, test: Callable[[Column], Column], rank: Callable[[Column], Column] | None = None, limit: int | None = 50) -> list[str]:
        """At most `limit` terms of the field that pass test (None: all), by rank (greatest first), then term."""
        order = [rank(F.col("term")).desc()] if rank else []
        found = self.dictionary(f).where(test(F.col("term"))).select("term").orderBy(*order, "term")
        return [r["term"] for r in (found if limit is None else found.limit(limit)).collect()]

    # ---- running a query

    def _rows(self, only: Column | None = None) -> DataFrame:
        """A row for each document that holds a noted term (or for every document), with the noted slots."""
        of = lambda kind: [(k[1:], name) for k, name in self.slots.items() if k[0] == kind]
        tfs, places, tests, anys, sums = of("tf"), of("pos"), of("has"), of("any"), of("sum")
        fields = list(dict.fromkeys(k[0] for k, _ in tfs + places + tests))
        terms = {f: sorted({k[1] for k, _ in tfs + places if k[0] == f}) for f in fields}
        lens = [f for (f,), _ in of("len")]
        every, docs = ("every",) in self.slots, ("docs",) in self.slots
        single = len(fields) == 1 and len(terms[fields[0]]) == 1 and not tests
        grouped = None
        for f in fields:
            words, where = self.dictionary(f), bool(places or anys)
            mine = [(k[1], name) for k, name in tests if k[0] == f]
            listed = [self.expanded(f, self.tests[f, t], None, LISTED + 1) for t, _ in mine] if self.path else [None] * len(mine)
            flags = {name: F.col("term").isin(found) if found is not None and len(found) <= LISTED else self.tests[f, t](F.col("term")) for (t, name), found in zip(mine, listed)}
            flag = {t: flags[name] for t, name in mine}
            some = F.lit(False)
            for c in flags.values():
                some = some | c
            if all(found is not None and len(found) <= LISTED for found in listed):
                tested = sorted({t for found in listed for t in found})
                rows, words = self.posted(f, sorted({*tested, *terms[f]}), None, where), self._of_terms(words, f, tested)
            else:
                rows, words = self.posted(f, None, some | F.col("term").isin(terms[f]), where), words.where(some)
            own = {n: self.sums[n] for k, n in sums if k[0] == f}
            if own:
                rows = rows.join(words.select("term", F.col("df").cast("double").alias("__df"), F.col("ttf").cast("double").alias("__ttf")), "term", "left")
            n = sim.coded_length(F.col(f"len_{f}")) if self.coded else F.col(f"len_{f}")
            of_row = (F.col("term"), F.col("tf").cast("double"), n.cast("double"), F.col("__df"), F.col("__ttf"))
            rows = rows.select(
                self.key,
                *[F.when(F.col("term") == k[1], F.col("tf")).alias(n) if k[0] == f else F.lit(None).cast("int").alias(n) for k, n in tfs],
                *[F.when(F.col("term") == k[1], F.col("pos")).alias(n) if k[0] == f else F.lit(None).cast("array<int>").alias(n) for k, n in places],
                *[flags[n].alias(n) if n in flags else F.lit(False).alias(n) for _, n in tests],
                *[F.when(flag[k[1]], F.col("pos")).alias(n) if k[0] == f else F.lit(None).cast("array<int>").alias(n) for k, n in anys],
                *[F.when(flag[k[1]], own[n](*of_row)).cast("double").alias(n) if n in own else F.lit(None).cast("double").alias(n) for k, n in sums],
                *[f"len_{g}" for g in lens],
            )
            grouped = rows if grouped is None else grouped.unionByName(rows)
        if grouped is not None and not single:
            aggs = [F.max(n).alias(n) for _, n in tfs + tests] + [F.first(n, ignorenulls=True).alias(n) for _, n in places] + [F.max(f"len_{g}").alias(f"len_{g}") for g in lens]
            aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n) for _, n in anys] + [F.sum(n).alias(n) for _, n in sums]
            grouped = grouped.groupBy(self.key).agg(*aggs)
        if grouped is not None and only is not None:
            grouped = grouped.where(only)
        if grouped is not None and getattr(self, "programs", None):
            grouped = self._programmed(grouped)
        if every or grouped is None:
            base = self.lengths().select(self.key, *[f"len_{g}" for g in lens]) if lens or not docs else None
            if docs:
                base = self.docs.join(base, self.key) if base is not None else self.docs
            grouped = base if grouped is None else base.join(grouped.drop(*[f"len_{g}" for g in lens]), self.key, "left")
        elif docs:
            grouped = self.docs.join(grouped, self.key)
        return grouped.withColumns({name: F.col(f"len_{k[0]}") for k, name in of("len")} | self._statistics())

    def _statistics(self) -> dict[str, Column]:
        """Noted statistics as values of scalar subqueries."""
        out = {}
        wanted = [(k, n) for k, n in self.slots.items() if k[0] in ("df", "ttf")]
        for f in dict.fromkeys(k[1] for k, _ in wanted):
            terms = sorted({k[2] for k, _ in wanted if k[1] == f})
            at = {t: i for i, t in enumerate(terms)}
            found = self._of_terms(self.dictionary(f), f, terms)
            one = lambda t, c: F.coalesce(F.sum(F.when(F.col("term") == t, F.col(c))), F.lit(0)).cast("double")
            all_ = found.agg(F.array(*[F.struct(one(t, "df").alias("df"), one(t, "ttf").alias("ttf")) for t in terms]).alias("s")).select("s").scalar()
            out |= {n: all_[at[k[2]]][k[0]] for k, n in wanted if k[1] == f}
        for k, n in self.slots.items():
            if k[0] == "all":
                out[n] = self.collection_stats(k[1]).select(F.col(k[2]).cast("double")).scalar()
        return out

    def _programmed(self, rows: DataFrame) -> DataFrame:
        """rows with the frequencies that need a program, computed where their candidates hold."""
        names = rows.columns
        given, fns = {}, []
        for i, (name, (candidates, lists, fn)) in enumerate(self.programs.items()):
            given[f"__in{i}"] = F.when(candidates, F.array(*lists))
            fns.append((f"__in{i}", name, fn))
        places = {n for k, n in self.slots.items() if k[0] in ("pos", "any")}
        kept = [n for n in names if n not in places]
        schema = T.StructType([rows.schema[n] for n in kept] + [T.StructField(name, T.DoubleType()) for _, name, _ in fns])

        def run(batches):
            for b in batches:
                new = [pa.array([0.0 if x is None else fn([sorted(y) for y in x]) for x in b.column(source).to_pylist()], pa.float64()) for source, _, fn in fns]
                yield pa.RecordBatch.from_arrays([b.column(n) for n in kept] + new, names=schema.names)

        return rows.withColumns(given).select(*kept, *given).mapInArrow(run, schema)

    def project(self, make: Callable[[Corpus], list[Column]], all_rows: bool = True) -> DataFrame:
        """Columns over slots for every document: make names them of the corpus that it is given."""
        c = self.like()
        if all_rows:
            c.every()
        columns = make(c)
        return c._rows().select(*columns)

    def search(self, query) -> DataFrame:
        """(key, score) of every matching document."""
        query, c = query.rewritten(self), self.like()
        match, score, need = query.match(c), query.score(c, Stats(c)), query.required(c)
        return c._rows(need).where(match).select(self.key, score.alias("score"))

    def count(self, query) -> DataFrame:
        """(n), the number of matching documents."""
        query, c = query.rewritten(self), self.like()
        match, need = query.match(c), query.required(c)
        return c._rows(need).where(match).agg(F.count("*").alias("n"))

    def top(self, query, k: int, after: tuple[float, object] | None = None) -> DataFrame:
        """The k best by score, then key; after: those behind this (score, key)."""
        found = self.search(query)
        if after is not None:
            found = found.where((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col(self.key) > F.lit(after[1]))))
        return found.orderBy(F.col("score").desc(), self.key).limit(k)

    def top_with_total(self, query, k: int, most: int | None = None) -> DataFrame:
        """The k best with the number of all hits: total, and relation `=`, or `>=` where counting stopped at `most`."""
        found = self.search(query)
        hits = found.agg(F.count("*").alias("n")) if most is None else found.limit(most + 1).agg(F.count("*").alias("n"))
        n = hits.scalar()
        total, relation = (n, F.lit("=")) if most is None else (F.least(n, F.lit(most)), F.when(n > most, ">=").otherwise("="))
        return found.orderBy(F.col("score").desc(), self.key).limit(k).select("*", total.alias("total"), relation.alias("relation"))

    def explain(self, query) -> DataFrame:
        """(key, node, depth, description, matches, value): every clause of the query on every document that matches it."""
        query, c = query.rewritten(self), self.like()
        match, need = query.match(c), query.required(c)
        nodes = [F.struct(F.lit(i).alias("node"), F.lit(d).alias("depth"), F.lit(x.named()).alias("description"), x.match(c).alias("matches"), F.when(x.match(c), x.score(c, Stats(c))).cast("double").alias("value")) for i, (d, x) in enumerate(query.tree())]
        return c._rows(need).where(match).select(self.key, F.inline(F.array(*nodes)))

    def matches(self, query) -> DataFrame:
        """(key, field, term, start): the places of the query's terms in the documents that match it."""
        found, out = self.search(query).select(self.key), None
        query = query.rewritten(self)
        for f, terms in query.term_sets():
            tests = query.tests_of(f)
            if tests:
                some = F.col("term").isin(terms)
                for t in tests:
                    some = some | t(F.col("term"))
                rows = self.posted(f, None, some)
            else:
                rows = self.posted(f, terms)
            one = rows.select(F.lit(f).alias("field"), "term", self.key, F.explode("pos").alias("start"))
            out = one if out is None else out.unionByName(one)
        return out.join(found, self.key, "leftsemi").select(self.key, "field", "term", "start") if out is not None else found.select(self.key, F.lit("").alias("field"), F.lit("").alias("term"), F.lit(0).alias("start")).where("false")
