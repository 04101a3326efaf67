"""A training-corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents.

Cases: a null or empty text is scored like any other by the quality stage, has no near-duplicate, leak or secret, and no
tokens; a null id stays in every stage; rows that share an id are one document of the near-duplicate stage, which keeps
the first by text; empty tables give no rows; further columns pass, whatever their names, but those that the last stage
adds (token_ids, n_tokens, decoded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import bpe, decontaminate, jaccard, quality, secrets
from lexiquarry.llm.common import Scratch
from lexiquarry.llm.queries import table, word_vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no column of docs gives way to a score
    kept = quality.score(safe, network, f"c{names.index('text')}").where("predicted = 1")
    return kept.drop("score", "predicted").toDF(*names)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: 5-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, num=4, den=5)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 10 consecutive words of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), window=10)


def unsecret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no column of docs gives way to the spans
    clean = secrets.redact(secrets.scan(safe, f"c{names.index('text')}"), f"c{names.index('text')}").toDF(*names)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids and the text that they decode to."""
    return bpe.encode_decode(docs, word_vocabulary())


STAGES = [("quality classifier", good), ("n-gram Jaccard join", distinct), ("benchmark decontamination", unleaked), ("secret scans", unsecret), ("BPE encoding and decoding", tokens)]

#: SQL can't express the trained classifier or the merges; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other; each result is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage-{k}")
    return docs
