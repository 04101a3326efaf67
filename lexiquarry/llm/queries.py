"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.llm import licenses

    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = {c: F.array_join(c, ",") for c in ("sentence_ids", "licences")}
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), joined["sentence_ids"].alias("sentence_ids"), joined["licences"].alias("licences"), F.size("unmatched").cast("long").alias("n_unmatched"), "licence_status")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.llm import bpe

    out = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.llm.token_store import TokenStore

    docs = table(spark, sf_dir, "documents")
    store = TokenStore.write(docs, word_vocabulary(), end_id=1)
    return store.read(docs.select("doc_id")).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.llm import sharding

    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.llm import jaccard

    return jaccard.components_of(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.llm import decontaminate

    out = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    out = out.select("doc_id", "n_words", hits.alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.llm import secrets

    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = secrets.listed(F.filter("secret_spans", lambda s: s["kind"] < 3))
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("secret_spans")).alias("spans"))


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; the sample splits of the classifiers."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.llm import language

    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(F.coalesce(remainder(3) != 1, F.lit(False))))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality.train(docs, table(spark, sf_dir, "labels").where(F.coalesce(remainder(5) != 0, F.lit(False))))
    out = quality.score(docs, network)
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.llm import media

    out = media.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length("payload").cast("long")
    tail = F.substring("payload", -64, 64)
    return out.select("doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from lexiquarry.llm import licenses, sql

    return {"op1_licenses": licenses.oracle_sql(), "op5_jaccard": sql.jaccard(), "op6_decontaminate": sql.decontaminate()}
