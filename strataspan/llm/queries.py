"""Queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontam, jaccard, lines, mixing, phrases, pii, quality, spelling, sql, suffixes, tokens, urls
from .common import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines before and after, and the digest of what is left."""
    docs = table(spark, sf_dir, "documents")
    count = lambda c: F.size(F.split(F.coalesce(c, F.lit("")), "\n")).cast("long")
    out = lines.dedup_lines(docs.withColumn("n_lines", count(F.col("text"))))
    return out.select(
        "doc_id", "n_lines", F.when(F.col("text") == "", 0).otherwise(count(F.col("text"))).alias("n_kept"), F.sha2("text", 256).alias("kept_sha256")
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes_of(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document enters with an estimate, is revised to its exact count, and
    goes again where a label says toxic; each batch is also replayed."""
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    store = tokens.TokenTotals(spark, scratch_path(spark, "token-totals"))
    estimates = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit("byte_bpe_50k").alias("tokenizer"), F.lit("insert").alias("op"),
        "source", "lang", F.coalesce(F.ceil(F.length("text") / 4), F.lit(0)).cast("long").alias("n_tokens"),
    )
    exact = tokens.count_tokens(docs).withColumn("op", F.lit("revise"))
    gone = toxic.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit("byte_bpe_50k").alias("tokenizer"), F.lit("delete").alias("op"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n_tokens"),
    )
    for name, changes in (("estimates", estimates), ("exact", exact), ("toxic", gone), ("exact", exact)):
        store.commit(name, changes)
    return store.totals()


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(quality.ledger(table(spark, sf_dir, "documents")), "v2")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_earlier(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 3, "fr": 2, "es": 2}}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.remove_recurring(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


# Host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_line_dedup, op2_ngram_jaccard, op3_chat_format, op4_token_counts, op5_pii, op6_quality, op7_suffix_dedup, op8_mixing, op9_substring_dedup, op10_decontaminate, op11_token_alignment, op12_spelling_variants, op13_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_format": sql.OP3,
        "op6_quality": sql.OP6,
        "op8_mixing": sql.mixing(MIX_WEIGHTS),
        "op10_decontaminate": sql.OP10,
        "op13_url_filter": sql.url_filter(URL_RULES, urls.MASS, urls.DAMPING, urls.ROUNDS, urls.SHARE),
    }
