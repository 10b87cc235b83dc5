"""The operators of this subpackage as queries over the test tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.llm import chat, decontamination, id_files, jaccard, language, mixing, quality, quality_rules, simhash, trie, url_filters, whitening
from cardflow.llm.text import bounded_batches
from cardflow.llm.token_counts import TokenRollup
from cardflow.llm.tokens import default_path, token_count
from cardflow.session import checkpoint_root, stored

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{d}/{name}.parquet")


def op1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rollup of all documents: a first load, a delivery of it once more, the deletion of
    exact copies, and new counts for texts whose repeated lines were taken out."""
    docs = table(spark, d, "documents")
    lines = F.split("text", "\n")
    cleaned = F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.array_join(F.array_distinct(lines), "\n"))
    name = F.lit("word_bpe_49k")
    counts = docs.select(
        "doc_id", "source", "lang", name.alias("tokenizer"), F.xxhash64("text").alias("h1"), F.md5("text").alias("h2"),
        token_count(F.col("text"), default_path()).alias("n"),
        F.when(cleaned.isNotNull(), token_count(cleaned, default_path())).alias("n_clean"),
    )
    counts = stored(counts)
    first = counts.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    # A hot text is one row of `first`; Spark splits the other side of the join.
    marked = counts.filter("h2 IS NOT NULL").join(first, ["h1", "h2"])
    none = F.lit(None).cast("long")
    load = counts.select("source", "lang", "tokenizer", F.lit("insert").alias("op"), F.col("n").alias("n_tokens"), none.alias("old_tokens"))
    copies = marked.filter("doc_id > first").select(
        "source", "lang", "tokenizer", F.lit("delete").alias("op"), F.col("n").alias("n_tokens"), none.alias("old_tokens"))
    revised = marked.filter("doc_id = first AND n_clean IS NOT NULL").select(
        "source", "lang", "tokenizer", F.lit("revise").alias("op"), F.col("n_clean").alias("n_tokens"), F.col("n").alias("old_tokens"))
    rollup = TokenRollup(spark, f"{checkpoint_root(spark)}/rollups/{uuid.uuid4()}").create()
    for batch, changes in (("load", load), ("load", load), ("copies", copies), ("cleaned", revised)):
        rollup.apply(batch, changes)
    return rollup.totals()


def op2_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    # A conversation is one row; the column of its parts stays for readers of the table.
    return chat.rendered(table(spark, d, "conversations")).withColumn("part", F.lit(0).cast("long"))


# Host and path rules of the query (fixed values).
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op3_url_filters(spark: SparkSession, d: str) -> DataFrame:
    rules = [url_filters.host_path_rule(name, action) for name, action in HOST_RULES] + list(url_filters.UNWANTED)
    judged = url_filters.judge(table(spark, d, "pages").select("page_id", "url"), rules)
    own = F.col("rank") == 1
    return judged.select("page_id", "host", "path", F.when(own, F.col("rule")).alias("rule"), "verdict",
                         F.when(~own, F.col("rule")).alias("pattern"))


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op4_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    scores = quality.classify(docs, table(spark, d, "labels"), fold(5))
    return scores.select("doc_id", F.coalesce(fold(5) == 0, F.lit(True)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_token_ids(spark: SparkSession, d: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/ids/{uuid.uuid4()}"
    id_files.write(table(spark, d, "documents"), path, default_path())
    return id_files.digests(spark, path)


def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(4) == 2, F.lit(True))
    model = language.fit(docs, ~held_out)
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    marked = quality_rules.ledger(table(spark, d, "documents").select("doc_id", "text"))
    failed_base, failed_any = quality_rules.failed(quality_rules.BASE), quality_rules.failed(quality_rules.FULL)
    return marked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed_base.alias("base_failed"), (~failed_any).alias("kept"), "fail_bits")


def op8_decontamination(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return decontamination.mark(docs, table(spark, d, "benchmark")).drop("text")


def op9_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    found = jaccard.groups(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("root_id").alias("component_id"))


def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mix(table(spark, d, "documents").select("doc_id", "source", "text"))
    return mixing.taken(plan).drop("source")


def op11_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"))


def op12_simhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", simhash.digits(F.col("fp")).alias("fingerprint"), "component_id")


def op13_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return trie.trie(table(spark, d, "conversations"))


def all_queries() -> dict[str, Query]:
    return {q.__name__: q for q in (
        op1_token_counts, op2_chat_formatting, op3_url_filters, op4_quality_classifier, op5_token_ids,
        op6_language_id, op7_quality_rules, op8_decontamination, op9_ngram_jaccard, op10_mixing, op11_embedding_whitening,
        op12_simhash_dedup, op13_prefix_trie,
    )}
