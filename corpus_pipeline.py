"""Corpus pipeline: five stages over documents, each written and read again by the next.

1. language: documents without a language, or with an ambiguous one, go.
2. near_duplicates: one document of each group of linked ones (80% of the runs of five words in
   common) stays, the smallest id.
3. decontamination: documents that hold a benchmark item go.
4. mixing: runs of words of documents, so that sources come near their target weights.
5. token_ids: the mix as token ids in files of range-coded blocks, read back per row.

Null ids and texts are kept or dropped as the operators define it: a null or wordless text has no
language and goes in the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.llm import decontamination, id_files, jaccard, language, mixing
from cardflow.llm.text import bounded_batches, release_memory, row_keys, unused
from cardflow.llm.tokens import default_path
from cardflow.session import checkpoint_root


# Near copies share so many of their runs of words; op9's query has a setting of its own.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs, F.lit(True))
    names = unused(docs, *language.NAMES)
    pred, _, ambiguous = names
    known = (F.col(pred) != language.UNKNOWN) & ~F.col(ambiguous)
    return language.identify(docs, model, names=names).filter(known).drop(*names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are equal in all columns are one; documents without words are no one's copy."""
    found = jaccard.groups(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)
    group = F.when(F.col("n") > 0, F.struct(F.lit(0).alias("k"), F.col("root").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(
        F.struct(F.lit(1).alias("k"), F.col("h1").alias("a"), F.col("h2").alias("b")))
    key = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h1", "h2")
    h1, h2 = unused(docs, "h1", "h2")
    kept = found.groupBy(group.alias("g")).agg(F.min(key).alias("one")).select(F.col("one.h1").alias(h1), F.col("one.h2").alias(h2))
    rows = docs.select("*", *row_keys(docs, h1, h2)).join(kept, [h1, h2], "left_semi")
    return mixing.one_of_equal(rows, h1, h2).drop(h1, h2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_texts(docs, mixing.mix(docs))
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def token_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/ids/{uuid.uuid4()}"
    id_files.write(docs, path, default_path())
    return id_files.digests(spark, path)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_id_stage),
]

# SQL can express neither the classifier nor the coder; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents of ``sf_dir``."""
    docs = bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    work = f"{checkpoint_root(spark)}/pipeline/{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{work}/{name}")
        docs = spark.read.parquet(f"{work}/{name}")
        release_memory()
    return docs
