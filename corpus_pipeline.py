"""A corpus in five stages: quality, near copies, benchmark items, mix, token files.

Every stage works on all documents that the one before it kept, and its result is
written before the next one reads it.  Null texts pass the filters that they give
no reason to fail; rows that repeat a document's number and text are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import decontaminate, mixing, near_copies, quality, token_files
from ledgerfold.llm.queries import as_files, fold, n_words, table
from ledgerfold.session import cut

TOKENIZER = "byte_bpe_50k.json"


def _whole(docs: DataFrame) -> DataFrame:
    """Files whose key takes the other columns along, so that a verdict need not be joined back."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("file"), "text")


def _columns_of(docs: DataFrame) -> list:
    """The columns of ``docs`` out of such files."""
    return [F.col(c) if c == "text" else F.col("file").getField(c).alias(c) for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    rated = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), "quality").filter(fold(5) != 0)
    scored = quality.score_files(_whole(docs), rated, taught=as_files(docs), keep=True)
    return scored.filter(quality.keep_good(scored)).select(_columns_of(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest number."""
    found = near_copies.judged_copies(as_files(docs))
    gone = cut(found.filter(~F.col("kept")).select(F.col("file").alias("__file"), F.col("copy").alias("__gone")).distinct())
    told = docs.withColumn("__copy", near_copies.copy_of("text"))
    # a number may be null, or stand with several texts, each with a verdict of its own
    return told.join(gone, F.col("doc_id").eqNullSafe(F.col("__file")) & (F.col("__copy") == F.col("__gone")), "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    return decontaminate.find_items(_whole(docs), items, keep=True).filter("clean").select(_columns_of(docs))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, which may be never."""
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("tie"))
    sized = docs.select(key.alias("file"), F.col("source").alias("municipality"), n_words().alias("units"))
    copies = mixing.balance_rows(sized).groupBy(F.col("file").alias("__taken")).agg(F.max("copies").alias("__copies")).filter("__copies > 0")
    taken = docs.withColumn("__file", key).join(cut(copies), F.col("__file").eqNullSafe(F.col("__taken")))
    return taken.withColumn("__turn", F.explode(F.sequence(F.lit(1), "__copies"))).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in order of their numbers, written and read back."""
    folder = token_files.write_token_files(as_files(docs), public_tokenizers.path(TOKENIZER))
    return token_files.read_token_files(spark, folder).withColumnRenamed("file", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_target_weights),
    ("token-ID / binary output", token_output),
]

#: Learned scores, hashing and a tokenizer have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
