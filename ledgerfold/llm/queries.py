"""Thin steps from the given tables to the operators' records and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import decontaminate, infill, language, licences, line_copies, mixing, near_copies, phrases, quality, repeats, rules, token_files, toxic_spans
from ledgerfold.llm.records import SPACES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("file"), "text")


def fold(n: int) -> Column:
    """crc32 of the decimal document number, by ``n``."""
    return F.crc32(F.col("file").cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text", "lang")
    found = language.detect_languages(documents, documents.filter(fold(3) != 1))
    return found.select(F.col("file").alias("doc_id"), (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def n_words() -> Column:
    """Words of a text: runs of anything but white space."""
    return F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("bigint")


def op2_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("municipality"), n_words().alias("units"))
    mixed = mixing.balance_rows(rows)
    return mixed.select(
        F.col("file").alias("doc_id"), F.col("units").alias("size"), F.col("municipality_units").alias("source_size"), "target", F.col("units_taken").alias("taken"), "copies", "rate"
    )


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = licences.find_licences(as_files(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["line_no"], x["n_lines"], x["licence"])), ",")
    best = F.round(F.array_max(F.transform("found", lambda x: x["dice"])), 6)
    return told.select(F.col("file").alias("doc_id"), F.array_join("licences", ",").alias("licences"), lines.alias("found"), best.alias("best_dice"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = repeats.remove_repeats(as_files(table(spark, sf_dir, "documents")))
    return told.select(F.col("file").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge_files(as_files(table(spark, sf_dir, "documents")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(F.col("file").alias("doc_id"), *counts, "base_failed", "kept", "p_good")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = as_files(table(spark, sf_dir, "documents"))
    rated = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), "quality").filter(fold(5) != 0)
    scored = quality.score_files(files, rated)
    return scored.select(F.col("file").alias("doc_id"), (fold(5) == 0).alias("held_out"), "score", F.when(quality.keep_good(scored), 1).otherwise(0).alias("predicted"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies.near_copies(as_files(table(spark, sf_dir, "documents")), width=2)
    return found.withColumnRenamed("file", "doc_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_copies.drop_line_copies(as_files(table(spark, sf_dir, "documents")))
    return kept.select(F.col("file").alias("doc_id"), "n_lines", F.size("removed").alias("n_removed"), F.col("removed").alias("removed_lines"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    found = decontaminate.find_items(as_files(table(spark, sf_dir, "documents")), items)
    return found.select(F.col("file").alias("doc_id"), F.col("found.item").alias("item_ids"), F.array_min("found.edits").alias("least_edits"), (~F.col("clean")).alias("contaminated"))


def op10_token_files(spark: SparkSession, sf_dir: str, name: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    folder = token_files.write_token_files(as_files(table(spark, sf_dir, "documents")), public_tokenizers.path(name))
    return token_files.read_token_files(spark, folder).withColumnRenamed("file", "doc_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = infill.restore_files(infill.infill_files(as_files(table(spark, sf_dir, "documents"))))
    return turned.select(
        F.col("file").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256")
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = phrases.mine_phrases(table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), "text"))
    return mined.withColumnRenamed("kind", "lang")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), "toxic").filter(fold(5) != 0)
    tagged = toxic_spans.tag_files(as_files(table(spark, sf_dir, "documents")), rated)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return tagged.select(F.col("file").alias("doc_id"), (fold(5) == 0).alias("held_out"), "score", predicted.alias("predicted"), "spans")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mixing_to_target_weights": op2_mixing_to_target_weights,
    "op3_license_scans": op3_license_scans,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_token_files": op10_token_files,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_toxicity": op13_toxicity,
}
