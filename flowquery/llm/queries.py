"""The thin queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquery.llm import alignment, decontaminate, hash_forest, html_text, language_id, near_duplicates, packing, periodic_runs, quality, secret_scan, substring_dedup, token_files, toxicity
from flowquery.llm.common import new_table_path
from flowquery.llm.labelled import held_out
from flowquery.llm.oracles import ORACLE_SQL


__all__ = ["ORACLE_SQL", "QUERIES", "table", "tokenizer_path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    """The model file of the second tokenizer that the alignment's contract names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "token_files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read_documents(spark, path)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placements(packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def op5_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def scored(docs: DataFrame, score: Column, least: float) -> DataFrame:
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, quality.scorer(docs, table(spark, sf_dir, "labels")), 0.3)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, toxicity.scorer(docs, table(spark, sf_dir, "labels")), 0.5)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path(), piece_model_path()
    found = alignment.align(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return alignment.with_corpus_counts(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "n_overlaps", "n_shared", "pairs"), *paths)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_tails(table(spark, sf_dir, "documents")))
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    spelt = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    rows = found.select("*", longest.alias("longest"), F.when(F.size(runs) > 0, F.concat(spelt, F.lit("\n"))).otherwise("").alias("spelt"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div (-longest.period)").alias("exponent_milli"), F.sha2("spelt", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_secret_scan": op2_secret_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_hash_forest": op5_hash_forest,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_html_text": op10_html_text,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language_id": op13_language_id,
}
