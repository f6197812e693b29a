"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them again, so a lost executor
never sends the work back beyond the stage it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquery.llm import decontaminate, near_duplicates, packing, quality, secret_scan
from flowquery.llm.common import materialize
from flowquery.llm.queries import table, tokenizer_path

LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is LEAST_QUALITY or more."""
    return docs.where(quality.scorer(docs, table(spark, sf_dir, "labels")) >= LEAST_QUALITY)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return near_duplicates.one_of_each(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the secrets' kinds."""
    own = docs.withColumnRenamed("spans", "__own_spans")  # the caller's, if there is one
    found = secret_scan.find_secrets(own).withColumn("text", secret_scan.redact(F.col("text"), F.col("spans"))).drop("spans").withColumnRenamed("__own_spans", "spans")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed token sequences, each with the documents in it."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", keep_clean),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL cannot express the classifier and the packing; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
