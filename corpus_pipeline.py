"""The corpus pipeline: documents in, a cleaned and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept:

1. ``toxicity``: fits the CRF to the labelled documents among its input and drops those that score 0.7 or more.
2. ``line_dedup``: takes repeated lines out of the texts; ``n_chars`` follows. No document is dropped.
3. ``near_duplicates``: five-word shingles, Jaccard similarity 0.8; the smallest id of each group stays.
4. ``decontaminate``: drops documents that hold a test item.
5. ``mix``: drops what the source weights leave out; ``copies`` says how often a kept document is taken, ``taken`` how many words that is.

Null and empty texts pass the first four stages. A null id is dropped by none but the first and the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate as benchmark
from ledgerloom.llm import line_dedup as lines
from ledgerloom.llm import mixing, ngram_join
from ledgerloom.llm import toxicity as toxic
from ledgerloom.llm.tables import fold, read, without
from ledgerloom.session import new_path, remove, staging, write_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxic.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxic.score(docs, model).where("score < 0.7").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumns({"text": text, "n_chars": n_chars}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(docs, n=5, num=8, den=10)
    return without(docs, found.where("component <> doc").select(F.col("doc").alias("doc_id")), "doc_id")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = benchmark.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") == 0).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).where("copies > 0")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

# Toxicity and alignment are beyond SQL; tests/llm/test_pipeline.py checks the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with staging(spark):
            write_table(step(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
        if before:  # the stage that read it is written
            remove(spark, before)
        before = path
    return docs
