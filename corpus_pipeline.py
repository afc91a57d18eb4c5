"""The corpus pipeline: five stages over documents, each one of the operators of blockloom.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.
Empty tables pass through; columns beyond those of documents are carried along, whatever their names, up to the last stage.
Null texts count as empty, rows without id as the last of all; rows that repeat both id and text become one in near_dedup.
Very long texts are scored, compared, cut and packed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import op1_simhash, op2_packing, op4_toxicity, op5_quality, op7_suffix_dedup
from blockloom.llm.common import bound_batches, fresh, stash, table

#: Pre-tokens that a worker keeps while packing; after four stages its memory is no longer all free.
CACHE_ENTRIES = 250_000
#: Bytes of one Arrow batch: what executors and workers hold of a stage's batches adds to what earlier stages left with them.
BATCH_BYTES = 2 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the cut of their language go."""
    bound_batches(spark, BATCH_BYTES)
    model = op4_toxicity.train(docs, table(spark, sf_dir, "labels"), op4_toxicity.learns)
    score, cut = fresh(docs, "score"), fresh(docs, "cut")
    return op4_toxicity.score(docs, model, out=(score, cut)).where(F.col(score) < F.col(cut)).drop(score, cut)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the cut go."""
    bound_batches(spark, BATCH_BYTES)
    model = op5_quality.train(docs, table(spark, sf_dir, "labels"), op5_quality.learns)
    if model is None:
        return docs
    score = fresh(docs, "score")
    return op5_quality.score(docs, model, out=score).where(F.col(score) >= op5_quality.AT).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash links and shared MinHash bands, checked for a similarity of 0.8 or more on shingles of five words."""
    bound_batches(spark, BATCH_BYTES)
    return op1_simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that start in an earlier document are cut out; n_chars follows the text."""
    bound_batches(spark, BATCH_BYTES)
    kept = op7_suffix_dedup.remove_repeats(docs, with_digests=False)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    bound_batches(spark, BATCH_BYTES)
    return op2_packing.pack_documents(docs, cache_entries=CACHE_ENTRIES)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]
#: Learnt classifiers and tokenisers are not SQL: tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
