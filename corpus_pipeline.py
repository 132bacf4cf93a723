"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

``run(spark, sf_dir)`` applies ``STAGES`` to the documents table; every stage is written as
Parquet to the shared scratch folder and read again as the next one's input, so a lost executor
costs a read and not the stages before. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from corpusloom.llm.common import discard, materialise, scratch_dir, scratch_scope


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.5 or more; it learns from this stage's documents.

    A null or empty text is scored as one without words. Repeated rows are judged alike, null ids
    play no part, and labels of absent documents are ignored. Without labels every score is near a
    half; no rows give no rows. The columns of documents stay as they are.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for blanks: the longest original, then the smallest id.

    Null, empty and blank texts are one group. Null ids come last; of rows that repeat id, text
    length and normalised text one stays. No rows give no rows. All columns are kept.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of at least 0.8 on five-word shingles connect: the smallest id, then the smallest text hash.

    Texts that are null, empty or without words are linked to nothing and all stay; null ids come
    last; of rows that repeat id and text one stays. No rows give no rows. All columns are kept.
    """
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark table.

    Null and empty texts hold none, null and empty items are held by none; repeated rows are judged
    alike. Without items all documents stay; no rows give no rows. All columns are kept.
    """
    return decontamination.decontaminate(docs, decontamination.read_items(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed training sequences, as ``op7_cost_balanced_packing`` returns them.

    A null or empty text is its closing id alone; rows that repeat an id are separate documents;
    null ids stay null. No rows give no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can't express the classifier, the forest or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written before the next begins; what a stage wrote on its way, and the rows before it, are deleted then."""
    docs, home = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_dir(spark)
    for name, stage in STAGES:
        with scratch_scope(spark, "stage"):
            kept = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), home)
        discard(spark, docs)
        docs = kept
    return docs
