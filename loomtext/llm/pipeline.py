"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``, whatever their names besides ``doc_id`` and ``text``.  ``run``
writes each stage's rows as Parquet under the shared folder, rereads them as the next
one's docs, and deletes them when the application ends.

Null and empty texts: the classifier scores them like any other; those that it keeps are
exact copies of each other, of which one stays; they have no shingles and lose nothing to
the fourth stage; in packing they are a piece of the end id alone.  Very long texts are
never cut before packing.  Repeated rows are exact copies.  A null id is an id like any
other, and comes last where the smallest stays.  Without usable labels the classifier
gives all rows the same score, 0.5 where there are none, and keeps them.  Empty tables
give empty tables at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, jaccard, packing, quality, suffix_dedup
from .common import Workspace, documents


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least 0.5; it learns from the labels of the raw documents."""
    return quality.keep(docs, quality.fit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of five-word shingles at a similarity of 0.8."""
    return jaccard.keep_one(docs, words=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that start elsewhere too."""
    return suffix_dedup.remove(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences of 1024."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality", classify_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("suffix_dedup", remove_repeats),
    ("packing", pack_sequences),
]

#: No SQL states the classifier or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
