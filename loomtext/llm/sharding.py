"""Rendezvous sharding over weighted shards.

Each shard scores a record's key with a hash of (key, shard); the smallest
``-ln(u) / weight`` wins, so a shard receives its weight's part of the keys and
adding a shard takes records only into the new one.  The placement is a pure
function of key and shard list: no state, no shuffle.

``slot`` numbers the records of a shard gaplessly from 0.  Rows are first
collapsed to distinct (key, size, checksum) with a count, dealt to sub-buckets
of bounded size, numbered inside those, and shifted by the sub-buckets' running
totals; no task ever sees a whole shard.  A null key is a key like any other; a
null text has no bytes and the checksum of the empty text.  Repeated rows get
slots of their own.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, documents, text_of

N_SHARDS = 40
#: Distinct rows that are numbered together.
SUB_ROWS = 100_000


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))


def choose(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, shard) of the shard that wins the key."""
    scores = [_score(key, first + i, w) for i, w in enumerate(weights)]
    return scores[0] if len(scores) == 1 else F.least(*scores)


def assign(docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id", text_col: str = "text", grown_by: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of weight ``grown_by``)."""
    work = Workspace(docs.sparkSession, "sharding")
    text = text_of(text_col)
    rows = docs.select(F.col(key_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("won", choose(F.col("doc_id"), weights)).withColumn("grown", F.least("won", _score(F.col("doc_id"), len(weights), grown_by)))
    rows = work.save(rows.select("doc_id", "size", "text_crc32", "copies", F.col("won.shard").alias("shard"), F.col("grown.shard").alias("grown_shard")), "rows")
    subs = max(1, -(-rows.count() // (SUB_ROWS * len(weights))))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("text_crc32", "size", "doc_id"), F.lit(subs)))
    totals = rows.groupBy("shard", "sub").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "sub").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(totals, ["shard", "sub"])
    return rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("start") + F.col("n")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key_col: str = "doc_id", files_per_shard: int = 1) -> None:
    """Write ``docs`` under ``path/shard=i/``; a shard is split over ``files_per_shard`` tasks by key."""
    part = F.pmod(F.xxhash64(F.lit("file"), F.col(key_col)), F.lit(files_per_shard))
    docs.withColumn("shard", choose(F.col(key_col), weights).getField("shard")).repartition(len(weights) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir), [1.0] * N_SHARDS)
