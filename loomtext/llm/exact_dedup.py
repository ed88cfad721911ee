"""Exact deduplication against immutable snapshots.

Each snapshot is a table of distinct digests split into buckets by digest, with
one static binary-fuse filter per bucket.  A new batch is first grouped by
digest on its own (new-batch duplicates); the group's digests are then screened
by the filters of each snapshot, and only the positives are joined with the
exact buckets, where normalised texts are compared byte by byte.  Of the texts
only those of the rows that stand for a positive move: the others are screened
out where they lie, by filters over the positives (see ``screen``).

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]`` is
deleted.  Null texts count as empty.  Of equal texts the row with the most code
points in the original text stays, then the smallest id (of any type that has an
order); a null id comes last.  Rows repeated with the same id and length are told apart by a counter, so that
exactly one row of a group is kept.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, lean, text_of
from .screen import BUCKET_ROWS, BinaryFuse, split_by

WHITE = " \t\n\x0b\x0c\r"


def normalised(column: str = "text"):
    return F.translate(text_of(column), WHITE, "")


def _key64(hashes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in hashes.to_pylist()), np.uint64)


def group_batch(rows: DataFrame) -> DataFrame:
    """New-batch duplicates: a row for each digest with the row that stays and the group's size.

    ``best`` is ordered so that its minimum has most code points, then the smallest id.
    """
    return rows.groupBy("sha").agg(F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), "id")).alias("best"), F.count(F.lit(1)).alias("size"))


def _is(best: str):
    """Whether a row (id, n_chars) is the one that ``best`` names."""
    return (-F.col("n_chars") == F.col(f"{best}.less")) & F.col("id").eqNullSafe(F.col(f"{best}.id"))


def _place(id_col, n_chars):
    """A cheap hash that names a row well enough to screen by."""
    return F.xxhash64(id_col, n_chars.cast("long"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("sha"), F.lit(buckets)).cast("int").alias("bucket")


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One static filter per bucket of an immutable snapshot: (bucket, filter)."""

    def build(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": table["bucket"][:1], "filter": pa.array([BinaryFuse.build(_key64(table["sha"])).to_bytes()], pa.binary())})

    return snapshot.select("sha", _bucket(buckets)).groupBy("bucket").applyInArrow(lean(build), "bucket int, filter binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of ``batch`` that the snapshot may hold: its filters let no member pass unseen."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return left.select(["sha"]).slice(0, 0)
        return left.select(["sha"]).filter(pa.array(BinaryFuse.from_bytes(right["filter"][0].as_py()).contains(_key64(left["sha"]))))

    return batch.select("sha", _bucket(buckets)).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(lean(probe), "sha binary")


def resolve(docs: DataFrame, batch_col, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): ``docs`` taken in as two batches, the first as the immutable snapshot.

    rows: batch, id, n_chars, sha of each row.  classes: batch, sha, best, size, where groups of
    both batches whose normalised bytes are equal have the same best and size.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact-dedup")
    rows = work.save(_rows(docs, batch_col, id_col, text_col), "rows")
    snapshot = work.save(group_batch(rows.filter("batch = 0")), "snapshot")
    incoming = work.save(group_batch(rows.filter("batch = 1")), "incoming")
    buckets = max(1, -(-max(snapshot.count(), incoming.count()) // BUCKET_ROWS))
    filters = work.save(build_filters(snapshot, buckets), "filters")
    maybe = screen(incoming, filters, buckets)
    # Exact buckets: digests equal, then the normalised bytes themselves.
    held = work.save(maybe.join(snapshot.select("sha", F.col("best").alias("old"), F.col("size").alias("old_size")), "sha").join(incoming.select("sha", F.col("best").alias("new"), F.col("size").alias("new_size")), "sha"), "positives")
    rep = lambda c: held.select(_place(F.col(f"{c}.id"), -F.col(f"{c}.less")).alias("place"))
    mine = docs.select(batch_col.cast("int").alias("batch"), F.col(id_col).alias("id"), F.length(text_of(text_col)).alias("n_chars"), text_of(text_col).alias("text"))
    _, mine = split_by(mine, _place(F.col("id"), F.col("n_chars")), rep("old").unionByName(rep("new")))
    side = F.when((F.col("batch") == 0) & _is("old"), 0).when((F.col("batch") == 1) & _is("new"), 1)
    whole = mine.select("batch", "id", "n_chars", normalised("text").alias("norm"), _sha("text").alias("sha")).join(held.select("sha", "old", "new"), "sha").select("sha", "norm", side.alias("side")).filter("side is not null")
    same = whole.groupBy("sha").agg(F.min(F.when(F.col("side") == 0, F.col("norm"))).alias("a"), F.min(F.when(F.col("side") == 1, F.col("norm"))).alias("b")).filter(F.col("a") == F.col("b")).select("sha")
    both = held.join(same, "sha").select("sha", F.least("old", "new").alias("m_best"), (F.col("old_size") + F.col("new_size")).alias("m_size"))
    both = work.save(both, "merged")
    classes = snapshot.withColumn("batch", F.lit(0)).unionByName(incoming.withColumn("batch", F.lit(1))).join(both, "sha", "left").select("batch", "sha", F.coalesce("m_best", "best").alias("best"), F.coalesce("m_size", "size").alias("size"))
    return rows, classes


def _sha(column: str):
    return F.unhex(F.sha2(normalised(column), 256))


def _rows(docs: DataFrame, batch_col, id_col: str, text_col: str) -> DataFrame:
    return docs.select(batch_col.cast("int").alias("batch"), F.col(id_col).alias("id"), F.length(text_of(text_col)).alias("n_chars"), _sha(text_col).alias("sha"))


def halves(id_col: str = "doc_id"):
    """The batch of a row: half of the ids make the snapshot, the others come after it."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(2))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, classes = resolve(docs, halves(id_col), id_col, text_col)
    copies = rows.groupBy("batch", "sha", "id", "n_chars").agg(F.count(F.lit(1)).alias("copies"))
    stays = (F.col("n") == 0) & _is("best")
    return copies.join(classes, ["batch", "sha"]).withColumn("n", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).select(F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``, whatever their names.

    Rows that are surely alone in their group stay where they lie; the others are joined with
    the groups.
    """
    rows, classes = resolve(docs, halves(id_col), id_col, text_col)
    classes = Workspace(docs.sparkSession, "exact-dedup-classes").save(classes, "classes")
    several = rows.join(classes.filter("size > 1").select("batch", "sha"), ["batch", "sha"], "left_semi").select(_place(F.col("id"), F.col("n_chars")).alias("place")).distinct()
    mine = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    told = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()]).withColumn("n_chars", F.length(text_of(mine[text_col])))
    alone, others = split_by(told, _place(F.col(mine[id_col]), F.col("n_chars")), several)
    kept = classes.select(F.col("sha").alias("_sha"), F.col("best").alias("_best")).distinct()
    others = others.withColumn("_sha", _sha(mine[text_col])).join(kept, "_sha").withColumn("id", F.col(mine[id_col])).filter(_is("_best")).dropDuplicates(["_sha", "_best"])
    back = lambda df: df.select(*[F.col(n).alias(c) for c, n in mine.items()])
    return back(others) if alone is None else back(alone).unionByName(back(others))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
"""
