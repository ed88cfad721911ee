"""The pipeline: each stage against brute force on what the stage before it kept, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import exact_dedup, jaccard, packing, pipeline, quality, suffix_dedup

from test_operators import ODD, SCHEMA, brute_dedup, brute_links, rows_of

SF = "/root/testdata/sf0.001"


def brute_removed(rows, length=200):
    """The texts without their repeats, characters that would be broken going whole."""
    from collections import Counter

    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for (i, t), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        first = [k for k in range(len(d)) if d[k] & 0xC0 != 0x80] + [len(d)]
        out.append((i, None if t is None else b"".join(d[a:b] for a, b in zip(first, first[1:], strict=False) if not gone[a:b].any()).decode()))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage, as the pipeline writes them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_copies", "suffix_dedup", "packing"]


def test_columns_of_documents(stages):
    for name in ("quality", "exact_dedup", "near_copies", "suffix_dedup"):
        before, after = stages[name]
        assert after.dtypes == before.dtypes


def test_quality_drops_what_it_rejects(spark, stages):
    before, after = stages["quality"]
    model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r["doc_id"] for r in quality.classify(before, model).collect() if r["predicted"]}
    assert {r["doc_id"] for r in after.collect()} == keep and 0 < len(keep) < before.count()


def test_exact_copies_go(stages):
    before, after = stages["exact_dedup"]
    assert sorted(rows_of(after), key=repr) == sorted(((i, t) for i, t in rows_of(before) if (i, True) in {(r[0], r[3]) for r in brute_dedup(rows_of(before))}), key=repr)


def test_near_copies_go(stages):
    before, after = stages["near_copies"]
    want = {i for i, _, c in brute_links(rows_of(before), 5, 80) if i == c}
    got = [r["doc_id"] for r in after.collect()]
    assert set(got) == want and len(got) == len(want)


def test_repeats_go(stages):
    before, after = stages["suffix_dedup"]
    assert sorted(rows_of(after)) == sorted(brute_removed(rows_of(before)))


def test_packing_takes_every_token(stages):
    import public_tokenizers
    import tokenizers

    before, after = stages["packing"]
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {i: len(own.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows_of(before)}
    got = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want
    full = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 1024 for r in full)


def test_run_is_its_stages(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF).select(key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages["packing"][1].select(key).collect()))
    assert pipeline.ORACLE_SQL is None


def test_odd_rows_and_clashing_columns(spark):
    odd = spark.createDataFrame([*ODD, (18, "Copy  twice", "y", 2), (19, "Copytwice", "y", 2)], SCHEMA)
    clashing = odd.withColumnsRenamed({"batch": "_digest", "n": "_in_1"}).withColumns({c: F.lit(1) for c in ("id", "sha", "tkey", "n_chars", "_text", "set", "_sub", "_file", "node")})
    for docs in (clashing, clashing.limit(0)):
        for step in (exact_dedup.deduplicate, jaccard.keep_one, suffix_dedup.remove):
            got = step(docs)
            assert got.columns == docs.columns and got.count() <= docs.count()
    assert exact_dedup.deduplicate(clashing).filter("doc_id IN (18, 19)").select("doc_id").collect() == [(18,)]
    items = clashing.select("_sub", "_file", "_text", F.lit(7).cast("long").alias("_rank"), F.lit(5).cast("long").alias("length"), F.lit(0).alias("offset"))
    packed = packing.pack(items)
    assert packed.columns == ["_sub", "_file", "_text", "_rank", "length", "sequence_id", "offset"] and packed.count() == items.count()


def test_ids_of_other_types(spark):
    rows = [("b", "a b c"), ("a", "a bc"), (None, "abc"), ("c", "other words here"), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.mark(docs).collect()}
    assert got == {("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("c", "c", 1, True)}
    assert {(r["doc_id"], r["text"]) for r in exact_dedup.deduplicate(docs).collect()} == {("b", "a b c"), ("c", "other words here"), ("c", None)}


def test_repeats_of_many_copies_grow_with_the_copies(spark):
    """Copies of a text beside a hot anchor are one text: 300 of them give as many runs as 3."""
    import random

    rng = random.Random(2)
    line = "".join(rng.choice("abcdef ") for _ in range(230))
    others = [(1000 + i, "".join(rng.choice("xyz") for _ in range(60)) + line + "".join(rng.choice("uvw") for _ in range(60))) for i in range(12)]
    text = "start " * 3 + line + " and the end of the copied text " * 2

    def removed(copies):
        docs = spark.createDataFrame([(i, text) for i in range(copies)] + others, "doc_id bigint, text string")
        assert suffix_dedup.repeated(docs, hot=3).selectExpr("sum(size(a))").first()[0] < 400
        return {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digests(docs, hot=3).collect()}

    few, many = removed(3), removed(300)
    assert {k: v for k, v in many.items() if k in few} == few and many[299] == len(text)
