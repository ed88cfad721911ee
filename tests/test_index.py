"""The index of terms: equal to brute force, and its scans read the queries' terms only."""

import math
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext import SimpleStringify, TermIndex, Tfidf, corpus_from_documents
from loomtext.functions import index
from loomtext.sources.store import scratch

TEXTS = ["aa bb bb", None, "", "aa cc É é", "the dd the aa", "bb " * 40 + "cc", "x y", "aa bb bb"]
QUERIES = {0: "aa", 1: "bb cc cc", 2: "", 3: None, 4: "nothing here", 5: "é the aa"}


def chunks_of(spark, texts=TEXTS):
    return corpus_from_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")).chunk("document")


def built(spark, chunks, **options):
    expr = Tfidf(SimpleStringify(), "", **options)
    return TermIndex.build(chunks.select("id", value=expr.stringifier), scratch(spark, "test"), expr)


def asked(spark, queries=QUERIES):
    return spark.createDataFrame(list(queries.items()), "query_id int, value string")


def brute(texts, queries, min_df=1, norm="l2", sublinear_tf=False):
    analyze = Tfidf(SimpleStringify(), "").analyze
    terms = [Counter(analyze(t or "")) for t in texts]
    df = Counter(t for own in terms for t in own)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items() if n >= min_df}

    def vector(counts):
        own = {t: (1 + math.log(n) if sublinear_tf else n) * idf[t] for t, n in counts.items() if t in idf}
        size = sum(map(abs, own.values())) if norm == "l1" else math.sqrt(sum(x * x for x in own.values()))
        return {t: x / size for t, x in own.items()}

    vectors, out = [vector(t) for t in terms], {}
    for i, q in queries.items():
        asked = vector(Counter(analyze(q or "")))
        for j, own in enumerate(vectors):
            if dot := sum(x * own.get(t, 0) for t, x in asked.items()):
                out[i, j] = round(dot, 9)
    return out


@pytest.mark.parametrize(("options", "small"), [({}, False), ({"norm": "l1", "sublinear_tf": True, "min_df": 2}, True)])
def test_scores_equal_brute_force(spark, monkeypatch, options, small):
    if small:  # all terms are hot, and none is looked up by broadcast
        monkeypatch.setattr(index, "HOT", 1)
        monkeypatch.setattr(index, "FREQUENT", 1)
        monkeypatch.setattr(index, "ASKED", 0)
    chunks = chunks_of(spark)
    got = {(r["query_id"], r["id"]): round(r["value"], 9) for r in built(spark, chunks, **options).scores(asked(spark)).collect() if r["value"]}
    assert got == brute(TEXTS, QUERIES, **options)


def test_queries_read_their_parts_only(spark):
    made = built(spark, chunks_of(spark))
    parts = {r[0] for r in spark.createDataFrame([("aa",)], "t string").select(index._part(F.col("t"))).collect()}
    df = made.scores(asked(spark, {0: "aa"}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and f"= {parts.pop()})" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,aa)" in plan


def test_an_empty_index_and_no_queries(spark):
    assert built(spark, chunks_of(spark)).scores(asked(spark, {2: ""})).count() == 0
    made = built(spark, chunks_of(spark, ["", None]))
    assert made.postings().count() == 0 and made.scores(asked(spark)).count() == 0


def test_max_features_is_refused(spark):
    with pytest.raises(ValueError, match="max_features"):
        built(spark, chunks_of(spark), max_features=2)


def test_texts_are_taken_apart_once(spark, tmp_path):
    seen = tmp_path / "seen"

    def words(text):
        with open(seen, "a") as f:
            f.write(".")
        return text.split()

    index = built(spark, chunks_of(spark), tokenizer=words)
    assert len(seen.read_text()) == len(TEXTS)
    assert {p.name for p in Path(index.path.removeprefix("file:")).iterdir() if p.is_dir()} == {"terms", "postings", "lengths"}
