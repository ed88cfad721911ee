"""Chunks as intervals in a row: against their general form, against Python, and their plans."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from scan import COLUMNS, SCHEMA, table

from loomtext import AtomData, ChunkDelimitedStringify, ChunkOverlap, Chunks, Corpus, EqualTo, FixedSizeChunk, RegexCount, RegexMatchChunk, SimpleStringify, Threshold, TopK, corpus_from_documents, corpus_from_tesseract_documents, corpus_from_tesseract_table
from loomtext.functions import arrays, regex
from loomtext.plans import catalog

SF = "/root/testdata/sf0.001"
TEXTS = ["a  b\n\n c\t", None, "", " \n ", "one", "the 😀 the\nand the é\n\nthe end of the", "x " * 300, "\n".join("w v" for _ in range(200)), "a b c d e f g h i j k l m n o p q r s t u v w x y z"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string").repartition(3)


@pytest.fixture(scope="module")
def spans(docs):
    return corpus_from_documents(docs)


@pytest.fixture(scope="module")
def general(spans):
    """The same corpus by its bridge."""
    out = Corpus(spans.atoms)
    for name, c in spans.chunks.items():
        out.chunks[name] = Chunks(out, c.chunks, c.chunk_atoms)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


KINDS = {
    "document": "document",
    "line": "line",
    "windows": FixedSizeChunk("document", 4, -2),
    "windows of lines": FixedSizeChunk("line", 3, 1, closed="both"),
    "open windows": FixedSizeChunk("document", 2, closed="none"),
    "no windows": FixedSizeChunk("document", 1, closed="none"),
    "windows of windows": FixedSizeChunk(FixedSizeChunk("document", 7, -1), 3, -1, closed="right"),
    "matches": RegexMatchChunk("document", "the|[w-y] "),
}


@pytest.mark.parametrize("kind", list(KINDS))
def test_spans_equal_the_general_form(spans, general, kind):
    exprs = {"s": SimpleStringify("~"), "o": AtomData("ordinal"), "l": AtomData("line"), "i": AtomData("atom"), "n": RegexCount(SimpleStringify(), "e|x"), "d": ChunkDelimitedStringify([("line", "|")], atom_delimiter="_")}
    own, other = spans.chunk(KINDS[kind]), general.chunk(KINDS[kind])
    assert own.spans is not None and other.spans is None
    assert own.chunks.columns == other.chunks.columns
    assert rows(own.chunks) == rows(other.chunks)
    assert rows(own.members().select("_chunk", "text", "ordinal")) == rows(other.members().select("_chunk", "text", "ordinal"))
    assert rows(own.select("id", **exprs)) == rows(other.select("id", **exprs))


@pytest.mark.parametrize("agg", ChunkOverlap.AGGS)
@pytest.mark.parametrize("distinct", [False, True])
def test_overlaps_equal_the_general_form(spans, general, agg, distinct):
    for a, b in (("line", "windows"), ("windows", "line"), ("document", "windows of lines"), ("windows of lines", "windows"), ("matches", "windows"), ("windows", "matches"), ("line", "document")):
        got, want = (rows(c.chunk(KINDS[a]).select("id", x=ChunkOverlap(KINDS[b], agg, distinct), y=ChunkOverlap(KINDS[b], "bool"))) for c in (spans, general))
        assert got == want


def test_filtered_and_enriched_spans(spans, general):
    def run(c):
        lines = c.chunk("line").filter(Threshold("ordinal", "<", 50), EqualTo("document", [0, 5, 7]))
        lines = lines.enrich(n=RegexCount(SimpleStringify(), "the"), w=ChunkOverlap(KINDS["windows"], "count"))
        best = lines.filter(TopK("n", 4))
        inner = c.chunk(FixedSizeChunk("line", 2))
        return [rows(lines.select("id", "n", "w", s=SimpleStringify())), [tuple(r) for r in best.select("id", "n", s=SimpleStringify(), w=ChunkOverlap(KINDS["windows"], "frac")).collect()], rows(best.bridge()), rows(best.members().select("_chunk", "text")), len(best), rows(inner.select("id", s=SimpleStringify()))]

    assert run(spans) == run(general)


def test_windows_of_filtered_chunks(spans, general):
    def run(c):
        some = Corpus(c.atoms)
        some.chunks["few"] = Chunks(some, *(lambda k: (k.chunks, k.bridge()))(c.chunk("line").filter(Threshold("ordinal", ">", 0))))
        return rows(some.chunk(FixedSizeChunk("few", 3)).select("id", s=SimpleStringify()))

    assert run(spans) == run(general)
    again = corpus_from_documents(spans.chunk("document").spans.frame.table.select(F.col("id").alias("doc_id"), F.array_join(F.transform("__words", lambda w: w["text"]), " ").alias("text")))
    again.chunks["line"] = again.chunk("line").filter(Threshold("document", ">", 4))
    assert {r["constraint"]["document"] for r in again.chunk(FixedSizeChunk("line", 3)).chunks.collect()} == {5, 6, 7, 8}


def test_sizes(spans, general, docs):
    assert rows(spans.sizes()) == rows(general.sizes())
    words = [t.split() for t in TEXTS if t]
    words = sum(len(re.findall(r"[^ \t\n]+", t)) for t in TEXTS if t)
    assert dict(map(tuple, spans.sizes().collect())) == {"atoms": words, "document": len(TEXTS), "line": 2 + 1 + 3 + 1 + 200 + 1}
    assert dict(map(tuple, corpus_from_documents(docs.limit(0)).sizes().collect())) == {"atoms": 0, "document": 0, "line": 0}


def test_attributes_that_look_like_hidden_columns(spark):
    docs = spark.createDataFrame([(1, "a b\nc", 5, 6, 7, 8, 9)], "doc_id int, text string, __words int, __lines int, __document int, __place int, __c int")
    c = corpus_from_documents(docs)
    assert tuple(c.chunk("document").select("__words", "__lines", "__document", "__place", "__c", s=SimpleStringify(), o=ChunkOverlap("line", "count")).first()) == (5, 6, 7, 8, 9, "a b c", 3)
    assert rows(c.chunk("line").select("id", s=SimpleStringify())) == [((1, 0), "a b"), ((1, 1), "c")]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    c = corpus_from_documents(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id int, text string"))
    assert rows(c.chunk("document").select("id", s=SimpleStringify())) == [(1, "a"), (1, "b"), (None, "c")]


# Scans


@pytest.fixture(scope="module")
def scans(spark):
    two = table(spark).withColumn("d", F.lit("x")).unionByName(table(spark).withColumn("d", F.lit("y")).filter("level <> 3"))
    nested = two.groupBy("d").agg(F.collect_list(F.struct(*COLUMNS)).alias("rows"))
    odd = spark.createDataFrame([("none", None), ("empty", []), ("null row", [None])], f"d string, rows array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    return corpus_from_tesseract_documents(nested.unionByName(odd), "d", "rows"), corpus_from_tesseract_table(two, document_col="d")


@pytest.mark.parametrize("kind", ["page", "block", "paragraph", "line"])
def test_scans_in_rows_equal_the_table(scans, kind):
    nested, flat = scans
    assert nested.chunk(kind).chunks.columns == flat.chunk(kind).chunks.columns
    exprs = {"s": SimpleStringify(), "c": AtomData("tesseract_coord"), "b": AtomData("left"), "f": AtomData("confidence"), "i": AtomData("id"), "d": ChunkDelimitedStringify([("paragraph", "¶"), ("line", "|")]), "o": ChunkOverlap("block", "count")}
    names = nested.chunk(kind).chunks.columns
    assert rows(nested.chunk(kind).select(*names, **exprs)) == rows(flat.chunk(kind).select(*names, **exprs))
    assert nested.atoms.columns == flat.atoms.columns and rows(nested.atoms) == rows(flat.atoms)
    assert {r["id"] for r in nested.chunk("document").chunks.collect()} == {"x", "y", "none", "empty", "null row"}


def test_sizes_of_scans_need_no_order(scans):
    nested, flat = (c.sizes() for c in scans)
    plan = nested._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and "ArrowEvalPython" not in plan
    # The two corpora name documents apart: those without rows are chunks in one only.
    kinds = lambda df: {r["kind"]: r["n"] for r in df.collect() if r["kind"] != "document"}
    assert kinds(nested) == kinds(flat)


# Arrays


def test_running_sums(spark):
    rng = random.Random(2)
    lists = [[], [5], [1] * 64, [1] * 65, [rng.randint(-9, 9) for _ in range(1000)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<bigint>")
    got = {r["i"]: r["s"] for r in df.select("i", arrays.running_sums(F.col("x")).alias("s")).collect()}
    assert got == {i: [sum(x[: k + 1]) for k in range(len(x))] for i, x in enumerate(lists)}


@pytest.mark.parametrize("at_a_time", [1, 7, 1 << 20])
def test_sweep_against_counting(spark, monkeypatch, at_a_time):
    monkeypatch.setattr(arrays, "PLACES", at_a_time)
    rng = random.Random(3)
    made = []
    for i in range(60):
        n = rng.choice([0, 1, 5, 30])
        some = lambda: [(a, rng.randint(a - 1, n - 1)) for a in (rng.randint(0, n - 1) for _ in range(rng.randint(0, 6)))] if n else []  # noqa: E731, B023
        made.append((i, some(), some(), n))
    df = spark.createDataFrame(made, "i int, a array<struct<a:int,b:int>>, b array<struct<a:int,b:int>>, n int").coalesce(1)
    for distinct in (False, True):
        got = {r["i"]: r for r in df.select("i", *[arrays.covered(F.col("a"), F.col("b"), F.col("n"), g, distinct).alias(g) for g in ("count", "bool", "frac")]).collect()}
        for i, own, other, n in made:
            count = [sum(a <= p <= b for a, b in other) for p in range(n)]
            hits = [[min(1, count[p]) if distinct else count[p] for p in range(a, b + 1)] for a, b in own]
            pairs = [[1 if distinct else max(1, count[p]) for p in range(a, b + 1)] for a, b in own]
            assert got[i]["count"] == [sum(h) for h in hits]
            assert got[i]["bool"] == [sum(h) > 0 for h in hits]
            assert got[i]["frac"] == [sum(h) / sum(p) if p else None for h, p in zip(hits, pairs, strict=True)]


def test_term_counts(spark):
    lists = [["a", "b", "a"], [], None, ["é"] * 3, ["b"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>").coalesce(1)
    got = {r["i"]: {t["term"]: t["tf"] for t in r["c"]} for r in df.select("i", arrays.term_counts(F.col("x")).alias("c")).collect()}
    assert got == {i: dict(Counter(x or [])) for i, x in enumerate(lists)}


# Patterns

PATTERNS = [
    ("the", 0), ("(the|und|les) [a-z]+ing", 0), (r"\w+", 0), (r"\W+", 0), (r"\d+", 0), (r"\D", 0), (r"\s", 0), (r"\S+", 0), (r"\bt\w*", 0), (r"\Be", 0), (r"e\b", 0),
    (".", 0), (".+", 0), (".+", re.S), ("^.+", 0), ("^.+", re.M), (".+$", 0), (".+$", re.M), (r"\A.", 0), (r".\Z", 0), ("[^a-z]+", 0), (r"[\w.]+", 0), (r"[^\w\s]", 0), (r"[^\W_]+", 0), (r"[\W\d]", 0),
    ("(?P<x>a)(?P=x)", 0), (r"(a|b)\1", 0), ("a{2,3}", 0), ("a{2,3}?", 0), ("a++b", 0), ("(?>a+)b", 0), ("(?=t)th", 0), ("(?<!t)he", 0), ("(?<=t)he", 0), ("(?i:T)he", 0), ("(?i)THE", 0), ("STRASSE|ß|ſ|K|İ", re.I), ("[a-k]+", re.I), ("[^k]+", re.I),
    ("straße", re.I), ("σ", re.I), (r"\w", re.A), (r"\b\w", re.A), (r"\s", re.A), ("k", re.I | re.A), ("a b # x", re.X), ("&&", 0), ("[a&&b]", 0), ("[[]", 0), (r"\.|\*", 0), ("😀+", 0), ("[😀-😂]", 0), ("é", 0), ("(ab)+", 0), ("x(?:a|bc){1,2}", 0), ("#", 0), ("-", 0), (r"\\", 0),
]
SAMPLES = ["the und testing thing les going\nThe THE tHe", "", "aab aaab aaaa abab ba aa bb", "a_b 12 ٣٤ ½ Ⅷ ² x.y-z*w\\#", "line\r\nnext sep\x85nel\x0bvt\n", "é É é ß ſ S s K k K İ i ı I σ ς Σ STRASSE straße", "😀😁😂 😀", "  　\x1c\x1f\t", "[a&&b] ab &&", "xabc xaa xbcbc", "\n\n", "end\n", "ǆ ǅ Ǆ ﬁ ﬀ"]


@pytest.mark.parametrize(("pattern", "flags"), PATTERNS)
def test_patterns_mean_the_same(spark, pattern, flags):
    own = regex.native_pattern(pattern, flags)
    assert own is not None
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string").coalesce(1)
    got = {r["i"]: r["m"] for r in df.select("i", F.regexp_extract_all("s", F.lit(own), F.lit(0)).alias("m")).collect()}
    assert got == {i: [m.group() for m in re.finditer(pattern, s, flags)] for i, s in enumerate(SAMPLES)}


@pytest.mark.parametrize("pattern", ["a*", "", "(?=a)", "(a*)+", "(a?)*b", "(x)?(?(1)a|b)", r"(?:(a)\1)+", r"(?i)(a)\1", "a|", r"\b"])
def test_unsafe_patterns_stay_in_python(corpus_of_one, pattern):
    assert regex.native_pattern(pattern) is None
    with pytest.raises(ValueError):
        corpus_of_one.chunk(RegexMatchChunk("document", pattern, engine="native"))
    assert corpus_of_one.chunk("document").select(n=RegexCount(SimpleStringify(), pattern)).first()["n"] == len(re.findall(pattern, "aab 😀 xa"))


@pytest.fixture(scope="module")
def corpus_of_one(spark):
    return corpus_from_documents(spark.createDataFrame([(1, "aab 😀 xa")], "doc_id int, text string"))


def test_word_characters_are_the_same_in_both_engines(spark):
    """All of the plane that texts are written in, but for what one of the two does not know yet."""
    import unicodedata

    points = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "i int, s string").coalesce(1)
    for pattern in (r"\w", r"\d", r"\s"):
        native = {r["i"] for r in df.filter(F.regexp_count("s", F.lit(regex.native_pattern(pattern))) == 1).collect()}
        python = {c for c in points if re.fullmatch(pattern, chr(c))}
        assert len(native ^ python) <= 60 and all(c > 0x600 for c in native ^ python)


@pytest.mark.parametrize("pattern", [catalog.MATCH, r"\b[aeiou]\w+ \w+", "the |, ", "[A-Z]", r" \w+ ", "e", "(?s)the.{0,40}of"])
def test_native_matches_equal_python_on_all_documents(spark, pattern):
    corpus = corpus_from_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    native, python = (corpus.chunk(RegexMatchChunk("document", pattern, engine=e)) for e in ("native", "python"))
    assert native.spans is not None and python.spans is None
    got = rows(native.select("id", "start", "end", s=SimpleStringify()))
    assert got == rows(python.select("id", "start", "end", s=SimpleStringify())) and got


def test_native_matches_inside_lines(spark):
    corpus = corpus_from_documents(spark.createDataFrame([(1, "a the b\nthe the\n\nend the"), (2, "the")], "doc_id int, text string"))
    native, python = (rows(corpus.chunk(RegexMatchChunk("line", "the(?: the)?", engine=e)).select("id", s=SimpleStringify(), o=AtomData("ordinal"))) for e in ("native", "python"))
    assert native == python and len(native) == 4


# Plans


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["stringify_line", "stringify_every_line", "atom_data", "atom_data_every_line", "ocr_pages", "ocr_every_page", "enrich_chain_every_line", "delimited_stringify", "regex_count", "regex_count_ci", "regex_match", "overlap_bool", "overlap_count", "overlap_frac", *[f"fixed_size_{k}" for k in ("tumbling", "overlap", "gap", "right", "both", "none")]])
def test_no_shuffle_and_one_scan(spark, name):
    text = plan(spark, name)
    assert len(re.findall(r"\bExchange ", text)) == 0 and len(re.findall("FileScan parquet", text)) == 1


@pytest.mark.parametrize("name", ["regex_match", "regex_count_ci", "stringify_every_line", "fixed_size_overlap"])
def test_no_python_in_the_plan(spark, name):
    assert not re.search("EvalPython|InArrow|InPandas", plan(spark, name))


def test_retrieval_plan_is_short(spark):
    text = plan(spark, "retrieval")
    assert len(re.findall("FileScan parquet", text)) <= 6 and len(re.findall(r"\bExchange ", text)) <= 8


def test_only_what_is_asked_is_read(spark):
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in plan(spark, "threshold_select") and "GreaterThan(n_chars,1000)" in plan(spark, "threshold_select")


def test_tables_keep_the_order_of_topk(spark):
    got = catalog.queries()["retrieval"](spark, SF).collect()
    assert [tuple(r[:3]) for r in got] == sorted((tuple(r[:3]) for r in got), key=lambda r: (-r[0], r[1], r[2])) and len(got) == 20
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        corpus = corpus_from_documents(spark.read.parquet(f"{SF}/documents.parquet"))
        for best in (corpus.chunk("document").filter(TopK("n_chars", 9)), corpus.chunk("line").enrich(n=RegexCount(SimpleStringify(), "e")).filter(TopK("n", 9, reverse=True))):
            name = "n_chars" if "n_chars" in best.chunks.columns else "n"
            got = [r[name] for r in best.select(name, s=SimpleStringify(), o=ChunkOverlap("line", "count")).collect()]
            assert got == sorted(got, reverse=name == "n_chars") and len(got) == 9
    finally:
        spark.conf.set(conf, before)
