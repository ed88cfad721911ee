"""Expected results on two scanned pages, and on hand-built corpora."""

import re

import pytest
from pyspark.sql import functions as F
from scan import table

from loomtext import AtomData, AttrExpr, ChunkDelimitedStringify, ChunkExpr, ChunkFilter, ChunkOverlap, Chunks, Corpus, EqualTo, FixedSizeChunk, RegexCount, RegexMatchChunk, SimpleStringify, Tfidf, Threshold, TopK, corpus_from_documents, corpus_from_tesseract_table


@pytest.fixture(scope="module")
def corpus(spark):
    return corpus_from_tesseract_table(table(spark).repartition(3), "abc123")


@pytest.fixture(scope="module")
def merged(spark, corpus):
    return Corpus.merge([corpus, corpus_from_tesseract_table(table(spark), "def456")])


def column(df, name="t", by=None):
    rows = df.collect()
    return [r[name] for r in (sorted(rows, key=lambda r: r[by]) if by else rows)]


def sizes(c):
    return {k: len(c.chunk(k)) for k in ("document", "page", "block", "paragraph", "line")}


def test_levels(corpus):
    assert corpus.atoms.count() == 18
    assert sizes(corpus) == {"document": 1, "page": 2, "block": 2, "paragraph": 4, "line": 8}
    assert corpus.atoms.columns == ["left", "top", "width", "height", "text", "confidence", "ordinal", "id", "tesseract_coord", "document"]
    assert corpus.chunk("page").chunks.columns == ["document", "width", "height", "ordinal", "id"]
    assert corpus.chunk("line").chunks.columns == ["paragraph", "left", "top", "width", "height", "ordinal", "id"]


def test_original_numbers_stay_with_the_words(corpus):
    r = corpus.atoms.filter("ordinal = 18").first()
    assert (r["text"], tuple(r["tesseract_coord"])) == ("fox", (2, 1, 2, 2, 2))


def test_merge(merged):
    assert merged.atoms.count() == 36
    assert sizes(merged) == {"document": 2, "page": 4, "block": 4, "paragraph": 8, "line": 16}
    assert sorted(column(merged.chunk("document").select("id"), "id")) == ["abc123", "def456"]


def test_many_documents_at_once(spark):
    both = table(spark).withColumn("d", F.lit("x")).unionByName(table(spark).withColumn("d", F.lit("y")))
    c = corpus_from_tesseract_table(both, document_col="d")
    assert c.atoms.count() == 36 and sizes(c)["line"] == 16
    assert c.chunk("line").select("ordinal").distinct().count() == 8


def test_missing_level_gives_no_chunks(spark):
    c = corpus_from_tesseract_table(table(spark).filter("level <> 3"), "a")
    assert len(c.chunk("paragraph")) == 0 and len(c.chunk("line")) == 8
    with pytest.raises(ValueError):
        corpus_from_tesseract_table(table(spark))


def test_select_names_aliases_and_expressions(corpus):
    t = corpus.chunk("page").select("ordinal", o="ordinal", t=SimpleStringify(""))
    assert t.columns == ["ordinal", "o", "t"]
    assert sorted(map(tuple, t.collect())) == [(1, 1, "The(quick)[brown]foxjumps!Overthe<lazy>dog"), (2, 2, "The~groovyminute!dogboundsUPONthesleepyfox")]
    with pytest.raises(KeyError):
        corpus.chunk("page").select("nothing")


def test_first_query_of_the_docs(corpus):
    assert sorted(column(corpus.chunk("line").filter(Threshold("ordinal", "<=", 2)).select(t=SimpleStringify()))) == ["The (quick)", "[brown] fox jumps!"]


def test_ranked_query(corpus):
    best = corpus.chunk(FixedSizeChunk("page", 64, offset=-32)).enrich(tfidf=Tfidf(SimpleStringify(), query="brown fox")).filter(TopK("tfidf", 3))
    rows = best.select("tfidf", t=SimpleStringify()).collect()
    assert len(rows) == 2 and max(rows, key=lambda r: r["tfidf"])["t"].startswith("The (quick) [brown]")


def test_fixed_size(corpus):
    windows = corpus.chunk(FixedSizeChunk("document", 8, -2))
    assert sorted((r["start"], len(r["a"])) for r in windows.select("start", a=AtomData("id")).collect()) == [(1, 8), (7, 8), (13, 6)]
    assert len(corpus.chunk(FixedSizeChunk("line", 3, -1))) == 10


@pytest.mark.parametrize(("size", "offset"), [(3, 0), (3, -1), (3, 2), (1, 0), (5, -4)])
@pytest.mark.parametrize("closed", ["left", "right", "both", "none"])
def test_fixed_size_against_the_definition(spark, size, offset, closed):
    ordinals = [4, 5, 6, 9, 15, 16, 16, None, 30]
    atoms = spark.createDataFrame([(i, o) for i, o in enumerate(ordinals)], "id bigint, ordinal bigint")
    c = Corpus(atoms)
    c.set_chunk("d", Chunks(c, atoms.sparkSession.createDataFrame([(1,)], "id bigint"), atoms.select(F.lit(1).cast("long").alias("chunk"), F.col("id").alias("atom"))))
    got = {r["start"]: sorted(r["a"]) for r in c.chunk(FixedSizeChunk("d", size, offset, closed=closed)).select("start", a=AtomData("id")).collect()}
    want = {}
    for k in range(4, 31, size + offset):
        inside = [i for i, o in enumerate(ordinals) if o is not None and (k <= o if closed in ("left", "both") else k < o) and (o <= k + size if closed in ("right", "both") else o < k + size)]
        if inside:
            want[k] = inside
    assert got == want
    c.unpersist("d")


def test_fixed_size_arguments(corpus):
    for bad in ({"size": 0}, {"size": 3, "offset": -3}, {"size": 3, "closed": "up"}):
        with pytest.raises(ValueError):
            FixedSizeChunk("line", **bad)
    with pytest.raises(KeyError):
        corpus.chunk(FixedSizeChunk("nothing", 3))
    with pytest.raises(KeyError):
        Corpus(corpus.atoms.drop("ordinal")).chunk(FixedSizeChunk("line", 3))


def test_regex_match(corpus, merged):
    match = RegexMatchChunk("document", "Over the <lazy>")
    assert column(corpus.chunk(match).select(t=SimpleStringify())) == ["Over the <lazy>"]
    assert column(merged.chunk(match).select(t=SimpleStringify())) == ["Over the <lazy>"] * 2
    assert len(corpus.chunk(RegexMatchChunk("line", "Over the <lazy>"))) == 0
    r = corpus.chunk(match).chunks.first()
    assert (r["start"], r["end"]) == (31, 46)


@pytest.mark.parametrize(("pattern", "texts"), [("he <lazy>", ["<lazy>"]), ("az", []), ("the ", ["the <lazy>"]), ("(?=dog)", ["dog"]), (r"\bO", ["Over"])])
def test_regex_membership(corpus, pattern, texts):
    page = corpus.chunk("page").filter(EqualTo("ordinal", [1]))
    c = Corpus(corpus.atoms)
    c.chunks["p"] = Chunks(c, page.chunks, page.bridge())
    assert sorted(column(c.chunk(RegexMatchChunk("p", pattern)).select(t=SimpleStringify()))) == texts


def test_tfidf(corpus):
    assert column(corpus.chunk("page").select(t=Tfidf(SimpleStringify(), "the"))) == pytest.approx([0.5019383882729199] * 2)


def test_tfidf_edges(corpus, spark):
    pages = corpus.chunk("page")
    assert column(pages.select(t=Tfidf(SimpleStringify(), ""))) == [0.0, 0.0]
    assert column(pages.select(t=Tfidf(SimpleStringify(), "unheard"))) == [0.0, 0.0]
    assert len(set(column(pages.select(t=Tfidf(SimpleStringify(), "brown", analyzer="char_wb", ngram_range=(2, 3)))))) == 2
    for bad, error in (({"dtype": int}, TypeError), ({"stop_words": "english"}, ValueError), ({"norm": "l3"}, ValueError), ({"ngram_range": (2, 1)}, ValueError)):
        with pytest.raises(error):
            Tfidf(SimpleStringify(), "x", **bad)
    docs = corpus_from_documents(spark.createDataFrame([(1, "aa bb"), (2, None), (3, "x")], "doc_id bigint, text string"))
    assert sorted(map(tuple, docs.chunk("document").select("id", s=Tfidf(SimpleStringify(), "aa")).collect())) == [(1, pytest.approx(0.7071, abs=1e-3)), (2, 0.0), (3, 0.0)]


@pytest.mark.parametrize("options", [{"ngram_range": (1, 2)}, {"binary": True}, {"max_features": 3}, {"vocabulary": ["the", "fox"]}, {"use_idf": False}, {"norm": None}, {"max_df": 1}, {"min_df": 0.9}, {"lowercase": False}])
def test_tfidf_native_analysis_equals_python(corpus, options):
    native = corpus.chunk("line").select("ordinal", t=Tfidf(SimpleStringify(), "the fox dog", **options))
    python = corpus.chunk("line").select("ordinal", t=Tfidf(SimpleStringify(), "the fox dog", tokenizer=re.compile(r"\b\w\w+\b").findall, **options))
    assert column(native, by="ordinal") == pytest.approx(column(python, by="ordinal"))


def test_atom_data(corpus):
    t = corpus.chunk("line").filter(Threshold("ordinal", "<=", 2)).select("ordinal", d=AtomData("document"), a=AtomData("text"))
    assert column(t, "d", "ordinal") == [["abc123"] * 2, ["abc123"] * 3]
    assert column(t, "a", "ordinal")[0] == ["The", "(quick)"]
    with pytest.raises(KeyError):
        corpus.chunk("line").select(x=AtomData("nothing"))


def test_regex_count(corpus):
    for args, want in ((("o",), [3, 5]), (("(?i)o",), [4, 6]), (("o", re.IGNORECASE), [4, 6]), ((r"\w+(?=!)",), [1, 1])):
        for engine in ("auto", "python"):
            assert column(corpus.chunk("page").select("ordinal", t=RegexCount(SimpleStringify(), *args, engine=engine)), by="ordinal") == want
    assert column(corpus.chunk("page").select("ordinal", t=RegexCount(ChunkDelimitedStringify([("line", "o")]), "o")), by="ordinal") == [6, 8]


def test_overlap(corpus):
    lines, match = corpus.chunk("line"), RegexMatchChunk("document", "Over the <lazy>")
    for agg, want in (("count", [0, 0, 2, 1, 0, 0, 0, 0]), ("bool", [False, False, True, True, False, False, False, False]), ("frac", [0, 0, 1, 0.5, 0, 0, 0, 0])):
        assert column(lines.select("ordinal", t=ChunkOverlap(match, agg)), by="ordinal") == want
    with pytest.raises(ValueError):
        ChunkOverlap("line", "most")


def test_overlap_after_filters_and_with_overlapping_chunks(corpus):
    lines = corpus.chunk("line").filter(TopK("width", 8), Threshold("ordinal", ">", 6))
    assert column(lines.select("ordinal", t=ChunkOverlap("page", "count")), by="ordinal") == [2, 2]
    page = corpus.chunk("page").filter(EqualTo("ordinal", [1]))
    both = FixedSizeChunk("document", 4, -2)
    assert column(page.select(t=ChunkOverlap(both, "count"))) == [16]
    assert column(page.select(t=ChunkOverlap(both, "count", distinct=True))) == [9]


def test_stringify(corpus):
    want = ["The?(quick)?[brown]?fox?jumps!?Over?the?<lazy>?dog", "The?~groovy?minute!?dog?bounds?UPON?the?sleepy?fox"]
    assert column(corpus.chunk("page").select("ordinal", t=SimpleStringify("?")), by="ordinal") == want
    for missing in ("text", "ordinal"):
        c = Corpus(corpus.atoms.drop(missing))
        c.chunks["page"] = Chunks(c, corpus.chunk("page").chunks, corpus.chunk("page").chunk_atoms)
        with pytest.raises(ValueError, match=missing):
            c.chunk("page").select(t=SimpleStringify())


def test_delimited_stringify(corpus):
    want = ["The?(quick)•[brown]?fox?jumps!¶Over?the•<lazy>?dog", "The?~groovy•minute!?dog?bounds¶UPON?the•sleepy?fox"]
    expr = ChunkDelimitedStringify([("paragraph", "¶"), ("line", "•")], atom_delimiter="?")
    assert column(corpus.chunk("page").select("ordinal", t=expr), by="ordinal") == want


def test_filters(corpus):
    lines = corpus.chunk("line")
    on = lambda *f: sorted(column(lines.filter(*f).select("ordinal"), "ordinal"))
    assert on(TopK("width", 2)) == [2, 6] and on(TopK("width", 0)) == [] and len(on(TopK("width", 99))) == 8
    assert on(TopK("width", 2, reverse=True)) == [3, 7]
    assert on(Threshold("width", ">", 110)) == [2, 6] and on(Threshold("width", ">=", 110)) == [1, 2, 5, 6]
    assert on(Threshold("width", "<", 100)) == [3, 7] and on(Threshold("width", "<=", 100)) == [3, 4, 7, 8]
    assert on(EqualTo("width", [80, 100])) == [3, 4, 7, 8] and on(EqualTo("width", [])) == []
    for bad in (lambda: TopK("width", -1), lambda: Threshold("width", "~", 1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        lines.filter(Threshold("width", ">", "9"))


def test_filters_with_null_and_nan(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, 9.0)], "id bigint, x double")
    c = Corpus(rows.select("id"))
    chunks = Chunks(c, rows, rows.select(F.col("id").alias("chunk"), F.col("id").alias("atom")))
    on = lambda f: sorted(column(chunks.filter(f).select("id"), "id"))
    assert on(TopK("x", 9)) == [1, 4] and on(TopK("x", 1, reverse=True)) == [1]
    assert on(Threshold("x", ">", 1.0)) == [1, 4] and on(Threshold("x", "<=", 2.0)) == [1] and on(Threshold("x", ">", float("nan"))) == []
    assert on(EqualTo("x", [None, 9.0])) == [2, 4] and on(EqualTo("x", [float("nan")])) == [3]


def test_chunks_without_atoms(spark):
    atoms = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3)], "id bigint, text string, ordinal bigint")
    c = Corpus(atoms)
    c.chunks["d"] = Chunks(c, spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([(1, 1), (1, 2), (1, 3), (9, 1), (1, 77)], "chunk bigint, atom bigint"))
    r = {x["id"]: x for x in c.chunk("d").select("id", s=SimpleStringify(), d=ChunkDelimitedStringify([("d", "|")]), a=AtomData("text"), n=RegexCount(SimpleStringify(), "a"), o=ChunkOverlap("d", "count"), f=ChunkOverlap("d", "frac")).collect()}
    assert tuple(r[1])[1:5] == ("a c", "a|a|c", ["a", None, "c"], 1)  # the first atom is in two chunks of the kind that delimits
    assert tuple(r[2]) == (2, None, "", None, None, 0, None)


def test_names_and_identity(corpus, merged, spark):
    with pytest.raises(KeyError):
        corpus.chunk("nothing")
    with pytest.raises(ValueError):
        merged.set_chunk("line", corpus.chunk("line"))
    with pytest.raises(ValueError):
        Corpus.merge([])
    with pytest.raises(KeyError):
        bare = Corpus(corpus.atoms)
        Corpus.merge([corpus, bare])
    with pytest.raises(ValueError):
        Corpus.merge([Corpus(corpus.atoms), Corpus(corpus.atoms.drop("text"))])
    assert corpus.set_chunk("again", corpus.chunk("line")) is None and len(corpus.chunk("again")) == 8
    corpus.unpersist("again")
    del corpus.chunks["again"]


def test_enrich(corpus):
    lines = corpus.chunk("line").enrich(s=SimpleStringify(), n=RegexCount(SimpleStringify(), "o"))
    assert lines.chunks.columns[-2:] == ["s", "n"] and "s" not in corpus.chunk("line").chunks.columns
    with pytest.raises(ValueError):
        lines.enrich(s=SimpleStringify())
    with pytest.raises(TypeError):
        lines.enrich(x="ordinal")
    plan = lines.chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") <= 2  # both share one grouping


def test_extension_points(corpus):
    class Shout(AttrExpr):
        def __call__(self, chunks):
            return SimpleStringify()(chunks).select("id", F.upper("value").alias("value"))

    class Odd(ChunkFilter):
        def __call__(self, chunks):
            return chunks.replace(chunks.chunks.filter("ordinal % 2 = 1"), filtered=True)

    class Every(ChunkExpr):
        def __call__(self, corpus):
            return Chunks(corpus, corpus.atoms.select("id"), joined=corpus.atoms.withColumn("_chunk", F.col("id")))

    assert column(corpus.chunk("line").filter(Odd()).select("ordinal", t=Shout()), by="ordinal")[0] == "THE (QUICK)"
    assert len(corpus.chunk(Every())) == 18
    for kind in (AttrExpr, ChunkExpr, ChunkFilter):
        with pytest.raises(TypeError):
            kind()


def test_hand_built_corpora(spark):
    def build(doc, ids, texts):
        atoms = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(zip(ids, texts, strict=True), 1)], "id bigint, text string, ordinal bigint")
        c = Corpus(atoms)
        c.set_chunk("document", Chunks(c, spark.createDataFrame([(doc,)], "id bigint"), spark.createDataFrame([(doc, i) for i in ids], "chunk bigint, atom bigint")))
        c.set_chunk("w", c.chunk(FixedSizeChunk("document", 4, -2)))
        return c

    a, b = build(1234, [123, 355, 684, 235, 407], "Lorem ipsum dolor sit amet".split()), build(4321, [987, 654, 999, 765], "Some other little doc".split())
    assert [len(x.chunk("w")) for x in (a, b, Corpus.merge([a, b]))] == [3, 2, 5]


def test_words_of_documents(spark):
    docs = spark.createDataFrame([(1, "a  b\n\n c\t", "x"), (2, None, "y"), (3, "", None)], "doc_id bigint, text string, lang string")
    c = corpus_from_documents(docs)
    assert sorted((r["document"], r["line"], r["ordinal"], r["text"]) for r in c.atoms.collect()) == [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 2, 3, "c")]
    assert sorted((r["id"], r["lang"], r["t"]) for r in c.chunk("document").select("id", "lang", t=SimpleStringify()).collect()) == [(1, "x", "a b c"), (2, "y", None), (3, None, None)]
    assert len(c.chunk("line")) == 2
