"""License scans, vector codes and phrases against brute force, on small tables and odd rows."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import common, license_scan, phrases, registry, vector_codes
from loomtext.llm.license_scan import Template

SF = "/root/testdata/sf0.001"
NEW = ["op11_license_scan", "op12_vector_codes", "op13_phrases"]


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = registry.queries()[name](spark, SF)
    rel = c.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_words_are_found_without_objects():
    for text in ("", " ", "\n", "a", " a b\n\nc  d\n", "a\nb", "\na b \n"):
        want = re.findall("\n|[^ \n]+", text)
        assert [w.decode() for w in common.tokens(text.encode()).to_pylist()] == want


# License scans


def scan_by_hand(text, templates, least=license_scan.LEAST):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for i, t in enumerate(templates):
        own = t.words
        for start in range(-len(own), len(words)):
            agree = [0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(own)]
            if all(all(agree[a:b]) for a, b in t.spans()) and 100 * sum(agree) >= least * len(own):
                found.append((i, start, sum(agree)))
    return len(words), found


NOTICE = "Licensed under the Apache License, Version 2.0."
FILES = [
    (1, NOTICE, "x"),
    (2, None, "x"),
    (3, "", None),
    (4, "MIT License mit LICENSE; mit-license\nMIT Licenses", "x"),
    (4, "MIT License mit LICENSE; mit-license\nMIT Licenses", "x"),
    (5, "wörter mit license é", "x"),
    (None, "cc by " * 500, "x"),
    (6, "This work is licensed under the GNU General Public License, version 3. gnu general public license version 2", "x"),
    (7, "License, Version 2.0. General Public License", "x"),
    (8, "apache license version 2 0", "x"),
    (9, "word " * 20_000 + NOTICE + " tail" * 20_000, "x"),
    (10, "Permission is hereby granted, free of charge, to any man obtaining a copy of this software and associated documentation files (the software) to deal in the software without restriction", "x"),
    (11, "Permission is hereby granted, free of charge, to whom it may concern", "x"),
    (12, "gnu gnu general general public public license license gnu general public license", "x"),
]


def test_license_scan_by_hand(spark):
    docs = spark.createDataFrame(FILES, "doc_id bigint, text string, found string").repartition(3)
    templates = [*license_scan.BASE, *license_scan.NOTICES]
    got = Counter((r["doc_id"], r["n_words"], tuple((m["template"], m["start"], m["matched"]) for m in r["found"])) for r in license_scan.scan(docs).collect())
    want = Counter()
    for i, text, _ in FILES:
        n, found = scan_by_hand(text, templates)
        want[i, n, tuple(found)] += 1
    assert got == want
    by = {r["doc_id"]: r for r in license_scan.report(license_scan.scan(docs)).collect()}
    assert by[1]["labels"] == "apache,apache-2.0" and by[1]["score"] == 1.0
    assert by[4]["n_base"] == 3 and (by[4]["first_word"], by[4]["last_word"]) == (0, 4)
    assert (by[2]["n_words"], by[2]["n_base"], by[2]["first_word"], by[2]["labels"], by[2]["score"]) == (0, 0, None, "", 0.0)
    assert by[10]["labels"] == "mit" and 0.9 < by[10]["score"] < 1 and by[11]["labels"] == ""
    assert by[7]["labels"] == "" and by[12]["n_base"] == 1
    assert by[None]["n_base"] == 500


def test_license_index_does_not_depend_on_frequencies():
    templates = [*license_scan.BASE, *license_scan.NOTICES]
    words = license_scan.vocabulary(templates)
    code = {w: i for i, w in enumerate(words)}
    forward = license_scan.Index(templates, {w: i for i, w in enumerate(words)})
    backward = license_scan.Index(templates, {w: -i for i, w in enumerate(words)})
    rng = np.random.default_rng(1)
    for _ in range(300):
        parts = [w if rng.random() < 0.95 else "other" for k in rng.integers(0, len(templates), 3) for w in templates[k].words]
        codes = np.array([code.get(w, -1) for w in parts])
        found = scan_by_hand(" ".join(parts), templates)[1]
        assert forward.find(codes) == backward.find(codes) == sorted(found)


def test_license_templates_of_a_user(spark):
    own = [Template("own", "all of this is ours and nobody elses", ["this is ours", "nobody elses"])]
    docs = spark.createDataFrame([("a", "All of THIS is ours, or nobody elses. This is ours"), ("b", "this is ours and really nobody elses")], "`my.id` string, text string")
    got = {r["doc_id"]: [(m["label"], m["start"], m["matched"]) for m in r["found"]] for r in license_scan.scan(docs, own, id_col="my.id").collect()}
    assert got == {"a": [("own", 0, 7)], "b": []}
    with pytest.raises(ValueError):
        license_scan.Index([Template("x", "a b c", ["a c"])], {})


def test_license_scan_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert license_scan.report(license_scan.scan(docs)).collect() == []


# Vector codes


def lloyd(vectors, parts=4, entries=256, rounds=4):
    """Plain Lloyd in Python integers: (codes, errors, books) of rows (id, vector)."""
    whole = [[math.floor(1024 * x) for x in v] for _, v in vectors]
    width = len(whole[0]) // parts
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0, vectors[i][1]))[:entries]
    books = [[whole[i][p * width : (p + 1) * width] for i in order] for p in range(parts)]

    def assign():
        out = []
        for x in whole:
            out.append([min((sum((a - b) ** 2 for a, b in zip(x[p * width : (p + 1) * width], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            own = defaultdict(list)
            for x, n in zip(whole, near, strict=True):
                own[n[p][1]].append(x[p * width : (p + 1) * width])
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    near = assign()
    return ["".join(f"{k:02x}" for _, k in n) for n in near], [sum(d for d, _ in n) for n in near], books


VECTORS = "vec_id bigint, embedding array<double>, label int, error string, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], VECTORS)


def test_vector_codes_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.choice([-1.5, -0.25, 0.0, 0.001, 0.75], 8)], [None, 1, 1, 2][i % 4]) for i in range(120)]
    rows += rows[:5] + [(None, [0.5] * 8, None), (7, [0.25] * 8, 1)]
    odd = [(200, None, 1), (201, [None] + [0.0] * 7, 1), (202, [float("nan")] + [0.0] * 7, 1), (203, [float("inf")] + [0.0] * 7, 1)]
    got = vector_codes.compress(table(spark, rows + odd).repartition(5), entries=16).collect()
    codes, errors, books = lloyd([(i, v) for i, v, _ in rows], entries=16)
    sums = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        sums[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = Counter((i, c, e, sums[label], digest) for (i, _, label), c, e in zip(rows, codes, errors, strict=True))
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == want


def test_bounds_prune_and_decide_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 16))
    book = x[:64].copy()
    code, upper, lower = vector_codes.assign_first(x, book)
    took = 0
    for _ in range(4):
        new = book.copy()
        for k in range(64):
            if (code == k).any():
                new[k] = x[code == k].sum(0) // (code == k).sum()
        moved = vector_codes.above(((new - book) ** 2).sum(1))
        code, upper, lower, n = vector_codes.assign_again(x, new, code, upper, vector_codes.unpack(vector_codes.pack(lower)), moved)
        book, took = new, took + n
        exact = ((x[:, None] - book) ** 2).sum(2)
        assert (code == exact.argmin(1)).all()
        assert (upper**2 >= exact.min(1)).all() and (lower**2 <= exact + 1e-9).all()
    assert took < 0.25 * 4 * 3000 * 64


def test_packed_bounds_never_rise():
    x = np.concatenate([np.array([0.0, 1e-30, 1.0, 65535.99, 3e9]), np.random.default_rng(1).random(10_000) * 1e4])
    back = vector_codes.unpack(vector_codes.pack(x))
    assert (back <= x).all() and (back >= x * 0.99 - 1e-30).all()


def test_distances_are_exact_beyond_floats():
    x = np.array([[2**28 - 1, -(2**28) + 1], [1, 0]])
    book = np.array([[-(2**28) + 1, 2**28 - 1], [2**28 - 1, -(2**28) + 2]])
    assert vector_codes.distances(x, book).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in book] for r in x]


def test_vector_codes_odd_tables(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.compress(table(spark, [(1, None, 1)])).collect() == []
    same = vector_codes.compress(table(spark, [(i, [0.5] * 4, None) for i in range(9)])).collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in same} == {("00000000", 0, 0)} and len(same) == 9
    for bad in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e9] * 4, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(table(spark, bad))


# Phrases


def phrases_by_hand(rows, least, longest=4, covered=80, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in good.items():
            for q in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                longer[q] = max(longer[q], a)
        scored = []
        for p, a in good.items():
            if not (longer[p] and 100 * longer[p] >= covered * a):
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def some_texts(n=400):
    rng = np.random.default_rng(7)
    words = ["the", "of", "a", "The", "é", "x\x00y", "😀", "of_", *[f"w{i}" for i in range(30)]]
    share = np.array([1 / (i + 1) for i in range(len(words))])
    joints = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?", "\xa0"]
    rows = []
    for _ in range(n):
        own = rng.choice(words, rng.integers(0, 60), p=share / share.sum())
        rows.append(("".join(w + str(rng.choice(joints)) for w in own), [None, "en", "en", "und", "de"][rng.integers(0, 5)]))
    return rows + [(None, "en"), ("", None), ("the the the the the the " * 300, "de"), ("solo", "fr"), ("the of a the of a", "en")] + [("one and the same passage", "en")] * 50


@pytest.mark.parametrize(("known", "split", "held", "block"), [(1 << 20, 500_000, 1_000_000, 8 << 20), (12, 500_000, 500, 8 << 20), (1 << 20, 150, 2000, 512)])
def test_phrases_by_hand(spark, monkeypatch, known, split, held, block):
    """Whole; with most words unnumbered; with hot pivots in several buckets and texts cut between pieces."""
    rows = some_texts()
    monkeypatch.setattr(phrases, "SPLIT", split)
    docs = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, phrase int").repartition(5)
    got = phrases.collocations(docs, least=5, known=known).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == phrases_by_hand(rows, 5)


def test_fragments_hold_each_ngram_once():
    rng = np.random.default_rng(11)
    for _ in range(50):
        ids = rng.integers(-1, 6, 80)
        order = np.where(ids >= 0, 100 - ids, 0)
        rows = phrases.fragments(ids, order, 3)
        for size in (2, 3, 4):
            grams, n = phrases.ngrams(rows, np.ones(len(rows), np.int64), 3, size)
            want = Counter(tuple(ids[i : i + size].tolist()) for i in range(len(ids) - size + 1) if (ids[i : i + size] >= 0).all())
            assert {tuple(g - 1): int(c) for g, c in zip(grams.tolist(), n, strict=True) for g in [np.array(g)]} == want


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 50)
    for data in (b"", b"x" * 300, b"ab cd\n" * 100, b"y" * 120 + b"\n" + b"z w\n" * 60):
        blocks = list(phrases._blocks(data))
        assert b"".join(blocks) == data
        assert [w for b in blocks for w in common.tokens(b).to_pylist()] == common.tokens(data).to_pylist()


def test_phrases_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([("a b", None)], "text string, lang string").filter(F.lit(True))).collect() == []
