"""Each operator against brute force: on the small tables and on one fixture of odd rows."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers_of
import pytest
from pyspark.sql import functions as F

from loomtext.llm import ann, bpe_transducer, exact_dedup, jaccard, packing, quality, sharding, suffix_array, suffix_dedup, token_counts, warc

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
BASE = " ".join(f"w{i}" for i in range(120))
ODD = [
    (1, "a b c d", "x", 1),
    (2, None, "x", 1),
    (3, "", None, None),
    (4, "a b c d", "x", 1),
    (4, "a b c d", "x", 1),
    (5, "ab  cd\n", "x", 1),
    (6, " \t\n", "x", 1),
    (7, LONG, "x", 1),
    (8, LONG + "end", "x", 1),
    (None, "no id", "x", 1),
    (9, "é日本語 😀 <|endoftext|> <s> don't\r\n\r\n  x", "x", 1),
    (10, "a\x00b \x85 \x1c   z", "x", 1),
    (11, BASE, "x", 1),
    (12, BASE.replace("w60", "changed"), "x", 1),
    (13, BASE + " tail", "x", 1),
    (14, "one", "x", 1),
    (15, "One", "x", 1),
    (16, "aaaa" * 200, "x", 1),
    (17, "x" * 199, "x", 1),
]
SCHEMA = "doc_id bigint, text string, batch string, n bigint"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, expected), key=repr)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# 1


def check_warc(spark, pages, path, expected_rows):
    warc.write_archive(pages, path)
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    import json

    got = []
    page = {r["capture_id"]: json.loads(r["metadata"]["fields"]).get("id") for r in rows}
    assert len(page) == len(rows)
    for r in rows:
        told = json.loads(r["metadata"]["fields"])
        assert r["request"]["target_uri"] == r["response"]["target_uri"]
        assert r["response"]["type"] == "revisit" or r["response"]["digest_ok"]
        refers = r["response"]["refers_to"]
        assert (refers is not None) == (r["response"]["type"] == "revisit")
        got.append((told.get("id"), told.get("url"), r["response"]["payload_bytes"], r["response"]["payload_digest"], r["response"]["type"], refers and page[refers]))
    least = {}
    for i, _, html in expected_rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    want = []
    for i, url, html in expected_rows:
        data = (html or "").encode()
        first = least.get(html or "")
        revisit = sum((h or "") == (html or "") for _, _, h in expected_rows) > 1 and first is not None and i != first
        want.append((i, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_warc_odd_rows(spark, tmp_path):
    tricky = "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 5\r\n\r\né"
    rows = [(1, "http://a.b/c d\r\nX: y", tricky), (2, None, None), (3, "http://e", ""), (4, "http://f", tricky), (5, "http://g", "z" * 2_000_000), (6, "http://h?q=1#z", "h"), (6, "http://h?q=1#z", "h"), (7, "u", "h"), (None, "n", "h")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, type int").repartition(2)
    check_warc(spark, pages, str(tmp_path / "a"), rows)


def test_warc_foreign_and_damaged_archives(spark, tmp_path):
    import gzip

    record = lambda kind, name, more, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()
    whole = record("warcinfo", "i", "", "software: x") + record("response", "r", "", "HTTP/1.1 200 OK\r\n\r\nbody") + record("request", "q", "WARC-Concurrent-To: <r>\r\n", "GET /")
    (tmp_path / "CC-MAIN.warc").write_bytes(whole)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.warc.gz").write_bytes(gzip.compress(record("response", "s", "", "HTTP/1.1 200 OK\r\n\r\nmore")) + gzip.compress(record("metadata", "m", "WARC-Concurrent-To: <s>\r\n", "{}")))
    (tmp_path / "cut.warc").write_bytes(record("response", "t", "", "HTTP/1.1 200 OK\r\n\r\nkept") + whole[:150])
    (tmp_path / "none.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <u>\r\n\r\nno length")
    (tmp_path / "other.txt").write_bytes(b"hello\r\n\r\n")
    (tmp_path / "empty.warc").write_bytes(b"")
    records = warc.read_records(spark, str(tmp_path))
    assert Counter(r["type"] for r in records.collect()) == {"response": 3, "request": 1, "metadata": 1, "warcinfo": 2, "damaged": 3}
    got = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"<r>", "<s>", "<t>"}
    assert got["<r>"]["request"]["record_id"] == "<q>" and got["<s>"]["metadata"]["fields"] == "{}" and got["<t>"]["response"]["payload_bytes"] == 4


def test_warc_empty(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "e"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "e"))).count() == 0


def test_warc_transactions_through_the_request(spark):
    records = spark.createDataFrame([("response", "r1", None), ("request", "q1", "r1"), ("metadata", "m1", "q1"), ("metadata", "m2", "gone"), ("request", "q0", "r1"), ("warcinfo", "w", None)], "type string, record_id string, concurrent_to string")
    for c in ("refers_to string", "target_uri string", "profile string", "payload_bytes bigint", "payload_digest string", "digest_ok boolean", "fields string"):
        name, kind = c.split()
        from pyspark.sql import functions as F

        records = records.withColumn(name, F.lit(None).cast(kind))
    got = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "gone"}
    assert got["r1"]["request"]["record_id"] == "q0" and got["r1"]["metadata"]["record_id"] == "m1"
    assert got["gone"]["response"] is None


# 2


def brute_dedup(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, held in groups.items():
        held.sort()
        keep = rows[held[0][3]][0]
        out += [(rows[k][0], keep, len(held), n == 0, sha(norm.encode())) for n, (_, _, _, k) in enumerate(held)]
    return out


def test_exact_dedup(odd, small):
    for docs in (odd, small):
        same(exact_dedup.mark(docs), brute_dedup(rows_of(docs)))
        kept = [r[0] for r in brute_dedup(rows_of(docs)) if r[3]]
        got = exact_dedup.deduplicate(docs)
        assert got.columns == docs.columns
        assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted(kept, key=repr)


def test_exact_dedup_empty(empty):
    assert exact_dedup.mark(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_binary_fuse_holds_all_and_little_else():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        own, other = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, 20_000, dtype=np.uint64)
        f = exact_dedup.BinaryFuse.from_bytes(exact_dedup.BinaryFuse.build(own).to_bytes())
        assert f.contains(own).all()
        assert f.contains(other).mean() < 0.001
    assert len(f.to_bytes()) <= 2 * (1.2 * 50_000 + 3 * f.segment) + 24


def test_screen_lets_members_pass(spark):
    rows = spark.range(500).selectExpr("unhex(sha2(cast(id as string), 256)) AS sha")
    filters = exact_dedup.build_filters(rows.limit(250), 3)
    passed = {bytes(r["sha"]) for r in exact_dedup.screen(rows, filters, 3).collect()}
    assert {bytes(r["sha"]) for r in rows.limit(250).collect()} <= passed and len(passed) < 260


# 3


def test_token_counts(odd, small):
    model = token_counts.load(token_counts.model_path())
    for docs in (odd, small):
        want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows_of(docs)]
        same(token_counts.count_tokens(docs, token_counts.model_path()), want)
        same(token_counts.count_tokens(docs, token_counts.model_path(), table_size=3, sample_rows=2), want)


def test_token_counts_empty(empty):
    assert token_counts.count_tokens(empty, token_counts.model_path()).count() == 0


# 4


def brute_repeats(rows, length):
    seen = Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        seen.update(d[p : p + length] for p in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, np.int8)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = 1
        spans = int(((gone[1:] == 1) & (gone[:-1] == 0)).sum() + (gone[0] == 1))
        keep = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((i, len(d), int(gone.sum()), spans, sha(keep)))
    return out


def test_suffix_dedup(odd, small):
    for docs in (odd, small):
        same(suffix_dedup.digests(docs), brute_repeats(rows_of(docs), 200))


def test_suffix_dedup_splits_hot_anchors(spark):
    rng = random.Random(5)
    line = "".join(rng.choice("abcdef ") for _ in range(150))
    rows = [(i, "".join(rng.choice("xyz é") for _ in range(rng.randint(0, 150))) + line + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 150)))) for i in range(40)]
    rows += [(100 + i, rows[i][1][20:] + "more") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(suffix_dedup.digests(docs, hot=3), brute_repeats(rows, 200))


def test_suffix_removal_keeps_whole_characters(spark):
    shared = "é" * 150
    rows = [(1, "a" + shared + "日本"), (2, "bb" + shared + "x"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, tkey string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove(docs).collect()}
    assert got == {1: "a日本", 2: "bbx", 3: None, 4: ""}


def test_suffix_kernels_stay_small():
    rng = random.Random(9)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(40_000)) for _ in range(5)]
    held = [b"".join(rng.choice(base)[rng.randrange(36_000) :][:1500] for _ in range(3)) for _ in range(28)] + [b"", b"x" * 199, b"x" * 200, b"y" * 5000]
    suffix_dedup._table.cache_clear()
    tracemalloc.start()
    o, n, gap, key, _ = suffix_dedup.anchors(held, 200, 32, 57)
    scanned = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    cut = [b[i : i + 257] for b in base for i in range(0, 39_000, 100)][: suffix_dedup.BUCKET_BYTES // 258]
    suffix_array.repeats(cut, np.ones(len(cut), np.int64), 200)
    transformed = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scanned < 20e6 and transformed < 60e6
    # Every start is in one segment, and equal strings have equal keys and distances, whatever stands around them.
    keys = {}
    for i, t in enumerate(held):
        lo = 0
        for m, g, k in zip(n[o == i], gap[o == i], key[o == i], strict=True):
            for p in range(lo, lo + m):
                assert keys.setdefault(t[p : p + 200], (k, lo + g - p)) == (k, lo + g - p)
            lo += m
        assert lo == max(0, len(t) - 199)


def test_repeats_between_many_runs():
    # Wide intervals with many runs of equal bytes before them, at levels beyond the first.
    rng = random.Random(2)
    line = b"a common line that all have in the very middle"
    held = [bytes(rng.choice(b"pqrs") for _ in range(rng.randrange(1, 9))) + line + bytes(rng.choice(b"tuvw") for _ in range(rng.randrange(1, 9))) for _ in range(800)]
    for length in (12, len(line), len(line) + 3):
        seen = Counter(s[i : i + length] for s in held for i in range(len(s) - length + 1))
        got = suffix_array.repeats(held, np.ones(len(held), np.int64), length)
        assert [x.tolist() for x in got] == [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in held]


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.digests(empty).count() == 0 and suffix_dedup.remove(empty).count() == 0


def test_transform_against_counting():
    rng = random.Random(3)
    for _ in range(400):
        length = rng.choice([1, 2, 5, 13, 17])
        alphabet = rng.choice([b"a", b"ab", b"abc\0", bytes(range(256))])
        base = bytes(rng.choice(alphabet) for _ in range(60))
        held = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) + base[(a := rng.randint(0, 50)) : a + rng.randint(0, 40)] * rng.randint(0, 3) for _ in range(rng.randint(1, 8))]
        weights = np.array([rng.choice([1, 1, 2]) for _ in held])
        seen = Counter()
        for s, w in zip(held, weights, strict=True):
            for i in range(len(s) - length + 1):
                seen[s[i : i + length]] += int(w)
        assert [x.tolist() for x in suffix_array.repeats(held, weights, length)] == [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in held]


# 5


def test_sharding(odd, small):
    for docs in (odd, small):
        got = sharding.assign(docs, [1.0] * 40).collect()
        data = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows_of(docs)]
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(data, key=repr)
        shards = defaultdict(list)
        where = {}
        for r in got:
            shards[r["shard"]].append(r["slot"])
            assert where.setdefault(r["doc_id"], r["shard"]) == r["shard"] and r["grown_shard"] in (r["shard"], 40)
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())
        grown = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, [1.0] * 41).collect()}
        assert {r["doc_id"]: r["grown_shard"] for r in got} == grown


def test_shards_follow_their_weights(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'x' AS text")
    n = Counter(r["shard"] for r in sharding.assign(docs, [1.0, 2.0, 1.0]).collect())
    assert abs(n[1] / 20_000 - 1) < 0.05 and abs(n[0] / 10_000 - 1) < 0.05


def test_shards_are_written(spark, small, tmp_path):
    sharding.write_shards(small, str(tmp_path / "s"), [1.0] * 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == small.count() and back.select("shard").distinct().count() == 3


def test_sharding_empty(empty):
    assert sharding.assign(empty, [1.0] * 40).count() == 0


# 6


def tiktoken_of(name):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizers_of.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(tokenizers_of.path(name)), special_tokens={})


def test_transducer(odd, small):
    library, path = tiktoken_of(bpe_transducer.RANKS), tokenizers_of.path(bpe_transducer.RANKS)
    for docs in (odd, small):
        want = [(i, len(ids := library.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows_of(docs)]
        same(bpe_transducer.transcode(docs, path, tokenizers_of.PATTERN), want)


def test_transducer_on_noise():
    library = tiktoken_of(bpe_transducer.RANKS)
    codec = bpe_transducer.load(tokenizers_of.path(bpe_transducer.RANKS), tokenizers_of.PATTERN)
    rng = random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choice("ab éß日\n\t .,'s1234 😀\x85\x1c ") for _ in range(rng.randint(0, 120)))
        assert codec.encode(t) == library.encode_ordinary(t)
        assert "".join(codec.decode(codec.encode(t))) == t


def test_transducer_survives_a_full_cache(monkeypatch):
    library = tiktoken_of(bpe_transducer.RANKS)
    monkeypatch.setattr(bpe_transducer, "MOST_STATES", 5)
    machine = bpe_transducer.Transducer(bpe_transducer.read_ranks(tokenizers_of.path(bpe_transducer.RANKS)))
    for word in (" internationalisation", "xqzkv" * 40, "日本語テキスト"):
        assert list(machine.run(word.encode())) == library.encode_ordinary(word)


def test_utf8_machine_matches_the_codec():
    rng = random.Random(2)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0]) for _ in range(rng.randint(0, 9)))
        out, held = "", b""
        for i in range(len(data)):
            text, held = bpe_transducer.Utf8.feed(held, data[i : i + 1])
            out += text
        assert out + ("�" if held else "") == data.decode("utf-8", "replace")


def test_transducer_empty(empty):
    assert bpe_transducer.transcode(empty, tokenizers_of.path(bpe_transducer.RANKS), tokenizers_of.PATTERN).count() == 0


# 7


def brute_neighbours(rows, every, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            d = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = d[:k]
    return out


def test_neighbours_recall_and_scores(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in rows.collect()], 20)
        got = defaultdict(list)
        for r in ann.search(rows, rows.filter("vec_id % 20 = 0")).collect():
            got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
        hit = 0
        for q, near in want.items():
            own = sorted(got[q])
            assert [r for r, _, _ in own] == list(range(1, 11)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
            exact = {j: d for d, j in near}
            hit += sum(v in exact for _, _, v in own)
            assert all(abs(exact[v] - s) < 1e-9 for _, s, v in own if v in exact)
        assert hit / (10 * len(want)) >= 0.9


def test_neighbours_recall_at_other_norms(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    for norm in (0.1, 2.0, 30.0):
        own = rows.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * norm))
        want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in own.collect()], 100)
        got = ann.search(own, own.filter("vec_id % 100 = 0")).collect()
        near = {(q, j) for q, found in want.items() for _, j in found}
        assert len({(r["query_id"], r["vec_id"]) for r in got} & near) / len(near) >= 0.9


def test_neighbours_odd_rows(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(0, v), (1, v), (2, None), (3, [0.0] * 3), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [1.0, 0.5, 2.0]), (100, [9.0, 9.0, 9.0]), (8, [1.0, 2.0]), (200, None), (300, [0.0, 0.0, 0.0]), (None, v), (9, []), (7, [1.0, 0.5, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, score int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, df.filter("vec_id % 100 = 0")).collect())
    want = [(q, n + 1, j, d) for q, near in brute_neighbours(rows, 100).items() for n, (d, j) in enumerate(near)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in got], [x[3] for x in sorted(want)])
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


# 8


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.classify(docs, quality.fit(docs, labels, max_rows=1500)).join(labels, "doc_id").filter("held_out").collect()
    y, p = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert ((p >= 0.5) == y).mean() > 0.985
    assert ((p - y) ** 2).mean() < 0.012
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (7, None), (9, 1), (14, 0), (None, 1), (16, 0)], "doc_id bigint, quality int")
    model = quality.fit(odd, labels)
    got = quality.classify(odd, model).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert quality.classify(empty, model).count() == 0
    none = quality.classify(odd, quality.fit(odd, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.keep(odd, model).columns == odd.columns
    clashing = odd.withColumnsRenamed({"batch": "_score", "n": "_in_0"})
    assert quality.keep(clashing, model).columns == clashing.columns


def test_quality_pooling_and_calibration(spark):
    rng = np.random.default_rng(3)
    words, weights = rng.normal(size=(quality.SLOTS, quality.DIM)).astype(np.float16), rng.uniform(0.1, 1, quality.SLOTS)
    model = quality.Model({"words": words, "weights": weights})
    for n in (0, 1, 2, 5, 65_536, 65_537, 140_000):
        at = rng.integers(0, quality.SLOTS, n)
        v = words[at].astype(np.float64)
        want = np.r_[weights[at] @ v / max(weights[at].sum(), 1e-9), (v[1:] * v[:-1]).sum(0) / max(1, n - 1)]
        assert np.allclose(model.pool(at), want, atol=1e-3)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.classify(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    y, p = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert abs(p.mean() - y.mean()) < 0.02
    for low, high in ((0, 0.1), (0.9, 1.01)):  # what is said with confidence holds
        some = (p >= low) & (p < high)
        assert abs(p[some].mean() - y[some].mean()) < 0.03


def test_quality_word_vectors_are_of_all_documents(spark):
    rows = [(1, "red fox runs far away home"), (2, "old dog"), (3, "zebra " * 70_000 + "quagga"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    model = quality.Model.from_bytes(quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")))
    counts, context, index = np.zeros(quality.SLOTS), np.zeros((quality.SLOTS, quality.DIM)), quality.index_vectors()
    for _, text in rows:
        at = [quality.slot_of(w) for w in (text or "").split()]
        for i, a in enumerate(at):
            counts[a] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(at):
                    context[a] += index[at[j]]
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    assert np.allclose(model.parts["weights"], 1e-3 / (1e-3 + counts / counts.sum()))
    assert np.allclose(model.words, unit(unit(index) + unit(context)), atol=2e-3)


# 9


def test_packing(odd, small):
    from tokenizers import Tokenizer

    path = tokenizers_of.path(packing.TOKENIZER)
    library = Tokenizer.from_file(path)
    for docs in (odd, small):
        packed = packing.pack_documents(docs, path, with_ids=True).collect()
        want = []
        for i, t in rows_of(docs):
            ids = library.encode(t or "", add_special_tokens=False).ids + [2]
            for k, (start, n) in enumerate(packing.cut(len(ids), 1024)):
                want.append((i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), ids[start : start + n]))
        assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in packed), key=repr) == sorted(want, key=repr)
        bins = defaultdict(list)
        for r in packed:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for held in bins.values():
            at = 0
            for offset, n in sorted(held):
                assert offset == at
                at += n
            assert at <= 1024
        assert len(bins) <= 1.05 * sum(w[3] for w in want) / 1024 + 2


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(6, 4) == [(0, 2), (2, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_plan_places_everything_once():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.choice([3, 10, 64, 1024])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(0, 25))}
        runs, bins = packing.plan(counts, capacity)
        held = defaultdict(list)
        ranks = defaultdict(list)
        for size, first, n, base, each, offset in runs.tolist():
            for r in range(n):
                ranks[size].append(first + r)
                held[base + r // each].append((offset + r % each * size, size))
        assert {s: list(range(n)) for s, n in counts.items()} == {s: sorted(r) for s, r in ranks.items()}
        assert sorted(held) == list(range(bins))
        for b in held.values():
            at = 0
            for offset, size in sorted(b):
                assert offset == at
                at += size
            assert at <= capacity
        assert bins <= best_fit(counts, capacity) * 1.02 + 1


def best_fit(counts, capacity):
    """Bins of plain best fit, longest first."""
    room = []
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fitting = [(r, k) for k, r in enumerate(room) if r >= size]
        if fitting:
            room[min(fitting)[1]] -= size
        else:
            room.append(capacity - size)
    return len(room)


def test_sequences_and_empty(spark, small, empty):
    path = tokenizers_of.path(packing.TOKENIZER)
    whole = packing.sequences(packing.pack_documents(small, path, with_ids=True))
    assert whole.selectExpr("max(size(ids))").first()[0] <= 1024
    assert packing.pack_documents(empty, path).count() == 0


# 10


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_links(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            where[g].add(i)
    for i, s in enumerate(sets):
        if s:
            for j in {j for g in s for j in where[g] if j < i}:
                if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def noisy_family(seed=7):
    rng = random.Random(seed)
    rows = []
    for family in range(6):
        words = [f"f{family}w{rng.randint(0, 400)}" for _ in range(rng.choice([12, 40, 150, 400]))]
        for _ in range(25):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(own[: rng.choice([len(own), len(own) - 1, len(own) - 5])])))
    common = " ".join(f"c{i}" for i in range(200))
    rows += [(len(rows) + i, common + " " + " ".join(f"o{i}x{j}" for j in range(rng.choice([2, 10, 30])))) for i in range(40)]
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_links(spark, odd, small, words, percent):
    for docs in (odd, small, spark.createDataFrame(noisy_family(), "doc_id bigint, text string")):
        got = jaccard.resolve(docs, words, percent).select("id", "n", "component_id")
        same(got, brute_links(rows_of(docs), words, percent))


def test_jaccard_keeps_one(spark, odd, empty):
    got = jaccard.keep_one(odd)
    assert got.columns == odd.columns
    ids = [r["doc_id"] for r in got.collect()]
    want = {i for i, _, c in brute_links(rows_of(odd), 5, 80) if i == c}
    assert set(ids) == want and len(ids) == len(want)
    assert jaccard.resolve(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_jaccard_keeps_one_of_each_component_whatever_the_ids(spark):
    far = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcdefg"]
    rows = [(None, far[0]), (None, far[1]), (None, far[1].upper()), (1, far[2]), (1, far[3]), (1, far[3]), (2, far[4]), (None, far[4] + " tail"), (2, far[5]), (3, far[5] + " tail"), (None, far[6]), (4, far[6] + " tail"), (None, ""), (None, None), (1, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in jaccard.keep_one(docs).collect()]
    want = [(None, far[0]), (None, far[1]), (1, far[2]), (1, far[3]), (2, far[4]), (2, far[5]), (4, far[6] + " tail"), (None, ""), (None, ""), (1, " ")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_quality_finds_slots_without_a_call_a_word(monkeypatch):
    rng = np.random.default_rng(7)
    signs = [0x20, 0x20, 0x41, 0x62, 0x5F, 0x30, 0xE9, 0x301, 0x4E2D, 0x1F600, 0x2E, 0x85, 0xA0, 0x2028, 0x1C, 0xB2, 0x660, 0x1D7D8, 0xFFFD, 0, 0xAD, 0x3000]
    held = ["".join(map(chr, rng.choice(signs, n))) for n in rng.choice([0, 1, 2, 5, 50, 500], 400)]
    held += ["a" * n for n in range(62, 68)] + ["\u00e9" * n for n in range(30, 35)] + ["", "x" * 200_000, "y! z " * 60_000, "\u4e2d" * 70_000, "a" * 140_000 + " b" * 100_000]
    held = [t.encode() for t in held] + [b"ab\xff\xfecd \xe4\xb8", b"\xff"]
    want = [[quality.slot_of(m[0]) for m in quality.TOKEN.finditer(t.decode("utf-8", "replace"))] for t in held]
    calls, slot_of = [], quality.slot_of
    monkeypatch.setattr(quality, "slot_of", lambda w: calls.append(w) or slot_of(w))
    got = quality.slots(held)
    assert [x.tolist() for x in got] == want
    assert all(len(w.encode()) > quality.LONGEST for w in calls)
    assert quality.slots([]) == []
    # a word more often than 16 bits count, and texts that are no neighbours
    index = np.r_[quality.index_vectors(np.int8), np.zeros((1, quality.DIM), np.int8)]
    at = np.r_[np.full(40_000, 3), [quality.SLOTS] * quality.WINDOW, [5, 7]].astype(np.uint16)
    counts, context = np.zeros(quality.SLOTS + 1, np.int64), np.zeros((quality.SLOTS + 1, quality.DIM), np.int64)
    quality.add_context(at, index, counts, context)
    assert counts[[3, 5, 7]].tolist() == [40_000, 1, 1]
    assert (context[3] == (4 * 40_000 - 6) * index[3].astype(int)).all() and (context[5] == index[7]).all() and (context[7] == index[5]).all()


def test_quality_takes_no_tables_along():
    """What is sent with every task is small, and contexts do not depend on the slices in which they are summed."""
    from pyspark import cloudpickle

    class Docs:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        groupBy = applyInArrow = lambda self, *a: self
        collect = lambda self: []

    quality.word_vectors(docs := Docs())
    assert len(cloudpickle.dumps(docs.run)) < 100_000
    at = np.random.default_rng(5).integers(0, 300, 3 * quality.PART + 7)
    index, found = quality.index_vectors(np.int8), []
    for part in (quality.PART, len(at)):
        own, quality.PART = quality.PART, part
        counts, context = np.zeros(quality.SLOTS, np.int64), np.zeros((quality.SLOTS, quality.DIM), np.int64)
        quality.add_context(at, index, counts, context)
        quality.PART = own
        found.append((counts, context))
    assert all((x == y).all() for x, y in zip(*found, strict=True))
