"""A quality classifier: random-indexing word vectors, pooled, under a small network.

Every word has a sparse ternary index vector drawn from a hash of the word.  A
word's vector is its own index vector plus those of its neighbours in all
documents (random indexing, no labels), scaled to unit length; tasks sum what
they read, and the sums are added up by blocks of slots; words live in ``SLOTS`` hashed
slots, so the model's size is fixed.  Case is kept; words are runs of letters,
digits and underscores, and runs of signs.  A document is two pooled vectors: the mean of its words' vectors,
rare words weighing more, and the mean of the products of neighbours' vectors
(component by component), which binds a word to the one before it.  A two-layer
numpy network over these gives the logit of label 1, and a temperature fitted on a
part kept from training calibrates its probabilities.  Nothing else is looked at.

Training takes at most ``max_rows`` labelled rows, those with the smallest hash
of their id, one row for each id (that with the least text), of which ids whose crc32 (of the id as text) modulo 3 is 1 are
never part.  It runs in one task on that bounded sample; the model is broadcast.
Scoring reads every row and whole text.

A null or empty text, or one of white space, has two zero vectors and is scored from those; a null id
counts as not held out.  Labels that are null are left out, of several labels
of an id the largest holds.  Without labels of both kinds every score is the
share of label 1 (0.5 without any).  Repeated rows stay repeated; no column but
the text enters a score.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, texts

SLOTS, DIM, ONES, WINDOW = 1 << 15, 64, 6, 2
HIDDEN, EPOCHS, MAX_ROWS = 48, 60, 4000
#: Words whose contexts are summed at a time, few enough that sums of 16 bits hold them (a component is at most 2 * WINDOW).
PART = 0xFFFF // (4 * WINDOW)
#: Bytes of text whose words are found at a time, and bytes of the words whose slots are found together.
SLICE, LONGEST = 1 << 17, 64
TOKEN = re.compile(r"(\w+)|[^\w\s]+")


def slot_of(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


def index_vectors(kind: type = np.float32) -> np.ndarray:
    """(SLOTS, DIM) sparse ternary vectors, the same for every process."""
    rng = np.random.default_rng(20240101)
    out = np.zeros((SLOTS, DIM), kind)
    at = rng.integers(0, DIM, (SLOTS, ONES))
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], kind), (SLOTS, ONES)), 1)
    return out


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each code point (0 between words), and what makes up a CRC-32's last bits: each byte's share by its distance from the end, and the length's."""
    kinds = np.zeros(0x110000, np.uint8)
    for m in TOKEN.finditer(np.arange(len(kinds), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        kinds[m.start() : m.end()] = 1 if m[1] else 2
    length = np.array([zlib.crc32(bytes(n)) for n in range(LONGEST + 1)], np.uint32)
    shares = np.array([[zlib.crc32(bytes([c]) + bytes(n)) for c in range(256)] for n in range(LONGEST)], np.uint32) ^ length[1:, None]
    return kinds, (shares % SLOTS).astype(np.uint16).ravel(), (length % SLOTS).astype(np.uint16)


def _found(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, slot) of each word of UTF-8 bytes, without a Python object a word."""
    kinds, shares, length = _tables()
    data = np.frombuffer(text, np.uint8)
    kind = kinds[data if text.isascii() else np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)]
    edges = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    own = kind[edges] > 0
    if len(kind) < len(data):
        edges = np.flatnonzero((data & 0xC0) != 0x80)[edges]
    sizes = np.diff(edges, append=len(data))
    left = np.repeat((edges + sizes - 1).astype(np.int32), sizes) - np.arange(len(data), dtype=np.int32)
    left = np.minimum(left, LONGEST - 1, out=left) << 8
    left |= data
    slots = np.bitwise_xor.reduceat(shares.take(left), edges)[own]
    edges, sizes = edges[own], sizes[own]
    slots ^= length[np.minimum(sizes, LONGEST)]
    for i in np.flatnonzero(sizes > LONGEST):
        slots[i] = slot_of(text[edges[i] : edges[i] + sizes[i]].decode())
    return edges, slots


def slots(held: list[bytes]) -> list[np.ndarray]:
    """The slots of the words of each text, of which several are looked at together and long ones in parts that end at a blank."""
    out: list[np.ndarray] = []
    held = [t.decode("utf-8", "replace").encode() for t in held]
    at = 0
    while at < len(held):
        if len(held[at]) > SLICE:
            t, start, parts = held[at], 0, []
            while start < len(t):
                end = len(t) if len(t) - start <= SLICE else t.find(b" ", start + SLICE)
                end = len(t) if end < 0 else end
                parts.append(_found(t[start:end])[1])
                start = end
            out.append(np.concatenate(parts))
            at += 1
            continue
        end, size = at, 0
        while end < len(held) and (size := size + len(held[end])) <= SLICE:
            end += 1
        own = held[at:end]
        ends = np.cumsum([len(t) + 1 for t in own])
        first, found = _found(b"\n".join([*own, b""]))
        out += np.split(found, np.searchsorted(first, ends[:-1]))
        at = end
    return out


class Model:
    """Word vectors, word weights and the network; ``scores`` gives calibrated probabilities."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.words = parts["words"].astype(np.float32)

    def pool(self, at: np.ndarray) -> np.ndarray:
        """The weighted mean of the words' vectors, and the mean of neighbours' products."""
        total, bound, weight = np.zeros(DIM), np.zeros(DIM), 0.0
        for i in range(0, len(at), 65536):
            own = at[i : i + 65537]  # with the next slice's first word, for its product
            v, w = self.words.take(own, 0), self.parts["weights"][own[:65536]]
            total += w @ v[:65536]
            weight += float(w.sum())
            bound += np.einsum("ij,ij->j", v[1:], v[:-1])
        return np.r_[total / max(weight, 1e-9), bound / max(1, len(at) - 1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.parts
        if not len(p["w2"]):
            return np.full(len(x), float(p["b2"][0]))
        h = np.tanh(((x - p["mean"]) / p["scale"]) @ p["w1"] + p["b1"])
        return (h @ p["w2"] + p["b2"]).ravel()

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.parts["temperature"][0], -40, 40)))

    def to_bytes(self) -> bytes:
        np.savez_compressed(out := io.BytesIO(), **self.parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as f:
            return cls({k: f[k] for k in f.files})


def add_context(at: np.ndarray, index: np.ndarray, counts: np.ndarray, context: np.ndarray) -> None:
    """Count a text's slots, and add to each word's context the index vectors of its neighbours."""
    counts += np.bincount(at, minlength=len(counts))
    for i in range(0, len(at), PART):
        low = max(0, i - WINDOW)
        near, own = index.take(at[low : i + PART + WINDOW], 0).view(np.uint8), at[i : i + PART].astype(np.uint16)
        total = np.full((len(own), DIM), 2 * WINDOW, np.uint8)  # from 0 to 4 * WINDOW, so that four components are summed as one number
        for k in range(1, WINDOW + 1):
            start = max(0, k - i)  # the text's first words have no words before them
            total[start:] += near[i - low + start - k : i - low + len(own) - k]
            after = near[i - low + k : i - low + len(own) + k]
            total[: len(after)] += after
        order = np.argsort(own, kind="stable")
        held = own[order]
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        sums = np.add.reduceat(total.take(order, 0).astype(np.uint16).view(np.uint64), first, axis=0).view(np.uint16)
        context[held[first]] += sums - 2 * WINDOW * np.diff(first, append=len(held))[:, None]


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) of all slots by random indexing over the texts of ``docs`` (text)."""
    blocks = 64
    size = SLOTS // blocks
    schema = "block int, counts binary, context binary"

    def run(it):
        own = np.r_[index_vectors(np.int8), np.zeros((1, DIM), np.int8)]  # made here: it would travel with every task
        counts, context = np.zeros(SLOTS + 1, np.int64), np.zeros((SLOTS + 1, DIM), np.int64)
        between = np.full(WINDOW, SLOTS, np.uint16)  # what keeps texts apart: slots of no word
        for batch in it:
            for _, held in texts(batch, "text", SLICE):
                add_context(np.concatenate([x for at in slots(held) for x in (at, between)]), own, counts, context)
        counts, context = counts[:SLOTS], context[:SLOTS]
        for b in range(blocks if counts.any() else 0):
            at = slice(b * size, (b + 1) * size)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([counts[at].tobytes()], pa.binary()), pa.array([context[at].tobytes()], pa.binary())], ["block", "counts", "context"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, context, block = np.zeros(size, np.int64), np.zeros(size * DIM, np.int64), None
        for batch in batches:
            for b, n, c in zip(*(batch.column(i) for i in range(3)), strict=True):
                block = b.as_py()
                counts += np.frombuffer(n.as_buffer(), np.int64)
                context += np.frombuffer(c.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.array([context.tobytes()], pa.binary())], ["block", "counts", "context"])

    index = index_vectors()
    counts, context = np.zeros(SLOTS), np.zeros_like(index)
    for r in docs.mapInArrow(lean(run), schema).groupBy("block").applyInArrow(add, schema).collect():
        at = slice(r["block"] * size, (r["block"] + 1) * size)
        counts[at], context[at] = np.frombuffer(r["counts"], np.int64), np.frombuffer(r["context"], np.int64).reshape(size, DIM)
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    share = counts / max(1.0, counts.sum())
    return norm(norm(index) + norm(context)).astype(np.float16), 1e-3 / (1e-3 + share)


def train(docs: list[np.ndarray], labels: np.ndarray, words: np.ndarray, weights: np.ndarray, seed: int = 1) -> Model:
    y = labels.astype(np.float64)
    parts = {"words": words, "weights": weights, "temperature": np.ones(1), "w2": np.zeros(0), "b2": np.zeros(1)}
    share = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        parts["b2"] = np.array([float(np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1)))]) if len(y) else np.zeros(1)
        return Model(parts)
    model = Model(parts)
    x = np.array([model.pool(d) for d in docs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    parts |= {"mean": x[own].mean(0), "scale": x[own].std(0) + 1e-6}
    z = (x - parts["mean"]) / parts["scale"]
    net = {"w1": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), "b2": np.full(1, np.log(share / (1 - share)))}
    m, v = ({k: np.zeros_like(w) for k, w in net.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(own)
        for i in range(0, len(shuffled), 64):
            b = shuffled[i : i + 64]
            h = np.tanh(z[b] @ net["w1"] + net["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ net["w2"] + net["b2"], -40, 40))) - y[b, None]) / len(b)
            dh = (d @ net["w2"].T) * (1 - h * h)
            grads = {"w1": z[b].T @ dh + 1e-3 * net["w1"], "b1": dh.sum(0), "w2": h.T @ d + 1e-3 * net["w2"], "b2": d.sum(0)}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net[k] -= 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    parts |= net
    if len(held):
        logit, yes = model.logits(x[held]), y[held]
        loss = lambda t: np.logaddexp(0, np.where(yes > 0, -1, 1) * logit / t).mean()
        parts["temperature"] = np.array([min(np.geomspace(0.3, 10, 60), key=loss)])
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """A model from at most ``max_rows`` labelled rows that are not held out."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")).filter(~held_out("id"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    vectors = word_vectors(docs.select(F.col(text_col).cast("string").alias("text")))
    told = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(own), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))

    def run(it):
        found = []
        for batch in it:
            y = batch.column(1).to_pylist()
            for start, held in texts(batch, "text"):
                found += [(zlib.crc32(t), len(t), x, label) for t, x, label in zip(held, slots(held), y[start:], strict=False)]
        found.sort(key=lambda r: r[:2])
        model = train([r[2] for r in found], np.array([r[3] for r in found]), *told.value)
        yield pa.RecordBatch.from_pydict({"model": [model.to_bytes()]}, schema=pa.schema([("model", pa.binary())]))

    made = rows.repartition(1).mapInArrow(lean(run), "model binary").first()
    return bytes(made["model"]) if made else train([], np.zeros(0), *vectors).to_bytes()


def _scored(rows: DataFrame, model: bytes, text_col: str) -> DataFrame:
    """``rows`` with a last column _score, which they lack."""
    from pyspark.sql.types import DoubleType, StructType

    told = rows.sparkSession.sparkContext.broadcast(model)

    def run(it):
        own = Model.from_bytes(told.value)
        for batch in it:
            out = []
            for _, held in texts(batch, text_col):
                out += own.scores(np.array([own.pool(at) for at in slots(held)])).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "_score"])

    return rows.mapInArrow(lean(run), StructType([*rows.schema.fields]).add("_score", DoubleType()))


def classify(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = _scored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), model, "text")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: bytes, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is at least ``least``, with the columns of ``docs``, whatever their names."""
    mine = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = _scored(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()]), model, mine[text_col])
    return rows.filter(F.col("_score") >= least).select(*[F.col(n).alias(c) for c, n in mine.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
