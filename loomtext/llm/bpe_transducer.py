"""Byte-level BPE by a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly when every token
encodes to itself and every adjacent pair does.  That makes encoding a
finite-state job: a hypothesis is (tokens not yet emitted, last token, bytes of
the next token so far), a state is the set of live hypotheses with the outputs
they agree on taken off, and states and transitions are made only when a text
first needs them.  What all hypotheses agree on is emitted at once, so the
delay is bounded by the longest token.  Pre-tokens that are a token as a whole
are that token, as in the library.

Decoding feeds ids to an incremental UTF-8 state machine that gives whole
characters as soon as they are complete.

A null text counts as empty: no tokens.  Special strings are ordinary text.
Texts are cut only where the pattern cuts them; repeated rows stay repeated;
other columns are ignored.  Caches are bounded and emptying them changes speed
only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, documents, lean, texts

RANKS = "byte_bpe_multi_50k.tiktoken"
# The characters of Unicode's White_Space property.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Token boundaries always lie before white space that follows something else.
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
MOST_STATES = 500_000
#: Recent pre-tokens and chunks that a worker remembers.
REMEMBERED = 300_000
BYTES = [bytes((b,)) for b in range(256)]


def pretoken_pattern(pattern: str):
    """The pattern with white space spelled out, as engines differ about it."""
    pattern = pattern.replace("[^\\s", "[^" + WHITE_SPACE).replace("\\s", f"[{WHITE_SPACE}]").replace("\\S", f"[^{WHITE_SPACE}]")
    return regex.compile(pattern)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.parts = dict.fromkeys((t[:k] for t in ranks for k in range(1, len(t))), -1) | ranks
        self.fits: dict[int, bool] = {}
        self.edges: dict[int, tuple[list[int], list[int]] | None] = {}
        self.clear()

    def clear(self) -> None:
        start = (((), -1, b""),)
        self.states, self.numbers, self.moves = [start], {start: 0}, {}

    def spines(self, token: int) -> tuple[list[int], list[int]] | None:
        """Tokens on the left and on the right edge of a token's merge tree, byte first; None if merging does not make it."""
        if token not in self.edges:
            found = None
            data = self.token[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            left, right = [self.ranks[parts[0]]], [self.ranks[parts[-1]]]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 62:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                left += [rank] * (i == 0)
                right += [rank] * (i == len(parts) - 1)
            else:
                found = left, right
            self.edges[token] = found
        return self.edges[token]

    def fit(self, last: int, token: int) -> bool:
        """May ``token`` follow ``last`` (-1: the start)?

        Walks both edges at the boundary in the order in which merging builds them; a merge
        across the boundary that is due before either side grows rules the pair out.
        """
        key = last << 32 | token
        if (known := self.fits.get(key)) is not None:
            return known
        edge = self.spines(token)
        known = edge is not None
        if known and last >= 0:
            xs, ys = self.spines(last)[1], edge[0]
            i = j = 0
            never = 1 << 62
            while True:
                x = xs[i + 1] if i + 1 < len(xs) else never
                y = ys[j + 1] if j + 1 < len(ys) else never
                across = self.ranks.get(self.token[xs[i]] + self.token[ys[j]], never)
                if across < x and across <= y and across < never:
                    known = False
                    break
                if x == y == never:
                    break
                if x <= y:
                    i += 1
                else:
                    j += 1
        if len(self.fits) > 300_000:
            self.fits.clear()
        self.fits[key] = known
        return known

    def _make(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition, made on first use.  Hypotheses stand by falling length of their open part; at most one has none."""
        after, done, more = [], None, BYTES[byte]
        parts, fits = self.parts, self.fits
        for out, last, part in self.states[number]:
            part += more
            if (t := parts.get(part)) is not None:
                after.append((out, last, part))
                if t >= 0 and done is None:
                    if (fit := fits.get(last << 32 | t)) is None:
                        fit = self.fit(last, t)
                    if fit:
                        done = (*out, t), t, b""
        if done is not None:
            after.append(done)
        k, first = 0, after[0][0]
        for token in first:
            for h in after:
                if len(h[0]) <= k or h[0][k] != token:
                    break
            else:
                k += 1
                continue
            break
        sure = first[:k]
        if k:
            after = [(out[k:], last, part) for out, last, part in after]
        state = tuple(after)
        if (to := self.numbers.get(state)) is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        self.moves[number << 8 | byte] = found = to, sure
        return found

    def _next(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition where it is not there yet; a full table is started anew from the state at hand."""
        if len(self.states) > MOST_STATES:
            held = self.states[state]
            self.clear()
            state = self.numbers.setdefault(held, len(self.states))
            if state == len(self.states):
                self.states.append(held)
        return self._make(state, byte)

    def run(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of a byte stream, each as soon as it is certain."""
        state = 0
        for byte in data:
            state, sure = self.moves.get(state << 8 | byte) or self._next(state, byte)
            yield from sure
        yield from self.states[state][-1][0]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        state, out, get = 0, [], self.moves.get
        for byte in piece:
            if (move := get(state << 8 | byte)) is None:
                move = self._next(state, byte)
                get = self.moves.get
            state, sure = move
            if sure:
                out += sure
        return (*out, *self.states[state][-1][0])


class Utf8:
    """An incremental UTF-8 state machine over bytes; the state is the unfinished character."""

    @staticmethod
    def wants(held: bytes) -> tuple[int, int, int]:
        """(length of the character, least and greatest next byte) after the bytes ``held``."""
        b = held[0]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if len(held) > 1:
            return n, 0x80, 0xBF
        return n, {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)

    @classmethod
    def feed(cls, held: bytes, data: bytes) -> tuple[str, bytes]:
        """(characters completed, bytes still held); an ill-formed part is U+FFFD."""
        out: list[str] = []
        for i in range(len(data)):
            b = data[i : i + 1]
            if held:
                n, low, high = cls.wants(held)
                if low <= b[0] <= high:
                    held += b
                    if len(held) == n:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held = b""
            n = cls.wants(b)[0]
            if n == 1:
                out.append(b.decode())
            elif n == 0:
                out.append("�")
            else:
                held = b
        return "".join(out), held


class Codec:
    """Encoding and streaming decoding of whole texts with one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.pattern = pretoken_pattern(pattern)
        self.pieces = BoundedCache(lambda p: self.machine.encode(p.encode()), REMEMBERED)
        self.chunks = BoundedCache(lambda c: tuple(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(c)))), REMEMBERED)
        size = max(ranks.values()) + 1
        self.names = [str(i) for i in range(size)]
        self.bytes = [self.machine.token.get(i, b"") for i in range(size)]
        self.steps: dict[bytes, list] = {b"": [None] * size}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.chunks.__getitem__, CHUNK.findall(text))))

    def _row(self, held: bytes) -> list:
        if (row := self.steps.get(held)) is None:
            if len(self.steps) > 64:  # lists as long as the vocabulary; forgetting changes speed only
                self.steps = {b"": self.steps[b""]}
            row = self.steps[held] = [None] * len(self.names)
        return row

    def text(self, ids: Iterable[int]) -> str:
        """The decoded text."""
        return "".join(self.decode(ids))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes whole, token by token.

        The UTF-8 machine runs over a token's bytes when its state (the unfinished character, few
        in number) first meets the token; where that led is looked up after that.
        """
        held = b""
        steps = row = self.steps[b""]
        for i in ids:
            if (step := row[i]) is None:
                step = row[i] = Utf8.feed(held, self.bytes[i])
            text, after = step
            if after != held:
                held = after
                row = steps if not held else self._row(held)
            if text:
                yield text
        if held:
            yield "�"


@lru_cache(2)
def load(path: str, pattern: str) -> Codec:
    import gc

    gc.set_threshold(500_000, 50, 100)  # large tables without cycles: looking through them often costs much and frees nothing
    return Codec(read_ranks(path), pattern)


def transcode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and the decoded text."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(it):
        codec = load(path, pattern)
        for batch in it:
            done = 0
            for _, held in texts(batch, "text"):
                counts, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
                for t in held:
                    ids = codec.encode(t.decode("utf-8", "replace"))
                    text = codec.text(ids)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        all_text.append(text)
                cols = {"doc_id": batch.column(0).slice(done, len(held)), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                if with_ids:
                    cols |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(all_text, pa.string())}
                done += len(held)
                yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return transcode(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
