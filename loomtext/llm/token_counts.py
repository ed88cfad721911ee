"""Token counts of whole texts by a two-tier lookup on the map side.

No piece of the vocabulary has a white-space mark after another character, and
none holds a line feed (both are checked when the model is loaded), so merges
never cross the places before a run of spaces or around a line feed.  A text is
the concatenation of such pre-tokens and its count the sum of theirs.

The first tier is a compact table of frequent pre-tokens and their lengths,
learned from ``sample_rows`` rows (a parameter; it decides speed only) of the first
``PARTS`` partitions, each of which sends its most frequent ones to the driver, and
broadcast: at most ``table_size`` pre-tokens of 48 characters.  Misses are encoded
by the library and held in a bounded cache of the worker.  There is no shuffle.

A null text counts as empty and has no tokens; special strings inside texts are
ordinary text, as the library treats them by default.  Repeated rows stay
repeated; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, documents, lean, texts

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Partitions whose first rows the table is learned from.
PARTS = 4
SPACE = "▁"
#: Spaces and what follows, up to a space or line feed; or trailing spaces; or a line feed.
PRETOKEN = re.compile(" *[^ \n]+| +|\n")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def load(path: str):
    """The processor, after checking what the split into pre-tokens rests on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "\n" in piece or SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {i} crosses pre-tokens")
    if model.encode("a  b") == model.encode("a b") or model.encode(" a") == model.encode("a"):
        raise ValueError("the model does not keep spaces")
    return model


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text with its dummy space; they joined are the text again."""
    return PRETOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


def piece_length(model):
    """Tokens of a pre-token as it stands inside a text.

    The processor puts a space before what it encodes; a lone line feed before
    the pre-token (always one token, never merged) keeps that space apart.
    """
    base = len(model.encode("\n"))

    def length(token: str) -> int:
        if token == "\n":
            return len(model.encode("\n\n")) - base
        return len(model.encode("\n" + token)) - base

    return length


def pack(lengths: dict[str, int]) -> bytes:
    """The compact table: lengths as 32-bit numbers, then the pre-tokens, NUL between them."""
    held = {k: v for k, v in lengths.items() if "\0" not in k and v < 1 << 32}
    return np.array([len(held), *held.values()], np.uint32).tobytes() + "\0".join(held).encode()


def unpack(data: bytes) -> dict[str, int]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return dict(zip(data[4 * (n + 1) :].decode().split("\0"), np.frombuffer(data, np.uint32, n, 4).tolist(), strict=True)) if n else {}


def frequent(docs: DataFrame, path: str, text_col: str = "text", sample_rows: int = 2000, table_size: int = 16384) -> bytes:
    """The packed table of the pre-tokens most frequent in ``sample_rows`` rows.

    Every partition would give one row, and only the first few are asked for, so no more are run.
    """
    own_rows = max(1, sample_rows // PARTS)

    def count(it):
        seen, left = Counter(), own_rows
        for batch in it:
            for _, held in texts(batch.slice(0, left), "text"):
                for t in held:
                    seen.update(x for x in pretokens(t.decode("utf-8", "replace")) if len(x) <= 48)
                if len(seen) > 1_000_000:
                    seen = Counter(dict(seen.most_common(500_000)))
            left -= min(left, batch.num_rows)
            if not left:
                break
        top, length = seen.most_common(table_size), piece_length(load(path))
        yield pa.RecordBatch.from_pydict({"token": pa.array([[k for k, _ in top]], pa.list_(pa.string())), "n": pa.array([[n for _, n in top]], pa.list_(pa.int64())), "length": pa.array([[length(k) for k, _ in top]], pa.list_(pa.int64()))})

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lean(count), "token array<string>, n array<bigint>, length array<bigint>").take(PARTS)
    seen, lengths = Counter(), {}
    for r in rows:
        seen.update(dict(zip(r["token"], r["n"], strict=True)))
        lengths |= dict(zip(r["token"], r["length"], strict=True))
    return pack({k: lengths[k] for k, _ in seen.most_common(table_size)})


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, **table) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""
    tier = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text_col, **table))
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(it):
        model = load(path)
        first = unpack(tier.value)
        second = BoundedCache(piece_length(model))

        class Tiers(dict):
            def __missing__(self, key):
                return second[key]

        tiers = Tiers(first).__getitem__
        for batch in it:
            sizes, counts = [], []
            for _, held in texts(batch, "text"):
                for t in held:
                    sizes.append(len(t))
                    counts.append(sum(map(tiers, pretokens(t.decode("utf-8", "replace")))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(lean(run), f"doc_id {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), model_path())
