"""Corpora that are written once and read back, in this session or a later one, without being computed again.

A corpus whose named chunks are all spans of one frame is stored by rows: a table with a document's
atoms and, for each name, the intervals of its chunks in arrays of one row.  What is computed from it
is computed in the row.

Any other corpus is stored by bridges, in tables bucketed alike: atoms by id, and for each name
chunks by id, the bridge by atom, and the chunks' atoms by chunk.  Joins of atoms with a bridge,
of bridges with each other, of chunks with what is grouped by them, and the grouping itself then need no
exchange; an executor that is lost costs a read of its buckets.  A chunk's atoms lie in one
bucket, as they meet in one task wherever they are gathered; ``gathered=False`` leaves those tables out,
and the even bridge serves instead.

The manifest is written last, so a store that can be opened is whole.  Ids may be null, and rows may
repeat; empty tables give empty ones.  Attributes keep their names and types.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import Chunks, Corpus, Frame, Spans, _free
from ..functions.arrays import fenced
from .text import corpus_of_frame


#: Stored tables repeat ids and keys; written with Spark's own codec, those of line items took 60 MB rather than 43.
PACKED = "zstd"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` that goes when the application ends; of this machine only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loomtext-")
    path = f"{base.rstrip('/')}/loomtext/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def _write_buckets(rows: DataFrame, path: str, key: str, buckets: int) -> str:
    """Write ``rows`` bucketed by ``key``, a file for each bucket, and give their schema; the name in the catalog is dropped, the files stay."""
    name = f"loomtext_{uuid.uuid4().hex}"
    rows.repartition(buckets, F.col(f"`{key}`")).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("compression", PACKED).option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")
    return rows.schema.toDDL()


def _read_buckets(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """The table as it was written, known to Spark as bucketed: the catalog holds its name as long as the session."""
    name = f"loomtext_{uuid.uuid4().hex}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def _frame_of(corpus: Corpus) -> Frame | None:
    """The one frame whose spans all named chunks are."""
    frames = {c.spans.frame if c.spans is not None and c.fresh and not c.filtered else None for c in corpus.chunks.values()}
    return frames.pop() if len(frames) == 1 else None


def _save_rows(corpus: Corpus, frame: Frame, path: str) -> dict:
    kinds, whole, table = [], ["id"], frame.table
    for j, (name, c) in enumerate(corpus.chunks.items()):
        kinds.append({"name": name, "attributes": c.spans.attributes, "whole": c.spans.whole})
        whole += [a for a in c.spans.attributes if c.spans.whole and a not in whole]
    taken = [*whole, *table.columns]
    stored = {"atoms": _free(taken, "__atoms"), "place": _free(taken, "__place"), "spans": _free(taken, "__spans")}
    own = {n: f"f{i}" for i, n in enumerate(frame.fields)}
    native = [k for k in frame.keys or {} if k in corpus.chunks and corpus.native(k, frame)]
    keys = {k: f"k{i}" for i, k in enumerate(native)}
    atoms = F.transform(f"`{frame.atoms}`", lambda x, i: F.struct(*[frame.fields[n](x, i).alias(f) for n, f in own.items()], *[frame.keys[k](x).alias(f) for k, f in keys.items()]))
    spans = [c.spans.items().alias(f"s{j}") for j, c in enumerate(corpus.chunks.values()) if not c.spans.whole]
    rows = table.select(*[F.col(f"`{a}`") for a in whole], fenced(atoms).alias(stored["atoms"]), F.struct(*spans or [F.lit(0).alias("none")]).alias(stored["spans"]))
    rows.write.parquet(f"{path}/rows")
    return {"form": "rows", "schema": rows.schema.toDDL(), "kinds": kinds, "fields": own, "keys": keys, "consecutive": frame.consecutive, "plain": frame.plain, **stored}


def _open_rows(spark: SparkSession, path: str, told: dict) -> Corpus:
    table = spark.read.schema(told["schema"]).parquet(f"{path}/rows")
    fields = {n: (lambda x, i, f=f: x[f]) for n, f in told["fields"].items()}
    keys = {k: (lambda x, f=f: x[f]) for k, f in told["keys"].items()}
    frame = Frame(table, told["atoms"], fields, (), keys, told["consecutive"], told["plain"], told["place"])
    kinds = {k["name"]: Spans(frame, k["attributes"], None if k["whole"] else F.col(f"`{told['spans']}`.s{j}")) for j, k in enumerate(told["kinds"])}
    return corpus_of_frame(frame, kinds)


def _save_bridges(corpus: Corpus, path: str, buckets: int, gathered: bool) -> dict:
    schemas: dict[str, str] = {}

    def write(rows: DataFrame, name: str, key: str) -> None:
        schemas[name] = _write_buckets(rows, f"{path}/{name}", key, buckets)

    write(corpus.atoms, "atoms", "id")
    for j, c in enumerate(corpus.chunks.values()):
        write(c.chunks, f"chunks-{j}", "id")
        write(c.bridge().select("chunk", "atom"), f"bridge-{j}", "atom")
        if gathered:
            write(c.members(), f"members-{j}", "_chunk")
    return {"form": "bridges", "kinds": list(corpus.chunks), "buckets": buckets, "schemas": schemas}


def _open_bridges(spark: SparkSession, path: str, told: dict) -> Corpus:
    def read(name: str, key: str) -> DataFrame | None:
        return _read_buckets(spark, f"{path}/{name}", told["schemas"][name], key, told["buckets"]) if name in told["schemas"] else None

    corpus = Corpus(read("atoms", "id"))
    for j, name in enumerate(told["kinds"]):
        corpus.set_chunk(name, Chunks(corpus, read(f"chunks-{j}", "id"), read(f"bridge-{j}", "atom"), read(f"members-{j}", "_chunk")), persist=False)
    return corpus


def save_corpus(corpus: Corpus, path: str, buckets: int | None = None, gathered: bool = True) -> None:
    """Write a corpus and its named chunks under ``path``, a folder that is not there yet or empty.

    ``buckets`` (by default as many as shuffles have partitions) should let a bucket fit a task; it
    is of no account where the corpus is stored by rows.
    """
    spark = corpus.atoms.sparkSession
    if (frame := _frame_of(corpus)) is not None:
        told = _save_rows(corpus, frame, path)
    else:
        told = _save_bridges(corpus, path, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), gathered)
    spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.text(f"{path}/manifest")


def open_corpus(spark: SparkSession, path: str) -> Corpus:
    """The corpus that ``save_corpus`` wrote under ``path``; what is computed from it starts at its tables."""
    told = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return (_open_rows if told["form"] == "rows" else _open_bridges)(spark, path, told)
