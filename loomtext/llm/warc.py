"""WARC archives: writing captures, reading them back and assembling transactions.

``write_archive`` turns a table of pages into WARC/1.1 request, response or
revisit, and metadata records.  Records are the rows of a text file whose line
separator is the record terminator, so Spark's own committer writes them (whole
files or none, also when an executor is lost) to any file system it knows.

``read_records`` parses archives by Content-Length, a gzip stream at a time; what is
damaged of an archive comes as a record of that type, which ``assemble`` leaves out.
``assemble`` joins request, response and metadata records through
WARC-Concurrent-To and emits one nested row per capture.

Defined cases: a null payload is empty; a null url leaves the target header out
and comes back as null; control characters of a url are percent-encoded in
headers while the metadata record keeps the url exactly.  Of equal payloads of
at least ``min_revisit`` bytes the smallest id is the response and the others
revisit it; rows that repeat this id are responses themselves; a null id comes
last.  A capture without request or metadata has null there; records whose
concurrent-to names no capture give a row with a null response.  Of several
requests (or metadata records) of a capture the smallest record id is taken.
Empty tables give no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batches, lean
from .screen import split_by

CRLF = "\r\n"
#: Rows of a file at most: readers take whole files.
RECORDS_PER_FILE = 6000
RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, profile string, payload_bytes bigint, payload_digest string, digest_ok boolean, fields string"


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: each 5 hex digits make 4 characters."""
    part = lambda i: F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.upper(F.concat(*map(part, range(8)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: Column | str, fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields]
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def choose_revisits(pages: DataFrame, min_revisit: int, work: Workspace) -> DataFrame:
    """``pages`` (id, url, html, sha, bytes) with rid, first (the id to revisit) and refers (its record id), null for responses.

    Of pages that revisit no html moves, it is dropped at once: others are found by filters where
    they lie.  Those whose payload others have too are written first, with their record ids.
    """
    urn = lambda: F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))  # noqa: E731  each with a seed of its own
    groups = work.save(pages.filter(F.col("bytes") >= min_revisit).groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "least"), "groups")
    pages = pages.withColumn("place", F.xxhash64("sha"))
    alone, others = split_by(pages, F.col("place"), groups.select(F.xxhash64("sha").alias("k")))
    rows = others.select("id", "url", "sha", "bytes").join(groups, "sha", "left")
    stays = F.col("least").isNull() | F.col("id").eqNullSafe(F.col("least")) | (F.col("bytes") < min_revisit)
    kept = rows.filter(stays).select(F.xxhash64("sha", "id").alias("k")).distinct()
    _, whole = split_by(others, F.xxhash64("sha", "id"), kept)
    whole = whole.join(groups, "sha", "left").filter(stays).select("id", "url", "html", "sha", "bytes", "least", urn().alias("rid"))
    whole = work.save(whole, "responses")
    first = whole.filter("least IS NOT NULL").groupBy("sha").agg(F.min("rid").alias("refers"))
    none = lambda kind: F.lit(None).cast(kind)
    id_type = pages.schema["id"].dataType
    columns = ["id", "url", "html", "sha", "bytes", "rid", "first", "refers"]
    whole = whole.withColumns({"first": none(id_type), "refers": none("string")}).select(columns)
    revisits = rows.filter(~stays).join(first, "sha").withColumns({"html": F.lit(""), "rid": urn(), "first": F.col("least")}).select(columns)
    out = whole.unionByName(revisits)
    return out if alone is None else out.unionByName(alone.withColumns({"rid": urn(), "first": none(id_type), "refers": none("string")}).select(columns))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "bytes": F.octet_length("html")})
    # One random id per row; all three records of a capture are cut from the same row.
    rows = choose_revisits(rows, min_revisit, Workspace(pages.sparkSession, "warc-revisits"))
    mine = lambda suffix: F.concat(F.substring("rid", 1, 46), F.lit(f"{suffix}>"))  # noqa: E731  <urn:uuid: and the id without >
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    when = F.lit(date)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("refers").isNotNull()
    main = _record(F.when(revisit, "revisit").otherwise("response"), [("WARC-Record-ID", F.col("rid")), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.hex("sha")))), ("WARC-Refers-To", F.col("refers")), ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))], F.when(revisit, http).otherwise(F.concat(http, F.col("html"))))
    host = F.coalesce(F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    request = _record("request", [("WARC-Record-ID", mine("-request")), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)))
    metadata = _record("metadata", [("WARC-Record-ID", mine("-metadata")), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/json"))], F.to_json(F.struct("id", "url")))
    # The line separator ends each record, as the standard's CRLF CRLF.
    rows.select(F.explode(F.array(request, main, metadata)).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Stream:
    """Bytes of an archive, inflated as they are asked for; gzip members may follow each other."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.z = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        chunk = bytes(self.data[self.at : self.at + (1 << 18)])
        self.at += len(chunk)
        if self.z is None:
            self.held += chunk
            return True
        while chunk:
            self.held += self.z.decompress(chunk)
            if not self.z.eof:
                break
            chunk, self.z = self.z.unused_data, zlib.decompressobj(31)
        return True

    def upto(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        out = bytes(self.held[:k])
        del self.held[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise ValueError("archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of one archive, plain or gzip.

    At a record that is cut short, lacks a length or is none at all the rest of the archive is
    given up: it comes as a last record of the type damaged, with the headers read so far.
    """
    stream = _Stream(data)
    fields: dict[str, str] = {}
    try:
        while (head := stream.upto(b"\r\n\r\n")) is not None:
            fields = {}
            lines = head.decode("utf-8", "surrogateescape").lstrip("\r\n").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            for line in lines[1:]:
                name, _, value = line.partition(":")
                fields.setdefault(name.strip().lower(), value.strip())
            size = int(fields.get("content-length", "none"))
            if size < 0:
                raise ValueError("negative length")
            block = stream.take(size)
            yield fields, block
            if stream.take(4) != b"\r\n\r\n":
                raise ValueError("record without its end")
        if stream.held.strip():
            raise ValueError("archive ends inside a record")
    except (ValueError, zlib.error):
        yield fields | {"warc-type": "damaged"}, b""


def _row(h: dict[str, str], block: bytes) -> dict:
    kind, digest = h.get("warc-type"), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    out = {"type": kind, "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "profile": h.get("warc-profile"), "payload_bytes": None, "payload_digest": digest, "digest_ok": None, "fields": None}
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out |= {"payload_bytes": len(payload), "payload_digest": own, "digest_ok": digest in (None, own)}
        elif m := re.search(rb"(?im)^content-length:\s*(\d+)", head):
            out["payload_bytes"] = int(m[1])
    elif kind == "metadata":
        out["fields"] = block.decode("utf-8", "replace")
    return out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, whatever their names: headers, and of payloads length and digest.

    Files whose names begin with an underscore or a point are none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    schema = to_arrow_schema(spark.createDataFrame([], RECORD).schema)

    def run(it):
        for b in it:
            for data in b.column(0):
                yield from batches((_row(h, block) for h, block in parse(data.as_py())), schema)

    return files.mapInArrow(lean(run), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata.

    A metadata record may be concurrent to the capture itself or to its request.
    """
    main = F.col("type").isin("response", "revisit")
    others = records.filter(F.col("type").isin("request", "metadata"))
    tied = others.filter("concurrent_to IS NOT NULL")
    via = tied.filter("type = 'request'").groupBy("record_id").agg(F.min("concurrent_to").alias("through")).withColumnRenamed("record_id", "hop")
    # Only metadata can go through a request, and only records that name another are joined.
    hopped = tied.filter("type = 'metadata'").join(via, F.col("concurrent_to") == F.col("hop"), "left").drop("hop")
    none = F.lit(None).cast("string")
    rows = hopped.unionByName(tied.filter("type = 'request'").withColumn("through", none)).withColumn("capture_id", F.coalesce("through", "concurrent_to"))
    rows = rows.unionByName(others.filter("concurrent_to IS NULL").unionByName(records.filter(main)).withColumns({"through": none, "capture_id": F.col("record_id")}))
    of = lambda test, *cols: F.min(F.when(test, F.struct("record_id", *cols)))
    return rows.groupBy("capture_id").agg(of(main, "type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "digest_ok", "profile").alias("response"), of(F.col("type") == "request", "target_uri").alias("request"), of(F.col("type") == "metadata", "fields").alias("metadata"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    path = work.path + "/archive"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    work.keep()
    # The archives are parsed once; what is kept of a record is small.
    rows = assemble(work.save(read_records(spark, path), "records")).withColumn("page_id", F.from_json("metadata.fields", "id bigint").getField("id"))
    rows = work.save(rows.select("capture_id", "page_id", "response.*"), "captures")
    out = lambda df, refers: df.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), refers.alias("refers_to"))
    named = rows.filter("type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("first"))
    first = rows.filter("type = 'revisit'").select("refers_to").distinct().join(named, "refers_to")
    revisits = rows.filter("type = 'revisit'").join(first, "refers_to")
    return out(rows.filter("type = 'response'"), F.lit(None).cast("bigint")).unionByName(out(revisits, F.col("first")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS least,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST(concat('0x', substr(hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to FROM b
"""
