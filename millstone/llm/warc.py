"""Operator 10: WARC archives: monolithic gzip in, one gzip member per record out.

``write_monolithic`` writes one WARC record per page with Spark's text writer:
the record separator is the line separator, and each output file is a single
gzip stream. ``normalise`` streams every such file once, in bounded buffers,
and rewrites each record as a gzip member of its own, next to a sidecar with
the offset and length of every member. ``read_archives`` seeks by the sidecar.

Files live in the shared checkpoint folder. A task writes under a name of its
own attempt and renames at the end, so a lost executor leaves nothing half-done
under a final name and a repeated task gives the same file.

Revisits: of records with equal payloads of at least ``MIN_REVISIT`` bytes the
largest page id keeps the payload, the others refer to it. Groups are
pre-aggregated by digest; only groups of two or more are joined back.

Defined results: null html is an empty payload; null url is empty; a null page id is
written as an empty id and reads back as null (it revisits like any other, and is
referred to by nobody); repeated rows with the group's largest id are all responses;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm.common import pick, prepare_session
from millstone.session import scratch_path

MIN_REVISIT = 1000
END = "\r\n\r\n"
BUFFER = 1 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = pa.schema([("archive", pa.string()), ("n_records", pa.int64())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())])
_RECORDS_DDL = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
                "digest_ok boolean")


def _fs(uri: str):
    """(file system, path): the plain file system, or what pyarrow knows for the URI's scheme."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


@contextmanager
def _replacing(*uris: str):
    """Output streams under attempt names, renamed to the final ones at the end."""
    attempt = f".attempt-{TaskContext.get().taskAttemptId()}-{os.getpid()}"
    opened = [(*_fs(u),) for u in uris]
    streams = [f.open_output_stream(p + attempt, compression=None) for f, p in opened]
    yield streams
    for (f, p), s in zip(opened, streams):
        s.close()
        f.move(p + attempt, p)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, record): WARC records as text, without the closing blank lines."""
    p = pick(pages, page_id=page_id, url=url, html=html).select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]+", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html").cast("bigint")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    same = (p.where(F.col("n") >= min_revisit).groupBy(F.col("digest").alias("d"), F.col("n").alias("m"))
            .agg(F.max("page_id").alias("newest"), F.count("*").alias("copies")).where("copies > 1"))
    p = p.join(same, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")), "left")
    again = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    common = [line("WARC-Record-ID", urn("page_id")), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.col("url")),
              line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("n").cast("string"))]
    revisit = F.concat(F.lit("WARC/1.1\r\nWARC-Type: revisit\r\n"), *common, line("WARC-Profile", F.lit(PROFILE)),
                       line("WARC-Refers-To", urn("newest")), F.lit("Content-Length: 0\r\n\r\n"))
    response = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\n"), *common, F.lit("Content-Type: text/html; charset=utf-8\r\n"),
                        line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"), F.col("html"))
    return p.select("page_id", F.when(again, revisit).otherwise(response).alias("record"))


def write_monolithic(recs: DataFrame, path: str) -> None:
    """One gzip stream per output file, records closed by the blank lines that WARC asks for."""
    recs.select("record").write.option("lineSep", END).option("compression", "gzip").text(path)


def _record_bytes(stream) -> Iterator[bytes]:
    """Records of an inflated stream: headers to the blank line, then Content-Length bytes."""
    held, inflate = bytearray(), zlib.decompressobj(31)

    def more() -> bool:
        nonlocal inflate
        raw = stream.read(BUFFER)
        if not raw:
            return False
        while raw:
            held.extend(inflate.decompress(raw))
            raw = inflate.unused_data
            if raw:  # a further member of a file that is not one stream
                inflate = zlib.decompressobj(31)
        return True

    while True:
        while (head := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
        size = head + 4 + int(_headers(bytes(held[:head]))["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(held[:size])
        del held[:size]


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for x in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = x.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _normalise(out_dir: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for src in b.column(0).to_pylist():
                name = posixpath.basename(src).split(".")[0] + ".warc.gz"
                target = posixpath.join(out_dir, name)
                fs, path = _fs(src)
                n = at = 0
                with fs.open_input_stream(path, compression=None) as f, _replacing(target, target + ".idx") as (gz, idx):
                    for rec in _record_bytes(f):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(rec) + z.flush()
                        gz.write(member)
                        idx.write(f"{at}\t{len(member)}\n".encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], schema=_INDEX)
    return run


def normalise(spark, src: str, out_dir: str, level: int = LEVEL) -> DataFrame:
    """Rewrite every monolithic archive under ``src``; (archive, n_records), written as a table."""
    prepare_session(spark)
    fs, path = _fs(out_dir)
    fs.create_dir(path, recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(src).select("path")
    n = max(1, files.count())
    listing = files.repartition(n, "path").mapInArrow(_normalise(out_dir, level), "archive string, n_records bigint")
    listing.write.parquet(out_dir + "-listing")
    return spark.read.parquet(out_dir + "-listing")


def _id(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for archive in b.column(0).to_pylist():
            fs, path = _fs(archive)
            rows = []
            with fs.open_input_stream(path + ".idx", compression=None) as idx, fs.open_input_file(path) as f:
                left, done = b"", False
                while not done:
                    chunk = idx.read(BUFFER)
                    done = not chunk
                    *lines, left = (left + chunk).split(b"\n")
                    for x in lines:
                        at, size = map(int, x.split(b"\t"))
                        rec = zlib.decompress(f.read_at(size, at), 31)
                        cut = rec.index(b"\r\n\r\n")
                        h = _headers(rec[:cut])
                        kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                        body = rec[cut + 4:-4]
                        rows.append((_id(h["warc-record-id"]), int(h["x-payload-length"]), digest, kind, _id(h.get("warc-refers-to")),
                                     kind == "revisit" or hashlib.sha1(body).hexdigest() == digest))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(_RECORDS.names, r)) for r in rows], schema=_RECORDS)
                            rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(_RECORDS.names, r)) for r in rows], schema=_RECORDS)


def read_archives(listing: DataFrame) -> DataFrame:
    """Every record of the listed archives, found by the sidecar offsets."""
    prepare_session(listing.sparkSession)
    n = max(1, listing.count())
    return listing.select("archive").repartition(n, "archive").mapInArrow(_read, _RECORDS_DDL)


def write_and_read(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages to monolithic archives, normalised, read back."""
    import uuid

    spark = pages.sparkSession
    base = scratch_path(spark, f"millstone/warc-{uuid.uuid4().hex[:12]}")
    write_monolithic(records(pages, page_id, url, html), base + "/mono")
    return read_archives(normalise(spark, base + "/mono", base + "/members"))
