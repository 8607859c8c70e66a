"""WARC archives: writing, normalising monolithic gzip files, and reading by offset index.

A monolithic archive is one gzip stream over all its records, so nothing in it can be reached without
inflating everything before it. The normaliser inflates such a stream once, piece by piece, rewrites
every record as a gzip member of its own and writes a sidecar index (offset, length, record id, type)
beside the archive; readers then fetch members by range.

Archives lie in the shared folder. A task writes files under names of its own attempt and returns them
as manifest rows; only rows of attempts that Spark committed are read, so a lost executor leaves at
most unread files. Names are opened through pyarrow's file systems (local, hdfs, s3, ...).

Nulls and edges: a null payload is empty; a null url is left out; line breaks in header values are
percent-encoded; payloads under min_revisit bytes are always responses; a null id is always a
response; rows that repeat the smallest id of a payload are responses too; an empty table writes no
archive; equal payloads go to the smallest id; other columns are left behind. A record, of any length, is held
in memory once, an archive never.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, materialize, table

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_READ = 1 << 20
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20


def _value(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in text or "\n" in text else text


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    number = urn[len("<urn:page:") : -1]
    return int(number) if number else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head (and so the payload's length) without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_value(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {"": lines[0]} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of uncompressed bytes in records; what is held is one record and one piece."""
    held = bytearray()  # grows in place: a record of many pieces is copied once
    for piece in pieces:
        held += piece
        at = 0
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            stop = end + 8 + int(parse_head(bytes(held[at:end]))["content-length"])
            if len(held) < stop:
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("an archive ends inside a record")


def inflate(stream: pa.NativeFile) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in bounded pieces."""
    unzip, open_member = zlib.decompressobj(31), False
    while data := stream.read(_READ):
        while data:
            open_member = True
            piece = unzip.decompress(data, _READ)
            if piece:
                yield piece
            if unzip.eof:
                data, unzip, open_member = unzip.unused_data, zlib.decompressobj(31), False
            else:
                data = unzip.unconsumed_tail
    rest = unzip.flush()
    if rest:
        yield rest
    if open_member and not unzip.eof:
        raise ValueError("an archive ends inside a gzip member")


def write_archives(records: DataFrame, folder: str, *, limit: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Write records (page_id, url, html, digest, refers_to) as monolithic archives; returns their manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = zipper = path = None
        size = count = 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")], strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, zipper, size, count = store.open_output_stream(path, compression=None), zlib.compressobj(level, wbits=31), 0, 0
                out.write(zipper.compress(encode_record(page_id, url, html or b"", digest, refers_to)))
                size, count = size + len(html or b""), count + 1
                if size >= limit:
                    out.write(zipper.flush())
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.write(zipper.flush())
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    plain = records.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to")
    return materialize(plain.mapInArrow(run, "path string, records long"), "warc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """One archive per task or few: a manifest row stands for a whole file."""
    return manifest.repartition(max(1, min(manifest.count(), 100_000)))


def normalise(manifest: DataFrame, folder: str, *, level: int = 6) -> DataFrame:
    """Rewrite each archive with a gzip member per record and a sidecar index; returns (path, index_path, records)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for part in parts:
            rows = []
            for path in part["path"]:
                target = f"{root}/{uuid.uuid4().hex}"
                count = at = 0
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(f"{target}.warc.gz", compression=None) as out, store.open_output_stream(f"{target}.idx", compression=None) as index:
                    for record in split_records(inflate(source)):
                        zipper = zlib.compressobj(level, wbits=31)
                        member = zipper.compress(record) + zipper.flush()
                        head = parse_head(record[: record.index(b"\r\n\r\n")])
                        entry = {"id": head["warc-record-id"], "type": head["warc-type"], "offset": at, "length": len(member)}
                        out.write(member)
                        index.write((json.dumps(entry) + "\n").encode())
                        at, count = at + len(member), count + 1
                rows.append((f"{target}.warc.gz", f"{target}.idx", count))
            yield pd.DataFrame(rows, columns=["path", "index_path", "records"])

    return materialize(_spread(manifest).mapInPandas(run, "path string, index_path string, records long"), "warc-index")


def read_member(data: bytes) -> dict:
    """One record from its gzip member: id, type, length and digest of the payload (a revisit's from its heads), refers_to, payload."""
    record = zlib.decompress(data, 31)
    end = record.index(b"\r\n\r\n")
    head = parse_head(record[:end])
    block = record[end + 4 : end + 4 + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n") + 4
    payload = block[cut:]
    out = {"page_id": page_of(head["warc-record-id"]), "record_type": head["warc-type"], "url": head.get("warc-target-uri")}
    if head["warc-type"] == "revisit":
        return out | {"payload_bytes": int(parse_head(block[: cut - 4])["content-length"]), "payload_digest": head["warc-payload-digest"].removeprefix("sha256:"), "refers_to": page_of(head["warc-refers-to"]), "payload": None}
    digest = hashlib.sha256(payload).hexdigest()
    if head["warc-payload-digest"] != f"sha256:{digest}":
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "refers_to": None, "payload": payload}


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Rows of normalised archives, each record fetched by the range its sidecar index gives."""
    fields = [("page_id", "long"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"), ("url", "string")]
    fields += [("payload", "binary")] * with_payload
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in fields], names=[n for n, _ in fields])

        for batch in batches:
            for path, index_path in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist(), strict=True):
                rows: list[dict] = []
                with store.open_input_stream(index_path, compression=None) as entries, store.open_input_file(path) as archive:
                    for line in entries.read().splitlines():
                        entry = json.loads(line)
                        rows.append(read_member(archive.read_at(entry["length"], entry["offset"])))
                        if len(rows) >= 256:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return _spread(index.select("path", "index_path")).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))


def with_revisits(pages: DataFrame, *, min_revisit: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the smallest id with the same payload, where that is another.

    A popular payload is one key with many rows; only Spark's own skew handling splits such a join, and it can,
    since nothing after it needs the rows of a key together.
    """
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = hashed.filter(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first_id")
    return hashed.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    monolithic = write_archives(with_revisits(table(spark, sf_dir, "pages")), f"{folder}/monolithic")
    index = normalise(monolithic, f"{folder}/records")
    return read_archives(index, f"{folder}/records").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP4_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url
FROM p LEFT JOIN f ON p.d = f.d
"""
