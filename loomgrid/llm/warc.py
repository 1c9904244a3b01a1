"""WARC archives: monolithic gzip files and their normal form.

``write_archives`` packs pages into archives whose records share one gzip stream (as some crawlers leave
them). ``normalise`` inflates each such stream once, start to end, rewrites every record as a gzip member
of its own and writes a sidecar index of offsets. ``read_back`` fetches each record by its index line.
Archives live in Parquet rows (archive, gz binary) of the shared folder, which any store can hold;
``export_files`` writes them out as files.

Defined cases: a null html is the empty payload; equal payloads (empty ones too) form one group, of which
the smallest page_id is the response and all others revisit it; rows equal in page_id, url and html are one
page written twice, each a response or each a revisit; a null page_id
comes after all others; a null url is written as ``urn:none``; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import utf8

LEVEL = 1
#: Uncompressed bytes after which a new archive begins.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, sha: str, refers_to, refers_url) -> bytes:
    """A response record (HTTP head and payload) or a revisit record (HTTP head only, its payload being the
    one of the record it names)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    body = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {quote(refers_url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}"]
    head.append(f"Content-Length: {len(body)}")
    return b"".join(("\r\n".join(head).encode(), b"\r\n\r\n", body, b"\r\n\r\n"))


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines[1:])


def parse(rec: bytes) -> tuple[dict[str, str], bytes, int]:
    """(WARC head, payload after the HTTP head, full payload length by that head) of one record."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = parse_head(head)
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("record length")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    full = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "response" and len(payload) != full:
        raise ValueError("payload length")
    return fields, payload, full


def records_of(gz: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Records of a stream of one or more gzip members, inflated once in steps; never more than one record and a step held."""
    z, buf, at = zlib.decompressobj(31), bytearray(), 0
    need = None
    while True:
        if need is None:
            cut = buf.find(b"\r\n\r\n")
            if cut >= 0:
                need = cut + 4 + int(parse_head(bytes(buf[:cut]))["Content-Length"]) + 4
        if need is not None and len(buf) >= need:
            yield bytes(buf[:need])
            del buf[:need]
            need = None
            continue
        if z.eof:
            at = min(at, len(gz)) - len(z.unused_data)
            while at < len(gz) and gz[at] == 0:  # padding
                at += 1
            if at == len(gz):
                break
            z = zlib.decompressobj(31)
        chunk = z.unconsumed_tail or gz[at : at + step]
        if not z.unconsumed_tail:
            at += step
        if not chunk:
            raise ValueError("gzip stream breaks off")
        buf += z.decompress(chunk, 1 << 20)
    if buf:
        raise ValueError("bytes after the last record")


def member(rec: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(rec) + z.flush()


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha, refers_to, refers_url): payloads of at least ``min_bytes`` that occurred under a
    smaller page_id refer to the smallest. Grouping is by digest with map-side combine; the join back
    has a row per digest on one side, so Spark can split hot digests of the other."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), utf8(html_col).alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload")))
    first = p.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("late"), F.col("page_id"), F.col("url").isNull().alias("no_url"), F.col("url"))).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("sha", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    j = p.join(first, "sha", "left")
    own = F.col("first_id").eqNullSafe(F.col("page_id")) & F.col("first_url").eqNullSafe(F.col("url"))
    again = ~own & (F.octet_length("payload") >= min_bytes) & (F.col("first_id").isNotNull() | F.col("first_url").isNotNull())
    return j.select("page_id", "url", "payload", F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive string, gz binary): the records of a task, in archives of about ``archive_bytes``."""

    def pack(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        z = out = None
        size = 0
        for b in batches:
            for r in b.to_pylist():
                if z is None:
                    z, out, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0
                rec = record(r["page_id"], r["url"], r["payload"], digest(r["payload"]), r["refers_to"], r["refers_url"])
                out.append(z.compress(rec))
                size += len(rec)
                if size >= archive_bytes:
                    out.append(z.flush())
                    yield pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{n:04d}"], "gz": [b"".join(out)]})
                    z, n = None, n + 1
        if z is not None:
            out.append(z.flush())
            yield pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{n:04d}"], "gz": [b"".join(out)]})

    return records.mapInArrow(pack, "archive string, gz binary")


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, gz, offsets array<long>, lengths array<long>): the archive with a member per record and
    its sidecar index, made in one pass over the inflated stream."""

    def rewrite(batches):
        for b in batches:
            for r in b.to_pylist():
                out, offsets, lengths, at = [], [], [], 0
                for rec in records_of(r["gz"]):
                    m = member(rec)
                    out.append(m)
                    offsets.append(at)
                    lengths.append(len(m))
                    at += len(m)
                yield pa.RecordBatch.from_pydict({"archive": [r["archive"]], "gz": [b"".join(out)], "offsets": pa.array([offsets], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    return archives.mapInArrow(rewrite, "archive string, gz binary, offsets array<long>, lengths array<long>")


def sidecar(normal: DataFrame) -> DataFrame:
    """The index as rows (archive, record, offset, length)."""
    return normal.select("archive", F.posexplode(F.arrays_zip("offsets", "lengths")).alias("record", "at")).select("archive", "record", F.col("at.offsets").alias("offset"), F.col("at.lengths").alias("length"))


def read_back(normal: DataFrame) -> DataFrame:
    """Each record, fetched by its index entry: page_id, url, payload (null for revisits), payload_digest,
    full payload_bytes, record_type, refers_to. Digests of response payloads are verified."""

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = {k: [] for k in ("page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                for o, n in zip(r["offsets"], r["lengths"], strict=True):
                    fields, payload, full = parse(zlib.decompress(r["gz"][o : o + n], 31))
                    kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != sha:
                        raise ValueError(f"digest of {fields['WARC-Record-ID']}")
                    ids = [None if (x := fields.get(k)) is None or x == "<urn:page:None>" else int(x[10:-1]) for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    for k, v in zip(rows, (ids[0], payload if kind == "response" else None, full, sha, kind, ids[1]), strict=True):
                        rows[k].append(v)
                    if len(rows["page_id"]) == 256:
                        yield out_batch(rows)
                        rows = {k: [] for k in rows}
                if rows["page_id"]:
                    yield out_batch(rows)

    def out_batch(rows):
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return normal.mapInArrow(read, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export_files(normal: DataFrame, folder_uri: str) -> DataFrame:
    """Writes ``<archive>.warc.gz`` and ``<archive>.idx`` (tab-separated record, offset, length) to a folder that
    every executor reaches; returns (archive, bytes). Files are written under their final content, so a
    repeated task rewrites equal files."""

    def put(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(folder_uri)
        store.create_dir(folder, recursive=True)
        for b in batches:
            for r in b.to_pylist():
                with store.open_output_stream(f"{folder}/{r['archive']}.warc.gz", compression=None) as f:
                    f.write(r["gz"])
                lines = "".join(f"{i}\t{o}\t{n}\n" for i, (o, n) in enumerate(zip(r["offsets"], r["lengths"], strict=True)))
                with store.open_output_stream(f"{folder}/{r['archive']}.idx") as f:
                    f.write(lines.encode())
                yield pa.RecordBatch.from_pydict({"archive": [r["archive"]], "bytes": pa.array([len(r["gz"])], pa.int64())})

    return normal.mapInArrow(put, "archive string, bytes long")


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to monolithic archives, to their normal form, and back by the index: one row per page."""
    from loomgrid.llm.common import Scratch, tune, workers

    spark = pages.sparkSession
    tune(spark)
    scratch = Scratch(spark, "warc")
    raw = scratch.save("monolithic", write_archives(revisits(pages), archive_bytes))
    normal = scratch.save("normal", normalise(raw.repartition(workers(spark), "archive")))
    scratch.drop(raw)
    return read_back(normal).drop("payload")
