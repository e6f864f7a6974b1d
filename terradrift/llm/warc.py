"""WARC archives written from rows and read back as a table of chunks.

A payload travels as rows ``(record, chunk number, bytes)`` of at most ``chunk_bytes``; the writer streams them
into one gzip member per record and the reader streams them out again, carrying the SHA-1 of all bytes so far, so
no task ever holds a whole record of an oversized payload besides the input row itself.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradrift.session import save_table, work_dir

CHUNK_BYTES = 1 << 20
CHUNK_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, declared_digest string, "
    "declared_bytes bigint, chunk_no int, chunk_bytes int, bytes_so_far bigint, sha1_so_far string, is_last boolean, data binary"
)


def dedup_payloads(records: DataFrame, key: str, payload: str, min_bytes: int = 1000) -> DataFrame:
    """Mark each record as response or revisit.

    ``payload`` is binary (null counts as empty). Of records with equal payloads of at least ``min_bytes`` the one with
    the largest key is the response and the others refer to it; all else is a response. A null key never leads: it
    revisits a keyed equal, or is a response when there is none. Repeated rows of the leading key are all responses.
    Adds ``payload_bytes``, ``payload_sha1``, ``record_type``, ``refers_to`` to ``key`` and ``payload``; other columns
    than ``target_uri`` are dropped, so they cannot clash.
    """
    body = F.coalesce(F.col(payload), F.lit("").cast("binary"))
    sized = records.select(
        F.col(key).alias("key"), F.col("target_uri"), body.alias("payload"),
        F.sha1(body).alias("payload_sha1"), F.octet_length(body).cast("bigint").alias("payload_bytes"),
    )
    shared = (
        sized.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_sha1").alias("sha1"), F.col("payload_bytes").alias("size"))
        .agg(F.max("key").alias("leader"), F.count("*").alias("n"))
        .filter("n > 1 AND leader IS NOT NULL").drop("n")
    )
    shared = save_table(shared, "warc-shared")
    matched = sized.join(shared, (F.col("payload_sha1") == F.col("sha1")) & (F.col("payload_bytes") == F.col("size")), "left")
    revisit = F.col("leader").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("leader")))
    return matched.select(
        "key", "target_uri", "payload", "payload_bytes", "payload_sha1",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("leader")).alias("refers_to"),
    )


def _line(value) -> str:
    return "" if value is None or value != value else str(value).replace("\r", "%0D").replace("\n", "%0A")


def _head(row) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <urn:record:{_line(row.key_text)}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{row.payload_sha1}",
        f"X-Payload-Length: {row.payload_bytes}", "Content-Type: application/octet-stream",
    ]
    if isinstance(row.target_uri, str):
        lines.append(f"WARC-Target-URI: {_line(row.target_uri)}")
    if isinstance(row.refers_text, str):
        lines += [
            f"WARC-Refers-To: <urn:record:{_line(row.refers_text)}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    stored = 0 if row.record_type == "revisit" else row.payload_bytes
    return ("\r\n".join([*lines, f"Content-Length: {stored}"]) + "\r\n\r\n").encode()


def write_archives(records: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write records (as from :func:`dedup_payloads`) to ``folder`` and return the manifest ``(path, n_records)``.

    One file per task. Every attempt of a task writes a file of its own name and only attempts whose manifest row was
    committed are listed, so lost executors and repeated tasks leave no half file in the manifest.
    An empty input gives an empty manifest.
    """
    folder = folder or f"{work_dir(records.sparkSession)}/warc-{uuid.uuid4().hex}"
    n_chunks = F.greatest(F.ceil(F.col("payload_bytes") / F.lit(chunk_bytes)).cast("int"), F.lit(1))
    last = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(n_chunks - 1)
    chunks = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last))).select(
        F.col("key").cast("string").alias("key_text"), F.col("refers_to").cast("string").alias("refers_text"),
        "target_uri", "payload_bytes", "payload_sha1", "record_type", "chunk_no", last.alias("last_chunk"),
        F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(
            F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")).alias("data"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system = out = member = None
        path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    system, inner = fs.FileSystem.from_uri(path)
                    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(inner)
                if row.chunk_no == 0:
                    member = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=4, mtime=0)
                    member.write(_head(row))
                member.write(row.data)
                if row.chunk_no == row.last_chunk:
                    member.write(b"\r\n\r\n")
                    member.close()
                    n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "n_records": [n]})

    return save_table(chunks.mapInPandas(write, "path string, n_records bigint"), "warc-manifest")


def _headers(stream) -> dict[str, str] | None:
    """Header fields of the next record, or None at the end of the archive."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _identifier(value: str | None) -> str | None:
    return value.removeprefix("<urn:record:").removesuffix(">") if value else None


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Chunk table of the archives a manifest lists: one row per chunk, at least one per record.

    ``sha1_so_far`` and ``bytes_so_far`` cover the payload up to and including the chunk; the row with ``is_last`` holds
    the record's totals. A payload that does not match its declared digest raises. ``with_data=False`` leaves ``data`` null.
    """
    def rows(path: str) -> Iterator[tuple]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner) as raw, gzip.GzipFile(fileobj=raw) as stream:
            while (head := _headers(stream)) is not None:
                left, number, so_far, digest = int(head["content-length"]), 0, 0, hashlib.sha1()
                declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
                while True:
                    data = stream.read(min(left, chunk_bytes)) if left else b""
                    if left and not data:
                        raise ValueError(f"{path} ends inside a record")
                    left -= len(data)
                    so_far += len(data)
                    digest.update(data)
                    if not left and head["warc-type"] == "response" and digest.hexdigest() != declared:
                        raise ValueError(f"{path}: payload of {head['warc-record-id']} does not match its digest")
                    yield (
                        _identifier(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"),
                        _identifier(head.get("warc-refers-to")), declared, int(head["x-payload-length"]), number,
                        len(data), so_far, digest.hexdigest(), not left, data if with_data else None,
                    )
                    number += 1
                    if not left:
                        break

    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for path in batch["path"]:
                for row in rows(path):
                    held.append(row)
                    size += 500 + (row[7] if with_data else 0)
                    if size >= 4 * CHUNK_BYTES:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    # One task per group of archives: the paths are dealt by their hash, a row per written file.
    files = manifest.count()
    return manifest.select("path").repartition(max(1, min(files, 4096)), "path").mapInPandas(read, CHUNK_SCHEMA)
