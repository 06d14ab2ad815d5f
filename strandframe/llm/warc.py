"""WARC archives: one gzip member per record, written and read sequentially.

A record's block is an HTTP response; its payload is the page. Of records with equal payloads the one with the largest
id is a ``response``; the others are ``revisit`` records without payload that refer to it. The reader inflates the
members one after another as the bytes arrive, frames the block by Content-Length, and verifies block and payload
digests. Files hold many records, but reading holds one record at a time.

Defined results: a null payload counts as empty; a null id has a name of its own and never refers; among records with
equal payloads whose ids are all null, all are responses; repeated rows with the group's largest id are all responses;
other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.words import slices
from strandframe.session import scratch, stored

CRLF = b"\r\n"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """An archive that is cut, badly framed or whose digests differ."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: str | None) -> str:
    return "<urn:x-no-page>" if page_id is None else f"<urn:x-page:{quote(page_id, safe='')}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member: headers, block, two line ends."""
    digest = sha1_base32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(stream, step: int = 1 << 18) -> Iterator[bytes]:
    """The inflated gzip members of a stream, each as soon as it ends."""
    data = b""
    while True:
        data = data or stream.read(step)
        if not data:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                data = stream.read(step)
                if not data:
                    raise WarcError("the last gzip member is cut")
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            data = inflate.unused_data
        yield b"".join(parts)


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = head.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in rest if line)}


def _page(urn: str | None) -> str | None:
    if urn is None or not urn.startswith("<urn:x-page:"):
        return None
    return unquote(urn.removeprefix("<urn:x-page:").removesuffix(">"))


def parse(member: bytes) -> dict:
    """A record's fields; raises WarcError where framing or a digest is wrong."""
    head, gap, rest = member.partition(CRLF * 2)
    version, fields = _headers(head)
    if not gap or not version.startswith("WARC/1."):
        raise WarcError("no WARC header")
    if missing := {"content-length", "warc-type", "warc-payload-digest", "warc-record-id"} - fields.keys():
        raise WarcError(f"no header {min(missing)}")
    if not fields["content-length"].isdecimal():
        raise WarcError("Content-Length is no number")
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != CRLF * 2:
        raise WarcError("the block's length is not its Content-Length")
    if fields.get("warc-block-digest") not in (None, "sha1:" + sha1_base32(block)):
        raise WarcError("the block's digest differs")
    http, gap, payload = block.partition(CRLF * 2)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if sha1_base32(payload) != digest:
            raise WarcError("the payload's digest differs")
        length = len(payload)
    else:
        length = _headers(http)[1].get("content-length", "")
        if not length.isdecimal():
            raise WarcError("a revisit without its payload's length")
        payload, length = None, int(length)
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": length, "payload_digest": digest, "payload": payload}


def assigned(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """``id, url, payload, refers_to``: null refers_to for responses. Payloads under min_bytes are all responses.

    The largest id of each payload is aggregated from (digest, length, id) rows, pre-summed before the shuffle; one
    join brings it to the pages. Adaptive execution splits the join's partition of a payload that many pages have.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    largest = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("id").alias("largest"))
    refers = F.when(F.col("largest") != F.col("id"), F.col("largest"))
    refers = F.when(F.col("id").isNull(), F.col("largest")).otherwise(refers)
    joined = rows.join(largest, ["digest", "size"], "left")
    return joined.select(F.col("id").cast("string").alias("id"), "url", "payload", refers.cast("string").alias("refers_to"))


def write(records: DataFrame, folder: str, max_file_bytes: int = 256 << 20) -> DataFrame:
    """Write ``id, url, payload, refers_to`` rows as ``folder/*.warc.gz``; returns the manifest ``path, records, bytes``.

    Each task writes its own files under a name of its partition, first under a name of its attempt, then renamed: a
    task that runs again replaces its files with equal ones.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        name, attempt, number, out, seen, size = f"part-{context.partitionId():06d}", context.taskAttemptId(), 0, None, 0, 0
        made = []

        def close():
            nonlocal out, number, seen, size
            out.close()
            final = f"{root}/{name}-{number:04d}.warc.gz"
            store.move(f"{root}/_{name}-{number:04d}.{attempt}", final)
            made.append((final, seen, size))
            out, number, seen, size = None, number + 1, 0, 0

        for batch in slices(batches, "payload"):
            for ident, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/_{name}-{number:04d}.{attempt}", compression=None)
                data = record(ident, url, payload, refers_to)
                out.write(data)
                seen, size = seen + 1, size + len(data)
                if size >= max_file_bytes:
                    close()
        if out is not None:
            close()
        yield pa.record_batch([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["path", "records", "bytes"])

    return records.select("id", "url", "payload", "refers_to").mapInArrow(save, "path string, records long, bytes long")


def read(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives, one task per file or so; payloads are left out where not wanted."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        row = parse(member)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held >= 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                yield made(rows)

    paths = manifest.select("path")
    return paths.repartition(max(1, min(paths.count(), 100_000))).mapInArrow(load, RECORD_SCHEMA)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record per page, read the archives back: per page its payload's size and digest, its type and reference."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch(spark, "warc")
    manifest = stored(write(assigned(pages), folder), "warc-manifest")
    back = read(spark, manifest, folder, payloads=False)
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: Twenty bits, five hexadecimal digits, are four characters of base 32.
_GROUPS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT // {32 ** (3 - j)}) % 32 AS INTEGER) + 1, 1)" for g in range(8) for j in range(4)
)
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT t, max(page_id) AS largest FROM p GROUP BY t)
SELECT p.page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, {_GROUPS} AS payload_digest,
  CASE WHEN p.page_id = m.largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = m.largest THEN NULL ELSE m.largest END AS refers_to
FROM p JOIN m ON p.t = m.t
"""
