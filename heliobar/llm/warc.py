"""WARC archives of gzip members: a writer with revisit records and a splittable reader.

The reader deals out byte ranges. A task looks for the gzip magic inside its range, takes a candidate for a
member only if its first bytes decode to a WARC header, and owns the records that start inside; the last one may
end beyond. So a range needs no index, and no record is read twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import drop_stage, scratch_path, stage
from .shared import map_arrays, open_fs, save_arrays, write_file

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
#: Bytes of one archive, about, and of one range of the reader.
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
#: Repeated digests in one shard of their index.
SHARD_DIGESTS = 2_000_000
#: A payload shorter than this is always stored.
REVISIT_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, size: int, sha1_hex: str, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit with HTTP headers only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        uri = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")
        head.append(f"WARC-Target-URI: {uri}")
        if uri != url:  # what a header can't hold comes back as it was given
            head.append("X-Given-URI: " + base64.b64encode(url.encode()).decode())
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _store(t: pa.Table, folder: str) -> pa.Table:
    """One shard of repeated digests: stores them sorted, with the page that holds the payload."""
    shard = int(t["shard"][0].as_py())
    digest = np.frombuffer(b"".join(bytes.fromhex(x) for x in t["digest"].to_pylist()), "S20")
    order = np.argsort(digest)
    save_arrays(f"{folder}/{shard}", {"digest": digest[order], "first": t["first"].to_numpy()[order]})
    return pa.table({"shard": pa.array([shard], pa.int64())})


class Repeated:
    """Looks digests up in the stored shards, memory-mapped."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.open = folder, shards, {}

    def first(self, digest: str):
        raw = bytes.fromhex(digest)
        shard = int(digest[:8], 16) % self.shards
        if shard not in self.open:
            try:
                self.open[shard] = map_arrays(f"{self.folder}/{shard}")
            except FileNotFoundError:
                self.open[shard] = {"digest": np.zeros(0, "S20"), "first": np.zeros(0, np.int64)}
        known, first = self.open[shard]["digest"], self.open[shard]["first"]
        key = np.frombuffer(raw, "S20")[0]
        at = int(np.searchsorted(known, key))
        return int(first[at]) if at < len(known) and known[at] == key else None


def _write(batches: Iterator[pa.RecordBatch], folder: str, most: int, repeated: Repeated) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number, held, size, records, done = TaskContext.get().partitionId(), 0, [], 0, 0, []

    def close():
        nonlocal number, held, size, records
        if records:
            uri = f"{folder}/{part:06d}-{number:04d}.warc.gz"
            done.append((uri, write_file(uri, lambda out: [out.write(x) for x in held]), records))
            number, held, size, records = number + 1, [], 0, 0

    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            first = repeated.first(r["digest"]) if r["size"] >= REVISIT_BYTES else None
            again = first is not None and first != r["page_id"]
            held.append(record(r["page_id"], r["url"], b"" if again else r["payload"], r["size"], r["digest"], first if again else None))
            size += len(held[-1])
            records += 1
            if size >= most:
                close()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(3)], names=["path", "bytes", "records"])


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row and returns the manifest (path, bytes, records).

    Of the rows with equal payloads of at least REVISIT_BYTES, those with the largest id are responses and others
    revisit it; a null payload is an empty one, a long one is written whole. A null id is written without one and
    never referred to. Rows with equal ids and payloads are stored each. An empty table writes nothing. Columns other
    than the three named aren't read, whatever their names.

    Payloads are never shuffled: only digests and ids are grouped, and repeated ones are looked up where rows stand.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "warc")
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    base = base.withColumns({"size": F.length("payload").cast("long"), "digest": F.sha1("payload")})
    # equal ones are counted before they are sent
    same = base.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("rows"), F.max("page_id").alias("first"))
    same = stage(same.where("rows > 1 AND first IS NOT NULL").select("digest", "first"), "warc-equal")
    shards = max(1, -(-same.count() // SHARD_DIGESTS))
    index = scratch_path(spark, "warc-index")
    sharded = same.withColumn("shard", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % shards)
    drop_stage(stage(sharded.groupBy("shard").applyInArrow(lambda t: _store(t, index), "shard long"), "warc-stored"))
    drop_stage(same)
    return stage(base.mapInArrow(lambda it: _write(it, folder, archive_bytes, Repeated(index, shards)), "path string, bytes long, records long"), "warc-manifest")


def members(source, start: int, end: int, block: int = 1 << 16) -> Iterator[bytes]:
    """Decoded members that begin in [start, end) of a random-access file."""
    size = source.size()
    end = min(end, size)
    data, base, at = source.read_at(min(end + 2, size) - start, start), start, start
    while at < end:
        found = data.find(MAGIC, at - base)
        if found < 0 or base + found >= end:
            return
        at = base + found
        probe = zlib.decompressobj(31)
        try:
            head = probe.decompress(data[found : found + 512], 16)
            if len(head) < len(VERSION) and base + found + 512 > base + len(data):
                head = zlib.decompressobj(31).decompress(source.read_at(512, at), 16)
        except zlib.error:
            head = b""
        if not head.startswith(VERSION):
            at += 1
            continue
        z, out, pos = zlib.decompressobj(31), [], found
        try:
            while not z.eof:
                piece = data[pos : pos + block]
                if not piece:
                    piece = source.read_at(block, base + pos)
                    if not piece:
                        raise zlib.error("the archive ends inside a record")
                out.append(z.decompress(piece))
                pos += len(piece)
        except zlib.error as e:
            raise ValueError(f"broken record at byte {at}: {e}") from e
        at = base + pos - len(z.unused_data)
        yield b"".join(out)
        if at - base > len(data):
            return


_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r$", re.M)


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in _HEADER.findall(head + b"\r\n")}
    block = rest[: int(fields[b"content-length"])]
    kind = fields[b"warc-type"].decode()
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict((k.lower(), v) for k, v in _HEADER.findall(http + b"\r\n"))[b"content-length"])
    digest = base64.b32decode(fields[b"warc-payload-digest"].removeprefix(b"sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields[b'warc-record-id'].decode()} doesn't match its digest")

    def page(name: bytes):
        text = fields[name].strip(b"<>").rpartition(b":")[2] if name in fields else b""
        return int(text) if text else None

    uri, given = fields.get(b"warc-target-uri"), fields.get(b"x-given-uri")
    url = base64.b64decode(given).decode() if given else uri and uri.decode()
    return {"page_id": page(b"warc-record-id"), "url": url, "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": page(b"warc-refers-to"), "payload": payload if kind == "response" else None}


_SCHEMA = {"page_id": "long", "url": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "payload": "binary"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _read(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _ARROW[_SCHEMA[c]]) for c in columns], names=columns)

    for batch in batches:
        for r in batch.to_pylist():
            files, path = open_fs(r["path"])
            rows, held = [], 0
            with files.open_input_file(path) as source:
                for raw in members(source, r["start"], r["end"]):
                    rows.append(parse(raw))
                    held += len(raw)
                    if held > 16 << 20:
                        yield emit(rows)
                        rows, held = [], 0
            if rows:
                yield emit(rows)


def read_archives(manifest: DataFrame, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives in ``manifest`` (path, bytes): a row for each, of the columns asked for.

    A url comes back as it was given; a revisit has no payload. An empty manifest gives no rows.
    """
    spark = manifest.sparkSession
    ship(spark)
    columns = columns or list(_SCHEMA)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", starts.alias("start")).withColumn("end", F.col("start") + range_bytes)
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0
    dealt = ranges.repartition(max(1, min(int(total), 100_000)))
    return dealt.mapInArrow(lambda it: _read(it, columns), ", ".join(f"{c} {_SCHEMA[c]}" for c in columns))
