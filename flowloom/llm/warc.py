"""WARC archives with a shared Zstandard dictionary: one frame per record, the dictionary in a leading skippable frame.

An archive is a sequence of chunks of whole frames; chunk 0 is the skippable frame with the dictionary. The chunks of
one archive in order are the bytes of its .warc.zst file. Chunks are rows, so that any store Spark writes to can hold
them; `export` writes files where the executors share a file system.

Edge cases: a null payload is empty; payloads below `DEDUP_BYTES` are never revisits; of equal larger payloads the
record with the largest page id is the response (rows that repeat this id are all responses), also if other ids are
null; if all ids are null, all are responses. A record's id comes from page id, digest and URL, and from its place in the
archives too where its page id is null or repeats; a revisit names the id of its response where that has the first form, and
always its URL and date. An empty table gives no archive. With too few records for a trained
dictionary their bytes serve as a raw one. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import narrow, quoted, saved, unit_hash

DEDUP_BYTES = 1000
DICTIONARY_BYTES = 64 << 10
#: Bounds of the records the dictionary is built from.
DICTIONARY_RECORDS, DICTIONARY_SAMPLE_BYTES = 1_000, 32 << 20
CHUNK_BYTES = 4 << 20
LEVEL = 3
#: Fixed values of the format.
DICTIONARY_MAGIC, FRAME_MAGIC, VERSION = 0x184D2A5D, 0xFD2FB528, "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: What `record` takes of a row.
COLUMNS = ("id", "url", "payload", "bytes", "digest", "refers_to", "refers_url", "alone", "refers_alone")


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """`COLUMNS`: what to write for each row; `alone` if no other row has its id, `refers_url` and `refers_alone` of the response."""
    rows = pages.select(F.col(quoted(key)).alias("id"), F.col(quoted(url)).alias("url"), F.coalesce(F.col(quoted(payload)).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"bytes": F.length("payload").cast("long"), "digest": F.sha1("payload")})
    large = rows.filter(F.col("bytes") >= DEDUP_BYTES)
    several = saved(rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated_ids")
    several = narrow(several.withColumn("several", F.lit(True)))
    top = F.max(F.struct("id", "url"))
    first = large.groupBy("digest").agg(top.alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1 and r.id is not null")
    first = first.select("digest", F.col("r.id").alias("first"), F.col("r.url").alias("first_url"))
    response = several.select(F.col("id").alias("first"), F.col("several").alias("first_several"))
    lookup = narrow(saved(first.join(response, "first", "left"), "repeated"))
    joined = rows.join(lookup, "digest", "left").join(several, "id", "left")
    is_copy = (F.col("bytes") >= DEDUP_BYTES) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        "id", "url", "payload", "bytes", "digest",
        F.when(is_copy, F.col("first")).alias("refers_to"),
        F.when(is_copy, F.col("first_url")).alias("refers_url"),
        (F.col("id").isNotNull() & F.col("several").isNull()).alias("alone"),
        F.col("first_several").isNull().alias("refers_alone"),
    )


def one_line(url: str | None) -> str:
    return "".join(c for c in (url or "") if c not in "\r\n")


def record_id(page, target: str, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}:{place}:{target}')}>"


def record(page, url, payload: bytes, size: int, digest: str, refers_to, refers_url, alone: bool, refers_alone: bool, place: str) -> bytes:
    """One WARC record: the payload as an HTTP response, or a revisit without a block. `place` tells records with one id apart."""
    revisit = refers_to is not None
    block = b"" if revisit else HTTP_HEAD.format(size).encode() + payload
    target = one_line(url)
    name = "null" if page is None else str(page)
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(name, target, digest, '' if alone else place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-ID: {name}",
        f"X-Payload-Length: {size}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_alone:
            lines.append(f"WARC-Refers-To: {record_id(refers_to, one_line(refers_url), digest)}")
        lines += [f"WARC-Refers-To-Target-URI: {one_line(refers_url)}", f"WARC-Refers-To-Date: {DATE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; the block's length must be what the header says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, rest[:size]


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response."""
    head, end, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not end:
        raise ValueError("the block isn't an HTTP response")
    return body


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        yield tuple(column[i].as_py() for column in batch.columns)


def build_dictionary(plan: DataFrame) -> bytes:
    """A dictionary from a bounded number of whole records, drawn by hash."""
    n = plan.select("id").count()
    drawn = plan.filter(unit_hash("warc", F.col("id"), F.col("digest")) < min(1.0, DICTIONARY_RECORDS / max(n, 1))).limit(2 * DICTIONARY_RECORDS)
    found, total = [], 0
    for row in drawn.toLocalIterator():
        found.append(record(*row, ""))
        total += len(found[-1])
        if total > DICTIONARY_SAMPLE_BYTES:
            break
    found.sort()
    if not found:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)[-DICTIONARY_BYTES:]


def write(plan: DataFrame, dictionary: bytes) -> DataFrame:
    """(archive, chunk, data): one archive per task, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, chunk, frames, size, number = f"part-{TaskContext.get().partitionId():06d}.warc.zst", 0, [], 0, 0
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)

        def out(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([chunk], pa.int32()), pa.array([data], pa.binary())], names=["archive", "chunk", "data"])

        for batch in batches:
            for row in rows_of(batch):
                if chunk == 0:
                    yield out(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                    chunk = 1
                number += 1
                frames.append(packer.compress(record(*row, f"{archive}/{number}")))
                size += len(frames[-1])
                if size >= CHUNK_BYTES:
                    yield out(b"".join(frames))
                    chunk, frames, size = chunk + 1, [], 0
        if frames:
            yield out(b"".join(frames))

    return saved(plan.mapInArrow(run, "archive string, chunk int, data binary"), "warc")


def frames_of(data: bytes) -> Iterator[bytes]:
    """The Zstandard frames of a chunk, found by walking their block headers."""
    at = 0
    while at < len(data):
        begin = at
        if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
            raise ValueError("not a frame")
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
        at += zstandard.frame_header_size(data[at : at + 18])
        last = False
        while not last:
            head = int.from_bytes(data[at : at + 3], "little")
            last, kind = bool(head & 1), head >> 1 & 3
            at += 3 + (1 if kind == 1 else head >> 3)
        at += 4 * checksum
        yield data[begin:at]


def dictionary_of(head: bytes) -> bytes:
    magic, size = struct.unpack_from("<II", head)
    if magic != DICTIONARY_MAGIC or len(head) != 8 + size:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    return head[8:]


def read(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of every record.

    The payload of a revisit is null. A response's digest is computed anew and must be that of its header. All
    archives of one writer share a dictionary; at most 100 different ones may be given.
    """
    heads = [r[0] for r in archives.filter("chunk = 0").select("data").distinct().limit(101).collect()]
    if len(heads) > 100:
        raise ValueError("more than 100 dictionaries; read the archives writer by writer")
    known = [dictionary_of(bytes(h)) for h in heads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [zstandard.ZstdCompressionDict(d) for d in known if d]
        unpackers = {t.dict_id(): zstandard.ZstdDecompressor(dict_data=t) for t in tables}
        plain = zstandard.ZstdDecompressor()
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                found, size = [], 0
                for frame in frames_of(batch.column(0)[i].as_py()):
                    own = zstandard.get_frame_parameters(frame[:18]).dict_id
                    headers, block = parse(unpackers.get(own, plain).decompress(frame))
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    revisit = headers["WARC-Type"] == "revisit"
                    block = block if revisit else payload_of(block)
                    if not revisit and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError("the payload's digest is wrong")
                    page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                    found.append((None if page == "null" else int(page), headers["WARC-Target-URI"], headers["WARC-Type"], None if revisit else block, int(headers["X-Payload-Length"]), digest, None if refers is None else int(refers)))
                    size += len(block)
                    if size > CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return archives.filter("chunk > 0").select("data").mapInArrow(
        run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    )


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the archives of `pages`; returns their chunks."""
    plan = planned(pages, key, url, payload)
    return write(plan, build_dictionary(plan))


def export(archives: DataFrame, folder: str) -> None:
    """One file per archive below `folder`, which all executors must share as a file system."""

    def run(batches: Iterator) -> None:
        for row in batches:
            with open(f"{folder}/{row['archive']}", "wb" if row["chunk"] == 0 else "ab") as file:
                file.write(row["data"])

    archives.repartition("archive").sortWithinPartitions("archive", "chunk").foreachPartition(run)
