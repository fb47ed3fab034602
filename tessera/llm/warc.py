"""WARC archives of Zstandard frames, one for each record, with a dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import fresh_path, materialize, until_exit

#: Magic of the skippable frame that holds a dictionary, as the format for .warc.zst has it (fixed value).
DICTIONARY_MAGIC = 0x184D2A5D
#: Bytes of records that an archive gathers before it is closed, of its dictionary, and of a read.
ARCHIVE_BYTES, DICTIONARY_BYTES, READ_BYTES = 32 << 20, 64 << 10, 1 << 20
#: Bytes of records that a dictionary is made from at most, spread over its archive, and of one such record.
TRAINING_BYTES, SAMPLE_BYTES = 4 << 20, 8 << 10
#: Tasks that read archives, at most.
MAX_READERS = 100_000
#: Rows and bytes of the table of repeated payloads up to which it is broadcast; beyond, the payloads are shuffled.
MAX_REPEATED, MAX_REPEATED_BYTES = 500_000, 48 << 20
#: Fixed values of WARC 1.1.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _filesystem(uri: str):
    """(filesystem, path) of a URI on the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page: object, digest: str) -> str:
    """The id of the one response of a page with a payload, which revisits name."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:sha1:{digest}')}>"


def record(
    page: object, url: str | None, payload: bytes, digest: str, refers_to: object = None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z", named: bool = True, source_named: bool = True
) -> bytes:
    """One WARC record. A revisit keeps the payload's length in an extension field, since it has no payload.

    Pages are named in extension fields. The id is that of :func:`record_id` for a response that is ``named`` and has a page,
    and otherwise one that nothing else has; a revisit names its response's id only where that is ``source_named``.
    """
    block = HTTP if revisit else HTTP + payload
    own = record_id(page, digest) if named and not revisit and page is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page is not None:
        head.append(f"X-Page-ID: {quote(str(page))}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page-ID: {quote(str(refers_to))}"]
        if source_named:
            head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread evenly over the archive, all of them if it is small.

    Where the training finds too little in them, their own bytes are the dictionary.
    """
    every = max(1, -(-sum(min(len(r), SAMPLE_BYTES) for r in records) // TRAINING_BYTES))
    samples = [r[:SAMPLE_BYTES] for r in records[::every]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> Iterator[bytes]:
    """The bytes of an archive of one record or more: its dictionary's frame, and a frame for each record."""
    made = _dictionary(records)
    held = zstandard.ZstdCompressor(level=level).compress(made.as_bytes())
    yield struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held
    compressor = zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=True)
    for r in records:
        yield compressor.compress(r)


def _opener(stream) -> tuple[zstandard.ZstdDecompressor, int, bytes]:
    """What opens the records of an archive, the place behind its dictionary, and the bytes read beyond that."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        return zstandard.ZstdDecompressor(), 0, head
    size = struct.unpack("<I", head[4:])[0]
    held = stream.read(size)
    if held[:4] == b"\x28\xb5\x2f\xfd":
        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=1 << 27)
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)), 8 + size, b""


def located(stream, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of the frames of an archive, one after another, from a stream that has read()."""
    opener, start, rest = _opener(stream)
    at = start + len(rest)  # of the stream
    frame, out = opener.decompressobj(), []
    while True:
        if not rest:
            rest = stream.read(read_bytes)
            at += len(rest)
            if not rest:
                if out:
                    raise ValueError("an archive ends within a record")
                return
        out.append(frame.decompress(rest))
        rest = b""
        if frame.eof:
            rest = frame.unused_data
            yield start, at - len(rest) - start, b"".join(out)
            start = at - len(rest)
            frame, out = opener.decompressobj(), []


def frames(stream, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    return (raw for _, _, raw in located(stream, read_bytes))


def read_record(path: str, offset: int, length: int) -> bytes:
    """One record of an archive, by the place of its frame; only that and the dictionary are read."""
    store, at = _filesystem(path)
    with store.open_input_file(at) as file:
        opener, _, _ = _opener(file)
        file.seek(offset)
        return opener.decompress(file.read(length))


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower-case names) and the payload of one record."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = body[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, first, copies): first is the least id with an equal payload of ``min_bytes`` or more, copies its rows.

    Ids and digests are what is shuffled, reduced to a row for each payload and page before any group meets, so no group
    is gathered. Payloads that do repeat are broadcast while they are few, which is counted; beyond that the rows
    themselves are shuffled.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha2("payload", 256))))
    each = rows.where("key IS NOT NULL").groupBy("key", "page_id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n"))).alias("least")
    groups = each.groupBy("key").agg(least, F.sum("n").alias("n")).where("n > 1 AND least IS NOT NULL")
    groups = materialize(groups.select("key", F.col("least.page_id").alias("first"), F.col("least.n").alias("copies")), "repeated-payloads")
    count, size = groups.agg(F.count("*"), F.sum(48 + F.coalesce(F.octet_length(F.col("first").cast("string")), F.lit(0)))).first()
    few = count <= MAX_REPEATED and (size or 0) <= MAX_REPEATED_BYTES
    return rows.join(F.broadcast(groups) if few else groups, "key", "left").select("page_id", "url", "payload", "first", "copies")


def write_archives(pages: DataFrame, folder: str | None = None, *, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write ``pages`` as archives below ``folder`` (a URI that all executors share); gives their manifest.

    Without a folder they go to the shared one and are deleted when the driver's JVM ends.

    The manifest, ``(path, n_records, n_bytes)``, is written as Parquet and names the archives of tasks that
    ended well; each try of a task writes files of its own name, so a lost executor leaves at most a file that
    the manifest lacks. A record whose payload equals that of a smaller id is a revisit, one of a null id too; rows that repeat both
    id and payload are each a response, which revisits then name by page and digest only. Every record's id is its own.
    Null payloads are empty, null urls have no target field, null ids no page field; without rows no archive is written.
    A task holds one archive's records.
    """
    spark = pages.sparkSession
    given, folder = folder, folder or fresh_path(spark, "warc")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal total
            name = f"{uuid.uuid4().hex}.warc.zst"
            size = 0
            # The suffix must not make the file system compress the file once more.
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for part in archive(held):
                    out.write(part)
                    size += len(part)
            made = pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": len(held), "n_bytes": size}])
            held.clear()
            total = 0
            return made

        for batch in batches:
            pages_, urls, payloads, firsts, copies = batch.columns
            for i in range(batch.num_rows):
                page, payload, first = pages_[i].as_py(), payloads[i].as_py(), firsts[i].as_py()
                once = (copies[i].as_py() or 1) == 1
                raw = record(page, urls[i].as_py(), payload, payload_digest(payload), first, first is not None and first != page, date, once, once)
                held.append(raw)
                total += len(raw)
                if total >= archive_bytes:
                    yield close()
        if held:
            yield close()

    manifest = materialize(with_revisits(pages, **columns).mapInArrow(run, schema), "warc-manifest")
    if given is None:
        until_exit(spark, folder)
    return manifest


def read_archives(manifest: DataFrame, id_type: T.DataType | None = None, payloads: bool = False) -> DataFrame:
    """The records of the archives that a manifest names, one task reading an archive as a stream.

    ``(page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to, record_id, path, offset, length)``, the last three
    for :func:`read_record`, and, if asked for, the ``payload``. A response's size and digest are worked out from its payload, and the digest must equal the
    record's; a revisit's are those that its record states.
    """
    fields = [T.StructField("page_id", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("payload_bytes", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in ("payload_digest", "record_type", "refers_to", "record_id", "path")]
    fields += [T.StructField(c, T.LongType()) for c in ("offset", "length")]
    schema = T.StructType(fields + [T.StructField("payload", T.BinaryType())] * payloads)

    def read(path: str) -> Iterator[tuple]:
        store, at = _filesystem(path)
        with store.open_input_stream(at, compression=None) as stream:
            for offset, length, raw in located(stream):
                head, payload = parsed(raw)
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                size = int(head["x-payload-length"])
                if kind == "response":
                    size = len(payload)
                    if payload_digest(payload) != digest:
                        raise ValueError(f"digest of {head['warc-record-id']} differs")
                page, source = (None if v is None else unquote(v) for v in (head.get("x-page-id"), head.get("x-refers-to-page-id")))
                yield (page, head.get("warc-target-uri"), size, digest, kind, source, head["warc-record-id"], path, offset, length, *([payload] * payloads))

    def given(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64()] + [pa.binary()] * payloads
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in read(path):
                    rows.append(row)
                    if len(rows) >= (64 if payloads else 2000):
                        yield given(rows)
                        rows.clear()
        if rows:
            yield given(rows)

    # A given number of parts, as Spark would gather rows as small as these in one task.
    paths = manifest.select("path")
    found = paths.repartition(max(1, min(paths.count(), MAX_READERS)), "path").mapInArrow(run, schema)
    kind = id_type or T.LongType()
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
