"""Binary sources: BAM as a Spark data source, and the flat tables of contigs, edges, ids and read pairs."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    Not,
    WriterCommitMessage,
)

#: Bytes read at a time, and of a BAM file for one task.
READ, SPLIT = 4 << 20, 64 << 20
BAM_SCHEMA = "file string, rec_no bigint, ref_name string, pos int, next_ref_name string, next_pos int, mapq smallint"
_EDGE = np.dtype([("start", "<i4"), ("end", "<i4"), ("weight", "<f8")])
_INVALID = np.dtype([("contig_id", "<i4")])
_PAIR = np.dtype([("ref_id", "<i4"), ("pos", "<i4"), ("next_ref_id", "<i4"), ("next_pos", "<i4")])


def open_path(path: str):
    """(filesystem, path) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of all gzip members of a stream, BGZF blocks among them."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(READ):
        while data:
            out = inflate.decompress(data)
            if out:
                yield out
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            else:
                break


class _Bytes:
    """Reads of exact size from an iterator of chunks."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held, self.at = chunks, b"", 0

    def take(self, n: int) -> bytes | None:
        while len(self.held) - self.at < n:
            more = next(self.chunks, None)
            if more is None:
                if len(self.held) > self.at:
                    raise ValueError("the file ends within a record")
                return None
            self.held, self.at = self.held[self.at :] + more, 0
        out = self.held[self.at : self.at + n]
        self.at += n
        return out


def _block_size(data: bytes, at: int) -> int | None:
    """The bytes of the BGZF block that starts at a place, None if there is no header of one."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 18:
        return None
    end = at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    at += 12
    while at + 4 <= min(end, len(data)):
        kind, size = data[at : at + 2], struct.unpack_from("<H", data, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(data):
            return struct.unpack_from("<H", data, at + 4)[0] + 1
        at += 4 + size
    return None


def _inflated_blocks(file, at: int) -> Iterator[tuple[int, bytes]]:
    """(place in the file, data) of the blocks from one on."""
    held = b""
    while True:
        if len(held) < 1 << 16:
            file.seek(at + len(held))
            held += file.read(READ)
        if not held:
            return
        size, done = _block_size(held, 0), 0
        while size is not None and done + size <= len(held):
            yield at + done, zlib.decompress(held[done : done + size], 31)
            done += size
            size = _block_size(held, done)
        if not done:
            raise ValueError(f"no whole block at {at}")
        at, held = at + done, held[done:]


def _first_block(file, size: int, at: int) -> int:
    """Where the first block at or after a place starts; the file's size if none does."""
    file.seek(at)
    data = file.read(3 << 16)
    k = data.find(b"\x1f\x8b\x08\x04")
    while k >= 0:
        n = _block_size(data, k)
        if n is not None and (at + k + n == size or data[k + n : k + n + 4] == b"\x1f\x8b\x08\x04"):
            return at + k
        k = data.find(b"\x1f\x8b\x08\x04", k + 1)
    return size


def _plausible(data: bytes, at: int, n_refs: int) -> int | None:
    """The end of a record that may start at a place, None if none can."""
    size, ref, pos, name, _, _, cigar, _, seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    least = 32 + name + 4 * cigar + (seq + 1) // 2 + seq
    right = -1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and name >= 1 and seq >= 0 and least <= size < 1 << 28
    if not right or (at + 36 + name <= len(data) and data[at + 35 + name] != 0):
        return None
    return at + 4 + size


def _first_record(file, size: int, at: int, n_refs: int) -> int | None:
    """The virtual place of the first record that starts in a block at or after a place in the file, None at the end.

    A virtual place is that of a block, times 65,536, and the place in its data. A record is taken to start where one may, and
    records follow without a gap for a megabyte or to the end. The reader of what lies before proves it: its last record must end there.
    """
    data, starts = b"", []
    whole = True
    for place, block in _inflated_blocks(file, _first_block(file, size, at)):
        starts.append((len(data), place))
        data += block
        if len(data) >= 1 << 20:
            whole = False
            break
    for k in range(len(data) - 35):
        end = k
        while end is not None and end + 36 <= len(data):
            end = _plausible(data, end, n_refs)
        if end is not None and end > k and (not whole or end == len(data)):
            at_, place = max(x for x in starts if x[0] <= k)
            return place << 16 | (k - at_)
    return None


def _bam_header(stream) -> tuple[list[str], int]:
    """The names of the references, and the bytes of the header."""
    data, size = _Bytes(inflated(stream)), 12
    if data.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")

    def number() -> int:
        return struct.unpack("<i", data.take(4))[0]

    text = number()
    data.take(text)
    names = []
    for _ in range(number()):
        n = number()
        names.append(data.take(n)[:-1].decode())
        number()
        size += 8 + n
    return names, size + text


def _fields(data: bytes, start: np.ndarray, names: pa.Array, columns: list[str]) -> dict[str, pa.Array]:
    """Those of ref_name, pos, next_ref_name, next_pos and mapq that are asked for, of the records that start at places of ``data``; an unknown one is null."""
    raw = np.frombuffer(data, np.uint8)

    def number(offset: int) -> np.ndarray:
        return np.ascontiguousarray(raw[start[:, None] + np.arange(offset, offset + 4)]).view("<i4").ravel()

    def known(values: np.ndarray) -> pa.Array:
        return pa.array(values, pa.int32(), mask=values < 0)

    decoded = {
        "ref_name": lambda: names.take(known(number(4))),
        "pos": lambda: known(number(8)),
        "next_ref_name": lambda: names.take(known(number(24))),
        "next_pos": lambda: known(number(28)),
        "mapq": lambda: pa.array(raw[start + 13].astype(np.int16)),
    }
    return {c: decode() for c, decode in decoded.items() if c in columns}


def bam_range(
    file, size: int, low: int, high: int, names: list[str], header: int, columns: list[str], least: int = 0, without: set[int] = frozenset()
) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
    """(virtual places, fields) of the records that start in a block of [low, high); ``header`` bytes of data precede the first one.

    Of records with a quality below ``least``, or one of ``without``, no field is decoded.
    Fails where the last record doesn't end at the place at which the next range takes its first one to start.
    """
    if low:
        first = _first_record(file, size, low, len(names))
        if first is None:
            return
        begin, skip = first >> 16, first & 0xFFFF
    else:
        begin, skip = 0, header
    values = pa.array(names, pa.string())
    data, starts = b"", []  # starts: (place in data, place in the file) of blocks
    at = skip
    last: int | None = None

    def virtual(k: np.ndarray) -> np.ndarray:
        inner, outer = (np.array(x, np.int64) for x in zip(*starts, strict=True))
        of = np.searchsorted(inner, k, side="right") - 1
        return outer[of] << 16 | (k - inner[of])

    def taken() -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        nonlocal data, starts, at, last
        found: list[int] = []
        limit = next((k for k, place in starts if place >= high), None)
        while at + 4 <= len(data) and (limit is None or at < limit):
            end = at + 4 + struct.unpack_from("<i", data, at)[0]
            if end > len(data):
                break
            found.append(at)
            at = end
        if limit is not None and limit <= at < len(data):
            last = int(virtual(np.array([at]))[0])
        if found:
            kept = np.array(found, np.int64)
            if least or without:
                quality = np.frombuffer(data, np.uint8)[kept + 13].astype(np.int64)
                kept = kept[(quality >= least) & ~np.isin(quality, list(without))]
            yield virtual(kept), _fields(data, kept, values, columns)
        # What is left of the data begins with the block in which the next record starts, if that is there.
        keep = max((i for i, (k, _) in enumerate(starts) if k <= at), default=0)
        cut = starts[keep][0] if starts else 0
        data, starts, at = data[cut:], [(k - cut, place) for k, place in starts[keep:]], at - cut

    for place, block in _inflated_blocks(file, begin):
        if block:
            starts.append((len(data), place))
            data += block
        if len(data) >= READ or place >= high:
            yield from taken()
            if last is not None:
                break
    if last is None:
        yield from taken()
        if last is None and at < len(data):
            raise ValueError("the file ends within a record")
    if high < size and last != _first_record(file, size, high, len(names)):
        raise ValueError(f"records around {high} can't be told apart: read the file whole (option split=0)")


class BamReader(DataSourceReader):
    """``columns`` are those that are read. Bounds on the quality that a query pushes drop records before their other fields are decoded."""

    def __init__(self, paths: list[str], split: int, columns: list[str] | None = None) -> None:
        self.paths, self.split = paths, split
        self.columns = columns or [f.split()[0] for f in BAM_SCHEMA.split(", ")]
        self.least, self.without = 0, set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes mapq >= x, mapq > x and mapq <> x, which need a record's quality byte alone; gives back all others."""
        for f in filters:
            match f:
                case GreaterThanOrEqual(("mapq",), value):
                    self.least = max(self.least, value)
                case GreaterThan(("mapq",), value):
                    self.least = max(self.least, value + 1)
                case Not(EqualTo(("mapq",), value)):
                    self.without.add(value)
                case IsNotNull(("mapq",)):
                    pass  # it never is
                case _:
                    yield f

    def partitions(self) -> list[InputPartition]:
        """(path, low, high) of each range of each file; a file that isn't in BGZF blocks is one."""
        made = []
        for path in self.paths:
            store, at = open_path(path)
            size = store.get_file_info(at).size
            step = self.split or max(1, size)
            made += [InputPartition((path, low, min(size, low + step))) for low in range(0, max(1, size), step)]
        return made

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, low, high = partition.value
        store, at = open_path(path)
        schema = pa.schema([("file", pa.string()), ("rec_no", pa.int64()), ("ref_name", pa.string()), ("pos", pa.int32()), ("next_ref_name", pa.string()), ("next_pos", pa.int32()), ("mapq", pa.int16())])
        with store.open_input_stream(at, compression=None) as stream:
            names, header = _bam_header(stream)
        with store.open_input_file(at) as file:
            for places, fields in bam_range(file, file.size(), low, high, names, header, self.columns, self.least, self.without):
                found = {"file": pa.array([path] * len(places), pa.string()), "rec_no": pa.array(places), **fields}
                yield pa.RecordBatch.from_arrays([found[c] for c in self.columns], schema=pa.schema([schema.field(c) for c in self.columns]))


class BamSource(DataSource):
    """``spark.read.format("bam")`` with the option ``paths``, separated by commas.

    A task reads a range of ``split`` bytes of a file (0: a whole file), which begins and ends where records do. ``rec_no`` is a
    record's virtual place: it grows along the file, but isn't dense. The option ``columns``, separated by commas, names those to
    decode (all); bounds on ``mapq`` reach the reader while ``spark.sql.python.filterPushdown.enabled`` is set.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        kinds = dict(f.split() for f in BAM_SCHEMA.split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in self._columns() or kinds)

    def _columns(self) -> list[str]:
        return [c for c in (self.options.get("columns") or "").split(",") if c]

    def reader(self, schema) -> DataSourceReader:
        return BamReader([p for p in (self.options.get("paths") or self.options["path"]).split(",") if p], int(self.options.get("split") or SPLIT), self._columns())


def read_mapping(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Alignment records of files, by their suffix (.bam). ``columns`` are those that are decoded; filters on mapq are pushed into the scan."""
    for p in paths:
        if not p.endswith(".bam") and not os.path.basename(p).startswith("part-"):
            raise ValueError(f"no reader for {p!r}")
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bam").option("paths", ",".join(paths)).option("columns", ",".join(columns or [])).load()


def _records(spark: SparkSession, path: str, kind: np.dtype, head: int, per_task: int = 1 << 20) -> DataFrame:
    """Records of a fixed size behind ``head`` bytes, read in ranges."""
    store, at = open_path(path)
    count = (store.get_file_info(at).size - head) // kind.itemsize
    schema = ", ".join(f"{n} {'double' if kind[n].kind == 'f' else 'int'}" for n in kind.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name = open_path(path)
        with source.open_input_file(name) as file:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    file.seek(head + k * per_task * kind.itemsize)
                    rows = np.frombuffer(file.read(min(per_task, count - k * per_task) * kind.itemsize), kind)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[n])) for n in kind.names], names=list(kind.names))

    tasks = -(-count // per_task)
    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, schema)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(start, end, weight)``."""
    return _records(spark, path, _EDGE, 8)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(ref_id, pos, next_ref_id, next_pos)``."""
    return _records(spark, path, _PAIR, 0)


def read_invalid(spark: SparkSession, path: str) -> DataFrame:
    """``(contig_id)``."""
    return _records(spark, path, _INVALID, 8)


def _contig_range(path: str, low: int, high: int, entry: int | None = None, rows: list | None = None) -> tuple[int, int, int]:
    """(first, n, end): where the first record at or after ``low`` starts, how many start before ``high``, and where the last of these ends.

    Without ``entry``, the first record's place is taken to be the first from which one record follows another through the range's
    end: a guess, which the caller proves. ``n`` is -1 where no whole records follow from ``entry``. ``rows`` gets (name, length) of each record.
    """
    store, at = open_path(path)
    size = store.get_file_info(at).size
    with store.open_input_file(at) as file:
        file.seek(low)
        held = file.read(min(high, size) - low)

        def bytes_at(place: int, n: int) -> bytes:
            if low <= place and place + n <= low + len(held):
                return held[place - low : place - low + n]
            file.seek(place)
            return file.read(n)

        def follow(place: int, proven: bool) -> tuple[int, int] | None:
            n = 0
            while place < min(high, size):
                head = bytes_at(place, 4)
                count = struct.unpack("<i", head)[0] if len(head) == 4 else -1
                whole = count >= 0 and place + 8 + count <= size
                if not whole or not proven and bytes_at(place + 4 + count, 4)[3] > 127:
                    return None
                if rows is not None:
                    rows.append((bytes_at(place + 4, count).decode(), struct.unpack("<i", bytes_at(place + 4 + count, 4))[0]))
                place, n = place + 8 + count, n + 1
            return n, place

        if entry is not None:
            return entry, *(follow(entry, True) or (-1, high))
        for place in range(low, min(high, size)):
            if found := follow(place, False):
                return place, *found
    return high, 0, high


def contig_ranges(spark: SparkSession, path: str, split: int = READ) -> list[tuple[int, int, int, int]]:
    """(low, high, first, id) of each range of a contig file: where its first record starts, and that record's id.

    Ranges look for their first record by themselves. It is proven where the range before ends there; a range for which
    that fails is read again from the place it should start at, until all are proven; each round proves one more at least. A row a
    range reaches the driver.
    """
    store, at = open_path(path)
    size = store.get_file_info(at).size
    with store.open_input_file(at) as file:
        expected = struct.unpack("<q", file.read(8))[0]
    lows = list(range(8, max(size, 9), split))
    told: dict[int, tuple[int, int, int]] = {}
    asked: dict[int, int | None] = dict.fromkeys(lows) | {8: 8}
    while asked:
        given = [(low, min(low + split, size), entry) for low, entry in asked.items()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(r["low"], *_contig_range(path, r["low"], r["high"], r["entry"])) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_pylist([dict(zip(("low", "first", "n", "end"), f, strict=True)) for f in found])

        rows = spark.createDataFrame(given, "low bigint, high bigint, entry bigint").repartition(len(given), "low")
        told |= {r.low: (r.first, r.n, r.end) for r in rows.mapInArrow(run, "low bigint, first bigint, n bigint, end bigint").collect()}
        ends = [8, *(told[low][2] for low in lows)]
        asked = {low: end for low, end in zip(lows, ends, strict=False) if told[low][0] != end}
    if broken := [told[low][0] for low in lows if told[low][1] < 0]:
        raise ValueError(f"{path}: no whole records from {broken[0]} on")
    if sum(told[low][1] for low in lows) != expected or ends[-1] != size:
        raise ValueError(f"{path}: {expected} records are announced, {sum(t[1] for t in told.values())} are there")
    out, ids = [], 0
    for low in lows:
        out.append((low, min(low + split, size), told[low][0], ids))
        ids += told[low][1]
    return out


def read_contigs(spark: SparkSession, path: str, split: int = READ) -> DataFrame:
    """``(id, name, length)``: ids are places in the file. Ranges of ``split`` bytes are read in tasks of their own, see :func:`contig_ranges`.

    A file that ends within a record, or holds other records than it announces, is an error.
    """
    ranges = contig_ranges(spark, path, split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows: list[tuple[str, int]] = []
                _contig_range(path, r["low"], r["high"], r["first"], rows)
                ids = np.arange(r["id"], r["id"] + len(rows), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([n for n, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.int32())], names=["id", "name", "length"])

    dealt = spark.createDataFrame(ranges, "low bigint, high bigint, first bigint, id bigint").repartition(len(ranges), "low")
    return dealt.mapInArrow(run, "id int, name string, length int")


def _parts(df: DataFrame, folder: str, encode: Callable[[pa.RecordBatch], bytes], head: bytes = b"") -> list[tuple[str, int]]:
    """(path, records) of the part files, in order, that the tasks of ``df`` wrote, each beginning with ``head``.

    Each try of a task writes a file of its own name, and only those of tasks that ended well are named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_path(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}", 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(head)
            for batch in batches:
                out.write(encode(batch))
                n += batch.num_rows
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n": n}])

    rows = df.mapInArrow(run, "path string, n bigint").collect()  # a row a task
    return sorted((r.path, r.n) for r in rows)


def _written(df: DataFrame, path: str, encode: Callable[[pa.RecordBatch], bytes], counted: bool) -> None:
    """One file, as these formats have no parts: tasks encode part files beside it, whose bytes are then put together."""
    store, at = open_path(path)
    folder = f"{path}.{uuid.uuid4().hex}"
    parts = _parts(df, folder, encode)
    with store.open_output_stream(at, compression=None) as out:
        if counted:
            out.write(struct.pack("<q", sum(n for _, n in parts)))
        for part, _ in parts:
            with open_path(part)[0].open_input_stream(open_path(part)[1], compression=None) as held:
                while data := held.read(READ):
                    out.write(data)
    store.delete_dir(open_path(folder)[1])


def _fixed(kind: np.dtype) -> Callable[[pa.RecordBatch], bytes]:
    """Batches as records of a fixed size; a null id or position is -1."""

    def encode(batch: pa.RecordBatch) -> bytes:
        rows = np.empty(batch.num_rows, kind)
        for name in kind.names:
            rows[name] = batch.column(name).fill_null(-1).to_numpy(zero_copy_only=False)
        return rows.tobytes()

    return encode


def _typed(df: DataFrame, kind: np.dtype) -> DataFrame:
    return df.select(*(F.col(n).cast("double" if kind[n].kind == "f" else "int").alias(n) for n in kind.names))


def write_edges(edges: DataFrame, path: str) -> None:
    _written(_typed(edges, _EDGE).orderBy("start", "end"), path, _fixed(_EDGE), True)


def write_pairs(pairs: DataFrame, path: str) -> None:
    _written(_typed(pairs, _PAIR), path, _fixed(_PAIR), False)


def write_invalid(ids: DataFrame, path: str) -> None:
    _written(_typed(ids, _INVALID).orderBy("contig_id"), path, _fixed(_INVALID), True)


def write_contigs(contigs: DataFrame, path: str) -> None:
    def encode(batch: pa.RecordBatch) -> bytes:
        names = [n.encode() for n in batch.column("name").to_pylist()]
        return b"".join(struct.pack("<i", len(n)) + n + struct.pack("<i", size) for n, size in zip(names, batch.column("length").to_pylist(), strict=True))

    _written(contigs.select("id", "name", F.col("length").cast("int").alias("length")).orderBy("id"), path, encode, True)


#: Flat tables by kind.
KINDS = {"edges": _EDGE, "pairs": _PAIR, "invalid": _INVALID}
_LIST = "_parts"


class _Part(WriterCommitMessage):
    def __init__(self, name: str, n: int) -> None:
        self.name, self.n = name, n


class FlatWriter(DataSourceArrowWriter):
    """A part file for each task; the list of those that are part of the table is written when all tasks have ended well."""

    def __init__(self, folder: str, kind: str, overwrite: bool) -> None:
        self.folder, self.kind, self.overwrite = folder, kind, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = open_path(self.folder)
        store.create_dir(root, recursive=True)
        encode, name, n = _fixed(KINDS[self.kind]), f"part-{uuid.uuid4().hex}", 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                out.write(encode(batch))
                n += batch.num_rows
        return _Part(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = open_path(self.folder)
        store.create_dir(root, recursive=True)
        old = [] if self.overwrite else listed(self.folder)
        parts = sorted((m.name, m.n) for m in messages if m is not None)
        with store.open_output_stream(f"{root}/{_LIST}", compression=None) as out:
            out.write("".join(f"{name} {n}\n" for name, n in [*old, *parts]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Deletes the parts of tasks that ended; those of killed tries stay, but no list names them."""
        store, root = open_path(self.folder)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


def listed(folder: str) -> list[tuple[str, int]]:
    """(name, records) of the parts of a table; none where no write has ended."""
    store, root = open_path(folder)
    if not store.get_file_info(f"{root}/{_LIST}").is_file:
        return []
    with store.open_input_stream(f"{root}/{_LIST}", compression=None) as held:
        return [(name, int(n)) for name, n in (line.split() for line in held.read().decode().splitlines())]


class FlatReader(DataSourceReader):
    def __init__(self, folder: str, kind: str, per_task: int) -> None:
        self.folder, self.kind, self.per_task = folder, kind, per_task

    def partitions(self) -> list[InputPartition]:
        """(name, first record, records) of ranges of the listed parts."""
        ranges = [InputPartition((name, k, min(self.per_task, n - k))) for name, n in listed(self.folder) for k in range(0, n, self.per_task)]
        return ranges or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        (name, first, n), kind = partition.value, KINDS[self.kind]
        store, root = open_path(self.folder)
        with store.open_input_file(f"{root}/{name}") as file:
            file.seek(first * kind.itemsize)
            rows = np.frombuffer(file.read(n * kind.itemsize), kind)
        if len(rows) < n:
            raise ValueError(f"{name} ends before its last record")
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in kind.names], names=list(kind.names))


class FlatSource(DataSource):
    """``format("flat")`` with the options ``path``, a folder, and ``kind``, one of ``KINDS``: records of a fixed size in part files.

    A write is seen once its list of parts is there, whole or not at all; nothing but names and counts passes the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "flat"

    def schema(self) -> str:
        kind = KINDS[self.options["kind"]]
        return ", ".join(f"{n} {'double' if kind[n].kind == 'f' else 'int'}" for n in kind.names)

    def reader(self, schema) -> DataSourceReader:
        return FlatReader(self.options["path"], self.options["kind"], int(self.options.get("records") or 1 << 20))

    def writer(self, schema, overwrite: bool) -> FlatWriter:
        return FlatWriter(self.options["path"], self.options["kind"], overwrite)


def save_flat(df: DataFrame, folder: str, kind: str, mode: str = "append") -> None:
    """The columns of a kind of flat table, in part files of a folder. A null id or position is -1."""
    df.sparkSession.dataSource.register(FlatSource)
    _typed(df, KINDS[kind]).write.format("flat").option("kind", kind).mode(mode).save(folder)


def load_flat(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """What :func:`save_flat` wrote; an empty table where no write has ended."""
    spark.dataSource.register(FlatSource)
    return spark.read.format("flat").option("kind", kind).load(folder)


def _block(data: bytes) -> bytes:
    """A BGZF block of at most 64 KiB of data."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = struct.pack("<4BI2BHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _blocks(data: bytes, size: int = 0xFF00) -> bytes:
    return b"".join(_block(data[i : i + size]) for i in range(0, len(data), size))


def write_bam(records: DataFrame, contigs: list[tuple[str, int]], folder: str) -> list[str]:
    """The paths of BAM files, one a task, of records (ref_name, pos, next_ref_name, next_pos, mapq) without sequences.

    ``contigs`` are the (name, length) of the header. An unknown or missing name or position is -1, a missing quality 255.
    """
    number = {name: k for k, (name, _) in enumerate(contigs)}
    head = b"BAM\1" + struct.pack("<ii", 0, len(contigs))
    for name, length in contigs:
        head += struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", length)

    def encode(batch: pa.RecordBatch) -> bytes:
        made = []
        for ref, pos, next_ref, next_pos, mapq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            place = (number.get(ref, -1), -1 if pos is None else pos)
            mate = (number.get(next_ref, -1), -1 if next_pos is None else next_pos)
            body = struct.pack("<iiBBHHHIiii", *place, 2, 255 if mapq is None else mapq, 0, 0, 0, 0, *mate, 0) + b"*\0"
            made.append(struct.pack("<i", len(body)) + body)
        return _blocks(b"".join(made))

    rows = records.select("ref_name", F.col("pos").cast("int"), "next_ref_name", F.col("next_pos").cast("int"), F.col("mapq").cast("int"))
    return [path for path, _ in _parts(rows, folder, encode, _blocks(head))]
