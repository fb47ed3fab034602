"""Substring deduplication by content-defined chunks: a gear hash cuts, digests find repeats, runs of them go.

A run of repeated chunks is extended to the exact ends of what its document shares with the one that has it first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.sift import touching
from tessera.llm.text import text_batches
from tessera.session import Scratch, materialize

#: Bytes of a chunk at least and at most; a cut after white space has a hash below SPACE_CUT, any other one below OTHER_CUT.
LEAST, MOST, SPACE_CUT, OTHER_CUT = 16, 256, 1 << 30, 1 << 24
#: Words that a repeated passage must hold to be removed, and those that the whole chunks inside it must: a chunk, of about seven words.
MIN_WORDS, RUN_WORDS = 20, 5
#: Bytes on the outer side of a run's end that are compared with the first document's: more than a chunk, in which the passage may end.
CONTEXT = 384
#: Digests of more repeats than this, and than one in so many of all repeats, are joined in parts; so there are at most as many of them.
HOT, MAX_HOT = 1_000, 100_000
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)
_SPACES = frozenset((9, 10, 11, 12, 13, 32))
_SPACE = np.isin(np.arange(256), list(_SPACES))
#: Bytes in another order, white space first: of all contexts in order, the two next to an end's own then share most with it, up to a word's end.
_RANK = np.argsort(np.argsort(~_SPACE, kind="stable"), kind="stable").astype(np.uint8).tobytes()


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a text end, the last at its own end.

    The hash after each byte is the gear hash h = 2 h + G[byte] in 32 bits, which the last 32 bytes decide. It is
    summed for all bytes at once by doubling: a window of 2k bytes is the one of k bytes and the one before it
    shifted by k. Cuts never part the bytes of a character.
    """
    n = len(data)
    if not n:
        return []
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    for k in (1, 2, 4, 8, 16):
        if n > k:
            longer = h.copy()
            longer[k:] += h[:-k] << np.uint32(k)
            h = longer
    starts = np.ones(n + 1, bool)
    starts[:n] = (b & 0xC0) != 0x80
    cuts = np.flatnonzero(((h < SPACE_CUT) & _SPACE[b] | (h < OTHER_CUT)) & starts[1:]) + 1
    ends: list[int] = []
    last = 0

    def forced(upto: int) -> None:
        nonlocal last
        while upto - last > MOST:
            last += MOST
            while not starts[last]:
                last -= 1
            ends.append(last)

    for e in cuts.tolist():
        forced(e)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    forced(n)
    if last < n:
        ends.append(n)
    return ends


def digests(data: bytes, ends: list[int]) -> list[int]:
    """A signed 64-bit digest of each chunk: 58 bits of a hash, and the number of its words, 63 for more."""
    if not ends:
        return []
    hashes = np.array([xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip([0, *ends], ends)], np.uint64)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    word = ~space
    word[1:] &= space[:-1]
    starts = np.array([0, *ends[:-1]])
    words = np.minimum(np.add.reduceat(word.astype(np.int64), starts), 63).astype(np.uint64)
    return (hashes & ~np.uint64(63) | words).view(np.int64).tolist()


def outward(data: bytes, at: int, before: bool) -> tuple[bytes, bool]:
    """The bytes on one side of a place, away from it, in the order of ``_RANK``; and whether the text ends there."""
    if before:
        return data[max(0, at - CONTEXT) : at][::-1].translate(_RANK), at <= CONTEXT
    return data[at : at + CONTEXT].translate(_RANK), at + CONTEXT >= len(data)


def shared(own: bytes, theirs: bytes, all_own: bool, all_theirs: bool) -> int:
    """How many bytes, both outward from a place, are whole words of both.

    ``all_own`` and ``all_theirs`` tell whether the bytes reach the end of their text.
    """
    n, over = 0, min(len(own), len(theirs)) + 1
    while n + 1 < over:
        middle = (n + over) // 2
        n, over = (middle, over) if own[:middle] == theirs[:middle] else (n, middle)
    spaces = len(_SPACES)
    while n:
        first = all_own if n == len(own) else own[n] < spaces
        second = all_theirs if n == len(theirs) else theirs[n] < spaces
        if first and second or own[n - 1] < spaces:
            break
        n -= 1
    return n


def repeated_spans(data: bytes, chunks: list[int], min_words: int = MIN_WORDS, grown: list[tuple[int, bool, int]] = ()) -> list[tuple[int, int]]:
    """The spans (start, stop) in bytes that runs of the given chunks and what is shared around them make, of ``min_words`` words or more.

    ``grown``: (chunk, whether before it, bytes) for the ends of runs.
    """
    ends = chunk_ends(data)
    b = np.frombuffer(data, np.uint8)
    word = ~_SPACE[b]
    word[1:] &= _SPACE[b[:-1]]
    words = np.concatenate([[0], np.cumsum(word)])
    grow = {(k, before): n for k, before, n in grown}
    spans: list[tuple[int, int]] = []
    for k in sorted(set(chunks)):
        start, stop = (ends[k - 1] if k else 0) - grow.get((k, True), 0), ends[k] + grow.get((k, False), 0)
        if spans and spans[-1][1] >= start:
            spans[-1] = (min(spans[-1][0], start), max(spans[-1][1], stop))
        else:
            spans.append((start, stop))
    # What precedes the first word stays, so that the words on either side of a span aren't joined.
    return [(s + int(np.argmin(_SPACE[b[s:e]])), e) for s, e in spans if words[e] - words[s] >= min_words]


def contexts_of(data: bytes, wanted: set[tuple[int, bool]]) -> list[tuple[int, bool, bytes, bool]]:
    """(digest, whether before it, bytes outward, whether the text ends) for each chunk of a wanted digest and side, equal ones once."""
    ends = chunk_ends(data)
    found: dict[tuple[int, bool, bytes, bool], None] = {}
    for k, g in enumerate(digests(data, ends)):
        for before in (True, False):
            if (g, before) in wanted:
                found[g, before, *outward(data, (ends[k - 1] if k else 0) if before else ends[k], before)] = None
    return list(found)


def own_bytes(data: bytes, sides: list[tuple[int, bool]]) -> list[tuple[bytes, bool]]:
    """What :func:`outward` gives for each (chunk, whether before it)."""
    ends = chunk_ends(data)
    return [outward(data, (ends[k - 1] if k else 0) if before else ends[k], before) for k, before in sides]


def without(data: bytes, spans: list[tuple[int, int]]) -> str:
    """A text without some spans of its bytes."""
    kept, last = [], 0
    for s, e in spans:
        kept.append(data[last:s])
        last = e
    return b"".join([*kept, data[last:]]).decode()


def _chunked(rows: DataFrame) -> DataFrame:
    """(id, mark, digests) of each text that has both id and text."""
    schema = T.StructType([rows.schema["id_"], rows.schema["mark_"], T.StructField("digests", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns[:2], names=["id", "mark"]), batch.column(2)], names=["key", "text"])
            for keys, texts in text_batches(iter([pair])):
                made = [digests(data, chunk_ends(data)) for data in ((t or "").encode() for t in texts)]
                columns = [pa.array([k[c] for k in keys], batch.column(i).type) for i, c in enumerate(("id", "mark"))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.list_(pa.int64()))], names=schema.names)

    return rows.select("id_", "mark_", "text_").mapInArrow(run, schema)


def _first_elsewhere(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """(id_, mark_, pos, digest, first) of the chunks that a document of a lesser id has, and the least such id.

    Chunks are reduced by digest before their shuffle. To mark the others, those of a digest that very many have are
    dealt out in parts; how many such digests there are is bounded by their share of all repeats.
    """
    groups = chunks.groupBy("digest").agg(F.min("id_").alias("first"), F.max("id_").alias("last"), F.count("*").alias("n")).where("first < last")
    first = scratch.table(groups.select("digest", "first", "n"), "repeated-chunks")
    share = max(HOT, (first.agg(F.sum("n")).first()[0] or 0) // MAX_HOT)
    parted = first.withColumn("parts", F.ceil(F.col("n") / share).cast("int"))
    hot = F.broadcast(parted.where("parts > 1").select("digest", "parts"))

    def key(part: Column) -> Column:
        # One number to join by: the digest itself, and another one for each further part.
        return F.when(part > 0, F.xxhash64("digest", part)).otherwise(F.col("digest"))

    # Place and text in one number, as these are the rows that are many.
    place = F.shiftleft(F.col("mark_").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    part = F.pmod(F.xxhash64("id_", "pos"), F.coalesce("parts", F.lit(1))).cast("int")
    salted = chunks.join(hot, "digest", "left").select(key(part).alias("key"), "id_", place.alias("place"))
    every = parted.select("digest", "first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(key(F.col("part")).alias("key"), "digest", "first")
    met = salted.join(every, "key").where("id_ > first")
    return met.select("id_", F.shiftright("place", 32).cast("int").alias("mark_"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"), "digest", "first")


def _runs(again: DataFrame) -> DataFrame:
    """The rows of ``again`` in runs of ``RUN_WORDS`` words, once for equal rows, with whether they begin (low) or end (high) one."""
    text = ["id_", "mark_"]
    once = again.groupBy(*text, "pos").agg(F.min("digest").alias("digest"), F.min("first").alias("first"))
    placed = once.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(*text).orderBy("pos")))
    run = Window.partitionBy(*text, "island")
    whole = placed.withColumns({"words": F.sum(F.col("digest").bitwiseAND(F.lit(63))).over(run), "low": F.min("pos").over(run) == F.col("pos"), "high": F.max("pos").over(run) == F.col("pos")})
    return whole.where(F.col("words") >= RUN_WORDS).select(*text, "pos", "digest", "first", "low", "high")


#: An end of a run, or a context of a first document: what is compared, outward, with all of the same first document, digest and side.
_PLACED = "first {id}, digest bigint, before boolean, bytes binary, own boolean, whole boolean, id_ {id}, mark_ int, pos int"


def _told(texts: DataFrame, requests: DataFrame, keys: list[str], answer) -> DataFrame:
    """Rows of ``_PLACED``: ``answer`` of (id, mark, text, request) for the texts that ``requests`` (keys, request) asks of."""
    schema = _PLACED.format(id=texts.schema["id_"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.binary(), pa.bool_(), pa.bool_(), batch.schema.field(0).type, pa.int32(), pa.int32())
            found: list[tuple] = []
            for k in range(batch.num_rows):
                found += answer(*(batch.column(c)[k].as_py() for c in range(4)))
                if found and (len(found) >= 4_000 or k == batch.num_rows - 1):
                    names = [f.split()[0] for f in schema.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
                    found = []

    met = touching(texts, requests, keys)[0].join(requests, keys)
    return met.select("id_", "mark_", "text_", "request").mapInArrow(run, schema)


def _contexts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The contexts in first documents of what ``asked`` (first, digest, before) asks of them."""
    requests = asked.groupBy(F.col("first").alias("id_")).agg(F.collect_set(F.struct("digest", "before")).alias("request"))

    def answer(id_: object, mark: int, text: str, request: list[dict]) -> list[tuple]:
        wanted = {(r["digest"], r["before"]) for r in request}
        return [(id_, g, before, x, False, whole, None, None, None) for g, before, x, whole in contexts_of(text.encode(), wanted)]

    return _told(texts, requests, ["id_"], answer).distinct()


def _own(ends: DataFrame, texts: DataFrame) -> DataFrame:
    """What stands outward of the ends of runs (id_, mark_, pos, digest, first, before) in their own documents."""
    requests = ends.groupBy("id_", "mark_").agg(F.collect_set(F.struct("first", "digest", "before", "pos")).alias("request"))

    def answer(id_: object, mark: int, text: str, request: list[dict]) -> list[tuple]:
        around = own_bytes(text.encode(), [(r["pos"], r["before"]) for r in request])
        return [(r["first"], r["digest"], r["before"], x, True, whole, id_, mark, r["pos"]) for r, (x, whole) in zip(request, around, strict=True)]

    return _told(texts, requests, ["id_", "mark_"], answer)


def _grown(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(id_, mark_, pos, before, n): how many bytes each end shares outward with the context that shares most with it.

    All ends and contexts are put in order, in ranges that no first document, digest or value of bytes holds together; the
    context next to an end, on either side, shares most. A range borrows the last context before it and the first one after it.
    """
    order = ["first", "digest", "before", "bytes", "own", "whole", "id_", "mark_", "pos"]
    dealt = scratch.table(placed.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "placed")
    # Ordered by part_ alone, a row a range: what is borrowed.
    row = F.struct(*order)
    edge = dealt.groupBy("part_").agg(F.max(F.when(~F.col("own"), row)).alias("last"), F.min(F.when(~F.col("own"), row)).alias("head"))
    by_part = Window.orderBy("part_")
    earlier = F.last("last", True).over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("head", True).over(Window.orderBy(F.desc("part_")).rowsBetween(Window.unboundedPreceding, -1))
    near = edge.select("part_", earlier.alias("earlier"), later.alias("later"))
    lent = near.select("part_", F.explode(F.array_compact(F.array("earlier", "later"))).alias("x")).select(*(F.col(f"x.{c}").alias(c) for c in order), "part_")
    schema = f"id_ {placed.schema['id_'].dataType.simpleString()}, mark_ int, pos int, before boolean, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the last context the key and the bytes; and the ends that wait for the next one, with what they share with the last.
        now, last, waiting = None, None, []
        for batch in batches:
            done: list[tuple] = []
            for part, first, digest, before, data, own, whole, id_, mark, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (part, first, digest, before)
                if key != now:
                    done += [w[:5] for w in waiting]
                    now, last, waiting = key, None, []
                if own:
                    n = shared(data, last[0], whole, last[1]) if last else 0
                    waiting.append((id_, mark, pos, before, n, data, whole))
                    continue
                last = data, whole
                done += [(*w[:4], max(w[4], shared(w[5], data, w[6], whole))) for w in waiting]
                waiting = []
            kinds = (batch.schema.field(7).type, pa.int32(), pa.int32(), pa.bool_(), pa.int32())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*(w[:5] for w in waiting), strict=True), kinds, strict=True)], names=names)

    names = [f.split()[0] for f in schema.split(", ")]
    together = dealt.unionByName(lent).repartition("part_").sortWithinPartitions("part_", *order)
    return together.select("part_", *order).mapInArrow(run, schema)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_`` (the whole row), ``text_`` (without repeats), ``spans_`` (bytes removed) and ``bytes_`` of each row.

    Among the chunks of equal digest those of the document of the least id stay. Runs of the others, of ``RUN_WORDS`` words or
    more, are extended on both sides by the words that their document shares there with the one of the least id; spans that
    then hold ``min_words`` words or more are repeated passages. What repeats only inside a document is left.

    Digests, ids and places are shuffled for all chunks, the texts only of documents with such a run, or with the
    first chunk of a run's end. A chunk that a document has very often costs a row each time, and a run's end as much: ends and
    contexts are compared in their order. The result reads tables that it wrote, which are deleted with the session.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_"), F.col(f"`{id_col}`").alias("id_"), F.hash(text).alias("mark_"))
    # The text travels once, inside its row.
    inner = F.coalesce(F.col(f"doc_.`{text_col}`").cast("string"), F.lit(""))
    texts = rows.select("id_", "mark_", inner.alias("text_")).where("id_ IS NOT NULL AND text_ <> ''")
    with Scratch(docs.sparkSession) as scratch:
        told = scratch.table(_chunked(texts), "digests")
        chunks = told.select("id_", "mark_", F.posexplode("digests").alias("pos", "digest"))
        runs = scratch.table(_runs(_first_elsewhere(chunks, scratch)), "runs")
        side = F.explode(F.array_compact(F.array(F.when(F.col("low"), F.lit(True)), F.when(F.col("high"), F.lit(False))))).alias("before")
        ends = runs.where("low OR high").select("id_", "mark_", "pos", "digest", "first", side)
        ends = scratch.table(ends, "ends")
        asked = ends.select("first", "digest", "before").distinct()
        placed = _contexts(asked, texts).unionByName(_own(ends, texts))
        grown = _grown(placed, scratch).select("id_", "mark_", "pos", F.struct("pos", "before", "n").alias("grown"))
        entries = runs.select("id_", "mark_", "pos", F.lit(None).cast(grown.schema["grown"].dataType).alias("grown")).union(grown)
        info = materialize(entries.groupBy("id_", "mark_").agg(F.collect_set("pos").alias("again_"), F.collect_set("grown").alias("grown_")), "repeats")
    kind = "struct<text: string, spans: array<struct<start: int, stop: int>>>"

    @F.arrow_udf(kind)
    def cut(texts: pa.Array, chunk_sets: pa.Array, growths: pa.Array) -> pa.Array:
        left, spans = [], []
        for text, again_, grown_ in zip(texts, chunk_sets, growths, strict=True):
            data = text.as_py().encode()
            found = repeated_spans(data, again_.as_py(), min_words, [(g["pos"], g["before"], g["n"]) for g in grown_.as_py()])
            left.append(without(data, found))
            spans.append([{"start": s, "stop": e} for s, e in found])
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        return pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(spans, pa.list_(span))], names=["text", "spans"])

    maybe, clean = touching(rows, info, ["id_", "mark_"])
    none = F.array().cast("array<struct<start:int,stop:int>>")
    both = maybe.join(info, ["id_", "mark_"], "left").withColumn("text_", inner)
    changed = both.where("again_ IS NOT NULL").withColumn("cut_", cut("text_", "again_", "grown_"))
    alone = clean.select("doc_").union(both.where("again_ IS NULL").select("doc_")).select("doc_", inner.alias("text_"), none.alias("spans_"))
    found = alone.unionByName(changed.select("doc_", F.col("cut_.text").alias("text_"), F.col("cut_.spans").alias("spans_")))
    return found.withColumn("bytes_", F.octet_length(inner).cast("long"))


def repeat_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, repeated, spans, text)`` for each row: what repeats, and the text without it.

    Rows of one id are one document, and nothing that only repeats inside it goes. Null and empty texts have no chunks and stay as they are, null as null; rows without an id are kept whole and
    aren't the first of anything; rows of equal id and text get one result, each text of an id its own; other columns are left out; an empty table gives an empty one.
    """
    found = repeats(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    removed = F.aggregate("spans_", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    size = F.size("spans_").cast("long")
    text = F.when(F.col(f"doc_.`{text_col}`").isNotNull(), F.col("text_"))
    return found.select(F.col(f"doc_.`{id_col}`").alias("doc_id"), F.col("bytes_").alias("n_bytes"), removed.alias("n_removed"), size.alias("n_spans"), (size > 0).alias("repeated"), F.col("spans_").alias("spans"), text.alias("text"))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, without repeated passages; a text that nothing but white space remains of goes.

    Rows as for :func:`repeat_report`; rows that had no text to begin with stay.
    """
    found = repeats(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    kept = found.where(r"size(spans_) = 0 OR text_ RLIKE '[^\\x20\\x09-\\x0D]'")
    changed = F.when(F.size("spans_") == 0, F.col(f"doc_.`{text_col}`")).otherwise(F.col("text_"))
    return kept.select(*(changed.alias(c) if c == text_col else F.col(f"doc_.`{c}`").alias(c) for c in docs.columns))
