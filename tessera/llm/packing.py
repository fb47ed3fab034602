"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.text import hf_tokenizer, key_and_text, text_batches, vocabulary

#: Tokens of a window, of a piece that differencing moves as one, windows of a block, and pieces of a block at most.
CAPACITY, PIECE, BLOCK_WINDOWS, BLOCK_PIECES = 1024, 256, 128, 2048
#: A run of white space or of other characters this long goes to the tokenizers file: the other library's matcher has a stack,
#: and its merging takes the square of a run's length.
_RUN = re.compile(r"\s{2000}|\S{2000}").search
#: Texts of these characters, without "<|", have the same ids from either library (tests hold this).
_PLAIN = re.compile("[\t\n\r -~¡-¬®-ɏ–-—‘-”…€]*").fullmatch


def difference(sizes: list[int], windows: int) -> tuple[list[int], int]:
    """The window of each size, and the largest window's sum, by multiway differencing.

    Each size starts as a partial partition of ``windows`` sums. The two partitions of the largest
    imbalance (largest sum less smallest) merge, again and again, the largest sums of one with the
    smallest of the other. Ties go by the partitions' age. The merges' permutations, walked back from
    the last one, tell where each size lies.
    """
    n = len(sizes)
    if not n or windows == 1:
        return [0] * n, sum(sizes)
    # A partition: its sums, largest first. Those of a single size need no array until they merge.
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def taken(node: int) -> np.ndarray:
        if node >= n:
            return sums.pop(node)
        one = np.zeros(windows, np.int64)
        one[0] = sizes[node]
        return one

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        together = taken(a) + taken(b)[::-1]
        order = np.argsort(-together, kind="stable")
        together = together[order]
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = together
        heapq.heappush(heap, (int(together[-1] - together[0]), node))
    last = heap[0][1]
    largest = int(taken(last)[0])
    slots = {last: np.arange(windows)}  # of each partition, the window that each of its sums ends in
    found = [0] * n
    if last < n:
        return found, largest
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        place = np.empty(windows, np.int64)
        place[order] = slots.pop(node)
        for child, at in ((a, place), (b, place[::-1])):
            if child < n:
                found[child] = int(at[0])
            else:
                slots[child] = at
    return found, largest


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], int]:
    """The window of each size so that none exceeds ``capacity``, and the number of windows.

    Starts from the fewest windows that could do and raises their number while one is too full.
    """
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found, largest = difference(sizes, windows)
        if largest <= capacity:
            return found, windows
        windows += max(1, int(windows * (largest - capacity) / capacity / 2))


@cache
def byte_encoder(json_path: str, rank_path: str | None) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts by the tokenizers file; plain texts by the same vocabulary's ranks, which is faster."""

    def slow(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in hf_tokenizer(json_path).encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    if rank_path is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        plain = [bool(_PLAIN(t)) and "<|" not in t and not (len(t) >= 2000 and _RUN(t)) for t in texts]
        rest = iter(slow([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [fast.encode_ordinary(t) if p else next(rest) for t, p in zip(texts, plain, strict=True)]

    return encode


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    ranks: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    piece: int = PIECE,
    block_windows: int = BLOCK_WINDOWS,
    end_id: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents' ids, each with its place in a sequence of at most ``capacity`` tokens.

    Gives ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` and, ``with_ids``, the
    ``ids``. A document's ids are those of its text, without added tokens, and then ``end_id``. What fills
    whole windows is cut off first; the rest is cut into pieces of at most ``piece`` tokens. Pieces of about
    ``block_windows`` windows (2048 pieces at most) of one task are dealt to windows by differencing.

    A null or empty text is ``end_id`` alone; a repeated row is packed again; other columns are left out; an
    empty table gives no piece. There is no shuffle, a task holds one block, and a lost task gives the same
    rows again since ids of sequences come from the number of its partition.
    """
    json_path = tokenizer or vocabulary("byte_bpe_50k.json")
    rank_path = ranks or (None if tokenizer else vocabulary("byte_bpe_50k.tiktoken"))
    rows = key_and_text(docs, id_col, text_col)
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(json_path, rank_path)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        kind: pa.DataType | None = None
        done: list[tuple] = []  # (doc, start, ids, doc_tokens, sequence, offset)
        held: list[tuple] = []  # (doc, start, ids, doc_tokens), not yet dealt
        tokens = 0

        def deal() -> None:
            nonlocal sequence, tokens
            places, windows = windows_of([len(p[2]) for p in held], capacity)
            filled = [0] * windows
            used = {w: sequence + k for k, w in enumerate(sorted(set(places)))}
            for p, w in zip(held, places, strict=True):
                done.append((*p, used[w], filled[w]))
                filled[w] += len(p[2])
            sequence += len(used)
            tokens = 0
            held.clear()

        def given() -> pa.RecordBatch:
            docs_, starts, ids, totals, sequences, offsets = zip(*done, strict=True)
            columns = [pa.array(docs_, kind), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64())]
            columns += [pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(totals, pa.int64())]
            columns += [pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for keys, texts in text_batches(iter([batch])):
                for key, ids in zip(keys, encode([t or "" for t in texts]), strict=True):
                    whole = np.asarray([*ids, end_id], "<u4")
                    full = len(whole) // capacity * capacity
                    for s in range(0, full, capacity):
                        done.append((key, s, whole[s : s + capacity], len(whole), sequence, 0))
                        sequence += 1
                    for s in range(full, len(whole), piece):
                        held.append((key, s, whole[s : s + piece], len(whole)))
                    tokens += len(whole) - full
                    if tokens >= block_windows * capacity or len(held) >= BLOCK_PIECES:
                        deal()
                if len(done) >= 2000:
                    yield given()
        if held:
            deal()
        if done:
            yield given()

    return rows.mapInArrow(run, schema)
