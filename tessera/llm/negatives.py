"""Hard negatives: blocks of anchors are broadcast against blocks of candidates, whose products are dense matrices.

A first pass keeps each anchor's best positives, as lists that merge; a second one keeps, for each of them, the best rows of
other labels whose product lies in a window that the positive's sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import fresh_path, materialize, until_exit

#: Components are floor(SCALE x); positives and negatives kept, and the window's shares of the positive's score, in hundredths.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256.0, 5, 10, 30, 90
#: Bytes of the anchors' vectors that are broadcast at once, those of the candidates that one task goes through, and products that it holds at once.
ANCHOR_BYTES, TASK_BYTES, PRODUCTS = 16 << 20, 256 << 20, 1 << 21
_EXACT, _MOST = float(1 << 53), (1 << 63) - 1


def quantised(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors that have no null or non-finite component: their places, and floor(SCALE x) in float64.

    Shorter vectors are filled up with zeros.
    """
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    there = np.flatnonzero(np.asarray(vectors.is_valid()))
    held = vectors.take(pa.array(there))
    sizes = np.asarray(held.value_lengths(), np.int64) if len(held) else np.zeros(0, np.int64)
    flat = held.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(math.nan)) if len(flat) else np.zeros(0)
    at = np.repeat(np.arange(len(there)), sizes)
    out = np.zeros((len(there), int(sizes.max(initial=0))))
    with np.errstate(over="ignore", invalid="ignore"):
        out[at, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(SCALE * x)
    fine = np.isfinite(out).all(axis=1)
    return there[fine], out[fine]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer inner products of the rows of two matrices of integers: int64, the nearest one where one doesn't fit.

    A sum of products whose sizes stay below 2^53 is exact in float64, in any order. Others are added up as Python's integers.
    """
    d = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (a, b))
    with np.errstate(over="ignore"):
        bound = d * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[min(max(sum(x * y for x, y in zip(r, s)), -_MOST - 1), _MOST) for s in whole[1]] for r in whole[0]], np.int64).reshape(len(a), len(b))


@dataclass
class Best:
    """The best ``k`` (score, id) of each of ``n`` lists, higher scores first, then smaller ids. Two of them merge."""

    n: int
    k: int

    def __post_init__(self) -> None:
        self.of, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A full list's last entry; what comes after it changes nothing.
        self.last_score, self.last_id = np.full(self.n, -_MOST - 1, np.int64), np.full(self.n, _MOST, np.int64)

    def closer(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of some entries come before the last one of their list, or may enter it as it isn't full."""
        last = self.last_score[of]
        return (score > last) | (score == last) & (ids <= self.last_id[of])

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        of, score, ids = (np.concatenate(p) for p in ((self.of, of), (self.score, score), (self.id, ids)))
        # ~x instead of -x: it turns the order round for all of int64.
        order = np.lexsort((ids, ~score, of))
        of, score, ids = of[order], score[order], ids[order]
        first = np.searchsorted(of, of)
        kept = np.arange(len(of)) - first < self.k
        self.of, self.score, self.id = of[kept], score[kept], ids[kept]
        full = np.flatnonzero(np.arange(len(of)) - first == self.k - 1)
        self.last_score[of[full]], self.last_id[of[full]] = score[full], ids[full]


@dataclass
class Anchors:
    """A block of anchors: ids, labels and vectors, and for the second pass (anchor, score) of each positive, which go by anchor."""

    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    positive_of: np.ndarray | None = None
    positive: np.ndarray | None = None


def _windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest x with low * s <= 100 x <= high * s, for each s."""
    return (np.array([f(int(s)) for s in scores], np.int64) for f in (lambda s: -((-low * s) // 100), lambda s: high * s // 100))


def positives_in(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], anchors: Anchors, k: int) -> Best:
    """The best ``k`` other rows of each anchor's label among candidates (ids, labels, vectors). Only rows of one label meet."""
    best = Best(len(anchors.id), k)
    by_label = {int(v): np.flatnonzero(anchors.label == v) for v in np.unique(anchors.label)}
    for ids, labels, vectors in batches:
        for label in np.unique(labels).tolist():
            rows = by_label.get(label)
            if rows is None:
                continue
            same = np.flatnonzero(labels == label)
            step = max(1, PRODUCTS // len(rows))
            for s in range(0, len(same), step):
                part = same[s : s + step]
                found = products(anchors.vector[rows], vectors[part])
                of, other = (x.ravel() for x in np.broadcast_arrays(rows[:, None], ids[part][None, :]))
                score = found.ravel()
                near = np.flatnonzero(best.closer(of, score, other) & (anchors.id[of] != other))
                best.add(of[near], score[near], other[near])
    return best


def negatives_in(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], anchors: Anchors, k: int, low: int, high: int) -> Best:
    """The best ``k`` rows of other labels in each positive's window among candidates (ids, labels, vectors)."""
    best = Best(len(anchors.positive), k)
    least, most = _windows(anchors.positive, low, high)
    # Positives go by anchor: slot j of an anchor is its j-th one.
    slot = np.arange(len(anchors.positive)) - np.searchsorted(anchors.positive_of, anchors.positive_of)
    slots = [np.flatnonzero(slot == j) for j in range(int(slot.max(initial=-1)) + 1)]
    for ids, labels, vectors in batches:
        step = max(1, PRODUCTS // max(1, len(anchors.id)))
        for s in range(0, len(ids), step):
            other, label = ids[s : s + step], labels[s : s + step]
            found = products(anchors.vector, vectors[s : s + step])
            for of in slots:
                score = found[anchors.positive_of[of]]
                met = (score >= least[of][:, None]) & (score <= most[of][:, None]) & (label[None, :] != anchors.label[anchors.positive_of[of]][:, None])
                i, j = np.nonzero(met)
                near = best.closer(of[i], score[i, j], other[j])
                i, j = i[near], j[near]
                best.add(of[i], score[i, j], other[j])
    return best


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        rows, vectors = quantised(batch.column(2))
        ids, labels = (np.asarray(batch.column(i), np.int64)[rows] for i in (0, 1))
        yield ids, labels, vectors


def _pass(rows: DataFrame, shared, mine, k: int) -> DataFrame:
    """(at, score, vec_id): what ``mine`` finds in each task for the broadcast anchors, and of it the best ``k`` of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = mine(_candidates(batches), shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(best.of), pa.array(best.score), pa.array(best.id)], names=["at", "score", "vec_id"])

    found = rows.mapInArrow(run, "at bigint, score bigint, vec_id bigint")
    order = Window.partitionBy("at").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relabelled(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """(label + 1) % 10 where the id is divisible by 7, else the label."""
    label = F.col(label_col).cast("bigint")
    return F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label)


def mine_hard_negatives(
    vectors: DataFrame,
    anchor: Column | None = None,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the anchors among the rows of ``vectors``.

    ``anchor`` tells which rows are anchors (those whose id is divisible by 100), ``label`` is the label's expression
    (``label``). Components become floor(256 x), and a score is the integer inner product. An anchor's positives are its first
    rows of the same label and another id; for each one its negatives are the first rows of other labels with
    ``low`` * positive_score <= 100 * negative_score <= ``high`` * positive_score. Higher scores come first, then smaller ids.

    Anchors are dealt into blocks of ``anchor_bytes``, and of one block at a time the vectors come to the driver and are broadcast;
    the candidates stay where they are and nothing of them is shuffled but each task's best. Each block's rows are written before the next.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. A shorter vector is filled up with zeros. Scores
    beyond a long are the nearest one. Rows that repeat each take part, and each repeated anchor gets its rows; a row with
    the anchor's own id is never its positive. Other columns aren't read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ids = F.col(f"`{id_col}`").cast("bigint")
    chosen = F.col(f"`{id_col}`") % 100 == 0 if anchor is None else anchor
    rows = vectors.select(ids.alias("vec_id"), (F.col("label") if label is None else label).cast("bigint").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.coalesce(chosen, F.lit(False)).alias("anchor"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    candidates = rows.select("vec_id", "label", "vector")
    anchors = materialize(rows.where("anchor").drop("anchor").withColumn("row_", F.monotonically_increasing_id()), "anchors")
    n, width = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n * width * 8 // anchor_bytes))
    # Many small files are few tasks: each one's best lists are merged before they are shuffled.
    candidates = candidates.coalesce(max(spark.sparkContext.defaultParallelism, vectors.count() * width * 8 // TASK_BYTES))
    out = fresh_path(spark, "negatives")
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == "rank" else T.LongType()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
    spark.createDataFrame([], schema).write.parquet(out)
    for block in range(blocks):
        held = anchors.where(F.pmod(F.xxhash64("row_"), F.lit(blocks)) == block).toArrow()
        fine, matrix = quantised(held.column("vector"))
        mine = Anchors(np.asarray(held.column("vec_id"), np.int64)[fine], np.asarray(held.column("label"), np.int64)[fine], matrix)
        if not len(mine.id):
            continue
        shared = spark.sparkContext.broadcast(mine)
        found = _pass(candidates, shared, lambda batches, a: positives_in(batches, a, positives), positives).toArrow().sort_by([("at", "ascending"), ("rank", "ascending")])
        shared.unpersist()
        mine.positive_of, mine.positive = (np.asarray(found.column(c), np.int64) for c in ("at", "score"))
        shared = spark.sparkContext.broadcast(mine)
        best = _pass(candidates, shared, lambda batches, a: negatives_in(batches, a, negatives, low, high), negatives)
        pairs = {"at": np.arange(found.num_rows), "anchor_id": mine.id[mine.positive_of], "positive_id": np.asarray(found.column("vec_id"), np.int64), "positive_score": mine.positive}
        named = F.broadcast(spark.createDataFrame(pa.table({c: pa.array(v, pa.int64()) for c, v in pairs.items()})))
        full = best.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(named, "at")
        full.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)).write.mode("append").parquet(out)
        shared.unpersist()
    return spark.read.schema(schema).parquet(until_exit(spark, out))
