"""Mates: records s -> d in file order become pairs.

As defined, a record s -> d that finds d's entry absent enters d as the mate of s, unless s has one; a record that
finds s there makes a pair, and d's entry is spent; any other record is dropped. So an entry is made once and spent once:

* A record makes an entry if neither s nor d has one by then. Of equal records only the first can.
* A pair is made for each entry s of a d that some record s -> d comes after, and how many do is of no account.

What is left to find is which records make entries, a greedy choice in file order. It is made by deterministic reservations,
for all positions at once. Contigs that mate only within themselves and have few records don't concern one another: these are gone
through one after another, many in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import Scratch, broadcast_if_few, materialize

#: Open records that one task may go through at the end.
TAIL = 250_000
#: Records of a contig that are gone through in order, and of contigs that a task has.
HELD, DEALT = 250_000, 1_000_000
RECORD = ("file", "rec_no", "ref_id", "pos", "next_ref_id", "next_pos")


def _positions(records: DataFrame) -> DataFrame:
    s, d = F.struct("file", F.col("ref_id").alias("id"), F.col("pos").alias("at")), F.struct("file", F.col("next_ref_id").alias("id"), F.col("next_pos").alias("at"))
    return records.select(*RECORD, s.alias("s"), d.alias("d"))


def single_mate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records whose positions both have one mate each, and the others."""
    placed = _positions(records)
    mates = placed.select(F.col("s").alias("p"), F.col("d").alias("m")).union(placed.select("d", "s"))
    several = mates.groupBy("p").agg(F.min("m").alias("x"), F.max("m").alias("y")).where("x <> y").select("p")
    a, b = several.select(F.col("p").alias("s"), F.lit(True).alias("s_many")), several.select(F.col("p").alias("d"), F.lit(True).alias("d_many"))
    marked = placed.join(a, "s", "left").join(b, "d", "left").withColumn("many", F.coalesce("s_many", "d_many", F.lit(False))).drop("s_many", "d_many")
    return marked.where("NOT many").drop("many"), marked.where("many").drop("many")


def simple_pairs(simple: DataFrame) -> DataFrame:
    """Pairs of records whose positions have one mate each: one where both directions occur, in the later one's direction.

    A position that is its own mate makes a pair from two records on. The count of partial results, not of records,
    is what the shuffle moves.
    """
    key = [F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")]
    there = F.col("s") <= F.col("d")
    seen = simple.groupBy(*key).agg(F.min(F.when(there, F.col("rec_no"))).alias("up"), F.min(F.when(~there, F.col("rec_no"))).alias("down"), F.count("*").alias("n"))
    own = (F.col("a") == F.col("b")) & (F.col("n") > 1)
    pair = own | (F.col("a") != F.col("b")) & F.col("up").isNotNull() & F.col("down").isNotNull()
    first, second = F.when(own | (F.col("up") > F.col("down")), F.col("a")).otherwise(F.col("b")), F.when(own | (F.col("up") > F.col("down")), F.col("b")).otherwise(F.col("a"))
    out = seen.where(pair).select(first.alias("s"), second.alias("d"))
    return out.select(F.col("s.id").alias("ref_id"), F.col("s.at").alias("pos"), F.col("d.id").alias("next_ref_id"), F.col("d.at").alias("next_pos"))


def fold(records: list[tuple]) -> list[tuple]:
    """Pairs (s, d) of records (s, d) in order, as defined."""
    mate: dict = {}
    pairs = []
    for s, d in records:
        if d not in mate:
            mate.setdefault(s, d)
        elif mate[d] == s:
            mate[d] = None
            pairs.append((s, d))
    return pairs


def _entering(live: DataFrame) -> DataFrame:
    """(p, at, mate) of the records that surely make an entry: first in line at s, and before all that d itself has in line."""
    heads = live.groupBy("s").agg(F.min(F.struct("at", "d")).alias("head")).select("s", "head.*")
    turns = heads.select(F.col("s").alias("d"), F.col("at").alias("turn"))
    return heads.join(turns, "d", "left").where("turn IS NULL OR turn > at OR s = d").select(F.col("s").alias("p"), "at", F.col("d").alias("mate"))


def _still_open(live: DataFrame, entered: DataFrame) -> DataFrame:
    """The records that may yet make an entry: their s has none, and their d none that came before them."""
    own, other = entered.select(F.col("p").alias("s")), entered.select(F.col("p").alias("d"), F.col("at").alias("since"))
    return live.join(own, "s", "left_anti").join(other, "d", "left").where("since IS NULL OR since > at").select("s", "d", "at")


def _rest(live: DataFrame) -> DataFrame:
    """(p, at, mate) of all records that make an entry, one after another in a task."""
    schema = T.StructType([T.StructField("p", live.schema["s"].dataType), T.StructField("at", T.LongType()), T.StructField("mate", live.schema["d"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has: set = set()
        for batch in batches:
            s, d = ([tuple(x.values()) for x in batch.column(i).to_pylist()] for i in (0, 1))
            hits = []
            for i, (x, y) in enumerate(zip(s, d, strict=True)):
                if x not in has and y not in has:
                    has.add(x)
                    hits.append(i)
            made = batch.take(pa.array(hits, pa.int64()))
            yield pa.RecordBatch.from_arrays([made.column(0), made.column(2), made.column(1)], names=schema.names)

    return live.repartition(1).sortWithinPartitions("at").select("s", "d", "at").mapInArrow(run, schema)


def directions(records: DataFrame) -> DataFrame:
    """``(s, d, first, last)``: the first and the last record from one position to another."""
    return _positions(records).groupBy("s", "d").agg(F.min("rec_no").alias("first"), F.max("rec_no").alias("last"))


def entries_of(scratch: Scratch, pairs: DataFrame, tail: int = TAIL) -> DataFrame:
    """``(p, at, mate)``: all entries that :func:`directions` make where there is none yet, in rounds; the table goes with ``scratch``."""
    live = scratch.table(pairs.select("s", "d", F.col("first").alias("at")), "open")
    entries = scratch.folder("entries")
    for done in count():
        if (n := live.count()) <= tail:
            break
        entered = scratch.part(_entering(live), entries, done)
        live = scratch.table(_still_open(live, entered), "open")
    entered = scratch.part(_rest(live) if n else _entering(live), entries, done)
    return scratch.spark.read.schema(entered.schema).parquet(entries).select("p", "at", "mate")


def met(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """``(s, d)`` of the entries s of a d that some record s -> d comes after."""
    return pairs.join(entries.select(F.col("p").alias("d"), F.col("mate").alias("s"), "at"), ["s", "d"]).where("last > at").select("s", "d")


def as_pairs(found: DataFrame) -> DataFrame:
    return found.select(F.col("s.id").alias("ref_id"), F.col("s.at").alias("pos"), F.col("d.id").alias("next_ref_id"), F.col("d.at").alias("next_pos"))


def complex_pairs(records: DataFrame, tail: int = TAIL) -> DataFrame:
    """Pairs of any records, whatever the graph of positions.

    Of the records from one position to another the first and the last are kept, by a partial aggregate. Then come rounds: of
    each position the first record in line is looked at, and if the position that it goes to has nothing in line before it, the
    record makes an entry, as in file order it would. All records that this decides leave: those from such a position, and later ones to
    it. The first record of all is decided in each round, and in any order but an adverse one a share of all is; a position with very many
    records costs no round for each, as only its first in line and its entry count. Joins have one row a position on one side.

    Each round's tables are written, so a lost executor costs no round. Once ``tail`` records at most are open, one task
    goes through them in order; with 0 there are rounds to the end.
    """
    with Scratch(records.sparkSession) as scratch:
        pairs = scratch.table(directions(records), "mates")
        return materialize(as_pairs(met(pairs, entries_of(scratch, pairs, tail))), "mate-pairs")


def _joined_contigs(records: DataFrame, held: int) -> tuple[DataFrame | None, int]:
    """(file, contig) of the contigs that have a mate on another one, nulls or more than ``held`` records, None without any; and the number of all records."""
    inside = F.col("ref_id") == F.col("next_ref_id")
    for c in ("file", "rec_no", "pos", "next_pos"):
        inside &= F.col(c).isNotNull()
    outside = ~F.coalesce(inside, F.lit(False))
    of = materialize(records.groupBy("file", F.col("ref_id").alias("contig")).agg(F.count("*").alias("n"), F.max(outside).alias("outside")), "contigs")
    joined = of.where(F.col("outside") | (F.col("n") > held)).select("file", "contig")
    total, led, several = of.agg(F.sum("n"), F.max("outside"), F.max("n")).first()
    if not led and (several or 0) <= held:
        return None, total or 0
    if led:
        joined = joined.union(records.where(outside).select("file", F.col("next_ref_id").alias("contig")))
    return joined.distinct(), total


def _folded(records: DataFrame, parts: int) -> DataFrame:
    """:func:`fold` of each contig's records, none of which leads to another contig."""
    fields = {f.name: f.dataType for f in records.schema.fields}
    schema = T.StructType([T.StructField("ref_id", fields["ref_id"]), T.StructField("pos", fields["pos"]), T.StructField("next_pos", fields["next_pos"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mate: dict = {}
        before = None
        for batch in batches:
            file, ref, s, d = (batch.column(c) for c in ("file", "ref_id", "pos", "next_pos"))
            fresh = [True] * len(s)
            if len(s):
                same = pc.and_(pc.equal(file[1:], file[:-1]), pc.equal(ref[1:], ref[:-1]))
                fresh[1:] = pc.invert(same).to_pylist()
                fresh[0] = before != (file[0].as_py(), ref[0].as_py())
                before = (file[-1].as_py(), ref[-1].as_py())
            hits = []
            for i, (new, x, y) in enumerate(zip(fresh, s.to_pylist(), d.to_pylist(), strict=True)):
                if new:
                    mate = {}
                if y not in mate:
                    mate.setdefault(x, y)
                elif mate[y] == x:
                    mate[y] = None
                    hits.append(i)
            yield batch.select(["ref_id", "pos", "next_pos"]).take(pa.array(hits, pa.int64()))

    own = records.select("file", "ref_id", "rec_no", "pos", "next_pos").repartition(parts, "file", "ref_id").sortWithinPartitions("file", "ref_id", "rec_no")
    return own.mapInArrow(run, schema).select("ref_id", "pos", F.col("ref_id").alias("next_ref_id"), "next_pos")


def mate_pairs(records: DataFrame, tail: int = TAIL, held: int = HELD) -> DataFrame:
    """``(ref_id, pos, next_ref_id, next_pos)`` of all pairs of records (file, rec_no, ref_id, pos, next_ref_id, next_pos).

    Files don't mix. ``rec_no`` orders a file's records. A contig whose records, ``held`` at most, all stay on it is gone through in order
    in a task, with others like it; that shuffles a record once. Of the other contigs positions with one mate each need an aggregate only,
    and the rest rounds. ``records`` is gone over twice, or four times where there are others.
    """
    records = records.select(*RECORD)
    joined, n = _joined_contigs(records, held)
    parts = max(-(-n // DEALT), 1)
    parts = max(parts, records.sparkSession.sparkContext.defaultParallelism) if parts > 1 else 1
    if joined is None:
        return _folded(records, parts)
    joined = broadcast_if_few(joined.select(F.col("file").alias("of_file"), "contig"))
    met = F.col("file").eqNullSafe(F.col("of_file")) & F.col("ref_id").eqNullSafe(F.col("contig"))
    simple, rest = single_mate(records.join(joined, met, "left_semi"))
    return _folded(records.join(joined, met, "left_anti"), parts).unionByName(simple_pairs(simple)).unionByName(complex_pairs(rest, tail))
