"""Sequences cut at regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_sequences(contigs: DataFrame, regions: DataFrame) -> DataFrame:
    """``(id, ord, name, seq)``: the pieces of each contig (id, name, seq) at its regions (contig_id, a, b).

    Positions count from 1. A region gives the piece before it, ``name_base+1_a-1``, and itself, ``name_a_b-1``; what
    is left after the last is ``name_base_size``. A contig without regions stays whole under its name. Bytes past the
    sequence's end are left out, the label keeps the region's end.
    """
    listed = regions.groupBy("contig_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cuts"))
    both = contigs.join(listed, contigs["id"] == listed["contig_id"], "left").drop("contig_id")

    def piece(label: Column, start: Column, stop: Column) -> Column:
        return F.struct(label.alias("label"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))

    def pieces(cut: Column, i: Column) -> Column:
        base = F.when(i > 0, F.get("cuts", i - 1)["b"] - 1).otherwise(0)
        s, e = cut["a"] - 1, cut["b"] - 1
        return F.array(piece(F.concat_ws("_", F.lit(""), base + 1, s), base, s), piece(F.concat_ws("_", F.lit(""), s + 1, e), s, e))

    size = F.char_length("seq")
    last = F.try_element_at("cuts", F.lit(-1))["b"] - 1
    tail = F.when(last < size, F.array(piece(F.concat_ws("_", F.lit(""), last, size), last, size))).otherwise(F.array().cast("array<struct<label:string,start:int,stop:int>>"))
    whole = F.array(piece(F.lit(""), F.lit(0), size))
    made = F.when(F.col("cuts").isNull(), whole).otherwise(F.concat(F.flatten(F.transform("cuts", pieces)), tail))
    rows = both.select("id", "name", "seq", F.posexplode(made).alias("ord", "p"))
    text = F.substring("seq", F.col("p.start") + 1, F.greatest(F.lit(0), F.col("p.stop") - F.col("p.start")))
    return rows.select("id", "ord", F.concat("name", "p.label").alias("name"), text.alias("seq"))
