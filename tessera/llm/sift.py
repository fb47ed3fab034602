"""Rows that a step may touch told apart from the others, so that only they are shuffled. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the table that tells them apart.
SLOTS = 1 << 17


def touching(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose ``columns`` may be among ``keys``, and those whose aren't, by a table of ``SLOTS`` times 64 bits.

    The table is broadcast and doesn't grow; with more keys than it has bits it lets all rows pass, which loses nothing.
    """

    def place(h: Column) -> tuple[Column, Column]:
        return F.pmod(h, F.lit(SLOTS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")

    slot, bit = place(F.xxhash64(*columns))
    bits = keys.select(slot.alias("slot_"), bit.alias("bit_")).groupBy("slot_").agg(F.bit_or(F.expr("shiftleft(1L, bit_)")).alias("bits_"))
    met = rows.withColumns({"slot_": slot, "bit_": bit}).join(F.broadcast(bits), "slot_", "left")
    has = F.coalesce(F.call_function("shiftright", F.col("bits_"), F.col("bit_")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return met.where(has).drop("slot_", "bit_", "bits_"), met.where(~has).drop("slot_", "bit_", "bits_")
