"""Text sources: numbered lines, FASTA, paired FASTQ and the table of alleles, plain or gzip by suffix."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.motifs import trimmed_right
from tessera.operators.align import contig_ids
from tessera.session import broadcast_if_few


def path_suffix(path: str) -> str:
    """What follows the last dot, with the dot; empty without one."""
    return os.path.splitext(path)[1]


def path_core(path: str) -> str:
    """The file's name without folders and without its last suffix."""
    return os.path.splitext(os.path.basename(path))[0]


def numbered(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """``rows`` (value, file, block) of a file scan with ``id``, dense from 0, in the order of files and lines.

    A row's number within its block is how far it stands behind the block's first; blocks, not rows, are put in order.
    """
    placed = rows.withColumn("mid", F.monotonically_increasing_id())
    firsts = placed.groupBy("file", "block").agg(F.min("mid").alias("first"))
    marked = placed.join(broadcast_if_few(firsts), ["file", "block"])  # a row per split of the scan
    marked = marked.withColumn("head", (F.col("block") == 0) & (F.col("mid") == F.col("first")))
    kept = marked if where is None else marked.where(where)
    within = kept.withColumn("mid", F.monotonically_increasing_id())
    blocks = within.groupBy("file", "block").agg(F.min("mid").alias("first_kept"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "block", "first_kept", F.coalesce(before, F.lit(0)).alias("offset"))
    return within.join(broadcast_if_few(offsets), ["file", "block"]).withColumn("id", F.col("mid") - F.col("first_kept") + F.col("offset")).drop("mid", "first", "first_kept", "offset")


def _scan(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(id, value)``: lines, trimmed at the right, numbered from 0."""
    return numbered(_scan(spark, path)).select("id", trimmed_right(F.col("value")).alias("value"))


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    lines.select(F.col(column).cast("string").alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str | list[str], name_mode: str = "line") -> DataFrame:
    """``(id, name, seq, length)``: records in file order, ids dense from 0.

    The name is the whole header, or with ``name_mode="first_token"`` what precedes its first white space. Lines are
    trimmed at the right and joined; what precedes the first header, and records without a sequence, go without an id.
    """
    if name_mode not in ("line", "first_token"):
        raise ValueError(f"unknown name_mode {name_mode!r}")
    body = F.regexp_replace(F.regexp_replace("rest", r"[ \t\x0B\f\r]*\n", ""), r"[ \t\x0B\f\r]+$", "")
    rows = _scan(spark, path, "\n>").withColumn("junk", F.lit(None))
    shown = numbered(rows, (~F.col("head") | F.col("value").startswith(">")) & _has_sequence(F.col("value"))).drop("junk")
    text = F.when(F.col("head"), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    parts = shown.select("id", F.regexp_extract(text, r"^([^\n]*)", 1).alias("header"), F.regexp_replace(text, r"^[^\n]*\n?", "").alias("rest"))
    name = trimmed_right(F.col("header"))
    if name_mode == "first_token":
        name = F.regexp_extract(name, r"^(\S*)", 1)
    return parts.select(F.col("id").cast("int").alias("id"), name.alias("name"), body.alias("seq")).withColumn("length", F.char_length("seq"))


def _has_sequence(value: Column) -> Column:
    return value.rlike(r"\n[\s\S]*\S")


def write_fasta(pieces: DataFrame, path: str) -> None:
    """Pieces (id, ord, name, seq) in order, one line for each sequence, as text files whose names sort in that order."""
    ordered = pieces.repartitionByRange("id", "ord").sortWithinPartitions("id", "ord")
    ordered.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def read_fastq_pairs(spark: SparkSession, left: str, right: str) -> DataFrame:
    """``(block, left, right)``: the records of two files of the same order, each (name, seq, split, quality)."""

    def records(path: str, side: str) -> DataFrame:
        lines = read_lines(spark, path).select(F.floor(F.col("id") / 4).alias("block"), (F.col("id") % 4).alias("k"), "value")
        at = [F.max(F.when(F.col("k") == k, F.col("value"))).alias(n) for k, n in enumerate(("name", "seq", "split", "quality"))]
        whole = lines.groupBy("block").agg(*at, F.count("*").alias("n")).where("n = 4")
        return whole.select("block", F.struct(F.regexp_replace("name", "^@", "").alias("name"), "seq", "split", "quality").alias(side))

    return records(left, "left").join(records(right, "right"), "block")


def allele_table(lines: DataFrame, contigs: DataFrame, groups: int) -> DataFrame:
    """``(line_no, allele_idx, contig_id)`` of lines (id, value): from the third column on, each a contig's name, -1 if unknown.

    Lines of fewer than four columns are passed over; one of more than ``groups`` + 2 fails.
    """
    columns = lines.select(F.col("id").alias("line_no"), F.split(trimmed_right(F.col("value")), "\t").alias("cols")).where("size(cols) >= 4")
    fits = F.when(F.size("cols") <= groups + 2, F.col("cols")).otherwise(F.raise_error(F.lit(f"a line has more contigs than the {groups} allele groups")))
    named = columns.select("line_no", F.posexplode(F.slice(fits, F.lit(3), F.greatest(F.size("cols") - 2, F.lit(0)))).alias("allele_idx", "name"))
    ids = contig_ids(contigs).select("name", F.col("id").alias("contig_id"))
    return named.join(ids, "name", "left").select("line_no", "allele_idx", F.coalesce("contig_id", F.lit(-1)).cast("int").alias("contig_id"))
