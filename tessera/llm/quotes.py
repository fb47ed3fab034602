"""Quotation linking: quoted passages joined to the messages they come from, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import Scratch, materialize

#: A line's quote marks, a class in a loop, so that matching needs no stack however many there are.
MARKS = r"^([ \t>]*>)"
#: Lines that only announce a quote (fixed forms of mail programs). A line is gone over once however long it is: literals come before
#: their boundary, the first "schrieb" is as good as any other, and white space is looked at from the start of its run only.
ANNOUNCES = (
    r"^\s*(?:On|Am|Le|El)\b(?:.*(?:wrote(?<=\bwrote)|a écrit(?<=\ba écrit)|escribió(?<=\bescribió))\s*:\s*$"
    r"|(?>.*?schrieb(?<=\bschrieb)\b).*(?<!\s)\s*:\s*$)"
)
#: White space of one line, as ``\s`` has it.
WHITE = " \t\x0b\f\r"


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """(level, body) of each line: the number of its quote marks, and what follows them."""

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        level = F.char_length(F.regexp_replace(marks, "[^>]", ""))
        body = F.regexp_replace(F.regexp_replace(line, MARKS + " ?", ""), r"\r$", "")
        return F.struct(level.alias("level"), body.alias("body"))

    return F.transform(F.split(text, "\n"), parse)


def _starts(lines: str) -> Column:
    """Where runs of lines of one level start; a blank line ends a run and is in none."""

    def starts(line: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        return (F.trim(line["body"]) != "") & ((i == 0) | (before["level"] != line["level"]) | (F.trim(before["body"]) == ""))

    marked = F.transform(lines, lambda line, i: F.when(starts(line, i), i))
    return F.array_compact(marked)


def _passages(lines: str, starts: str) -> Column:
    """(level, text) of each run of lines that starts at one of ``starts``; each line is looked at once."""

    def run(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), F.size(lines))
        body = F.array_join(F.transform(F.slice(lines, start + 1, stop - start), lambda x: x["body"]), " ")
        return F.struct(F.get(lines, start)["level"].alias("level"), normalised(body).alias("text"))

    return F.filter(F.transform(starts, run), lambda r: r["text"] != "")


def _positions(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, position): the place of each of ``keys`` (conv_id, turn, thread) in its conversation, by thread and turn.

    Keys are dealt out in their order, so a conversation that holds most of them is spread over many tasks; a part's
    keys are numbered within it, and what precedes the part of a conversation, a row at most for each task, is added.
    """
    order = ["conv_id", "thread", "turn"]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.table(dealt.withColumns({"mid": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "quote-order")
    sizes = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only what a task begins in the middle of has something before it, so there is a row at most for each task.
    offsets = F.broadcast(sizes.withColumn("offset", before).where("offset > 0").select("conv_id", "part", "offset"))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("mid")) - 1
    numbered = placed.withColumn("k", within).join(offsets, ["conv_id", "part"], "left")
    return numbered.select("conv_id", "turn", (F.col("k") + F.coalesce("offset", F.lit(0))).cast("long").alias("position"))


def link_quotes(
    messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_depth: int = 64
) -> DataFrame:
    """Messages without their quotes, each with the message it replies to.

    Gives ``(conv_id, turn, role, text, n_quotes, n_linked, quote_depth, reply_to, thread, depth, position)``. In the order
    of ``position``, from 0 without gaps in each conversation, every message stands after the one it replies to.

    A line's level is the number of ``>`` before it; a run of lines of one level is a passage. Passages and lines
    of level 0 are a message's own. The hash of each quoted passage, and of each quoted line, is looked up among
    the own passages and lines of its conversation; the earliest earlier message that has it is its source. A
    message replies to the source of most quoted characters of level 1 (of the next level where none of level 1
    is found), the latest of several. ``thread`` is the turn that a chain of replies starts with, ``depth`` its length.
    In messages that quote, lines that announce a quote aren't own ones. They end an own passage, as lines of white space
    do; the own passage that goes on through them is looked up too, as a quote may hold them.

    Own passages are reduced to the first turn of each (conversation, hash) before the join, so a passage that
    many messages share makes no more rows. Null texts are empty; messages of a null conversation or turn link
    with nothing and have no position; rows that repeat a turn share its links and position; other columns are left out;
    an empty table gives an empty one. Lines and marks may be any number: each is looked at once. The result is a written table.
    """
    with Scratch(messages.sparkSession) as scratch:
        return materialize(_linked(messages, scratch, conv_col, turn_col, role_col, text_col, max_depth), "quotes")


def _linked(messages: DataFrame, scratch: Scratch, conv_col: str, turn_col: str, role_col: str, text_col: str, max_depth: int) -> DataFrame:
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("raw"))
    bare = F.transform(F.split("raw", "\n"), lambda x: F.struct(F.lit(0).alias("level"), F.rtrim(x, F.lit("\r")).alias("body")))
    rows = rows.withColumn("lines", F.when(F.contains("raw", F.lit(">")), _lines(F.col("raw"))).otherwise(bare))
    quoting = F.exists("lines", lambda x: x["level"] > 0)
    rows = rows.withColumns({"quoting": quoting, "depth": F.array_max(F.transform("lines", lambda x: x["level"])), "starts": _starts("lines")})

    def announces(x: Column) -> Column:
        return (x["level"] == 0) & F.col("quoting") & x["body"].rlike(ANNOUNCES)

    def parted(x: Column) -> Column:
        """The line, blank where it ends an own passage."""
        ends = (x["level"] == 0) & ((F.trim(x["body"], F.lit(WHITE)) == "") | announces(x))
        return F.struct(x["level"].alias("level"), F.when(ends, "").otherwise(x["body"]).alias("body"))

    empty = F.array().cast("array<struct<level:int,text:string>>")
    rows = rows.withColumns({"own": F.filter("lines", lambda x: (x["level"] == 0) & ~announces(x)), "passages": F.when(F.col("quoting"), _passages("lines", "starts")).otherwise(empty)})
    own_text = F.trim(F.array_join(F.transform("own", lambda x: x["body"]), "\n"), F.lit(" \t\r\n"))
    rows = rows.withColumn("text", F.when(F.col("quoting"), own_text).otherwise(F.col("raw")))
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    done = rows.select("conv_id", "turn", "role", "text", F.size(quoted).cast("long").alias("n_quotes"), F.col("depth").alias("quote_depth"))

    keyed = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    line_units = F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("text"), F.lit(False).alias("whole")))
    passage_units = F.transform(quoted, lambda p: F.struct(p["level"].alias("level"), p["text"].alias("text"), F.lit(True).alias("whole")))
    asked = keyed.where("quoting").select("conv_id", "turn", F.explode(F.concat(passage_units, line_units)).alias("u")).where("u.text <> ''")
    asked = scratch.table(asked.select("conv_id", "turn", F.col("u.level").alias("level"), F.sha2("u.text", 256).alias("h"), F.char_length("u.text").alias("chars"), F.col("u.whole").alias("whole")), "quoted")
    # Only conversations in which something is quoted need their own passages hashed.
    told = keyed.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    told = told.withColumn("parted", F.transform("lines", parted)).withColumn("own_starts", _starts("parted"))
    passages = F.concat(_passages("lines", "starts"), _passages("parted", "own_starts"))
    paragraphs = F.transform(F.filter(passages, lambda p: p["level"] == 0), lambda p: p["text"])
    whole = F.array(normalised(F.col("text")))
    units = F.explode(F.array_distinct(F.concat(paragraphs, F.transform("own", lambda x: normalised(x["body"])), whole))).alias("t")
    sources = told.select("conv_id", "turn", units).where("t <> ''").groupBy("conv_id", F.sha2("t", 256).alias("h")).agg(F.min("turn").alias("source"))
    met = asked.join(sources, ["conv_id", "h"]).where("source < turn")
    found = met.groupBy("conv_id", "turn", "level", "source").agg(F.sum(F.when(F.col("whole"), 2 * F.col("chars")).otherwise(F.col("chars"))).alias("chars"), F.count_if("whole").alias("n"))
    best = found.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), F.col("chars"), F.col("source"))).alias("best"), F.sum("n").alias("n_linked"))
    replies = scratch.table(best.select("conv_id", "turn", "n_linked", F.col("best.source").alias("reply_to")), "replies")

    # Chains of replies by pointer doubling: after k rounds each message knows its ancestor 2^k back.
    chains = replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("depth"))
    for _ in range(max_depth):
        up = chains.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        further = chains.join(up, ["conv_id", "thread"], "left")
        if not further.where("next IS NOT NULL").limit(1).count():
            break
        chains = scratch.table(further.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chains")
    else:
        raise RuntimeError("chains of replies did not settle")
    linked = replies.join(chains, ["conv_id", "turn"])
    keys = done.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct().join(chains.select("conv_id", "turn", "thread"), ["conv_id", "turn"], "left")
    positions = _positions(keys.withColumn("thread", F.coalesce("thread", "turn")), scratch)
    out = done.join(positions.join(linked, ["conv_id", "turn"], "left"), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "quote_depth", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), "position")
