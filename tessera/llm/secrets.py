"""Secret scans: candidates by pattern, told apart by how many repositories and owners have the same value.

A value that many owners have is an example that was copied; one that looks live and that one or two owners have is theirs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import text_batches
from tessera.session import materialize

#: Kinds of candidates in the order of their spans; the last is what this method adds.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
#: A bare value: so many characters at least, of which so many differ, with capitals, small letters and digits.
BARE, BARE_DIFFERENT = re.compile(r"[A-Za-z0-9+/_-]{20,}"), 10
#: Characters of an assigned value, and those, of which so many differ, of any that looks live.
LEAST_ASSIGNED, LEAST_LIVE, LIVE_DIFFERENT = 8, 16, 8
#: A value of more owners than this is copied.
MAX_OWNERS = 2
#: A value of more than one in so many candidates is hot: there are fewer hot ones than this.
HOT = 1_000


def _has(value: str, *classes: str) -> bool:
    return all(re.search(c, value) for c in classes)


def looks_live(value: str) -> bool:
    """Letters and digits, long and varied enough for a key."""
    return len(value) >= LEAST_LIVE and len(set(value)) >= LIVE_DIFFERENT and _has(value, "[A-Za-z]", "[0-9]")


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start and kind; places are code points. Bare values are those outside the other spans.

    Matches of one kind are leftmost and don't overlap; an assignment of a short value is passed over, with what it spans.
    """
    if not text:
        return []
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        found += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    found.sort(key=lambda x: (x[1], x[0]))
    bare = [m for m in BARE.finditer(text) if len(set(m[0])) >= BARE_DIFFERENT and _has(m[0], "[A-Z]", "[a-z]", "[0-9]")]
    if bare:
        # Both lists go by start; spans of the base may overlap, so the furthest end before a place decides.
        at, reach, own = 0, 0, []
        for m in bare:
            while at < len(found) and found[at][1] < m.end():
                reach = max(reach, found[at][2])
                at += 1
            if reach <= m.start():
                own.append((3, m.start(), m.end(), m[0]))
        found = sorted(found + own, key=lambda x: (x[1], x[0]))
    return found


def scan(docs: DataFrame, owner: Column, repo: Column, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, owner, repo, found) of each row; a candidate is (kind, start, stop, digest, live). No value leaves the scan."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), owner.alias("owner"), repo.alias("repo"), F.col(f"`{text_col}`").cast("string").alias("text"))
    item = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("live", T.BooleanType())])
    schema = T.StructType([rows.schema["doc_id"], rows.schema["owner"], rows.schema["repo"], T.StructField("found", T.ArrayType(item))])
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("digest", pa.binary()), ("live", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(range(batch.num_rows))
            for at, texts in text_batches(iter([pa.RecordBatch.from_arrays([keys, batch.column(3)], names=["at", "text"])])):
                made = [
                    [{"kind": k, "start": s, "stop": e, "digest": hashlib.sha256(v.encode()).digest()[:16], "live": looks_live(v)} for k, s, e, v in candidates(text)]
                    for text in texts
                ]
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(taken) for i in range(3)), pa.array(made, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """``(digest, n_owners, n_repos, n)``: the distinct owners and repositories of each candidate value, and its occurrences.

    Occurrences are counted by value, owner and repository first, where they are; what is shuffled for a value is a row for
    each of its repositories, and no group is ever held.
    """
    each = found.select("owner", "repo", F.explode("found.digest").alias("digest"))
    by_repo = each.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"), F.sum("n").alias("n"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS) -> DataFrame:
    """``(doc_id, secrets)`` for each row: its candidates in order as (kind, start, stop, live, n_owners, n_repos, copied).

    Kinds are those of ``KINDS``. ``copied`` tells that more than ``max_owners`` owners have the value; ``live`` that it looks
    like a key and isn't copied. A bare value stays only if it isn't copied, the others always.

    Null and empty texts have no candidates; nulls of the owner or of a repository's columns are one owner's or part of one name; repeated
    rows each get their result and are one repository's; other columns are left out; an empty table gives an empty one.
    A value that very many rows have is joined by broadcast: fewer than ``HOT`` values can have more than one in ``HOT`` of all candidates.
    """

    def name(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    told = scan(docs, name(owner_col), F.struct(*(name(c).alias(f"c{i}") for i, c in enumerate(repo_cols))), id_col, text_col)
    found = materialize(told.withColumn("row_", F.monotonically_increasing_id()), "secrets")
    known = materialize(ownership(found), "ownership")
    share = (known.agg(F.sum("n")).first()[0] or 0) / HOT
    some = found.where(F.size("found") > 0).select("row_", F.explode("found").alias("x")).select("row_", "x.*")
    columns = ["n_owners", "n_repos"]
    hot = known.where(F.col("n") > share).select(F.col("digest"), *(F.col(c).alias(f"hot_{c}") for c in columns))
    met = some.join(F.broadcast(hot), "digest", "left")
    common = met.where("hot_n_owners IS NOT NULL").select("row_", "kind", "start", "stop", "live", *(F.col(f"hot_{c}").alias(c) for c in columns))
    rare = met.where("hot_n_owners IS NULL").join(known.where(F.col("n") <= share).select("digest", *columns), "digest").select(*common.columns)
    copied = F.col("n_owners") > max_owners
    judged = common.union(rare).withColumn("copied", copied).withColumn("live", F.col("live") & ~copied).where((F.col("kind") < 3) | ~F.col("copied"))
    each = judged.groupBy("row_").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "live", "n_owners", "n_repos", "copied"))).alias("secrets"))
    return found.select("row_", "doc_id").join(each, "row_", "left").select("doc_id", F.coalesce("secrets", F.array().cast(each.schema["secrets"].dataType)).alias("secrets"))


def spans_of(secrets: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:stop`` of those of some kinds, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    some = F.filter(secrets, lambda x: F.get(names, x["kind"]).isin(list(kinds)))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame, **options: object) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied)`` for each row, from :func:`scan_secrets`."""
    found = scan_secrets(docs, **options)

    def count(field: str, value: object) -> Column:
        return F.size(F.filter("secrets", lambda x: x[field] == F.lit(value))).cast("long")

    kinds = [count("kind", k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    base = F.sha2(spans_of(F.col("secrets"), KINDS[:3]), 256).alias("base_sha256")
    return found.select("doc_id", *kinds, base, spans_of(F.col("secrets")).alias("spans"), count("live", True).alias("n_live"), count("copied", True).alias("n_copied"))
