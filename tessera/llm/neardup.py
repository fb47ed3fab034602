"""Near duplicates: MinHash bands, sequential Bayesian pruning, exact verification, connected classes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shingles import mixed, shingle_set
from tessera.llm.text import key_and_text, text_batches
from tessera.operators.components import connected_components
from tessera.session import Scratch, materialize

#: With 40 bands of 5 rows a pair of similarity 0.8 shares no band with probability 1.3e-7.
BANDS, ROWS = 40, 5
#: Hashes that one step of the sequential comparison looks at.
STEP = 20
#: Buckets up to this size are joined with themselves; larger ones are compared in blocks of about so many shingles and rows.
BLOCK, BLOCK_SHINGLES, BLOCK_ROWS = 32, 400_000, 512
#: A bucket's leader is its least node in one of so many orders: with few of them the buckets of
#: a large group mostly share their leaders, and a node is compared with few.
LEADERS = 4


@cache
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20_240_501)
    return made.integers(0, 1 << 32, (n, 1), np.uint32), made.integers(0, 1 << 32, (n, 1), np.uint32) | np.uint32(1)


def minhash(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least of each of ``n`` 32-bit hash functions over a set that isn't empty."""
    xor, mul = _seeds(n)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(h), 1024):
        np.minimum(least, ((h[None, s : s + 1024] ^ xor) * mul).min(axis=1), out=least)
    return least


@cache
def least_matches(threshold: float, miss: float, n: int) -> int:
    """The fewest matches among ``n`` hashes with which a pair stays a candidate.

    With a uniform prior the similarity's posterior after m matches is Beta(m + 1, n - m + 1), and it is at
    least ``threshold`` with the probability that n + 1 trials of that chance give m successes at most.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two signature matrices stay, looking at ``STEP`` more hashes at a time."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for s in range(0, a.shape[1], STEP):
        matches = matches + (a[alive, s : s + STEP] == b[alive, s : s + STEP]).sum(axis=1, dtype=np.int32)
        keep = matches >= least_matches(threshold, miss, min(s + STEP, a.shape[1]))
        alive, matches = alive[keep], matches[keep]
    return alive


def _leader_order() -> tuple[Column, Column]:
    """What a bucket's nodes are ordered by, to be reduced to its least, and the leader that the least stands for.

    Nodes are compared after an exclusive or with one of ``LEADERS`` masks, which gives them back.
    """
    masks = np.random.default_rng(11).integers(0, 1 << 62, LEADERS).tolist()
    mask = F.get(F.array(*map(F.lit, masks)), F.pmod("key", F.lit(LEADERS)).cast("int"))
    return F.col("node").bitwiseXOR(mask), F.col("least").bitwiseXOR(mask)


def _sketches(rows: DataFrame, size: int, bands: int, per_band: int) -> DataFrame:
    """(doc_id, mark, n, digest, sig, keys) of (doc_id, text, mark): set size, set digest, 16 bits of each hash, a key of each band."""
    columns = [("n", T.LongType()), ("digest", T.BinaryType()), ("sig", T.BinaryType()), ("keys", T.ArrayType(T.LongType()))]
    schema = T.StructType([rows.schema["doc_id"], rows.schema["mark"], *(T.StructField(c, t) for c, t in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([batch.column(0), batch.column(2)], names=["id", "mark"]), batch.column(1)], names=["key", "text"])
            for ids, texts in text_batches(iter([pair])):
                sizes, digests, sigs, keys = [], [], [], []
                for key, text in zip((x["id"] for x in ids), texts, strict=True):
                    shingles = shingle_set(text, size)
                    sizes.append(len(shingles))
                    if not len(shingles) or key is None:
                        digests.append(None)
                        sigs.append(None)
                        keys.append(None)
                        continue
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    least = minhash(shingles, bands * per_band)
                    sigs.append(((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes())
                    h = salt.copy()
                    for column in least.reshape(bands, per_band).T:
                        h = mixed(h + column)
                    keys.append(h.view(np.int64))
                own = [pa.array([x[c] for x in ids], batch.column(k).type) for c, k in (("id", 0), ("mark", 2))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of rows that hold (node, text, digest), where the text has that digest."""
    schema = T.StructType([rows.schema["node"], T.StructField("shingles", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            held: list[tuple] = []
            room = 1 << 18
            for i, key in enumerate(ids):
                shingles = shingle_set(batch.column(1)[i].as_py(), size)
                if xxhash.xxh3_128_digest(shingles.tobytes()) == digests[i]:
                    held.append((key, shingles.view(np.int64)))
                    room -= len(shingles)
                if room < 0 or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], batch.schema.field(0).type), pa.array([h[1] for h in held], pa.list_(pa.int64()))], names=schema.names)
                    held, room = [], 1 << 18

    return rows.mapInArrow(run, schema)


def _pruned(pairs: DataFrame, sketches: DataFrame, threshold: float, miss: float, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures leave a similarity of the threshold possible."""
    a = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (2, 3))
            stay = survivors(first, second, threshold, miss) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(stay, pa.int64())), batch.column(1).take(pa.array(stay, pa.int64()))], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have ``den * intersection >= num * union``."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    shared = F.size(F.array_intersect("xa", "xb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", shared.cast("long").alias("i"), (F.size("xa") + F.size("xb")).cast("long").alias("t"))
    return both.where(F.col("i") * den >= (F.col("t") - F.col("i")) * num).select("a", "b")


def _linked(group: pa.Table, threshold: float, miss: float, num: int, den: int) -> list[tuple]:
    """For each row that asks (``query``), a link to each other class among the others that has one.

    Members are tried in the order of their signatures' agreement, those that posterior bounds leave; the whole
    sets decide, and a class once linked isn't tried again.
    """
    found: list[tuple] = []
    nodes, comps = group["node"].to_pylist(), group["comp"].to_pylist()
    sizes = group["n"].to_numpy()
    sig = np.frombuffer(b"".join(group["sig"].to_pylist()), "<u2").reshape(len(nodes), -1)
    lists = group["shingles"].combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    # Sets are sorted as unsigned numbers, which Spark's longs aren't.
    sets = [values[i:j].view(np.uint64) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    asks = group["query"].to_numpy(zero_copy_only=False)
    number = {c: k for k, c in enumerate(dict.fromkeys(comps))}
    classes = np.array([number[c] for c in comps])
    rest = np.flatnonzero(~asks)
    for x in np.flatnonzero(asks):
        own, n = sets[x], sizes[x]
        rows = rest[(classes[rest] != classes[x]) & (np.minimum(sizes[rest], n) * den >= np.maximum(sizes[rest], n) * num)]
        one = np.broadcast_to(sig[x], (len(rows), sig.shape[1]))
        rows = rows[survivors(sig[rows], one, threshold, miss)]
        agree = (sig[rows] == one[: len(rows)]).sum(axis=1)
        met: set = set()
        for y in rows[np.argsort(-agree, kind="stable")]:
            if classes[y] in met:
                continue
            shared = int((own[np.minimum(np.searchsorted(own, sets[y]), len(own) - 1)] == sets[y]).sum())
            if shared * den >= (len(own) + len(sets[y]) - shared) * num:
                met.add(classes[y])
                found.append((nodes[x], nodes[y]))
    return found


def _within_large(members: DataFrame, sketches: DataFrame, sets: DataFrame, scratch: Scratch, threshold: float, miss: float, num: int, den: int) -> DataFrame:
    """Links of large buckets between a member outside its leader's class and members of other classes.

    ``members``: (key, node, n, comp, home), home the leader's class. A bucket's rows are dealt to blocks of about
    ``BLOCK_SHINGLES`` shingles and ``BLOCK_ROWS`` rows; those outside the home class go to every block, in parts of their own, so that
    no task holds more than a block and a part. A task gives links between classes, not pairs.
    """
    # What is small is written, so that a join with it is a broadcast, or one that can split a bucket.
    members = scratch.table(members, "large")
    weight = members.groupBy("key").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"))
    weight = scratch.table(weight, "blocks")
    at = members.join(sketches.select("node", "sig").join(sets, "node"), "node").join(weight, "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    outer = members.where("comp <> home").join(weight, "key").select("key", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("part")).distinct()
    outer = scratch.table(outer, "parts")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    shown = ("node", "comp", "n", "sig", "shingles")
    left = at.where("comp <> home").select("key", F.col("own").alias("part"), every.alias("block"), *shown, F.lit(True).alias("query"))
    right = at.join(outer, "key").select("key", "part", F.col("own").alias("block"), *shown, F.lit(False).alias("query"))
    node = sketches.schema["node"].dataType
    schema = T.StructType([T.StructField("a", node), T.StructField("b", node)])

    def run(group: pa.Table) -> pa.Table:
        found = _linked(group, threshold, miss, num, den) if len(group) else []
        kind = group.schema.field("node").type
        return pa.table({name: pa.array([f[k] for f in found], kind) for k, name in enumerate(("a", "b"))})

    # By one hash of all three: rows that lie by key already would else stay there, all of a bucket in one task. Two
    # blocks of one hash would be compared as one, which loses nothing.
    both = left.unionByName(right).withColumn("block", F.xxhash64("key", "part", "block")).drop("key", "part")
    return both.groupBy("block").applyInArrow(run, schema)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-7
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row: its class of near duplicates.

    Two texts are linked where ``100 * intersection >= percent * union`` of their sets of ``shingle``-word
    shingles (A-Z lower-cased); a class is what links reach, named by its least id, whose row is kept.

    Texts of equal sets are one node. Nodes that share a band's bucket are candidates. First each is compared
    with its bucket's leader: batch by batch of the signature, a pair goes when the posterior probability that it
    reaches the threshold falls below ``miss``, and the whole sets of the others decide. Then all pairs of a bucket
    that these links leave in different classes are treated alike, so that every candidate link that could join
    two classes is decided, while no group of copies is expanded into its pairs.

    Null and empty texts, and those without words, have an empty set and link with nothing; rows without an id
    link with nothing and are kept, in no class; equal repeated rows all get the same result; where an id stands on
    other texts too, each text is linked by itself, and may be in a class of its own, named by the least id of its rows;
    other columns are left out; an empty table gives an empty result. The result is a written table; those it took are deleted.
    """
    return _classes(docs, id_col, text_col, shingle, percent, bands, rows, miss).select("doc_id", "n_shingles", "component_id", "kept")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-7) -> DataFrame:
    """:func:`near_duplicates` with the ``mark`` of each row's text and the number of its class, ``class_``, null where it has none."""
    num, den, threshold = percent, 100, percent / 100
    texts = key_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    with Scratch(docs.sparkSession) as scratch:
        # A row's number is written with it, so it stays the same however often the table is read.
        sketched = scratch.table(_sketches(texts, shingle, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
        # A distinct set is a node, named by the least number of its rows.
        heads = scratch.table(sketched.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")), "heads")
        nodes = sketched.withColumnRenamed("row", "node").join(heads.select("node"), "node").select("node", "doc_id", "mark", "digest", "n", "sig", "keys")
        # Written, and not dealt out by key once for both uses: counts are then reduced before their shuffle, and
        # Spark can split the bucket of a large group in the join.
        slots = scratch.table(nodes.select("node", "n", F.explode("keys").alias("key")), "slots")
        order, leader = _leader_order()
        buckets = slots.groupBy("key").agg(F.count("*").alias("size"), F.min(order).alias("least")).where("size > 1").select("key", "size", leader.alias("leader"))
        members = scratch.table(slots.join(buckets, "key"), "members")

        active = members.select("node").distinct()
        sketches = scratch.table(nodes.join(active, "node").select("node", "doc_id", "mark", "digest", "n", "sig"), "active")
        # By id and text, so that the many texts of one id aren't one key; equal rows give one set.
        wanted = texts.join(sketches.select("doc_id", "mark", "node", "digest"), ["doc_id", "mark"])
        wanted = wanted.groupBy("doc_id", "mark", "node", "digest").agg(F.first("text").alias("text")).select("node", "text", "digest")
        sets = scratch.table(_sets(wanted, shingle), "sets")
        sketches = sketches.drop("doc_id", "mark", "digest")

        tried = members.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        links = scratch.table(_verified(_pruned(tried, sketches, threshold, miss, num, den), sets, num, den), "links")
        comps = connected_components(links).withColumnRenamed("component", "comp")

        known = members.where("size > 2").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        home = F.max(F.when(F.col("node") == F.col("leader"), F.col("comp"))).alias("home")
        split = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), home).where("x <> y").select("key", "home")
        open_ = scratch.table(known.join(split, "key").select("key", "node", "n", "comp", "home", "size"), "open")
        small = open_.where(F.col("size") <= BLOCK)
        u = small.where("comp <> home").select("key", F.col("node").alias("p"), F.col("comp").alias("cp"))
        v = small.select("key", F.col("node").alias("q"), F.col("comp").alias("cq"))
        near = u.join(v, "key").where("cp <> cq").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        near = _pruned(near, sketches, threshold, miss, num, den)
        far = _within_large(open_.where(F.col("size") > BLOCK), sketches, sets, scratch, threshold, miss, num, den)
        more = scratch.table(_verified(near, sets, num, den).union(far), "more-links")
        classes = connected_components(links.union(more)).withColumnRenamed("component", "class_")

        # A class is named by the least id of all its rows; one of a single set needs no grouping.
        linked = heads.join(classes, "node")
        least = linked.groupBy("class_").agg(F.min("least_id").alias("component_id"))
        linked = linked.select("digest", "class_").join(least, "class_")
        alone = heads.join(classes, "node", "left_anti").select("digest", F.col("node").alias("class_"), F.col("least_id").alias("component_id"))
        result = sketched.select("doc_id", "mark", "row", "n", "digest").join(linked.select("digest", "class_", "component_id").union(alone), "digest", "left")
        component = F.coalesce("component_id", "doc_id")
        kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
        return materialize(result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "mark", "row", "class_"), "near-duplicates")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with one row of each class: one of its least id.

    Of the rows of that id that are in the class, equal ones among them, the one with the least hash of its text stays, and of
    rows of equal id and text one. Another row of an id goes or stays with its own text's class. Rows without
    an id, and those without words, all stay.
    """
    found = _classes(docs, id_col, text_col, **options)
    first = found.where("class_ IS NOT NULL AND kept").groupBy("class_").agg(F.min("mark").alias("mark"), F.first("doc_id").alias("doc_id"))
    stays = first.select(F.col("doc_id").alias("stay_id_"), F.col("mark").alias("stay_mark_"), F.lit(True).alias("stays_"))
    classed = found.where("class_ IS NOT NULL").groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    # Only rows of texts that aren't alone in their class, or that repeat, are told apart by a join.
    told = classed.join(stays, (F.col("doc_id") == F.col("stay_id_")) & (F.col("mark") == F.col("stay_mark_")), "left")
    told = materialize(told.select("doc_id", "mark", (~F.coalesce("stays_", F.lit(False))).alias("gone"), F.col("n").alias("copies")).where("gone OR copies > 1"), "copies")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_"), F.col(f"`{id_col}`").alias("id_"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark_"))
    gone = told.where("gone").select(F.col("doc_id").alias("id_"), F.col("mark").alias("mark_"))
    left = packed.join(gone, ["id_", "mark_"], "left_anti")
    again = told.where("NOT gone").select(F.col("doc_id").alias("id_"), F.col("mark").alias("mark_"))
    if not again.limit(1).count():
        return left.select("doc_.*")
    single = left.join(again, ["id_", "mark_"], "left_anti").select("doc_")
    one = left.join(again, ["id_", "mark_"], "left_semi").groupBy("id_", "mark_").agg(F.first("doc_").alias("doc_")).select("doc_")
    return single.union(one).select("doc_.*")
