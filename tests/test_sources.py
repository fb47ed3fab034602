import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.plans import cli
from tessera.sources import binary, text


def bam(path, references, records, block=500):
    """A BAM file of BGZF blocks. A record: (ref, pos, mapq, next_ref, next_pos)."""
    raw = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(references))
    for name, length in references:
        raw += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for ref, pos, mapq, next_ref, next_pos in records:
        body = struct.pack("<iiBBHHHIiii", ref, pos, 2, mapq, 0, 0, 0, 0, next_ref, next_pos, 0) + b"r\0"
        raw += struct.pack("<i", len(body)) + body
    with open(path, "wb") as out:
        for i in range(0, len(raw), block):
            packed = gzip.compress(raw[i : i + block])
            extra = struct.pack("<HBBHH", 6, 66, 67, 2, len(packed) + 8 - 1)
            out.write(packed[:3] + bytes([packed[3] | 4]) + packed[4:10] + extra + packed[10:])
        out.write(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))


def test_fasta(spark, tmp_path, rows):
    path = tmp_path / "a.fasta"
    path.write_text("junk\n>one first \nAC GT  \nTT\r\n>empty\n\n>two\nGG\n>last\nACGT")
    want = [(0, "one first", "AC GTTT", 7), (1, "two", "GG", 2), (2, "last", "ACGT", 4)]
    assert rows(text.read_fasta(spark, str(path))) == want
    assert rows(text.read_fasta(spark, str(path), "first_token"), "name") == [("last",), ("one",), ("two",)]
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as out:
        out.write(">x\nAC\n")
    with gzip.open(tmp_path / "b.fasta.gz", "at") as out:
        out.write(">y\nGT\n")
    assert rows(text.read_fasta(spark, str(tmp_path / "b.fasta.gz")), "id", "name", "seq") == [(0, "x", "AC"), (1, "y", "GT")]


def test_fasta_over_many_splits(spark, tmp_path):
    random.seed(0)
    seqs = ["".join(random.choices("ACGT", k=random.randint(1, 300))) for _ in range(400)]
    path = tmp_path / "big.fasta"
    path.write_text("".join(f">c{i}\n{s[:70]}\n{s[70:]}\n" for i, s in enumerate(seqs)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = text.read_fasta(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.id, r.name, r.seq) for r in sorted(got, key=lambda r: r.id)] == [(i, f"c{i}", s) for i, s in enumerate(seqs)]


def test_fastq_pairs(spark, tmp_path, rows):
    (tmp_path / "1.fastq").write_text("@a/1\nAC\n+\nII\n@b/1\nGG\n+\nJJ\n")
    (tmp_path / "2.fastq").write_text("@a/2\nTT\n+\nKK\n@b/2\nCC\n+\nLL\n")
    pairs = text.read_fastq_pairs(spark, str(tmp_path / "1.fastq"), str(tmp_path / "2.fastq"))
    assert rows(pairs, "block", "left.name", "left.quality", "right.seq") == [(0, "a/1", "II", "TT"), (1, "b/1", "JJ", "CC")]


def test_alleles(spark, tmp_path, rows):
    path = tmp_path / "a.table"
    path.write_text("x\ty\tc1\tzz\n\nx\ty\tc1\nx\ty\tc2\tc\n")
    contigs = spark.createDataFrame([(0, "c1"), (1, "c2"), (2, "c1")], "id int, name string")
    lines = text.read_lines(spark, str(path))
    assert rows(text.allele_table(lines, contigs, 2)) == [(0, 0, 0), (0, 1, -1), (3, 0, 1), (3, 1, -1)]
    with pytest.raises(Exception, match="allele groups"):
        text.allele_table(lines, contigs, 1).collect()


@pytest.mark.parametrize("block, split", [(500, 700), (37, 4_000), (65_000, 10_000), (500, 0), (3_000, 1_000_000), (200, 60)])
def test_bam_in_ranges(tmp_path, block, split):
    """Every record once, in order, however a file is cut."""
    rng = random.Random(block)
    records = [(rng.randint(-1, 2), rng.randint(-1, 10**6), rng.randint(0, 255), rng.randint(-1, 2), rng.randint(-1, 10**6)) for _ in range(3_000)]
    names = ["c1", "a much longer name of a contig " * 4, "c3"]
    path = str(tmp_path / "a.bam")
    bam(path, [(n, 100) for n in names], records, block)
    reader = binary.BamReader([path], split)
    ranges = reader.partitions()
    assert len(ranges) > 5 or split in (0, 1_000_000, 10_000)
    got = [r for part in ranges for batch in reader.read(part) for r in batch.to_pylist()]
    name, place = (lambda k: names[k] if k >= 0 else None), (lambda x: x if x >= 0 else None)
    assert [(r["ref_name"], r["pos"], r["mapq"], r["next_ref_name"], r["next_pos"]) for r in got] == [(name(a), place(b), q, name(c), place(d)) for a, b, q, c, d in records]
    numbers = [r["rec_no"] for r in got]
    assert numbers == sorted(set(numbers))


def test_bam_without_records_and_cut_short(tmp_path):
    path = str(tmp_path / "a.bam")
    bam(path, [("c1", 5)], [])
    for split in (0, 50):
        reader = binary.BamReader([path], split)
        assert [b.num_rows for part in reader.partitions() for b in reader.read(part)] == []
    bam(path, [("c1", 5)], [(0, 1, 2, 0, 3)] * 50)
    data = open(path, "rb").read()
    short = str(tmp_path / "b.bam")
    with open(short, "wb") as out:
        out.write(data[: len(data) // 2])
    with pytest.raises((ValueError, zlib.error)):
        reader = binary.BamReader([short], 0)
        [list(reader.read(part)) for part in reader.partitions()]


def test_bam(spark, tmp_path, rows):
    records = [(0, 5, 60, 1, 7), (1, 7, 255, 0, 5), (-1, -1, 0, -1, -1)] * 200
    bam(tmp_path / "a.bam", [("c1", 100), ("c2", 50)], records)
    got = binary.read_mapping(spark, [str(tmp_path / "a.bam")])
    assert got.count() == 600
    first = got.orderBy("rec_no").limit(3).select("ref_name", "pos", "next_ref_name", "next_pos", "mapq").collect()
    assert [tuple(r) for r in first] == [("c1", 5, "c2", 7, 60), ("c2", 7, "c1", 5, 255), (None, None, None, None, 0)]
    assert got.select("rec_no").distinct().count() == 600
    with pytest.raises(ValueError):
        binary.read_mapping(spark, ["a.sam"])
    (tmp_path / "bad.bam").write_bytes(gzip.compress(b"nope" * 9))
    with pytest.raises(Exception, match="not a BAM file"):
        binary.read_mapping(spark, [str(tmp_path / "bad.bam")]).collect()


def packed(contigs):
    return struct.pack("<q", len(contigs)) + b"".join(struct.pack("<i", len(n.encode())) + n.encode() + struct.pack("<i", x) for n, x in contigs)


@pytest.mark.parametrize("split", [25, 150, 1 << 20])
def test_contigs_in_ranges(spark, rows, tmp_path, split):
    rng = random.Random(4)
    # Names of null bytes look like records of their own, so that guesses fail; some are longer than a range.
    names = ["".join(rng.choices("ab\x00\x01é", k=rng.choice([0, 1, 5, 12]))) for _ in range(40)] + ["\x00" * 90, "long" * 50]
    contigs = [(n, rng.randint(0, 2**31 - 1)) for n in names]
    path = tmp_path / "c.bin"
    path.write_bytes(packed(contigs))
    got = rows(binary.read_contigs(spark, str(path), split))
    assert got == [(i, *c) for i, c in enumerate(contigs)]
    assert len(binary.contig_ranges(spark, str(path), split)) == -(-(path.stat().st_size - 8) // split)


def test_contigs_that_end_too_early(spark, tmp_path):
    data = packed([("a", 1), ("bc", 2)])
    for k, bad in enumerate((data[:-1], data + b"\x00", data[:-10])):
        (tmp_path / f"{k}").write_bytes(bad)
        with pytest.raises(Exception, match="record"):
            binary.read_contigs(spark, str(tmp_path / f"{k}"))
    (tmp_path / "none").write_bytes(packed([]))
    assert binary.read_contigs(spark, str(tmp_path / "none")).count() == 0


def test_flat_tables(spark, tmp_path, rows):
    edges = spark.createDataFrame([(i, i + 1, i / 3) for i in range(50)], "start int, end int, weight double")
    binary.write_edges(edges, str(tmp_path / "e.bin"))
    assert rows(binary.read_edges(spark, str(tmp_path / "e.bin"))) == rows(edges)
    pairs = spark.createDataFrame([(1, 2, 3, 4), (5, 6, 7, 8)], "ref_id int, pos int, next_ref_id int, next_pos int")
    binary.write_pairs(pairs, str(tmp_path / "p.bin"))
    assert rows(binary.read_pairs(spark, str(tmp_path / "p.bin"))) == rows(pairs)
    ids = spark.createDataFrame([(4,), (9,)], "contig_id int")
    binary.write_invalid(ids, str(tmp_path / "i.bin"))
    assert rows(binary.read_invalid(spark, str(tmp_path / "i.bin"))) == [(4,), (9,)]
    contigs = spark.createDataFrame([(0, "é", 3), (1, "b", 4)], "id int, name string, length int")
    binary.write_contigs(contigs, str(tmp_path / "c.bin"))
    assert rows(binary.read_contigs(spark, str(tmp_path / "c.bin"))) == rows(contigs)


def test_programs(spark, tmp_path):
    random.seed(4)
    seqs = {f"c{i}": "".join(random.choices("ACGT", k=3000)) for i in range(8)}
    (tmp_path / "g.fasta").write_text("".join(f">{n}\n{s}\n" for n, s in seqs.items()))
    records = []
    for _ in range(1500):
        a = random.randrange(8)
        b = a if random.random() < 0.3 else (a + 2) % 8 if random.random() < 0.8 else random.randrange(8)
        p, q = random.randrange(3000), random.randrange(3000)
        records += [(a, p, 60, b, q), (b, q, 60, a, p)]
    bam(tmp_path / "g.bam", [(n, 3000) for n in seqs], records, block=20_000)
    out = str(tmp_path / "draft")
    cli.run(spark, ["draft", "-f", str(tmp_path / "g.fasta"), "-m", str(tmp_path / "g.bam"), "-o", out, "-e", "mboi", "-r", "600"])
    edges = spark.read.parquet(f"{out}.edges")
    assert edges.count() > 8 and edges.where("start > end").count() == 0
    assert spark.read.parquet(f"{out}.read_pairs").where("ref_id = next_ref_id").count() == 0
    cli.run(spark, ["partition", "-n", f"{out}.contigs", "-e", f"{out}.edges", "-g", "2", "-o", str(tmp_path / "part")])
    assert spark.read.parquet(f"{tmp_path}/part.groups").columns == ["group_id", "contig_id"]
    cli.run(spark, ["correct", "-f", str(tmp_path / "g.fasta"), "-m", str(tmp_path / "g.bam"), "-o", f"{tmp_path}/fixed", "-w", "200", "-n", "20", "-d", "800", "-s", "0.9"])
    fixed = text.read_fasta(spark, f"{tmp_path}/fixed")
    assert sum(r.length for r in fixed.collect()) == sum(map(len, seqs.values()))


def test_paths_and_options():
    assert (text.path_suffix("a/b.fasta.gz"), text.path_core("a/b.fasta")) == (".gz", "b")
    args = cli.parser().parse_args(["draft", "-f", "f", "-m", "a", "b", "-o", "o", "-e", "e", "-r", "1001"])
    assert (args.mapping, args.enzyme_range >> 1) == (["a", "b"], 500)
    with pytest.raises(ValueError):
        cli.P.PartitionConfig(0)
    with pytest.raises(ValueError):
        cli.P.PartitionConfig(2, 1)


def test_flat_parts_are_committed_together(spark, rows, tmp_path):
    folder = str(tmp_path / "pairs")
    pairs = spark.range(0, 1000, 1, 7).selectExpr("int(id) AS ref_id", "int(id * 2) AS pos", "int(id % 5) AS next_ref_id", "IF(id % 3 = 0, NULL, int(id)) AS next_pos")
    want = rows(pairs.selectExpr("ref_id", "pos", "next_ref_id", "coalesce(next_pos, -1)"))
    assert binary.load_flat(spark, folder, "pairs").count() == 0
    binary.save_flat(pairs, folder, "pairs")
    assert rows(binary.load_flat(spark, folder, "pairs")) == want and len(binary.listed(folder)) == 7
    # A write that fails in one task leaves what was there, and no part of its own is seen.
    fails = pairs.withColumn("pos", F.expr("IF(ref_id = 990, raise_error('no'), pos)").cast("int"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no"):
            binary.save_flat(fails, folder, "pairs", mode)
        assert rows(binary.load_flat(spark, folder, "pairs")) == want
    binary.save_flat(pairs.limit(0), folder, "pairs")
    binary.save_flat(pairs.where("ref_id < 10"), folder, "pairs")
    assert binary.load_flat(spark, folder, "pairs").count() == 1010
    binary.save_flat(pairs.where("ref_id < 10"), folder, "pairs", "overwrite")
    assert rows(binary.load_flat(spark, folder, "pairs")) == want[:10]


def test_bam_filters_and_columns_are_pushed(spark, rows, tmp_path):
    made = spark.range(0, 3000, 1, 2).selectExpr("'c' || (id % 3) AS ref_name", "int(id) AS pos", "'c0' AS next_ref_name", "int(id + 1) AS next_pos", "int(IF(id % 10 = 0, 255, id % 60)) AS mapq")
    paths = binary.write_bam(made, [("c0", 10_000), ("c1", 10_000), ("c2", 10_000)], str(tmp_path / "bam"))
    some = binary.read_mapping(spark, paths, ["ref_name", "pos", "mapq"])
    assert some.columns == ["ref_name", "pos", "mapq"]
    good = some.where("mapq >= 40 AND mapq <> 255 AND pos < 2000")
    assert rows(good) == rows(made.where("mapq >= 40 AND mapq <> 255 AND pos < 2000").select("ref_name", "pos", "mapq"))
    plan = good._jdf.queryExecution().executedPlan().toString()
    # The bounds on the quality are the scan's; the one on the position is left to Spark.
    assert "mapq" not in plan.split("Filter", 1)[1].split("\n")[0] and "pos" in plan.split("Filter", 1)[1].split("\n")[0]
    reader = binary.BamReader(paths, 0, ["pos", "mapq"])
    left = list(reader.pushFilters([binary.GreaterThanOrEqual(("mapq",), 40), binary.Not(binary.EqualTo(("mapq",), 255)), binary.EqualTo(("pos",), 3)]))
    assert left == [binary.EqualTo(("pos",), 3)] and (reader.least, reader.without) == (40, {255})
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert {b.schema.names[0] for b in read} == {"pos"} and sum(b.num_rows for b in read) == made.where("mapq >= 40 AND mapq <> 255").count()
