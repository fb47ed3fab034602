from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera.functions import motifs as M
from tessera.plans import cli
from tessera.session import in_order, shared_dir


def test_names_and_motifs():
    assert M.resolve_motif("mboi") == "GATC"
    assert M.resolve_motif("Hind3") == "AAGCTT"
    assert M.resolve_motif("acgt") == "ACGT"
    assert len(M.ENZYMES) == 28
    with pytest.raises(ValueError):
        M.resolve_motif("ACGN")


def test_scalars(spark):
    df = spark.createDataFrame([("ab \t\n\x0b\f\r", 1.234567, -3, 7)], "t string, x double, a int, b int")
    key = M.packed_key(F.col("a"), F.col("b"))
    a, b = M.unpacked_key(key)
    got = df.select(M.trimmed_right(F.col("t")), M.truncated5(F.col("x")), a, b, M.floor_bin(F.col("b"), 5), M.squared(F.col("b")), M.first_position("b", F.col("t")), M.first_position("z", F.col("t"))).first()
    assert tuple(got) == ("ab", 1.23456, -3, 7, 5, 49, 1, -1)


def test_numbers_of_options():
    for text, whole, number in (("12", 12, 12.0), (" -3x", -3, -3.0), ("1e3", 1, 1000.0), ("0.5.6", 0, 0.5), (".25", 0, 0.25), ("x9", 0, 0.0), ("", 0, 0.0), ("5.", 5, 5.0), ("1e", 1, 1.0)):
        assert (cli.leading_int(text), cli.leading_float(text)) == (whole, number)
    args = cli.parser().parse_args("draft -f a -m b -o c -e MboI -q 10abc -r none".split())
    assert (args.mapq, args.enzyme_range) == (10, 0)


def test_a_cluster_needs_a_shared_folder():
    def session(master, conf=None, folder=None):
        made = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else folder, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf))

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://n/shared/")) == "hdfs://n/shared"
        assert shared_dir(session(master, None, "hdfs://n/own")) == "hdfs://n/own"
    assert shared_dir(session("local[4]")).startswith("file://")


def test_places_without_one_task(spark):
    rows = spark.range(1000).selectExpr("id", "(id * 7919) % 13 AS w")
    got = sorted((r.place, r.w, r.id) for r in in_order(rows, F.desc("w"), F.col("id")).collect())
    assert [g[0] for g in got] == list(range(1000)) and [(-w, i) for _, w, i in got] == sorted((-w, i) for _, w, i in got)
    assert in_order(rows.limit(0), "id").count() == 0
