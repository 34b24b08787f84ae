"""Operators beside plain Python: nearest neighbours with ties, components, cutting of lineage, splits, dealing."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cutting, graph, runs, splits


@pytest.mark.parametrize("block_rows", [4096, 20])
def test_nearest_neighbours_with_ties(spark, block_rows):
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((90, 6)), 1)
    x[10:40] = x[10]
    x[50:60] *= 1e6
    rows = [(int(i) * 3, [float(v) for v in r]) for i, r in zip(rng.permutation(90), x)]
    got = graph.knn(spark.createDataFrame([*rows, (1000, None)], "id long, v array<double>"), "id", "v", 4, block_rows).collect()
    found = {}
    for r in got:
        found.setdefault(r.src, []).append((r["rank"], r.dst))
    assert len(found) == 90
    for i, v in rows:
        d = sorted((float(((np.array(w) - np.array(v)) ** 2).sum()), j) for j, w in rows if j != i)
        assert [j for _, j in sorted(found[i])] == [j for _, j in d[:4]]
    two = spark.createDataFrame(rows[:2], "id long, v array<double>")
    assert graph.knn(two, "id", "v", 9).count() == 2 and graph.knn(two.where("false"), "id", "v", 3).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(i, i + 1) for i in range(400, 480)] + [(600, 600)]
    root = {n: n for e in edges for n in e} | {999: 999}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(n,) for n in root], "id long")
    got = graph.components(nodes, spark.createDataFrame([*edges, (None, 3)], "src long, dst long"), "id").collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in root}


def test_files_of_a_cut_are_deleted(spark):
    some = cutting.cut(spark.range(5))
    file = spark._jvm.org.apache.hadoop.fs.Path(some._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    store = file.getFileSystem(spark._jsc.hadoopConfiguration())
    assert store.exists(file) and some.count() == 5
    cutting.cut_off(some)
    assert not store.exists(file)
    cutting.cut_off(spark.range(3))


def test_what_was_shuffled_for_a_cut_is_deleted(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return set(re.findall(r"(?i)shuffle\w*\([^)]*\)|shuffle_\w+", disk.getAllBlocks().mkString(" ")))

    before = shuffled()
    spark.range(100).groupBy((F.col("id") % 7).alias("k")).count().collect()
    assert shuffled() - before, "shuffle files are found"
    before, settings = shuffled(), dict(spark.conf.getAll)
    made = cutting.cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    chain = graph.roots(spark.range(64).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert dict(spark.conf.getAll) == settings
    assert made.count() == 7 and sorted(map(tuple, chain.collect())) == [(i, 0) for i in range(65)]


def test_a_cluster_needs_a_shared_folder():
    class Stub:
        master = "spark://host:7077"

        def __getattr__(self, name):
            return self

        def __call__(self, *a):
            return self

        def isEmpty(self):  # noqa: N802
            return True

        def getConf(self):  # noqa: N802
            return {}

    with pytest.raises(RuntimeError):
        cutting.cut(Stub())


def test_places_are_counted_in_ranges(spark):
    rows = [(i * 7 % 101, i) for i in range(101)]
    for ranges in (None, 1, 13):
        got = splits.split_by_position(spark.createDataFrame(rows, "k int, v int"), "k", ranges=ranges).collect()
        assert {r.k: r.split for r in got} == {k: "train" if k < 70 else "val" if k < 85 else "test" for k in range(101)}


def test_values_are_dealt_in_order(spark):
    slots = spark.createDataFrame([("a", 5), ("a", 2), ("b", 9)], "g string, slot int")
    takers = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "z"), ("b", "q")], "g string, who string")
    got = runs.dealt(slots, ["slot"], takers, ["who"], "slot", ["g"])
    assert {(r.g, r.who): r.slot for r in got.collect()} == {("a", "x"): 2, ("a", "y"): 5, ("b", "q"): 9}
    assert got.where(F.col("slot").isNull()).isEmpty()
