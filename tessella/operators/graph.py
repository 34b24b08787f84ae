"""Nearest-neighbour graphs and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import closeness
from .cutting import cut, cut_off, passing


def padded(df: DataFrame, vector: str) -> DataFrame:
    """df with its arrays filled up with zeros to the longest one's length."""
    most = df.agg(F.max(F.size(vector)).alias("_most"))
    return df.join(F.broadcast(most), F.lit(True)).withColumn(vector, F.concat(vector, F.array_repeat(F.lit(0.0), F.greatest(F.col("_most") - F.size(vector), F.lit(0))))).drop("_most")


def flattened(df: DataFrame, keys: list[str], position: str, parts: list[str], out: str = "vector") -> DataFrame:
    """One array for each group: the parts of its rows one after another, rows by position."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(position, F.array(*[F.col(p).cast("double") for p in parts]).alias("_v")))), lambda x: x["_v"])
    return df.groupBy(*keys).agg(F.flatten(rows).alias(out))


def knn(vectors: DataFrame, id_col: str, vector_col: str, k: int, block_rows: int = 4096) -> DataFrame:
    """(src, dst, d2, rank): for each vector the k nearest others, nearest first, equals by id; k is at most the number of others.

    Exact: every vector meets every other, in blocks of about block_rows that follow from the number of rows. A block meets another in one task as two
    matrices, and gives its vectors' k best there; the last ranking has blocks x k rows of a vector. Null vectors take no part, and all others
    must have the same length.
    """
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    blocks = max(-(-rows.count() // block_rows), 1)
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = dealt.groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("points"))
    asked = packed.select(F.col("points").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (q_ids, q), (p_ids, p) = (_unpacked(batch.column(j)[i].values) for j in (0, 1))
                for at in range(0, len(q), 512):
                    who, found, d2 = _nearest(q[at : at + 512], q_ids.slice(at, 512), p, p_ids, k)
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at + who)), p_ids.take(pa.array(found)), pa.array(d2)], names=["src", "dst", "d2"])

    best = asked.join(packed, "b").select("queries", "points").mapInArrow(work, f"src {id_type}, dst {id_type}, d2 double")
    last = Window.partitionBy("src").orderBy("d2", "dst")
    return best.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def _unpacked(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """The ids and the matrix of a block, by id."""
    order = pc.sort_indices(rows.field("id"))
    ids = rows.field("id").take(order)
    x = rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    return ids, x[order.to_numpy()]


def _nearest(q: np.ndarray, q_ids: pa.Array, p: np.ndarray, p_ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, point's place, squared distance) of the k nearest others of each query; points come in the order of their ids."""
    squares = (p * p).sum(axis=1)[None, :] + (q * q).sum(axis=1)[:, None]
    about = squares - 2 * (q @ p.T)
    own = pc.index_in(q_ids, p_ids)
    here = np.flatnonzero(own.is_valid())
    about[here, own.drop_null().to_numpy()] = np.inf
    most = min(k, len(p))
    limit = np.partition(about, most - 1, axis=1)[:, most - 1]
    # A matrix product rounds differently from a sum of squares: what it can't tell apart is measured again.
    who, at = np.nonzero((about <= (limit + 1e-9 * (1 + np.abs(squares).max(axis=1)))[:, None]) & np.isfinite(about))
    d2 = np.empty(len(who))
    for i in range(0, len(who), 1 << 16):
        part = slice(i, i + (1 << 16))
        d2[part] = ((q[who[part]] - p[at[part]]) ** 2).sum(axis=1)
    order = np.lexsort((at, d2, who))
    who, at, d2 = who[order], at[order], d2[order]
    first = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[first], at[first], d2[first]


def undirected(directed: DataFrame) -> DataFrame:
    """(src, dst, weight) with src < dst, each edge once, whichever end chose the other."""
    return directed.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(closeness(F.min("d2")).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(nodes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """(node, degree); nodes without edges have degree 0."""
    counts = both_ways(edges).groupBy("src").agg(F.count("*").alias("degree"))
    return nodes.select(F.col(id_col).alias("node")).join(counts, F.col("node") == F.col("src"), "left").select("node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def degree_stats(of_nodes: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return of_nodes.agg(F.count("*").alias("nodes"), zero(F.min("degree")).alias("min_degree"), zero(F.max("degree")).alias("max_degree"), F.coalesce(F.avg("degree"), F.lit(0.0)).alias("mean_degree"))


def degree_histogram(of_nodes: DataFrame) -> DataFrame:
    return of_nodes.groupBy("degree").agg(F.count("*").alias("nodes"))


def edge_faults(edges: DataFrame, node_count: Column) -> DataFrame:
    """The edges that break a rule, with the rule: ends in order, within the nodes, weight in (0, 1], no repeats."""
    many = F.count("*").over(Window.partitionBy("src", "dst"))
    rules = F.array(
        F.when(~(F.col("src") < F.col("dst")), "order"), F.when((F.col("src") < 0) | (F.col("dst") >= node_count), "bounds"),
        F.when(~((F.col("weight") > 0) & (F.col("weight") <= 1)) | F.isnan("weight"), "weight"), F.when(F.col("_many") > 1, "repeat"),
    )
    return edges.withColumn("_many", many).withColumn("fault", F.explode(F.array_compact(rules))).drop("_many")


def roots(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, root) for each node of links between different nodes; root is the least node of its component. By alternating star contractions.

    Each round hangs every neighbour of a node that is larger than it under the least node of its neighbourhood, then
    does the same with the smaller ones, until nothing changes. Links stay in Spark and are cut from
    their lineage each round; the number of rounds grows with the logarithm of the longest path. Self-links,
    repeated links and null ends are ignored.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = cut(pairs)
    before = None
    while True:
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = pairs.select(F.explode(ways).alias("way")).select("way.u", "way.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every u of `large` is now larger than its v: the small star.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # The one row of each u that has v = m gives the link of u itself.
        new = cut(large.join(lowest, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct())
        cut_off(pairs)
        pairs = new
        after = passing(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))).collect()
        if after == before:
            break
        before = after
    heads = pairs.select(F.col("v").alias("node")).distinct().join(pairs.select(F.col("u").alias("node")), "node", "left_anti")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(heads.select("node", F.col("node").alias("root")))


def components(nodes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """(node, component): the least node that can be reached; a node without edges is its own component."""
    found = roots(edges, "src", "dst")
    return nodes.select(F.col(id_col).alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def laplacian_step(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, x, lx): the graph Laplacian applied to a value of each node: its degree times its value, less its neighbours' values."""
    near = both_ways(edges).join(values.select(F.col("node").alias("dst"), F.col("x").alias("_x")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("_x").alias("_sum"), F.count("*").alias("_deg"))
    return values.join(near, "node", "left").select("node", "x", (F.coalesce("_deg", F.lit(0)) * F.col("x") - F.coalesce("_sum", F.lit(0.0))).alias("lx"))


def rayleigh(applied: DataFrame) -> DataFrame:
    return applied.agg((F.sum(F.col("x") * F.col("lx")) / F.sum(F.col("x") * F.col("x"))).alias("rayleigh"))


def centred(values: DataFrame) -> DataFrame:
    """Values less their mean, with their squares summing to 1; alternating signs if nothing is left."""
    mean = values.agg(F.avg("x").alias("_mean"))
    c = values.join(F.broadcast(mean), F.lit(True)).select("node", (F.col("x") - F.col("_mean")).alias("x"))
    norm = c.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"))
    sign = F.when(F.col("node") % 2 == 0, 1.0).otherwise(-1.0)
    return c.join(F.broadcast(norm), F.lit(True)).select("node", F.when(F.col("_norm") > 1e-12, F.col("x") / F.col("_norm")).otherwise(sign).alias("x"))


def lambda2(nodes: DataFrame, edges: DataFrame, id_col: str, iterations: int = 64, seed: int = 42, start: Column | None = None) -> DataFrame:
    """An estimate of the second-least eigenvalue of the Laplacian, by power iteration from a seeded start, or from the given value of each node.

    Values stay in Spark and are cut from their lineage each round; the driver sees their mean and norm only.
    """
    edges = cut(edges.select("src", "dst"))
    seeded = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1.0
    values = cut(centred(nodes.select(F.col(id_col).alias("node"), (seeded if start is None else start).cast("double").alias("x"))))
    last = None
    beta = 2 * (degrees(nodes, edges, id_col).agg(F.max("degree")).first()[0] or 0) + 1
    for _ in range(iterations):
        stepped = cut(laplacian_step(edges, values).select("node", (F.col("x") - F.col("lx") / float(beta)).alias("x")))
        mean, squares, n = stepped.agg(F.avg("x"), F.sum(F.col("x") * F.col("x")), F.count("*")).first()
        norm = max((squares or 0.0) - n * (mean or 0.0) ** 2, 0.0) ** 0.5
        sign = F.when(F.col("node") % 2 == 0, 1.0).otherwise(-1.0)
        if last is not None:
            cut_off(last)
        last = stepped
        values = stepped.select("node", ((F.col("x") - mean) / norm if norm > 1e-12 else sign).alias("x"))
    return rayleigh(laplacian_step(edges, values)).withColumnRenamed("rayleigh", "lambda2")
