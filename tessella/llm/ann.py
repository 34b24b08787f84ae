"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Vectors are dealt to shards of bounded size by a hash. In each shard a graph is grown over the distinct
vectors: greedy searches propose neighbours for each vector, and relaxed distance pruning keeps an edge only if no kept
neighbour is nearer to its target by a factor. Queries are packed into blocks; each block meets each shard
once, where beam searches give each query's nearest, which are scored again exactly and merged over the shards.

Nearness is the inner product. It is turned into a distance by one more coordinate that brings all vectors of a
shard to the same norm. Vectors of another length (number of components) form shards of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Settings:
    """shard_rows and block_rows bound what a task holds: a shard of 16,384 vectors of 64 parts takes about 40 MB, and some seconds of one core to build. The rest trades time for recall.

    Queries are copied to each shard, so larger shards copy less; smaller ones keep more cores busy.
    """

    shard_rows: int = 16384
    block_rows: int = 1024
    degree: int = 24
    spare: int = 12
    beam: int = 40
    search_beam: int = 160
    alpha: float = 1.2
    entries: int = 64
    seed: int = 7


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite numbers."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


class Graph:
    """A directed graph over the rows of points, searched by beams of many queries at once."""

    def __init__(self, points: np.ndarray, settings: Settings, edges: np.ndarray | None = None):
        self.x = np.ascontiguousarray(points, np.float32)
        self.sq = (self.x * self.x).sum(axis=1)
        self.s = settings
        n = len(points)
        rng = np.random.default_rng(settings.seed)
        self.entry = np.sort(rng.permutation(n)[: settings.entries])
        self.edges = edges if edges is not None else self._grown(rng)

    def _distances(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances, less the query's own square, of each query to its candidates; at < 0 gives infinity."""
        row, col = np.nonzero(at >= 0)
        there = at[row, col]
        d = np.full(at.shape, np.inf, np.float32)
        d[row, col] = self.sq[there] - 2 * np.einsum("ij,ij->i", self.x[there], q[row])
        return d

    def search(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> np.ndarray:
        """The points nearest to each query that a beam search finds, nearest first, -1 where there are fewer."""
        n, m = len(self.x), len(q)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        if own is not None:
            seen[np.arange(m), own] = True
        row = np.arange(m)[:, None]
        at = np.broadcast_to(self.entry, (m, len(self.entry))).copy()
        at[seen[row, at]] = -1
        seen[row, at] = True
        dist = self._distances(q, at)
        done = at < 0
        if at.shape[1] < beam:
            fill = beam - at.shape[1]
            at, dist, done = (np.concatenate([a, np.full((m, fill), v)], axis=1) for a, v in ((at, -1), (dist, np.inf), (done, True)))
        live = np.arange(m)
        width = 4
        while len(live):
            key = np.where(done[live], np.inf, dist[live])
            pick = np.argpartition(key, width, axis=1)[:, :width]
            good = np.isfinite(np.take_along_axis(key, pick, 1))
            going = good.any(axis=1)
            live, pick, good = live[going], pick[going], good[going]
            if not len(live):
                break
            here = np.where(good, at[live[:, None], pick], -1)
            done[live[:, None], pick] = True
            new = np.where(here[:, :, None] >= 0, self.edges[here], -1).reshape(len(live), -1)
            new[seen[live[:, None], new]] = -1
            # The same point may come from two of the expanded ones.
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            seen[live[:, None], new] = True
            d = self._distances(q[live], new)
            all_d = np.concatenate([dist[live], d], axis=1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            at[live, :beam] = np.take_along_axis(np.concatenate([at[live], new], axis=1), keep, 1)[:, :beam]
            done[live, :beam] = np.take_along_axis(np.concatenate([done[live], new < 0], axis=1), keep, 1)[:, :beam]
            dist[live, :beam] = np.take_along_axis(all_d, keep, 1)[:, :beam]
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(np.where(np.isfinite(dist), at, -1), order, 1)

    def _pruned(self, p: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """For each point its neighbours among the candidates (-1: none): the nearest first, and no candidate that a kept one is nearer to by the factor alpha."""
        c = np.sort(candidates, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == p[:, None]] = -1
        safe = np.maximum(c, 0)
        y = self.x[safe]
        d = np.where(c < 0, np.inf, ((y - self.x[p][:, None, :]) ** 2).sum(axis=2))
        order = np.argsort(d, axis=1, kind="stable")
        c, d, y = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(y, order[:, :, None], 1)
        sq = (y * y).sum(axis=2)
        between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
        out = np.full((len(p), self.s.degree), -1, np.int32)
        count = np.zeros(len(p), np.int64)
        open_ = np.isfinite(d)
        row = np.arange(len(p))
        while True:
            first = open_.argmax(axis=1)
            go = open_[row, first] & (count < self.s.degree)
            if not go.any():
                break
            r, f = row[go], first[go]
            out[r, count[r]] = c[r, f]
            count[r] += 1
            open_[r, f] = False
            open_[r] &= self.s.alpha**2 * between[r, f] > d[r]
        return out

    def _grown(self, rng: np.random.Generator) -> np.ndarray:
        """Points are added in blocks. An edge back goes into a spare place of its point; only a point without one is pruned, so that most edges back cost nothing."""
        n, degree, width = len(self.x), self.s.degree, self.s.degree + self.s.spare
        if n <= degree:
            return np.tile(np.arange(n, dtype=np.int32), (n, 1))
        self.edges = np.full((n, width), -1, np.int32)
        start = rng.integers(0, n - 1, (n, degree)).astype(np.int32)
        self.edges[:, :degree] = start + (start >= np.arange(n)[:, None])
        order = rng.permutation(n)
        for at in range(0, n, 256):
            p = order[at : at + 256]
            found = self.search(self.x[p], self.s.beam, own=p)
            self.edges[p, :degree] = self._pruned(p, np.concatenate([found, self.edges[p]], axis=1))
            self.edges[p, degree:] = -1
            targets, sources = self.edges[p, :degree].ravel(), np.repeat(p, degree)
            new = (targets >= 0) & ~(self.edges[targets] == sources[:, None]).any(axis=1)
            self._linked_back(targets[new], sources[new])
        over = np.flatnonzero(self.edges[:, degree] >= 0)
        for at in range(0, len(over), 512):
            w = over[at : at + 512]
            self.edges[w, :degree] = self._pruned(w, self.edges[w])
        return np.ascontiguousarray(self.edges[:, :degree])

    def _linked_back(self, targets: np.ndarray, sources: np.ndarray) -> None:
        """Add the edges from targets to sources; a point's edges stand at the front of its places."""
        degree, width = self.s.degree, self.edges.shape[1]
        by = np.argsort(targets, kind="stable")
        targets, sources = targets[by], sources[by]
        who, start, size = np.unique(targets, return_index=True, return_counts=True)
        room = (self.edges[who] < 0).sum(axis=1)
        place = np.arange(len(targets)) - np.repeat(start, size) + width - np.repeat(room, size)
        fits = np.repeat(size <= room, size)
        self.edges[targets[fits], place[fits]] = sources[fits]
        full, start, size = who[size > room], start[size > room], size[size > room]
        for k in range(0, len(full), 512):
            w, first, many = full[k : k + 512], start[k : k + 512], size[k : k + 512]
            more = np.full((len(w), int(many.max())), -1, np.int64)
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            more[np.repeat(np.arange(len(w)), many), at] = sources[np.repeat(first, many) + at]
            self.edges[w, :degree] = self._pruned(w, np.concatenate([self.edges[w], more], axis=1))
            self.edges[w, degree:] = -1


def _levelled(x: np.ndarray) -> np.ndarray:
    """x with one more coordinate, so that all rows have the norm of the longest: then the nearest has the largest inner product."""
    sq = (x * x).sum(axis=1)
    return np.hstack([x, np.sqrt(np.maximum(sq.max() - sq, 0))[:, None]])


def _built(settings: Settings, most: int):
    """Grow one shard's graph. Equal vectors are one point that carries their least ids, as many as a result can need."""

    def work(rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy()
        x = np.array(rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        once = np.r_[True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)]
        ids, x = ids[once], x[once]
        new = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
        point = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        place = np.arange(len(ids)) - start[point]
        first = place < most
        graph = Graph(_levelled(x[new]), settings)
        out = {"kind": rows.column("kind")[0].as_py(), "shard": rows.column("shard")[0].as_py(), "dims": x.shape[1]}
        out |= {"points": x[new].tobytes(), "edges": graph.edges.astype(np.int32).tobytes(), "member": ids[first].tobytes(), "owner": point[first].tobytes()}
        return pa.Table.from_pylist([out], schema=_GRAPH)

    return work


_GRAPH = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("dims", pa.int32()), ("points", pa.binary()), ("edges", pa.binary()), ("member", pa.binary()), ("owner", pa.binary())])
_GRAPH_SQL = "kind int, shard bigint, dims int, points binary, edges binary, member binary, owner binary"


def _nearest(graph: Graph, x: np.ndarray, member: np.ndarray, owner: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, settings: Settings):
    """(query's place, vec_id, score) of the k nearest of each query in one shard, scored exactly."""
    found = graph.search(np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32), max(settings.search_beam, 2 * k))
    row, col = np.nonzero(found >= 0)
    score_of = np.full(found.shape, -np.inf)
    score_of[row, col] = (q[row] * x[found[row, col]]).sum(axis=1)
    starts, ends = np.searchsorted(owner, np.arange(len(x))), np.searchsorted(owner, np.arange(len(x)), "right")
    points, scores = found[row, col], score_of[row, col]
    sizes = (ends - starts)[points]
    who = np.repeat(row, sizes)
    at = np.repeat(starts[points], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids, scores = member[at], np.repeat(scores, sizes)
    other = ids != q_ids[who]
    who, ids, scores = who[other], ids[other], scores[other]
    order = np.lexsort((ids, -scores, who))
    who, ids, scores = who[order], ids[order], scores[order]
    first = np.searchsorted(who, who)
    best = np.arange(len(who)) - first < k
    return who[best], ids[best], scores[best]


def search(vectors: DataFrame, queries: DataFrame, k: int, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries the k rows of vectors with the largest inner products that are found, of other ids than its own.

    Both have id_col and vector_col. Ties go to the smaller vec_id. Rows without an id or a valid vector take no part, and a
    repeated row counts once; a query whose vector no other row matches in length has no result.
    """

    def slim(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        return df.where(valid(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("vector"), F.size(vector_col).alias("kind"))

    # A row that is repeated very often must not fill a shard, nor may an id that many vectors share.
    rows = slim(vectors).distinct()
    shards = rows.groupBy("kind").agg(F.ceil(F.count("*") / settings.shard_rows).alias("shards"))
    # One row for each number of components.
    dealt = rows.join(F.broadcast(shards), "kind").withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards")))
    graphs = cut(dealt.select("kind", "shard", "vec_id", "vector").groupBy("kind", "shard").applyInArrow(_built(settings, k + 1), _GRAPH_SQL))

    asked = slim(queries).distinct()
    blocks = asked.groupBy("kind").agg(F.ceil(F.count("*") / settings.block_rows).alias("blocks"))
    asked = asked.join(F.broadcast(blocks), "kind").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")))
    asked = asked.groupBy("kind", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("q"))
    # Each block goes to each shard, by the shard's number, so that searches are dealt over as many tasks as there are shards.
    asked = asked.join(F.broadcast(shards), "kind").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1))).select("kind", "shard", "q")
    pairs = graphs.join(asked, ["kind", "shard"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                if key != (r["kind"].as_py(), r["shard"].as_py()):
                    key = r["kind"].as_py(), r["shard"].as_py()
                    x = np.frombuffer(r["points"].as_buffer(), np.float64).reshape(-1, r["dims"].as_py())
                    edges = np.frombuffer(r["edges"].as_buffer(), np.int32).reshape(len(x), -1)
                    held = Graph(_levelled(x), settings, edges), x, np.frombuffer(r["member"].as_buffer(), np.int64), np.frombuffer(r["owner"].as_buffer(), np.int64)
                ids = r["q"].values.field("vec_id").to_numpy()
                q = np.array(r["q"].values.field("vector").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
                for at in range(0, len(ids), 256):
                    who, found, score = _nearest(*held, q[at : at + 256], ids[at : at + 256], k, settings)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256][who]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(work, "query_id bigint, vec_id bigint, score double").where("vec_id is not null")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
