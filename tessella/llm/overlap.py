"""Near-duplicates by the exact overlap of their shingles: SimHash links, completed by minhash bands, both verified.

Texts of equal shingles are one set. Fingerprints of 64 bits that differ in two bits or fewer (operator 6) propose few of the pairs of a Jaccard similarity of
0.8: at that similarity about ten bits differ, and segments that find ten bits are too short to tell texts apart. So each set is also indexed under 25 bands
of five minhashes; of sets whose similarity is 0.8 a pair shares a band with odds of 0.99995, and more similar ones with better. Whatever proposes a pair,
its sets are compared by all their shingles, so no pair below the threshold is linked. Only texts that a pair needs are read again.

Of a band that many share, texts rather than pairs are dealt out: the group is cut into blocks of bounded size, and a task holds two of them, or the
one there is, and searches them breadth first by their lists of shingles, each set against those not reached yet. Each two blocks meet in one task, so no
link is lost however large the group is. All other pairs that are not connected by then are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import roots as components
from .common import cut, cut_off, give_back, in_parts, row_key, tidy
from .simhash import kept, links, shingles, voted

BANDS, ROWS = 25, 5
#: Groups up to this size are compared pair by pair.
SMALL_GROUP = 48
#: Shingles of a block of a larger group, about.
BLOCK_SHINGLES = 1_000_000

_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**64 - 1, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of the runs of so many words of a text, in order."""
    return np.unique(shingles(text, words))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; none for a set without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, ((hashes[at : at + (1 << 12), None] + _PLUS) * _TIMES).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _signed(words: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 2, 4096):
                prints, sets = [], []
                for t in part.column(2):
                    hashes = shingles(t.as_py(), words)
                    prints.append(voted(hashes))
                    sets.append(np.unique(hashes))
                keys = [band_keys(s) for s in sets]
                digest = pa.array([xxhash.xxh64_intdigest(s.tobytes(), 7) - 2**63 for s in sets], pa.int64())
                ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                bands = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                columns = [part.column(0), part.column(1), digest, pa.array(map(len, sets), pa.int64()), bands, pa.array(prints, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "digest", "n", "bands", "fp"])

    return run


def _verified(words: int, percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            near = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != key:
                    key, held = a, shingle_set(batch.column(2)[i].as_py(), words)
                other = shingle_set(batch.column(3)[i].as_py(), words)
                both = len(np.intersect1d(held, other, assume_unique=True))
                near.append(100 * both >= percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(j).filter(pa.array(near, pa.bool_())) for j in (0, 1)], names=["a", "b"])

    return run


def _searched(words: int, percent: int):
    """Links (a, b) that connect what is connected in one group: each set with the first of its component."""

    def run(rows: pa.Table) -> pa.Table:
        sets = [shingle_set(t.as_py(), words) for t in rows.column("text")]
        size = np.array([*map(len, sets)])
        ends = np.cumsum(np.r_[0, size])
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
        start = np.cumsum(count) - count
        pending, root = np.ones(len(sets), bool), np.arange(len(sets))
        for first in range(len(sets)):
            if not pending[first]:
                continue
            pending[first], reached = False, [first]
            while reached and pending.any():
                i = reached.pop()
                c = code[ends[i] : ends[i + 1]]
                n = count[c]
                both = np.bincount(owner[np.repeat(start[c] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
                near = np.flatnonzero(pending & (100 * both >= percent * (size + size[i] - both)))
                pending[near], root[near] = False, first
                reached += near.tolist()
        digest, moved = rows.column("digest").to_numpy(), np.flatnonzero(root != np.arange(len(sets)))
        out = pa.table({"a": digest[root[moved]], "b": digest[moved]})
        del sets, code, owner
        give_back()
        return out

    return run


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of df: doc_id, row_key, fingerprint (of the whole class), component_id.

    Classes are the components of the graph in which texts are linked whose sets of shingles have a Jaccard similarity of percent / 100 or
    more. component_id is the least id of the class; null ids are passed over. Texts without words are equal.
    """
    keyed = df.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(df).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    rows = cut(keyed.mapInArrow(_signed(words), "doc_id bigint, row_key bigint, digest bigint, n bigint, bands array<bigint>, fp bigint"))
    prints = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp"))
    prints = cut(prints)
    keys = prints.select("digest", "n", F.explode("bands").alias("key"))
    group = keys.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    members = cut(keys.join(group, "key"))

    def texts_of(digests: DataFrame) -> DataFrame:
        asked = digests.distinct().join(prints.select("digest", "row_key"), "digest")
        return cut(keyed.select("row_key", "text").join(asked, "row_key").dropDuplicates(["digest"]).select("digest", "text"))

    texts = texts_of(members.select("digest"))

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("digest").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
        return cut(both.mapInArrow(_verified(words, percent), "a bigint, b bigint"))

    def apart(some: DataFrame, roots: DataFrame | None) -> DataFrame:
        """The members with their roots, in groups that are not connected yet."""
        if roots is None:
            return some.withColumn("root", F.col("digest"))
        named = some.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        mixed = named.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key")
        return named.join(mixed, "key")

    # Sets of too different sizes can't be as similar.
    fits = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    pair = F.least("digest", "digest2").alias("a"), F.greatest("digest", "digest2").alias("b")
    second = F.col("digest").alias("digest2"), F.col("n").alias("n2"), F.col("root").alias("root2")
    blocks = F.ceil(F.col("shingles") / BLOCK_SHINGLES)
    large = members.where(F.col("size") > SMALL_GROUP).select("key", "digest", blocks.alias("blocks"), F.pmod(F.xxhash64("digest", F.lit(1)), blocks).alias("block"))
    # A block meets itself where it is the only one, else each other block.
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), F.col("block")))
    dealt = large.withColumn("other", F.explode(other)).select("key", "digest", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    near = cut(dealt.join(texts, "digest").groupBy("key", "one", "two").applyInArrow(_searched(words, percent), "a bigint, b bigint").distinct())
    left = cut(apart(members.where(F.col("size") <= SMALL_GROUP), None if near.isEmpty() else components(near)))
    last = verified(left.join(left.select("key", *second), "key").where(fits & (F.col("digest") < F.col("digest2")) & (F.col("root") != F.col("root2"))).select(*pair).distinct(), texts)
    found = cut(near.union(last))
    for done in (members, texts, near, left, last):
        cut_off(done)
    roots = components(found)
    # Fingerprints: each one's least set stands for it, and is linked with its other sets and with those of fingerprints within two bits.
    sets = cut(prints.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "n", "fp", F.coalesce("root", "digest").alias("root")))
    heads = cut(sets.groupBy("fp").agg(F.min(F.struct("digest", "n", "root")).alias("h")).select("fp", "h.*"))
    other = [F.col(c).alias(f"{c}2") for c in ("digest", "n", "root")]
    near_prints = links(heads.select("fp")).join(heads.withColumnRenamed("fp", "a"), "a").join(heads.select(F.col("fp").alias("b"), *other), "b")
    proposed = sets.join(heads.select("fp", *other), "fp").unionByName(near_prints, allowMissingColumns=True).where(fits & (F.col("root") != F.col("root2")))
    proposed = cut(proposed.select(*pair).distinct())
    cut_off(sets)
    cut_off(heads)
    if not proposed.isEmpty():
        texts = texts_of(proposed.select(F.explode(F.array("a", "b")).alias("digest")))
        more = verified(proposed, texts)
        cut_off(texts)
        roots = components(found.union(more))
    named = prints.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "least", F.coalesce("root", "digest").alias("root"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "root").select("digest", F.col("root").alias("fingerprint"), "component_id")
    return rows.select("doc_id", "row_key", "digest").join(named, "digest").select("doc_id", "row_key", "fingerprint", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df with one row of each class, as simhash.keep_one chooses it."""
    return kept(df, classes(df, id_col, text_col, words, percent), id_col)
