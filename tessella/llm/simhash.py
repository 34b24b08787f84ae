"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves, fewer than the three that exact matching of segments would need. Of
two fingerprints that differ in at most two bits, one half is equal, or each half differs in one bit. So
each distinct fingerprint is indexed under its two whole halves and under the 32 variants of its high half with
one bit replaced by a wildcard; fingerprints that share a key are compared.

Fingerprints, not rows, are indexed, so copies cost nothing. A key that few fingerprints share is compared pair by
pair; for a key that many share, each fingerprint looks up the few fingerprints that can be linked to it there,
which takes time in proportion to the group. A key shared by more fingerprints than one task should hold is split again by
the quarters of the other half, after which at most 2^17 fingerprints can share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.graph import roots as components
from .common import cut, row_key, tidy, unused

#: Bits in which linked fingerprints may differ.
DISTANCE = 2
#: Groups up to this size are compared pair by pair.
SMALL_GROUP = 48
#: Fingerprints of one key that a task holds at most.
LARGE_GROUP = 1 << 18


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of the runs of so many words of a text, in order, repeats included; of a shorter text that of the whole, and none if it has no word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) > words else [b" ".join(parts)]
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in runs), np.uint64)


def voted(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text, as a signed 64-bit number; 0 if it has no word."""
    return voted(shingles(text, words))


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", words: int = 3) -> DataFrame:
    """The columns of df but for its text, with the fingerprint (long) appended as out_col; a column of that name is replaced. A null text counts as empty."""
    df = df.drop(out_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            prints = pa.array([fingerprint(t.as_py(), words) for t in batch.column(at)], pa.int64())
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), prints], names=[*(batch.schema.names[i] for i in kept), out_col])

    schema = StructType([*df.drop(text_col).schema.fields, StructField(out_col, LongType())])
    return df.mapInArrow(run, schema)


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def signatures(prints: DataFrame) -> DataFrame:
    """(key, sub, fp) for each distinct fingerprint: kind 0 is the whole high half, 1 the whole low half, 2 + i the high half with a wildcard for bit i. The kind stands in the key's bits from 32 up."""
    high, low = _halves(F.col("fp"))
    kind = F.col("kind")
    wild = high.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), kind - 2)))
    value = F.when(kind == 0, high).when(kind == 1, low).otherwise(wild)
    key = F.shiftleft(kind.cast("bigint"), 32).bitwiseOR(value)
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(33))).alias("kind")).select(key.alias("key"), F.lit(0).cast("bigint").alias("sub"), "fp")


def finer(crowded: DataFrame) -> DataFrame:
    """Signatures of a second level, for keys that too many share: by the quarters of the half that is not in the key.

    Under a whole half, the other half differs in up to two bits, so one quarter differs in at most one: whole quarters and the
    one-wildcard variants of the first quarter. Under a wildcard, the other half differs in one bit, so one quarter is whole.
    """
    kind = F.shiftright("key", 32)
    high, low = _halves(F.col("fp"))
    other = F.when(kind == 1, high).otherwise(low)
    first, second = F.shiftright(other, 16), other.bitwiseAND(F.lit(0xFFFF))
    sort = F.col("sort")
    wild = first.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), sort - 2)))
    value = F.when(sort == 0, first).when(sort == 1, second).otherwise(wild)
    sorts = F.when(kind < 2, F.sequence(F.lit(0), F.lit(17))).otherwise(F.sequence(F.lit(0), F.lit(1)))
    return crowded.select("key", "fp", F.explode(sorts).alias("sort")).select("key", F.shiftleft((sort + 1).cast("bigint"), 16).bitwiseOR(value).alias("sub"), "fp")


_TWO_BITS = [np.uint64(1 << i | 1 << j) for i in range(32) for j in range(i, 32)]


def _looked_up(kind: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a large group, by looking up for each fingerprint the ones within reach."""
    if kind >= 2:
        masks = [np.uint64(1 << (30 + kind) | 1 << j) for j in range(32)]
    else:
        masks = [m << np.uint64(32) if kind == 1 else m for m in _TWO_BITS]
    fps = np.sort(fps)
    left, right = [], []
    for m in masks:
        there = fps ^ m
        at = np.minimum(np.searchsorted(fps, there), len(fps) - 1)
        hit = (fps[at] == there) & (fps < there)
        left.append(fps[hit])
        right.append(there[hit])
    return np.concatenate(left), np.concatenate(right)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the links (a, b): each node to the least one it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, root, new)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _compared(small: int, large: int):
    """The work on sorted signatures: yields links (a, b, crowded = null), and the rows of crowded groups as (fp, sub = null, key)."""

    def groups(keys, subs, fps):
        """Links within whole groups, and the keys and fingerprints of crowded groups."""
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1])]) if len(keys) else np.zeros(0, int)
        sizes = np.diff(np.r_[new, len(keys)])
        size = np.repeat(sizes, sizes)
        group = np.repeat(np.arange(len(new)), sizes)
        kind = keys >> 32
        a, b = [], []
        on = np.flatnonzero((size > 1) & (size <= small))
        for lag in range(1, small):
            x = on[: len(on) - lag]
            y = on[lag:]
            near = group[x] == group[y]
            if not near.any():
                break
            x, y = x[near], y[near]
            linked = np.bitwise_count(fps[x] ^ fps[y]) <= DISTANCE
            a.append(fps[x[linked]])
            b.append(fps[y[linked]])
        for g in np.flatnonzero((sizes > small) & (sizes <= large)):
            x, y = _looked_up(int(kind[new[g]]), fps[new[g] : new[g] + sizes[g]])
            a.append(x)
            b.append(y)
        over = size > max(small, large)
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *a]), np.concatenate([none, *b]), (keys[over], fps[over])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, key=None):
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key if key is not None else np.zeros(len(a), np.int64), mask=np.full(len(a), key is None))], names=["a", "b", "crowded"])

        def results(a, b, over):
            if len(a):
                yield out(*_stars(a, b))
            if len(over[0]):
                yield out(over[1], over[1], over[0])

        held, crowded = [], None  # the rows of the last group so far; the key of a group that goes on as crowded
        for batch in batches:
            now = [batch.column(i).to_numpy().view(t) for i, t in enumerate((np.int64, np.int64, np.uint64))]
            if crowded is not None:
                n = int(np.searchsorted((now[0] != crowded[0]) | (now[1] != crowded[1]), True)) if len(now[0]) else 0
                if n:
                    yield out(now[2][:n], now[2][:n], now[0][:n])
                now = [x[n:] for x in now]
                if not len(now[0]):
                    continue
                crowded = None
            rows = [np.concatenate(x) for x in zip(held, now)] if held else now
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1])) if (rows[1] == 0).all() else int(np.flatnonzero(np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])[-1])
            yield from results(*groups(*(x[:last] for x in rows)))
            held = [x[last:] for x in rows]
            if len(held[0]) > max(small, large):
                crowded = int(held[0][0]), int(held[1][0])
                yield out(held[2], held[2], held[0])
                held = []
        if held:
            yield from results(*groups(*held))

    return run


def links(prints: DataFrame, small: int = SMALL_GROUP, large: int = LARGE_GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to give every component of the graph in which fingerprints that differ in at most two bits are linked."""

    def found(keys: DataFrame, most: int) -> DataFrame:
        dealt = keys.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
        return cut(dealt.mapInArrow(_compared(small, most), "a bigint, b bigint, crowded bigint"))

    first = found(signatures(prints), large)
    out = first.where("crowded is null").select("a", "b")
    crowded = first.where("crowded is not null").select(F.col("crowded").alias("key"), F.col("a").alias("fp"))
    if not crowded.isEmpty():
        out = out.union(found(finer(crowded), LARGE_GROUP).select("a", "b"))
    return out


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row for each row of df: doc_id, row_key, fingerprint (long), component_id.

    component_id is the least id in the row's component (null ids are passed over; null if all are). row_key tells rows of
    the same id but other contents apart. A null text counts as empty; texts without words have fingerprint 0 and are
    linked like any other.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(df).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    rows = cut(with_fingerprint(rows, "text", words=words))
    prints = cut(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")))
    roots = components(links(prints.select("fp")))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "row_key", "fingerprint", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of df with one row of each class of near-duplicates, all columns kept: that of the least id, and of its rows the one of least key.

    Rows without an id are kept only in classes that have no other. Of rows equal in all columns one stays.
    """
    return kept(df, classes(df, id_col, text_col, words), id_col)


def kept(df: DataFrame, of_rows: DataFrame, id_col: str) -> DataFrame:
    """The rows that keep_one keeps of df, whose classes are of_rows."""
    # Classes are told apart by their least fingerprint as well, as a class without ids has no component_id.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fingerprint").cast("string")))
    none = F.lit(-(2**63))
    of_id, key = unused(df, "_id", "_key")
    best = of_rows.groupBy(group.alias("group")).agg(F.min(rank).alias("best")).select(F.coalesce("best.doc_id", none).alias(of_id), F.col("best.row_key").alias(key)).distinct()
    keyed = df.select("*", F.coalesce(F.col(id_col).cast("bigint"), none).alias(of_id), row_key(df).alias(key))
    return keyed.join(best, [of_id, key], "left_semi").dropDuplicates([of_id, key]).select(*(F.col(f"`{c}`") for c in df.columns))
