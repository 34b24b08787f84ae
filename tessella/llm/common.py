"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from ..operators.cutting import cut, cut_off  # noqa: F401  the operators of this folder take them from here

#: The white space that separates words: space and U+0009 to U+000D, as a regular expression class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader opens it, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, made of the given ones by underscores; columns of df may be called anything."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _hashable(field: StructField) -> Column:
    held = [field.dataType]
    while held:
        t = held.pop()
        if isinstance(t, MapType):
            # Maps have no hash.
            return F.to_json(F.struct(F.col(f"`{field.name}`").alias("x")))
        held += [f.dataType for f in t.fields] if isinstance(t, StructType) else [t.elementType] if isinstance(t, ArrayType) else []
    return F.col(f"`{field.name}`")


def row_key(df: DataFrame) -> Column:
    """A hash of all columns of a row, of any type: rows that are equal in all columns have one key."""
    return F.xxhash64(*map(_hashable, df.schema.fields))


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text leaves this remainder. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus == remainder, F.lit(False))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, but when a task is done the memory that it freed goes back to the system: workers stay for the tasks of later stages, and would hold it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | StructType, text_col: str | None = None) -> DataFrame:
    """Apply work to each Arrow batch of df, or to parts of it of about four megabytes of text_col. A batch holds at most what spark.sql.execution.arrow allows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in [batch] if text_col is None else in_parts(batch, batch.schema.get_field_index(text_col), 8192, 1 << 22):
                out = work(part)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
            give_back()

    return df.mapInArrow(run, schema)


def in_parts(batch: pa.RecordBatch, text_column: int, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most so many rows, and of at most so many bytes of text unless one text alone is larger."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(max(int(np.searchsorted(ends, before + size, "right")), at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for the row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def bounded_rows(labelled: DataFrame, docs: DataFrame | None, id_col: str, label_col: str, text_col: str, most: int) -> DataFrame:
    """At most `most` rows (h, text, label) to learn from, or one of each label if there are more labels: of each label the rows whose ids have the least hash, in equal parts.

    labelled has id_col and label_col. Where the texts stand in the same rows, docs is None and text_col is a column of labelled, so that each
    text keeps the label of its own row; else texts are looked up in docs by id. Ids are chosen in one pass that reads no text, for any number
    of labels. Rows without an id or a label are passed over.
    """
    slim = labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(label_col).alias("label"))
    # Each task keeps the least hashes of each label before anything is shuffled.
    place = Window.partitionBy("label").orderBy("h")
    first = cut(slim.distinct().withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select("label", "h", "place"))
    labels = max(first.select("label").distinct().count(), 1)
    part = max(most // labels, 1)
    if docs is None:
        # A label's rows up to its last hash: one row is joined for each label.
        last = first.where(F.col("place") <= part).groupBy(F.col("label").alias("_label")).agg(F.max("h").alias("_last"))
        rows = labelled.select(F.xxhash64(id_col).alias("h"), F.col(label_col).alias("label"), F.col(text_col).cast("string").alias("text"), F.col(id_col).isNotNull().alias("_known"))
        rows = rows.join(F.broadcast(last), (F.col("label") == F.col("_label")) & (F.col("h") <= F.col("_last")) & F.col("_known"))
    else:
        chosen = first.where(F.col("place") <= part).select("h", "label")
        rows = docs.where(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "h")
    # An id may stand in many rows.
    return rows.select("h", "text", "label").orderBy("h", "label", "text").limit(part * labels)
