"""Train, validation and test splits by position, their filter and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares in hundredths; what is left goes to the test part.
TRAIN, VAL = 70, 15


def split_of(position: Column, n: Column) -> Column:
    """The part of the row at a position (from 0) among n."""
    train = F.floor(n * TRAIN / 100)
    return F.when(position < train, "train").when(position < train + F.floor(n * VAL / 100), "val").otherwise("test")


def split_by_position(df: DataFrame, order: str, out: str = "split", ranges: int | None = None) -> DataFrame:
    """df with each row's part, by its place in the order; ties in order are broken by the whole row.

    The place is counted in two steps, by ranges of the order and within each, so no task sorts all rows. There are as many ranges as the session
    has shuffle partitions, unless their number is given.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in df.columns if c != order]
    dealt = df.repartitionByRange(ranges, F.col(order), *columns).withColumn("_part", F.spark_partition_id())
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.withColumn("_n", F.sum("_size").over(Window.partitionBy(F.lit(0))))
    # One row for each range.
    placed = dealt.join(F.broadcast(sizes), "_part").withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order, *columns)) - 1)
    return placed.withColumn(out, split_of(F.col("_at"), F.col("_n"))).drop("_part", "_size", "_before", "_n", "_at")


def counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.agg(*(F.count_if(F.col(split) == s).alias(s) for s in ("train", "val", "test")), F.count("*").alias("total"))


def selected(df: DataFrame, choice: str, split: str = "split") -> DataFrame:
    """The rows of a part; `all`, in any case, is no filter."""
    choice = choice.lower()
    if choice not in ("all", "train", "val", "test"):
        raise ValueError(f"unknown split {choice!r}")
    return df if choice == "all" else df.where(F.col(split) == choice)


def exported(assigned: DataFrame, artifacts: list[DataFrame], key: str, choice: str) -> DataFrame:
    """The assigned rows of a part that have an artifact of every kind, by key."""
    out = selected(assigned, choice)
    for a in artifacts:
        out = out.join(a.select(key).distinct(), key, "left_semi")
    return out
