"""Operators over ordered rows of an entity: runs, transitions, last known values, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(keys: list[str], order: list[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def runs(df: DataFrame, keys: list[str], order: list[str | Column], value: str, out: str = "run") -> DataFrame:
    """df with the number (from 0) of each row's run: a new run begins where value differs from the row before."""
    w = _window(keys, order)
    changed = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")
    return df.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).otherwise(changed)).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def run_means(df: DataFrame, keys: list[str], order: list[str | Column], value: str, vector: str) -> DataFrame:
    """For each run of value the mean of each part of an array column, and how many rows the run has."""
    n = 4
    sums = [(F.sum(F.get(vector, i)) / F.count("*")).alias(f"m{i}") for i in range(n)]
    return runs(df, keys, order, value).groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("steps"), *sums)


def transitions(df: DataFrame, keys: list[str], order: list[str | Column], value: str) -> DataFrame:
    """How often value changes from one row to the next, for each entity."""
    before = F.lag(value).over(_window(keys, order))
    return df.withColumn("_changed", F.coalesce((before != F.col(value)).cast("int"), F.lit(0))).groupBy(*keys).agg(F.sum("_changed").cast("bigint").alias("transitions"))


def distinct_path(df: DataFrame, keys: list[str], order: list[str | Column], value: str, out: str = "path") -> DataFrame:
    """The values of each entity in order, without immediate repeats."""
    numbered = runs(df, keys, order, value)
    firsts = numbered.groupBy(*keys, "run").agg(F.first(value).alias(value))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("run", value))), lambda x: x[value]).alias(out))


def nth(df: DataFrame, keys: list[str], order: list[str], index: Column) -> DataFrame:
    """The row of each entity at a place (from 0) that may depend on its number of rows (`_n`); `move` is its number from 1."""
    w = _window(keys, order)
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).withColumn("move", F.row_number().over(w).cast("bigint"))
    return counted.where(F.col("move") - 1 == index).drop("_n")


def last_known(grid: DataFrame, keys: list[str], order: list[str], value: str, anchor: Column, out: str) -> DataFrame:
    """grid with the last value of each entity up to each row that is not null; anchor before there is any."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), anchor))


def carried(grid: DataFrame, keys: list[str], order: list[str], start: str, end: str, anchor: Column, out: str) -> DataFrame:
    """grid with an entity's position at the beginning of each slot: this slot's own start, else the last end before, else anchor."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return grid.withColumn(out, F.coalesce(start, F.last(end, ignorenulls=True).over(w), anchor))


def dealt(values: DataFrame, value_order: list[str], takers: DataFrame, taker_order: list[str], value: str, keys: list[str]) -> DataFrame:
    """takers, each with one of the values of its group (keys): the first in order gets the first in order. Values or takers without a counterpart are dropped."""
    a = values.withColumn("_i", F.row_number().over(_window(keys, value_order))).select(*keys, "_i", value)
    b = takers.withColumn("_i", F.row_number().over(_window(keys, taker_order)))
    return b.join(a, [*keys, "_i"]).drop("_i")


def contiguous(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Of each group, whether its indices are 0, 1, 2, ... without gap or repeat."""
    return df.groupBy(*keys).agg(((F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.countDistinct(index) == F.count("*"))).alias("contiguous"))


def peers(df: DataFrame, slot: list[str], member: str, out: str = "peers") -> DataFrame:
    """df with the other members of each row's slot, sorted, each once. Members of a slot are gathered once for each slot."""
    sets = df.groupBy(*slot).agg(F.array_sort(F.collect_set(member)).alias("_all"))
    return df.join(sets, slot).withColumn(out, F.array_remove("_all", F.col(member))).drop("_all")


def slot_grid(entities: DataFrame, slots: DataFrame, events: DataFrame, on: list[str]) -> DataFrame:
    """Every entity in every slot, with its event where there is one. slots must be few: it is broadcast."""
    return entities.crossJoin(F.broadcast(slots)).join(events, on, "left")


def downsampled(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most about `most` rows of each entity at an even stride, its last one always among them."""
    w = _window(keys, order)
    marked = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    stride = F.ceil(F.col("_n") / most)
    return marked.where((F.col("_i") % stride == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")
