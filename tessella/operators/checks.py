"""Checks that give their violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected_tasks(df: DataFrame, task: str, selector: str, strict: bool = False) -> DataFrame:
    """Rows of all tasks, of one, or of those whose name begins with selector. Strict: no row is an error."""
    out = df if selector == "all" else df.where((F.col(task) == selector) | F.col(task).startswith(selector))
    if strict and out.isEmpty():
        raise LookupError(f"no task is selected by {selector!r}")
    return out


def set_difference(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that are missing from the observed, and keys that are there unasked."""
    a, b = expected.select(key).distinct(), observed.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def parity(expected: DataFrame, observed: DataFrame, key: str, columns: list[str], tolerance: float | None = None) -> DataFrame:
    """(key, fault): keys on one side only, and keys whose columns differ (numbers by more than tolerance, if that is given)."""
    a = expected.select(key, *(F.col(c).alias(f"_a_{c}") for c in columns), F.lit(True).alias("_in_a"))
    b = observed.select(key, *(F.col(c).alias(f"_b_{c}") for c in columns), F.lit(True).alias("_in_b"))

    def differ(c: str) -> Column:
        if tolerance is None:
            return ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
        return ~F.coalesce(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) <= tolerance, F.col(f"_a_{c}").isNull() & F.col(f"_b_{c}").isNull())

    wrong = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "unexpected")
    for c in columns:
        wrong = wrong.when(differ(c), F.lit(f"{c} differs"))
    return a.join(b, key, "full_outer").withColumn("fault", wrong).where("fault is not null").select(key, "fault")


def vector_faults(df: DataFrame, group: str, vector: str) -> DataFrame:
    """For each group: rows, distinct widths, and rows with a component that is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.groupBy(group).agg(F.count("*").alias("vectors"), F.countDistinct(F.size(vector)).alias("widths"), F.count_if(bad).alias("not_finite"))


def permutation(values: Column, n: int) -> Column:
    """Whether an array is a permutation of 1 to n."""
    return F.coalesce(F.array_sort(values) == F.array(*(F.lit(i) for i in range(1, n + 1))), F.lit(False))


def graph_verdict(stats: DataFrame, k: int, lambda2_min: float) -> DataFrame:
    """stats (components, max_degree, lambda2) with the first guard that fails, in order, or null."""
    return stats.withColumn("fault", F.when(F.col("components") != 1, "not connected").when(F.col("max_degree") > 5 * k, "hub").when(~(F.abs("lambda2") < float("inf")) | F.isnan("lambda2") | (F.col("lambda2") < lambda2_min), "lambda2"))


def target_report(targets: DataFrame, task: str = "task_id", segment: str = "segment_index", values: str = "values") -> DataFrame:
    """One row: the number of different tasks, of segments, and of values."""
    return targets.agg(F.countDistinct(task).alias("target_count"), F.count("*").alias("total_segments"), F.coalesce(F.sum(F.size(values)), F.lit(0)).cast("bigint").alias("total_values"))


def target_faults(targets: DataFrame, expected: DataFrame, keys: list[str], task: str = "task_id", segment: str = "segment_index", values: str = "values") -> DataFrame:
    """(keys, task, fault): targets that are missing or unasked for (expected has keys and task), whose segments are not numbered from 0 on, are
    empty, differ in width, hold a number that is not finite, or, for passages of quadrants, leave 0 to 1 or do not sum to 1.
    """
    v = F.col(values)
    passage = F.col(task).startswith("oqp")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    total = F.aggregate(v, F.lit(0.0), lambda t, x: t + x)
    of_task = targets.groupBy(*keys, task).agg(
        F.count("*").alias("n"), F.min(segment).alias("low"), F.max(segment).alias("high"), F.countDistinct(segment).alias("numbers"), F.min(F.size(values)).alias("least"), F.max(F.size(values)).alias("most"),
        F.bool_and(finite).alias("finite"), F.bool_and(~passage | F.forall(v, lambda x: (x >= 0) & (x <= 1))).alias("in_range"), F.bool_and(~passage | (F.abs(total - 1.0) <= 1e-9)).alias("sums"), F.lit(True).alias("there"),
    )
    both = expected.select(*keys, task).distinct().withColumn("asked", F.lit(True)).join(of_task, [*keys, task], "full")
    rules = F.array(
        F.when(F.col("there").isNull(), "missing"), F.when(F.col("asked").isNull(), "unexpected"), F.when((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("numbers") != F.col("n")), "segments"),
        F.when(F.col("least") < 1, "empty"), F.when(F.col("least") != F.col("most"), "width"), F.when(~F.col("finite"), "not finite"), F.when(F.col("finite") & ~F.col("in_range"), "range"), F.when(F.col("finite") & ~F.col("sums"), "sum"),
    )
    return both.select(*keys, task, F.explode(F.array_compact(rules)).alias("fault"))


#: What a landscape must reach: different dominant quadrants on average, and the share of paths that come near a corner.
LEAST_QUADRANTS, LEAST_CORNERS = 2.0, 0.05


def landscape_verdict(quadrants: DataFrame, corners: DataFrame) -> DataFrame:
    """One row: the two figures of a landscape (one row and one column each) and what they fail, quadrants first; null if nothing."""
    both = quadrants.toDF("mean_quadrants").join(corners.toDF("corner_rate"), F.lit(True))
    fault = F.when(F.col("mean_quadrants") < LEAST_QUADRANTS, "quadrants").when(F.col("corner_rate") < LEAST_CORNERS, "corners")
    return both.withColumn("fault", fault)


def expected_samples(events: DataFrame, slots: int, rate: int, fps: int, keys: list[str], slot: str = "time_slot", duration: str = "duration_frames", order: str = "list_pos") -> DataFrame:
    """(keys, expected, fault): samples of one channel of each scene. A slot lasts as long as its events say; an empty one as long as the first event by slot, then list.

    fault: events of one slot that differ, an event without length, or one beyond the slots.
    """
    e = events.groupBy(*keys, slot).agg(F.min(duration).alias("low"), F.max(duration).alias("high"), F.min_by(duration, order).alias("first"))
    of_slot = lambda frames: F.floor((frames.cast("bigint") * rate + (fps - 1)) / fps)
    whole = e.groupBy(*keys).agg(
        F.sum(of_slot(F.col("low"))).alias("told"), F.count("*").alias("slots"), F.min_by("first", slot).alias("default"),
        F.max(F.when(F.col("low") != F.col("high"), "durations").when(F.col("low") < 1, "length").when((F.col(slot) < 0) | (F.col(slot) >= slots), "slot")).alias("fault"),
    )
    return whole.select(*keys, (F.col("told") + (F.lit(slots) - F.col("slots")) * of_slot(F.col("default"))).cast("bigint").alias("expected"), "fault")
